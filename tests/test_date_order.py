"""The order of day and month in a file's dates."""

import panelcast.catalog as catalog
from panelcast.sources import exports


def test_readings_are_made_of_cells_only(spark):
    """A filter on a reading would be pushed below the aggregation that makes the cells, and parse a date for each of its rows."""
    plan = catalog.queries()["A2_settle_date_order"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    assert any("RLIKE" in x for x in lines) and not any("RLIKE" in x for x in lines if "Filter" in x)


def test_steps_pass_over_repeated_days_and_gaps(spark):
    files = {
        "weeks": (["01/02/2024", "1/2/2024", "08/02/2024"], [("period", "D")]),
        "days": (["01/02/2024", "1/2/2024", "1/02/2024", "2/2/2024", "3/2/2024"], [("period", "M")]),
        "bounds": (["01/02/2024", "02/02/2024"], [("start date", "2024-02-01"), ("end date", "2024-02-02")]),
        "unread": (["01/02/2024", "soon"], []),
    }
    cells = spark.createDataFrame([(f, t) for f, (texts, _) in files.items() for t in texts], "file string, date_text string")
    meta = spark.createDataFrame([(f, k, v) for f, (_, known) in files.items() for k, v in [*known, ("other", "x")]], "file string, key string, value string")
    got = {r["file"]: (r["reading"], r["reason"]) for r in exports.settle_date_order(cells, meta).collect()}
    assert got == {"weeks": ("day_first", None), "days": ("month_first", None), "bounds": ("day_first", None), "unread": (None, "unreadable dates")}
