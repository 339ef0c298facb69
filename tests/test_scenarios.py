"""Scenarios on hand-worked inputs."""

import datetime as dt

import pytest

from panelcast.operators import scenario

DAY = dt.date(2024, 1, 1)


def day(k):
    return DAY + dt.timedelta(days=k)


@pytest.fixture(scope="module")
def tables(spark):
    aligned = [("t", "a", 1, day(1), 1.5), ("t", "a", 2, day(2), 2.0), ("t", "b", 1, day(1), 6.0), ("t", "b", 2, day(2), 7.0), ("t", "c", 1, day(1), 4.0), ("t", "c", 2, day(2), 4.0), ("t", "old", 1, day(1), None), ("t", "old", 2, day(2), None)]
    last = [("t", "a", 2.0, day(2)), ("t", "b", 7.0, day(2)), ("t", "c", 4.0, day(1)), ("t", "old", 9.0, day(-9)), ("u", "a", 1.0, day(1))]
    kinds = [("a", "LEVEL"), ("b", "LEVEL"), ("c", "DIFFERENCE"), ("old", "LEVEL")]
    obs = [("a", 1.0), ("a", 2.0), ("b", 6.0), ("b", 7.0), ("c", -4.0), ("c", 4.0), ("old", 9.0), ("old", 8.0)]
    return (
        spark.createDataFrame(aligned, "target_id string, series_id string, rn int, date date, x double"), spark.createDataFrame(last, "target_id string, series_id string, value double, date date"),
        spark.createDataFrame(kinds, "series_id string, transform string"), spark.createDataFrame(obs, "series_id string, value double"),
    )


def test_a_shock_of_one_series_leaves_the_others_in_the_forecast(spark, tables):
    aligned, last, kinds, _ = tables
    base = scenario.base_inputs(aligned, last, kinds)
    levels = spark.createDataFrame([(1, "t", "a", 3.0), (2, "t", "c", 9.0), (3, "t", "old", 5.0)], "scenario_id int, target_id string, series_id string, level double")
    shocked = scenario.shocked_inputs(base, levels)
    # c was last seen a day earlier, so both of its days read the shocked value; old is too old to be read
    assert {(r["scenario_id"], r["series_id"], r["base"], r["shocked"]) for r in shocked.collect()} == {(1, "a", 2.0, 3.0), (2, "c", 0.0, 0.0), (3, "old", None, None)}
    scenarios = levels.select("scenario_id", "target_id")
    inputs = spark.createDataFrame([("m", "t", n, None, None, None, None) for n in ("a", "b")] + [("clip", "t", "a", 0.0, 2.5, 1.0, 0.5), ("lost", "t", "old", None, None, None, None)], "model_id string, target_id string, name string, lo double, hi double, mean double, sd double")
    terms = spark.createDataFrame([("m", 0, 0.1, {}), ("m", 1, 1.0, {"a": 1}), ("m", 2, 10.0, {"b": 1}), ("clip", 1, 2.0, {"a": 2}), ("lost", 1, 1.0, {"old": 1})], "model_id string, term_id int, coef double, factors map<string, int>")
    got = {(r["scenario_id"], r["model_id"]): (r["base"], r["shocked"], r["change"]) for r in scenario.run_scenarios(base, shocked, scenarios, inputs, terms).collect()}
    assert got[1, "m"] == pytest.approx((72.1, 73.1, 1.0)) and got[2, "m"] == pytest.approx((72.1, 72.1, 0.0))
    assert got[1, "clip"] == pytest.approx((8.0, 18.0, 10.0)) and got[3, "lost"] == (None, None, None) and len(got) == 9
    ranges = spark.createDataFrame([("t", "a", 0.5, 2.9), ("t", "b", 0.0, 9.0)], "target_id string, series_id string, lo double, hi double")
    changes = {(r["scenario_id"], r["model_id"], r["series_id"], r["base"], r["shocked"], r["extrapolated"], r["clipped_to"]) for r in scenario.input_changes(shocked, inputs, ranges).collect()}
    assert changes == {(1, "m", "a", 2.0, 3.0, True, None), (1, "clip", "a", 2.0, 3.0, True, 2.5)}


def test_shocks_are_levels_or_changes_of_each_targets_own_last_value(spark, tables):
    _, last, kinds, obs = tables
    rows = [(1, "t", "a", "1,0", "absolute"), (1, "u", "a", "50", "percent"), (2, "t", "a", "0", "absolute"), (2, "t", "c", "-5", "absolute"), (3, "t", "b", "nan", "percent"), (4, "u", "b", "1", "absolute"), (5, "t", "b", "18", "absolute"), (6, "t", "b", "5%", "percent")]
    got = scenario.validate_shocks(spark.createDataFrame(rows, "scenario_id int, target_id string, series_id string, amount string, kind string"), obs, last, kinds)
    by = {(r["scenario_id"], r["target_id"], r["series_id"]): (r["level"], r["error"]) for r in got.collect()}
    assert by == {
        (1, "t", "a"): (10.0, None), (1, "u", "a"): (1.5, None), (2, "t", "a"): (None, "must stay above 0"), (2, "t", "c"): (-5.0, None), (3, "t", "b"): (None, "not a number"),
        (4, "u", "b"): (None, "no observed value"), (5, "t", "b"): (None, "beyond ten times the observed range"), (6, "t", "b"): (None, "not a number"),
    }
    assert {(r["scenario_id"], r["target_id"]) for r in scenario.runnable(got).collect()} == {(1, "t"), (1, "u")}
