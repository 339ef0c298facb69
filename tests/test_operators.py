"""Hand-worked cases and plain twins."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.operators import models, panel, portfolio, quality, resample, risk, runlog, scoring
from panelcast.sources import exports


def days(n, start=dt.date(2020, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_asof_goes_stale_after_three_calendar_rows(spark):
    cal = spark.createDataFrame([("t", d, float(i)) for i, d in enumerate(days(8))], "target_id string, date date, price double")
    obs = spark.createDataFrame([("s", days(8)[1], 5.0)], "series_id string, date date, value double")
    pairs = spark.createDataFrame([("t", "s")], "target_id string, series_id string")
    rows = panel.asof_align(obs, panel.target_calendar(cal), pairs).orderBy("rn").collect()
    assert [r["x"] for r in rows] == [None, 5.0, 5.0, 5.0, 5.0, None, None, None]
    assert [r["age"] for r in rows][1:6] == [0, 1, 2, 3, 4]


def test_no_training_label_reaches_its_test_window(spark):
    cal = panel.target_calendar(spark.createDataFrame([("t", d, 1.0 + i) for i, d in enumerate(days(200))], "target_id string, date date, price double"))
    labels = panel.forward_return(cal, 5)
    folds = panel.purge(panel.walk_forward_folds(cal, 60, 20, 3), labels, 5)
    late = folds.join(labels, "target_id").filter("rn BETWEEN train_lo AND train_hi").join(labels.select("target_id", F.col("rn").alias("test_lo"), F.col("date").alias("opens")), ["target_id", "test_lo"])
    assert folds.count() > 0 and late.filter("label_end >= opens").count() == 0


@pytest.mark.parametrize("lags", [0, 3])
def test_hac_against_matrix_form(spark, lags):
    rng = np.random.default_rng(1)
    x = rng.normal(size=120)
    y = 0.3 * x + rng.normal(size=120)
    rows = spark.createDataFrame(pd.DataFrame({"k": "a", "d": np.arange(120), "x": x, "y": y}))
    got = scoring.ols_hac(rows, ["k"], "x", "y", "d", lags).first()
    m = np.column_stack([np.ones(120), x])
    inv = np.linalg.inv(m.T @ m)
    b = inv @ m.T @ y
    s = m * (y - m @ b)[:, None]
    for kernel in ("bartlett", "uniform"):
        c = s.T @ s
        for k in range(1, lags + 1):
            g = s[k:].T @ s[:-k]
            c = c + (1 - k / (lags + 1) if kernel == "bartlett" else 1) * (g + g.T)
        v = (inv @ c @ inv)[1, 1]
        assert got[f"se_{kernel}"] == pytest.approx(np.sqrt(v)) if v > 0 else got[f"se_{kernel}"] is None
    assert got["slope"] == pytest.approx(b[1])


def test_portfolio_path_against_daily_loop(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.01, (60, 2))
    due = {0: (0.6, 0.4), 20: (0.3, 0.7), 41: (0.5, 0.5)}
    names = ("equity", "bond")
    returns = spark.createDataFrame([("p", names[a], days(60)[i], float(r[i, a])) for i in range(60) for a in (0, 1)], "portfolio_id string, asset string, date date, r double")
    weights = spark.createDataFrame([("p", days(60)[i], names[a], w[a]) for i, w in due.items() for a in (0, 1)], "portfolio_id string, date date, asset string, weight double")
    costs = spark.createDataFrame([("equity", 3.0), ("bond", 5.0)], "asset string, bps double")
    got = portfolio.portfolio_path(returns, weights, costs).orderBy("date").collect()
    held, opening, expected = np.array(due[0]), None, []
    opening = held @ np.array([3, 5]) / 1e4
    for i in range(1, 60):
        grown = held * (1 + r[i])
        gross, held = grown.sum() - 1, grown / grown.sum()
        cost = 0.0
        if i in due:
            cost = np.abs(np.array(due[i]) - held) @ np.array([3, 5]) / 1e4
            held = np.array(due[i])
        expected.append((gross, (1 + gross) * (1 - cost) * (1 - (opening if i == 1 else 0)) - 1))
    assert got[0]["gross"] is None and got[0]["turnover"] == pytest.approx(1)
    assert [(g["gross"], g["net"]) for g in got[1:]] == [pytest.approx(e, abs=1e-12) for e in expected]


def test_constant_returns_have_no_sharpe(spark):
    rows = spark.createDataFrame([("a", d, 0.001) for d in days(10)], "k string, date date, r double")
    got = portfolio.performance(rows, ["k"]).first()
    assert got["annual_volatility"] == 0 and got["sharpe"] is None and got["calmar"] is None


def test_var_is_an_order_statistic(spark):
    rows = spark.createDataFrame([("a", d, (i - 50) / 100) for i, d in enumerate(days(100))], "k string, date date, r double")
    got = risk.historical_var(rows, ["k"], 0.95).first()
    assert got["var"] == pytest.approx(0.46) and got["cvar"] == pytest.approx(0.48) and got["k"] == 5


def test_lasso_without_penalty_is_least_squares():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    y = x @ [1, 0, -2] + 0.5 + rng.normal(size=200) * 0.1
    v = np.column_stack([np.ones(200), x, y])
    got = models.lasso(v.T @ v, np.array([0.0]))[0]
    assert got == pytest.approx(np.linalg.lstsq(v[:, :-1], y, rcond=None)[0], abs=1e-6)
    assert models.lasso(v.T @ v, np.array([10.0]))[0][1:] == pytest.approx([0, 0, 0])


def test_rebounds_follow_the_sequential_rule(spark):
    rng = np.random.default_rng(4)
    rn = np.cumsum(rng.integers(1, 3, 80))
    change = rng.choice([-1.0, 1.0], 80)
    flags = spark.createDataFrame([("s", int(a), float(b)) for a, b in zip(rn, change)], "series_id string, rn int, change double")
    kept, out = None, []
    for a, b in zip(rn, change):
        if kept is not None and a == kept[0] + 1 and b * kept[1] < 0:
            kept = None
        else:
            out.append(int(a))
            kept = (a, b)
    assert sorted(r["rn"] for r in quality.drop_rebounds(flags).collect()) == out


def test_rank_correlation_with_ties(spark):
    x, y = [1, 2, 2, 3, 5, 5, 5], [2.0, 1, 4, 4, 9, 7, 7]
    rows = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)], "k string, x double, y double")
    expected = pd.Series(x).rank().corr(pd.Series(y).rank())
    assert scoring.rank_ic(rows, ["k"], "x", "y").first()["rank_ic"] == pytest.approx(expected)


def test_exports_settle_their_dates_and_reject_bad_files(spark):
    files = {
        "us.csv": "Security,SPX Index\nPeriod,D\n\nDate,PX_LAST\n1/13/2020,\"1,234.50\"\n1/14/2020,\"1,235.00\"\n1/15/2020,#N/A N/A\n",
        "eu.csv": "Security,DAX Index\nPeriod,D\nStart Date,01/02/2020\nEnd Date,03/02/2020\n\nDate,PX_LAST\n01/02/2020,1\n02/02/2020,2\n03/02/2020,3\n",
        "unsure.csv": "Security,X Index\n\nDate,V\n01/02/2020,1\n",
        "nameless.csv": "Date,A,B\n2020-01-01,1,2\n",
        "wide.csv": "Security,W Index\n\nDate,V\n2020-01-01,1,9\n",
    }
    rows = [(f, i, line) for f, text in files.items() for i, line in enumerate(text.split("\n"))]
    obs, bad = exports.observations(spark.createDataFrame(rows, "file string, pos int, line string"))
    got = {(r["file"], str(r["date"])): r["value"] for r in obs.collect()}
    assert got == {("us.csv", "2020-01-13"): 1234.5, ("us.csv", "2020-01-14"): 1235.0, ("us.csv", "2020-01-15"): None, ("eu.csv", "2020-02-01"): 1.0, ("eu.csv", "2020-02-02"): 2.0, ("eu.csv", "2020-02-03"): 3.0}
    assert {r["file"]: r["reason"] for r in bad.collect()} == {"unsure.csv": "ambiguous dates", "nameless.csv": "no security", "wide.csv": "row beyond the header"}


def test_factor_table_skips_prose(spark):
    text = "Some prose, 2020\n,Mkt-RF,SMB\n20200102,0.1,-0.2\n20200103,0.3,0.4\n20210101,9,9\nCopyright\n"
    rows = [("f", i, line) for i, line in enumerate(text.split("\n"))]
    got = exports.read_factor_table(spark.createDataFrame(rows, "file string, pos int, line string"), "2020-01-01", "2020-12-31")
    assert sorted((str(r["date"]), r["factor"], r["value"]) for r in got.collect()) == [("2020-01-02", "Mkt-RF", 0.1), ("2020-01-02", "SMB", -0.2), ("2020-01-03", "Mkt-RF", 0.3), ("2020-01-03", "SMB", 0.4)]


def test_candles_open_at_the_last_close(spark):
    rows = [("s", dt.datetime(2020, 1, d, h), v) for d, h, v in ((1, 1, 5.0), (1, 2, 3.0), (2, 1, 7.0))]
    got = resample.candles(spark.createDataFrame(rows, "series_id string, ts timestamp, value double"), "day").orderBy("period_start").collect()
    assert [(r["open"], r["high"], r["low"], r["close"]) for r in got] == [(5, 5, 3, 3), (3, 7, 3, 7)]


def test_fits_of_all_prefixes_are_those_of_each(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(3, 1, 40)
    y = 0.4 * x + rng.normal(size=40)
    rows = spark.createDataFrame(pd.DataFrame({"k": "a", "d": np.arange(40), "x": x, "y": y}))
    got = {r["d"]: r for r in scoring.growing_fits(rows, ["k"], "x", "y", "d", 3).collect()}
    assert sorted(got) == list(range(1, 40))
    for d in (5, 17, 39):
        want = scoring.ols_hac(rows.filter(F.col("d") <= d), ["k"], "x", "y", "d", 3).first()
        for c in ("n", "slope", "intercept", "se_bartlett", "se_uniform"):
            assert got[d][c] == (pytest.approx(want[c], rel=1e-6) if want[c] is not None else None)


def test_difference_test_against_lagged_products(spark):
    rng = np.random.default_rng(7)
    d = np.convolve(rng.normal(0, 0.01, 320), [1, 0.5], "valid")[:319]
    rows = spark.createDataFrame([("p", x, float(v), 0.0) for x, v in zip(days(319), d)], "k string, date date, r double, base double")
    got = portfolio.relative(rows, ["k"]).first()
    e, lags = d - d.mean(), int(4 * (319 / 100) ** (2 / 9))
    s = e @ e + 2 * sum((1 - i / (lags + 1)) * (e[i:] @ e[:-i]) for i in range(1, lags + 1))
    assert got["lags"] == lags and got["spread_t"] == pytest.approx(d.mean() / (np.sqrt(s) / 319))


def test_asof_takes_the_last_row_known(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("a", 7), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 10, 1), ("a", 5, 20, 1), ("a", 5, 30, 2), ("b", 6, 40, 1), ("a", None, 50, 1)], "k string, at int, v int, o int")
    read = lambda strict: {(r["k"], r["t"]): r["v"] for r in panel.asof(left, right, ["k"], "t", "at", ["v"], strict, "o").collect()}
    assert read(False) == {("a", 1): None, ("a", 5): 30, ("a", 7): 30, ("b", 5): None}
    assert read(True) == {("a", 1): None, ("a", 5): 10, ("a", 7): 30, ("b", 5): None}


def test_rows_of_ranges_are_all_found_once(spark):
    rows = spark.createDataFrame([("t", i) for i in range(1, 201)], "target_id string, rn int")
    ranges = [(0, 1, 200), (1, 63, 64), (2, 64, 64), (3, 128, 127), (4, 190, 400)]
    got = panel.rows_in_ranges(rows, spark.createDataFrame([("t", *r) for r in ranges], "target_id string, f int, lo int, hi int")).collect()
    assert sorted((r["f"], r["rn"]) for r in got) == [(f, i) for f, lo, hi in ranges for i in range(1, 201) if lo <= i <= hi]


def test_a_start_date_that_a_reading_cannot_read_rules_it_out(spark):
    text = "Security,S Index\nStart Date,8/31/2016\n\nDate,PX_LAST\n9/1/2016,1\n9/2/2016,2\n9/5/2016,3\n9/6/2016,4\n"
    other = text.replace("8/31/2016", "no date at all")
    dotted = "Security,T Index\n\nDate,PX_LAST\n13.09.2016,1\n14.09.2016,2\n"
    rows = [(f, i, line) for f, t in (("us", text), ("unsure", other), ("dots", dotted)) for i, line in enumerate(t.split("\n"))]
    meta, cells = exports.read_exports(spark.createDataFrame(rows, "file string, pos int, line string"))
    got = {r["file"]: (r["reading"], r["reason"]) for r in exports.settle_date_order(cells, meta).collect()}
    assert got == {"us": ("month_first", None), "unsure": (None, "ambiguous dates"), "dots": ("day_first", None)}


def test_hit_rate_counts_views_on_the_side_of_the_baseline(spark):
    runs = spark.createDataFrame([(1, "m"), (2, "m"), (3, "n")], "run_id int, model string")
    rows = [(1, 0.3, 0.1, 0.2), (1, 0.3, 0.1, 0.05), (2, 0.0, 0.1, -1.0), (2, 0.1, 0.1, 5.0), (2, 0.3, 0.1, 0.1), (3, None, 0.1, 0.2), (3, 0.2, 0.1, None)]
    made = spark.createDataFrame(rows, "run_id int, predicted double, baseline double, realised double")
    got = {r["model"]: (r["views"], r["hit_rate"]) for r in runlog.direction_hit_rate(runs, made).collect()}
    assert got == {"m": (4, 0.5)}


def test_directional_steps_count_rows_with_an_outcome(spark):
    d = days(14, dt.date(2020, 1, 6))  # a Monday
    outcome = {0: 0.1, 1: 0.2, 3: -0.1, 4: 0.3, 6: 0.2}
    rows = spark.createDataFrame([("t", d[i], 0.5 if i != 3 else None, outcome.get(i)) for i in range(8)], "target_id string, date date, predicted double, realised double")
    steps = portfolio.directional_steps(rows, 2).orderBy("date").collect()
    assert [(r["date"], r["held_until"], r["invested"]) for r in steps] == [(d[0], d[2], True), (d[3], d[5], False), (d[6], dt.date(2020, 1, 14), True)]
    inside = portfolio.directional_pnl(rows, 2, str(d[1]), str(d[4])).first()
    assert (inside["days"], inside["steps"], inside["first_step"]) == (3, 2, d[1])


def test_closed_days_return_nothing_and_gaps_are_marked(spark):
    d = days(9)
    prices = [("p", "equity", d[i], 10.0 + i) for i in range(9)] + [("p", "bond", d[i], v) for i, v in ((0, 5.0), (2, 6.0), (8, 7.0))]
    got = portfolio.joint_calendar_returns(spark.createDataFrame(prices, "portfolio_id string, asset string, date date, price double"), spark.createDataFrame([("p", d[0])], "portfolio_id string, first date"))
    bond = [(r["r"], r["closed"], r["gap"]) for r in got.filter("asset = 'bond'").orderBy("date").collect()]
    assert bond[:3] == [(0.0, False, False), (0.0, True, False), (pytest.approx(0.2), False, False)]
    assert [g for *_, g in bond] == [False] * 6 + [True] * 2 + [False] and bond[6][0] is None and bond[8][0] is None


def test_numbers_follow_start_and_day(spark):
    runs = spark.createDataFrame([(i, dt.datetime(2020, 1, 1 + i % 3, i)) for i in range(9)], "run_id int, started_at timestamp")
    given = spark.createDataFrame([(4, 7)], "run_id int, number int")
    got = {r["run_id"]: r["number"] for r in runlog.number_new_runs(runs, given).collect()}
    order = [r for r in sorted(range(9), key=lambda i: (i % 3, i)) if r != 4]
    assert got == {r: 8 + k for k, r in enumerate(order)}


def plain_lasso(x, y, penalty, free):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    z, t, w = (x - mean) / sd, y - y.mean(), np.zeros(x.shape[1])
    for _ in range(300):
        for j in range(len(w)):
            r = z[:, j] @ (t - z @ w + z[:, j] * w[j]) / len(t)
            w[j] = r if j < free else np.sign(r) * max(abs(r) - penalty, 0)
    return np.concatenate([[y.mean() - w / sd @ mean], w / sd])


@pytest.mark.parametrize("free", [0, 2])
def test_lasso_and_its_penalty_against_rows(free):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(180, 4))
    y = x @ [0.5, 0, -0.3, 0] + rng.normal(size=180)
    gram = lambda a, b: (lambda v: v.T @ v)(np.column_stack([np.ones(len(a)), a, b]))
    for penalty in (0.3, 0.05):
        assert models.lasso(gram(x, y), np.array([penalty]), free)[0] == pytest.approx(plain_lasso(x, y, penalty, free), abs=1e-7)
    h, size = 5, 30
    parts = {(b, late): slice(30 * b + (25 if late else 0), 30 * b + (30 if late else 25)) for b in range(6) for late in (False, True)}
    got = models.choose_lasso({k: gram(x[s], y[s]) for k, s in parts.items()}, free)
    lams = models._penalties(gram(x, y), free)
    errors = np.zeros(len(lams))
    for i in range(1, 6):
        known, judged = slice(0, size * i - h), slice(size * i, size * (i + 1))
        for k in range(0, len(lams), 9):
            c = plain_lasso(x[known], y[known], lams[k], free)
            errors[k] += ((y[judged] - c[0] - x[judged] @ c[1:]) ** 2).sum()
    chosen = min(range(len(lams)), key=lambda k: np.abs(plain_lasso(x, y, lams[k], free) - got).max())
    assert plain_lasso(x, y, lams[chosen], free) == pytest.approx(got, abs=1e-6)
    near = [errors[k] for k in range(0, len(lams), 9)]
    assert errors[chosen // 9 * 9] <= min(near) * 1.02
