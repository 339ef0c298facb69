"""Placebo shifts and rolling order statistics against plain loops."""

import datetime as dt

import numpy as np
import pytest

from panelcast.operators import risk, scoring


def days(n):
    return [dt.date(2000, 1, 1) + dt.timedelta(days=i) for i in range(n)]


def plain_fit(x, y, lags):
    xc, yc = x - x.mean(), y - y.mean()
    slope = xc @ yc / (xc @ xc)
    u = xc * (yc - slope * xc)
    errors = []
    for kernel in ("bartlett", "uniform"):
        v = u @ u + sum(2 * (1 - lag / (lags + 1) if kernel == "bartlett" else 1) * (u[lag:] @ u[:-lag]) for lag in range(1, lags + 1))
        errors.append(np.sqrt(v) / (xc @ xc) if v > 0 else np.nan)
    return slope, slope / np.fmax(*errors)


def test_all_shifts_at_once_against_each_alone(spark):
    rng = np.random.default_rng(3)
    n, lags = 331, 4  # a prime length
    x = np.convolve(rng.normal(size=n + 9), np.ones(10), "valid")
    y = 0.1 * x + np.convolve(rng.normal(size=n + 4), np.ones(5), "valid")
    rows = [("p", d, float(a), float(b), lags) for d, a, b in zip(days(n), x, y, strict=True)] + [("p", dt.date(1999, 1, 1), None, 1.0, lags), ("flat", days(1)[0], 1.0, 1.0, 0), ("flat", days(2)[1], 1.0, 2.0, 0)]
    got = scoring.circular_shift_placebo(spark.createDataFrame(rows, "key string, date date, x double, y double, lags int"), ["key"], 40, least=252)
    by = {r["shift"]: r for r in got.collect()}
    assert sorted(by) == [0, *range(40, n - 39)] and all(r["key"] == "p" and r["n"] == n for r in by.values())
    for shift, r in by.items():
        moved = np.roll(x, shift)
        slope, t = plain_fit(moved, y, lags)
        assert r["slope"] == pytest.approx(slope) and r["t"] == pytest.approx(t) and r["opens"] == (t > 2)
        assert r["placebo_ic"] == pytest.approx(np.corrcoef(moved, y)[0, 1])
    share = scoring.placebo_share(got, ["key"]).first()
    assert share["shifts"] == len(by) - 1 and share["share_open"] == pytest.approx(np.mean([r["opens"] for s, r in by.items() if s])) and share["opens"] == by[0]["opens"]


def test_rolling_limits_against_sorted_windows(spark):
    rng = np.random.default_rng(8)
    series = {"a": np.round(rng.normal(size=97), 1), "b": np.zeros(40), "c": rng.normal(size=9)}
    rows = [(k, d, float(v)) for k, s in series.items() for d, v in zip(days(len(s)), s, strict=True)] + [("a", dt.date(1999, 1, 1), None)]
    df = spark.createDataFrame(rows, "key string, date date, r double")
    got = {(r["key"], r["date"]): r["least"] for r in risk.rolling_limits(df, ["key"], 3, 10).collect()}
    assert len(got) == 97 + 40 + 9
    for k, s in series.items():
        for i, d in enumerate(days(len(s))):
            assert got[k, d] == (sorted(s[i - 10 : i].tolist())[:3] if i >= 10 else None)
    table = {(r["key"], r["confidence"]): r for r in risk.tail_table(df, ["key"]).collect()}
    wealth = np.cumprod(1 + series["a"])
    assert table["a", 0.95]["max_drawdown"] == pytest.approx(min(wealth / np.maximum(1, np.maximum.accumulate(wealth)) - 1)) and table["a", 0.99]["days"] == 97
    assert table["a", 0.95]["var"] == pytest.approx(-np.sort(series["a"])[4]) and table["a", 0.99]["cvar"] == pytest.approx(-series["a"].min()) and len(table) == 6
