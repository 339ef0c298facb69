"""Shapley shares by subsets, naive means by sums, parts of hybrids, capped paths."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import models


def by_subsets(values, means, coef):
    """Shares of a product of powers, each subset of known factors tried."""
    k = len(values)
    out = []
    for i in range(k):
        others = [j for j in range(k) if j != i]
        total = 0.0
        for size in range(k):
            for known in itertools.combinations(others, size):
                mix = math.prod(values[j] if j in known else means[j] for j in others)
                total += mix / math.comb(k - 1, size)
        out.append(coef * (values[i] - means[i]) * total / k)
    return out


def test_shares_of_powers_against_all_subsets(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(40, 4)), 3)
    rows = [("t", i, bool(i < 30), *map(float, r)) for i, r in enumerate(x)] + [("t", 99, True, None, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "target_id string, rn int, train boolean, a double, b double, c double, d double")
    inputs = {"a": (-1.0, 1.0, 0.1, 0.5), "b": (None, None, 0.0, 1.0), "c": (None, 0.5, 0.0, 2.0), "d": (None, None, 0.0, 1.0)}
    terms = [(2.0, {"a": 2, "b": 1, "c": 3, "d": 1}), (-1.0, {"a": 1}), (0.5, {"b": 2, "d": 2}), (3.0, {"a": 2})]
    shares = models.product_attribution(df, inputs, terms, ["target_id"])
    z = np.stack([(np.clip(x[:, 0], -1, 1) - 0.1) / 0.5, x[:, 1], np.minimum(x[:, 2], 0.5) / 2, x[:, 3]], 1)
    want = np.zeros((40, 4))
    for coef, factors in terms:
        at = ["abcd".index(c) for c in factors]
        powers = np.stack([z[:, j] ** p for j, p in zip(at, factors.values(), strict=True)], 1)
        means = powers[:30].mean(axis=0)
        for i in range(40):
            for j, share in zip(at, by_subsets(powers[i], means, coef), strict=True):
                want[i, j] += share
    got = {r["rn"]: [r[f"phi_{c}"] for c in "abcd"] for r in shares.collect()}
    assert got[99] == [None] * 4 and np.allclose([got[i] for i in range(40)], want)
    sizes = {r["signal"]: r["importance"] for r in models.mean_attribution(shares, list("abcd"), ["target_id"]).collect()}
    assert [sizes[c] for c in "abcd"] == pytest.approx(np.abs(want[:30]).mean(axis=0))


def test_repeated_factor_has_the_mean_of_its_power(spark):
    df = spark.createDataFrame([("t", 1, True, 1.0), ("t", 2, True, 3.0)], "target_id string, rn int, train boolean, a double")
    got = models.product_attribution(df, {"a": (None, None, 0.0, 1.0)}, [(1.0, {"a": 2})], ["target_id"]).orderBy("rn").collect()
    assert [r["phi_a"] for r in got] == [-4.0, 4.0]


def test_naive_means_from_running_sums(spark):
    rng = np.random.default_rng(2)
    y = [float(v) if rng.random() < 0.8 else None for v in rng.normal(size=50)]
    a = [1.0 if rng.random() < 0.7 else None for _ in range(50)]
    rows = spark.createDataFrame([("t", i + 1, y[i], a[i]) for i in range(50)], "target_id string, rn int, y double, a double")
    folds = [(0, 1, 20, 23, 30), (1, 5, 30, 33, 48), (2, 20, 40, 44, 60)]
    got = {(r["fold_id"], r["part"]): (r["n"], r["predicted"]) for r in models.naive_by_fold(rows, spark.createDataFrame([("t", *f) for f in folds], "target_id string, fold_id int, train_lo int, train_hi int, test_lo int, test_hi int"), ["a"]).collect()}
    for fold, lo, hi, first, last in folds:
        mean = np.mean([y[i] for i in range(lo - 1, hi) if a[i] is not None and y[i] is not None])
        for part, p, q in (("train", lo, hi), ("test", first, last)):
            assert got[fold, part] == (sum(v is not None for v in a[p - 1 : q]), pytest.approx(mean))


def test_hybrid_has_the_training_mean_where_a_fold_has_neither_part(spark):
    rows = spark.createDataFrame([("t", f, part, i, None, float(i)) for f in range(4) for part, i in (("train", 1), ("train", 2), ("test", 3))], "target_id string, fold_id int, part string, rn int, date date, y double")
    level = rows.filter("fold_id IN (0, 1)").withColumn("predicted", F.lit(10.0))
    flow = rows.filter("fold_id IN (0, 2) AND NOT (fold_id = 0 AND rn = 2)").withColumn("predicted", F.col("rn") * 1.0)
    got = {(r["fold_id"], r["rn"]): r["predicted"] for r in models.hybrid_forecast(rows, level, flow).collect()}
    assert got == {(0, 1): 10.0, (0, 2): None, (0, 3): 12.0, **{(1, i): 10.0 for i in (1, 2, 3)}, **{(2, i): float(i) for i in (1, 2, 3)}, **{(3, i): 1.5 for i in (1, 2, 3)}}


def test_a_cap_stops_the_path_before_the_first_penalty_with_more_terms():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 6))
    y = x @ [0.5, -0.4, 0.3, 0.2, 0.1, 0.0] + 0.3 * rng.normal(size=240)
    m = np.concatenate([np.ones((240, 1)), x, y[:, None]], 1)
    blocks = {(b, late): g.T @ g for b in range(6) for late, g in ((False, m[40 * b : 40 * b + 35]), (True, m[40 * b + 35 : 40 * b + 40]))}
    total = sum(blocks.values())
    path = models.lasso(total, models._penalties(total))
    counts = [np.count_nonzero(w[1:]) for w in path]
    free = models.choose_lasso(blocks)
    for cap in (1, 2, 3):
        stop = next(i for i, c in enumerate(counts) if c > cap)
        got = models.choose_lasso(blocks, max_terms=cap)
        assert np.count_nonzero(got[1:]) <= cap and any(np.allclose(got, w) for w in path[: max(stop, 1)])
    assert np.array_equal(models.choose_lasso(blocks, max_terms=6), free) and np.count_nonzero(free[1:]) > 3


def test_correlations_by_blocks_against_each_pair(spark):
    from panelcast.operators import scoring

    rng = np.random.default_rng(6)
    days = [dt.date(2000, 1, 1) + dt.timedelta(days=int(3 * i)) for i in range(70)]
    x = 1e6 + rng.normal(size=(70, 7)).cumsum(axis=0)
    x[:, 3] = 5.0
    x[rng.random((70, 7)) < 0.2] = np.nan
    rows = [("t", f"m{j}", days[i], None if np.isnan(x[i, j]) else float(x[i, j])) for i in range(70) for j in range(7)]
    got = scoring.signal_correlations(spark.createDataFrame(rows, "target_id string, model_id string, date date, signal double"), block=2, span=50).collect()
    by = {(r["model_a"], r["model_b"]): (r["correlation"], r["n"]) for r in got}
    assert len(by) == len(got) == 21
    for i, j in itertools.combinations(range(7), 2):
        both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        r, n = by[f"m{i}", f"m{j}"]
        assert n == both.sum() and (r is None if 3 in (i, j) else r == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], abs=1e-7))
