"""Places where a part of the job was once left out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import panelcast.catalog as catalog
from panelcast.operators import boosted, models, panel
from panelcast.plans import fixtures as fx
from panelcast.plans.model_queries import H, TUNING_TRAIN
from panelcast.plans.panel_queries import Parts

SF = "/root/testdata/sf0.01"


def test_boosted_models_fit_every_fold(spark):
    p = Parts(spark, SF)
    want = {(r["target_id"], r["fold_id"]) for r in p.purged.collect()}
    forecasts = catalog.queries()["G13_boosted_walk_forward"](spark, SF)
    got = forecasts.collect()
    keys = [(r["target_id"], r["fold_id"], r["part"], r["rn"]) for r in got]
    assert len(set(keys)) == len(keys) and {k[:2] for k in keys} == want and len({k[1] for k in keys}) > 2
    assert all(r["predicted"] is not None for r in got) and len({(r["target_id"], r["model_id"]) for r in got}) == 5


def test_importances_are_of_each_targets_latest_fold(spark):
    last = {r["target_id"]: r["fold_id"] for r in models.latest_fold(Parts(spark, SF).purged).collect()}
    got = catalog.queries()["G15_feature_importance"](spark, SF).collect()
    assert {(r["target_id"], r["fold_id"]) for r in got} == set(last.items()) and min(last.values()) > 0
    shares = {}
    for r in got:
        shares[r["target_id"], r["params"]] = shares.get((r["target_id"], r["params"]), 0.0) + r["importance"]
    assert len(shares) == 10 and all(abs(x - 1) < 1e-9 or x == 0 for x in shares.values())


def test_every_tuning_period_has_its_own_window(spark):
    p = Parts(spark, SF)
    periods = {(r["target_id"], r["tuning_id"]) for r in panel.retune_schedule(p.folds, fx.TEST).select("target_id", "tuning_id").distinct().collect()}
    inner = boosted.tuning_folds(p.folds, p.labels, H, fx.TUNING, TUNING_TRAIN, fx.TEST, fx.EMBARGO)
    opens = {(r["target_id"], r["fold_id"] // 13): r["test_lo"] for r in p.folds.filter("fold_id % 13 = 0").collect()}
    per = {}
    for r in inner.collect():
        per.setdefault((r["target_id"], r["tuning_id"]), []).append(r)
        first = opens[r["target_id"], r["tuning_id"]]
        assert first - fx.EMBARGO - fx.TUNING <= r["train_lo"] < r["train_hi"] < r["test_lo"] and r["test_hi"] < first - fx.EMBARGO
    assert set(per) == set(opens) and all(len(v) >= 3 for v in per.values())
    tuned = catalog.queries()["G14_tune_grid"](spark, SF).collect()
    assert {(r["target_id"], r["tuning_id"]) for r in tuned} == periods and len(tuned) == 2 * len(periods) > 2
    with pytest.raises(ValueError, match="shorten the train or test window"):
        boosted.tuning_folds(p.folds, p.labels, H, 300, 252, fx.TEST, fx.EMBARGO)


def plain_boost(bins, y, rounds, depth, rate, leaf, penalty):
    """Forecasts of the training rows and gains by input: every split is tried in every node."""
    f, gains = np.full(len(y), y.mean()), np.zeros(bins.shape[1])
    least = min(leaf, max(int(len(y) * boosted.LEAF_CAP), 1))
    for _ in range(rounds):
        r, leaves, grown = y - f, [np.arange(len(y))], False
        for _ in range(depth):
            after = []
            for at in leaves:
                best = None
                for j in range(bins.shape[1]):
                    for b in range(boosted.BINS):
                        low = bins[at, j] <= b
                        if min(low.sum(), (~low).sum()) >= least:
                            gain = r[at][low].sum() ** 2 / low.sum() + r[at][~low].sum() ** 2 / (~low).sum() - r[at].sum() ** 2 / len(at)
                            if gain > (best[0] + 1e-14 if best else 1e-14):
                                best = gain, j, low
                if best is None:
                    after.append((at, False))
                    continue
                gains[best[1]] += best[0]
                grown = True
                after += [(at[best[2]], True), (at[~best[2]], True)]
            leaves = [at for at, _ in after]
        if grown:
            for at in leaves:
                f[at] += rate * r[at].sum() / (len(at) + penalty)
    return f, gains / gains.sum() if gains.sum() else gains


def test_boosting_on_bins_against_plain_trees(spark):
    rng = np.random.default_rng(5)
    rows, plain = [], {}
    for fold, n in ((0, 160), (1, 50), (2, 12)):
        x = np.round(rng.normal(size=(n, 2)), 1)
        y = np.where(x[:, 0] > 0.3, 1.0, -1.0) * np.where(x[:, 1] > 0, 1.0, 0.3) + 0.2 * rng.normal(size=n)
        edges = [np.sort(c)[np.ceil(np.arange(1, boosted.BINS) / boosted.BINS * n).astype(int) - 1] for c in x.T]
        plain[fold] = np.stack([(e[None, :] < c[:, None]).sum(1) for e, c in zip(edges, x.T, strict=True)], 1), y
        rows += [("t", fold, "train", i, None, float(y[i]), s, float(x[i, j])) for i in range(n) for j, s in enumerate("ab")]
        rows += [("t", fold, "train", i, None, float(y[i]), "off", None) for i in range(n)]
    df = spark.createDataFrame(rows, "target_id string, fold_id int, part string, rn int, date date, y double, series_id string, x double")
    screens = spark.createDataFrame([("t", f, s, s != "off") for f in range(3) for s in ("a", "b", "off")], "target_id string, fold_id int, series_id string, kept boolean")
    grid = {"one": (2, 1, 0.5, 10, 0.0), "two": (3, 2, 0.3, 30, 5.0)}
    settings = spark.createDataFrame([("t", f, p, p, *v) for f in range(3) for p, v in grid.items()], f"target_id string, fold_id int, config string, params string, {boosted.SETTING}")
    state, _ = boosted.grow(boosted.binned(df, screens), settings.drop("config"), 3, 2)
    got = {}
    for r in state.collect():
        assert list(plain[r["fold_id"]][0][r["rn"]]) == list(r["bins"])
        got[r["fold_id"], r["params"], r["rn"]] = r["f"]
    shares = {(r["fold_id"], r["params"], r["input"]): r["importance"] for r in boosted.feature_importance(df, screens, settings, 3, 2).collect()}
    assert {k[0] for k in got} == {0, 1} and len(shares) == 8
    for fold in (0, 1):
        for name, setting in grid.items():
            f, gains = plain_boost(*plain[fold], *setting)
            assert np.allclose([got[fold, name, i] for i in range(len(f))], f)
            assert np.allclose([shares[fold, name, s] for s in "ab"], gains)
