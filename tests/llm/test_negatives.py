"""Hard negatives against SQL and a plain search."""

import math
import random

import numpy as np
from pyspark.sql import functions as F
from rows import canonical

from panelcast.llm import negatives, registry


def test_query_against_sql(spark, oracle):
    got = registry.queries()["op11_hard_negatives"](spark, "/root/testdata/sf0.01").toPandas()
    assert len(got) > 100
    assert canonical(got) == canonical(oracle(registry.oracle_sql()["op11_hard_negatives"], "sf0.01"))


def test_strassen_is_exact_for_any_shape():
    rng = np.random.default_rng(0)
    for m, k, n in [(1, 1, 1), (17, 64, 90), (33, 65, 47), (100, 3, 100), (129, 128, 131), (40, 0, 40)]:
        a, b = rng.integers(-(2**28), 2**28, (m, k)), rng.integers(-(2**28), 2**28, (k, n))
        assert (negatives.strassen(a, b) == a @ b).all()


def test_heaps_keep_the_first_of_equals():
    rng = np.random.default_rng(1)
    scores = rng.integers(-3, 3, (7, 600))
    allowed = rng.random((7, 600)) < 0.7
    heaps = negatives.Heaps(7, 4)
    for k in range(0, 600, 37):
        at = np.arange(k, min(600, k + 37))
        heaps.offer(np.arange(7), scores[:, at], allowed[:, at], at)
    got = [(r, s, i) for r, s, i in zip(heaps.row.tolist(), heaps.score.tolist(), heaps.item.tolist(), strict=True)]
    assert got == [(r, -s, i) for r in range(7) for s, i in sorted((-int(scores[r, i]), i) for i in range(600) if allowed[r, i])[:4]]


def plain(rows):
    """The contract, row by row."""
    used = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        used.append((vec_id, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label, [math.floor(256 * x) for x in vector]))
    first = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for a, label, v in used:
        if a is None or a % 100:
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), b, lab) for b, lab, w in used if b != a]
        for score, positive, _ in sorted((x for x in scored if x[2] == label), key=first)[:5]:
            fit = sorted((x for x in scored if x[2] != label and 30 * score <= 100 * x[0] <= 90 * score), key=first)[:10]
            out += [(a, positive, k + 1, x[1], score, x[0]) for k, x in enumerate(fit)]
    return sorted(out, key=str)


def test_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(6)], rng.randrange(3)) for i in range(700)]
    rows += [(None, [0.5] * 6, 1), (None, [0.5] * 6, 1), (800, None, 1), (900, [0.5, None], 1), (1000, [0.5, float("nan")], 2), (1100, [float("inf")] * 6, 2), (1200, [0.5] * 6, None)]
    rows += [(1300, [], 1), (1400, [0.5] * 9, 2), (1500, [0.25] * 2, 0), (-100, [0.5] * 6, 0), (300, [0.25] * 6, 2), rows[5], rows[5], rows[200]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"group": F.lit(0), "tile": F.lit("t"), "anchor": F.lit(1), "k": F.lit(None)})
    got = negatives.hard_negatives(df).collect()
    assert sorted((tuple(r[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in got), key=str) == plain(rows)
    assert negatives.hard_negatives(df.limit(0)).count() == 0
    assert negatives.hard_negatives(df.filter("vec_id = 1")).count() == 0
