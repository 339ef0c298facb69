"""The toxicity chain's parts against plain forms."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from panelcast.llm import toxicity

SF = "/root/testdata/sf0.001"


def plain_marks(text):
    words = {w.encode() for w in re.sub(r"[\x00-@\[-`{-\x7f]", " ", (text or "").lower()).split(" ") if w}
    begins = Counter(w[:k] for w in words for k in range(4, 10) if k <= len(w))
    return {b"=" + w for w in words} | set(begins) | {b"2" + p for p, n in begins.items() if n > 1}


def test_marks_of_texts():
    for text in ("Idiots and idiotic idioms, ünder 2 roofs", "", "a-b_c'd", "äöüß" * 5, None):
        assert toxicity.marks_of(toxicity.word_set((text or "").encode())) == plain_marks(text)


def test_vocabulary_and_scores_against_plain_forms(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    known = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["toxic"] in (0, 1) and r["doc_id"] in texts}
    n = {k: Counter(m for d, t in known.items() if t == k for m in plain_marks(texts[d])) for k in (0, 1)}
    size = Counter(known.values())
    z = {}
    for w in set(n[0]) | set(n[1]):
        a, b, pos, neg = n[1][w], n[0][w], size[1], size[0]
        if a + b >= toxicity.LEAST_DOCS:
            odds = math.log((a + 0.5) / (pos - a + 0.5)) - math.log((b + 0.5) / (neg - b + 0.5))
            z[w] = abs(odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (pos - a + 0.5) + 1 / (neg - b + 0.5)))
    vocabulary, models = toxicity.fit(docs, labels)
    assert len(set(vocabulary)) == len(vocabulary) and [len(m) for m in models] == [len(vocabulary) + 1 + k for k in range(len(toxicity.CHAIN))]
    bound = min(z[w] for w in vocabulary)
    assert all(w in vocabulary for w, v in z.items() if v > bound + 1e-9 and (v >= toxicity.LEAST_Z or len(vocabulary) <= toxicity.LEAST_WORDS))
    got = {r["doc_id"]: [r[f"p_{c}"] for c in toxicity.CHAIN] for r in toxicity.score(docs, (vocabulary, models)).collect()}
    for d, text in texts.items():
        marks = plain_marks(text)
        x = [float(w in marks) for w in vocabulary]
        for k, m in enumerate(models):
            x.append(1 / (1 + math.exp(-min(max(float(np.dot(x, m[:-1]) + m[-1]), -30), 30))))
            assert got[d][k] == pytest.approx(x[-1], abs=1e-9)


def test_kinds_part_documents_by_their_words():
    rng = np.random.default_rng(3)
    x = np.zeros((60, 20))
    for i in range(60):
        x[i, rng.choice(10, 4, replace=False) + 10 * (i % 2)] = 1
    x[7] = 0
    group = toxicity.kinds_of(x, 2)
    assert group[7] == 0 and len({(i % 2, g) for i, g in enumerate(group.tolist()) if i != 7}) == 2
    assert (toxicity.kinds_of(x[:1], 2) == 0).all() and len(toxicity.kinds_of(x[:0], 2)) == 0 and (toxicity.kinds_of(np.zeros((5, 0)), 2) == 0).all()


def test_models_without_a_fold_see_its_vocabulary_alone():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2, (90, 3)).astype(float)
    y = np.column_stack([x[:, 0], x[:, 0]])
    fold = np.arange(90) % toxicity.FOLDS
    usable = np.array([[0.0, 1, 1], [1, 1, 1], [1, 1, 1]])
    # the first fold's probabilities come from models that cannot see the one telling column
    blind, seeing = toxicity.fit_chain(x, y, fold, usable), toxicity.fit_chain(x, y, fold)
    assert [len(m) for m in blind] == [4, 5] and blind[1][3] != pytest.approx(seeing[1][3])
