"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic models; each model sees the presence of vocabulary entries
and the probabilities of all earlier categories. While fitting, those come from out-of-fold models, whose vocabulary too
is picked without their fold, so a later link learns from probabilities as it will meet them. The label table has one
toxicity label; it is the last link. The earlier links are kinds of toxicity that the data show: groups of the toxic
documents by the words that set them apart from the others, found by spherical k-means from farthest starts.

Vocabulary and models come from at most TRAIN_DOCS labelled documents, the first by a hash of the id. The vocabulary
holds whole words and beginnings of words, so that compounds of a word count too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.shared import staged, text_bytes

#: Groups of toxic documents that are links of their own, before the label itself.
KINDS = 2
CHAIN = (*(f"kind_{k + 1}" for k in range(KINDS)), "toxic")
VOCABULARY = 512
LEAST_DOCS = 5
#: Words enter by the log-odds ratio between toxic and other documents, in standard errors; where few labels leave fewer
#: than LEAST_WORDS such words, the best of the rest enter too.
LEAST_Z, LEAST_WORDS = 4.0, 64
TRAIN_DOCS = 8000
FOLDS = 3
STEPS, RIDGE = 200, 1e-4
ROUNDS = 20
THRESHOLD = 0.5

#: Lengths, in bytes, of the word beginnings that are features.
PREFIXES = range(4, 10)

#: ASCII letters and bytes beyond ASCII as they are, all else a blank.
_LETTERS = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def word_set(text: bytes) -> set[bytes]:
    return set(text.decode("utf-8", "replace").lower().encode().translate(_LETTERS).split())


def marks_of(words: set[bytes], wanted: dict[bytes, int] | None = None) -> set[bytes]:
    """Features of a document: ``=word`` for whole words, ``prefix`` for beginnings of words, ``2prefix`` where two words
    or more begin so; only the wanted ones if given."""
    begins: Counter = Counter()
    out = set()
    for w in words:
        out.add(b"=" + w)
        for k in PREFIXES:
            if k > len(w):
                break
            begins[w[:k]] += 1
    out.update(begins)
    out.update(b"2" + p for p, n in begins.items() if n > 1)
    return out if wanted is None else out & wanted.keys()


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, int], Counter] = {}

    def rows():
        for (label, fold), words in counts.items():
            names, n = list(words), list(words.values())
            for at in range(0, len(names), 20_000):
                part = names[at : at + 20_000]
                columns = [pa.array(part, pa.binary()), *(pa.array([v] * len(part), pa.int32()) for v in (label, fold)), pa.array(n[at : at + 20_000], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "label", "fold", "n"])
        counts.clear()

    for batch in batches:
        for label, fold, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts.setdefault((label, fold), Counter()).update(marks_of(word_set(text)))
            if sum(map(len, counts.values())) > 400_000:
                yield from rows()
    yield from rows()


def _present(vocabulary: list[bytes]):
    place = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[w] for w in marks_of(word_set(t), place)) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "fold", "found"])

    return run


def kinds_of(x: np.ndarray, kinds: int = KINDS) -> np.ndarray:
    """Group of each row by spherical k-means: the first start is the row most like the mean, each further one the row
    least like all starts. Rows without features are of group 0."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    z = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    if not len(z):
        return np.zeros(0, int)
    starts = [int(np.argmax(z @ z.mean(axis=0)))]
    while len(starts) < kinds:
        starts.append(int(np.argmin(np.where(size[:, 0] > 0, (z @ z[starts].T).max(axis=1), np.inf))))
    centres, group = z[starts], np.zeros(len(z), int)
    for _ in range(ROUNDS):
        new = np.argmax(z @ centres.T, axis=1)
        if (new == group).all() and _:
            break
        group = new
        for k in range(kinds):
            if (group == k).any():
                mean = z[group == k].mean(axis=0)
                centres[k] = mean / max(np.linalg.norm(mean), 1e-12)
    return group


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    step = 4 / ((x * x).sum() / len(x) + 1)  # below the inverse of the gradient's Lipschitz constant
    w = ahead = np.zeros(x.shape[1])
    for k in range(STEPS):
        g = x.T @ (_sigmoid(x @ ahead) - y) / len(y)
        g[:-1] += RIDGE * ahead[:-1]
        new = ahead - step * g
        ahead = new + (k / (k + 3)) * (new - w)
        w = new
    return w


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray, usable: np.ndarray | None = None) -> list[np.ndarray]:
    """A model per column of ``y``; model k sees x and the out-of-fold probabilities of columns before k. ``usable[f]`` tells
    which columns of x the models that leave out fold f may see."""
    models, width = [], x.shape[1]
    for k in range(y.shape[1]):
        models.append(logistic(x, y[:, k]))
        p = np.zeros(len(x))
        for f in range(FOLDS):
            out = fold == f
            if out.any() and not out.all():
                seen = x if usable is None else np.hstack([x[:, :width] * usable[f], x[:, width:]])
                w = logistic(seen[~out], y[~out, k])
                p[out] = _sigmoid(seen[out] @ w[:-1] + w[-1])
        x = np.hstack([x, p[:, None]])
    return models


def apply_chain(models: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    for w in models:
        x = np.hstack([x, _sigmoid(x @ w[:-1] + w[-1])[:, None]])
    return x[:, x.shape[1] - len(models) :]


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[np.ndarray]]:
    """The vocabulary and the chain; both empty where no document is labelled."""
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("label"))
    sample = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS), "sample")  # bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(docs).alias("text"))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    texts = staged(texts.join(F.broadcast(sample), "doc_id").select("doc_id", "label", fold.alias("fold"), "text"), "labelled")
    sizes = {(r["label"], r["fold"]): r["count"] for r in texts.groupBy("label", "fold").count().collect()}
    counted = texts.select("label", "fold", "text").mapInArrow(_frequencies, "word binary, label int, fold int, n long")
    of = lambda label, fold: F.sum(F.when((F.col("label") == label) & (F.col("fold") != fold), F.col("n")).otherwise(0))
    # fold -1 leaves nothing out
    per_word = staged(counted.groupBy("word").agg(*[of(label, f).alias(f"n{label}_{f + 1}") for label in (0, 1) for f in range(-1, FOLDS)]), "words")
    picked = [_picked(per_word, f, *(sum(n for (lab, g), n in sizes.items() if lab == label and g != f) for label in (1, 0))) for f in range(-1, FOLDS)]
    vocabulary = picked[0]
    rows = texts.mapInArrow(_present(vocabulary), "doc_id long, label int, fold int, found array<int>")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("label", "fold", "found")).alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id")
    if rows.empty:
        return [], []
    x = np.zeros((len(rows), len(vocabulary)))
    for i, found in enumerate(rows["found"]):
        x[i, np.asarray(found, int)] = 1
    toxic = rows["label"].to_numpy(float)
    at = np.flatnonzero(toxic > 0)
    own = [i for i, w in enumerate(vocabulary) if x[:, i] @ toxic * (len(toxic) - toxic.sum()) > x[:, i] @ (1 - toxic) * toxic.sum()]
    groups = kinds_of(x[np.ix_(at, own)])
    y = np.zeros((len(rows), KINDS + 1))
    y[at, groups] = 1
    y[:, KINDS] = toxic
    usable = np.array([[w in names for w in vocabulary] for names in map(set, picked[1:])], float)
    return vocabulary, fit_chain(x, y, rows["fold"].to_numpy(int), usable)


def _picked(per_word: DataFrame, fold: int, pos: int, neg: int) -> list[bytes]:
    """The vocabulary by the documents outside a fold."""
    a, b = F.col(f"n1_{fold + 1}"), F.col(f"n0_{fold + 1}")
    odds = F.log((a + 0.5) / (pos - a + 0.5)) - F.log((b + 0.5) / (neg - b + 0.5))
    z = odds / F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (pos - a + 0.5) + 1 / (neg - b + 0.5))
    best = per_word.filter(a + b >= LEAST_DOCS).withColumn("z", F.abs(z)).orderBy(F.desc("z"), "word").limit(VOCABULARY).select("word", "z").collect()
    return [bytes(r["word"]) for i, r in enumerate(best) if i < LEAST_WORDS or r["z"] >= LEAST_Z]


def _scored(vocabulary: list[bytes], models: list[np.ndarray]):
    place = {w: i for i, w in enumerate(vocabulary)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            x = np.zeros((len(texts), len(vocabulary)))
            for i, t in enumerate(texts):
                x[i, [place[w] for w in marks_of(word_set(t), place)]] = 1
            p = apply_chain(models, x) if models else np.zeros((len(texts), len(CHAIN)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p[:, k], pa.float64()) for k in range(len(CHAIN)))], names=["doc_id", *(f"p_{c}" for c in CHAIN)])

    return run


def score(docs: DataFrame, chain: tuple[list[bytes], list[np.ndarray]]) -> DataFrame:
    """Probability of each category and the verdict for every row of ``docs(doc_id, text, ...)``.

    The whole text counts; null and empty texts have no words. Without labels to learn from, all probabilities are 0.
    Repeated rows are scored each; other columns are not read; an empty table gives an empty result.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(docs).alias("text")).mapInArrow(
        _scored(*chain), "doc_id long, " + ", ".join(f"p_{c} double" for c in CHAIN)
    )
    return scored.withColumn("toxic", F.col("p_toxic") >= THRESHOLD)
