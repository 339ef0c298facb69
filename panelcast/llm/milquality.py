"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words; every passage of the whole text is encoded by a small network over its
words and word pairs, hashed to BUCKETS, and its character and repetition statistics: the network's first layer is a
learned projection of them. Gated attention gives each passage a weight; the weighted mean of the passage codes is
scored by a logistic layer. Only document labels are needed: the attention weights are learned with the rest, by
full-batch gradient steps.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.shared import staged, text_bytes

PASSAGE = 128
#: Labelled documents that the model is fitted on: the first so many by a hash of the id.
TRAIN_DOCS = 4000
#: Passages that they may have together, so that the fit's memory is bounded: documents that would exceed it are passed over.
TRAIN_PASSAGES = 40_000
#: Buckets of hashed words and word pairs, and their standard deviation where a statistic's is 1: there are many of them,
#: and few labelled documents may be all that is known.
BUCKETS, BUCKET_WEIGHT = 96, 0.3
CODE, GATE = 12, 6
STEPS, RATE, DECAY = 400, 0.03, 1e-4
THRESHOLD = 0.3
_CLASSES = 10


def _class_table() -> np.ndarray:
    """Byte -> class: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 sentence marks, 6 loud marks, 7 symbols, 8 other ASCII, 9 beyond ASCII."""
    table = np.full(256, 8, np.int64)
    table[128:] = 9
    for name, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"()-", b"!?", b"#*$%&|<>")):
        table[list(members)] = name
    return table


_TABLE = _class_table()
STATISTICS = _CLASSES + 6
FEATURES = STATISTICS + BUCKETS
_CACHE_WORDS = 100_000
#: Passages, or somewhat more, that a task scores at a time.
AT_ONCE = 1024


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.lower()) & 0x7FFFFFFF
        return h


_hashes = _WordHashes()


def encode(text: bytes) -> np.ndarray:
    """A row of FEATURES statistics for each passage of the text; one row of an empty passage if it has no word."""
    words = text.split()
    n = max(1, -(-len(words) // PASSAGE))
    raw = np.frombuffer(text, np.uint8)
    kinds = _TABLE[raw]
    blank = (kinds == 3) | (kinds == 4)
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]])) if len(raw) else np.empty(0, np.int64)
    passage = np.zeros(len(raw), np.int64)
    heads = starts[PASSAGE::PASSAGE]
    passage[heads] = 1
    passage = np.cumsum(passage)
    counts = np.bincount(passage * _CLASSES + kinds, minlength=n * _CLASSES)[: n * _CLASSES].reshape(n, _CLASSES).astype(float)
    size = np.maximum(counts.sum(axis=1), 1)
    out = np.zeros((n, FEATURES), np.float32)
    out[:, :_CLASSES] = np.sqrt(counts / size[:, None])
    if words:
        h = np.fromiter(map(_hashes.__getitem__, words), np.int64, len(words))
        pairs = (h[:-1] * 31 + h[1:] * 17) >> 3
        at = np.arange(len(words)) // PASSAGE
        seen = np.bincount(np.concatenate([at, at[1:]]) * BUCKETS + np.concatenate([h, pairs]) % BUCKETS, minlength=n * BUCKETS).reshape(n, BUCKETS)
        out[:, STATISTICS:] = np.sqrt(seen / np.maximum(seen.sum(axis=1, keepdims=True), 1))
    for i in range(n):
        part = words[i * PASSAGE : (i + 1) * PASSAGE]
        if part:
            k = len(part)
            often = Counter(part)
            out[i, _CLASSES:STATISTICS] = (
                len(often) / k,
                max(often.values()) / k,
                sum(map(operator.eq, part, part[1:])) / k,
                size[i] / k / 10,
                np.log1p(k) / 5,
                len({w[-1:] for w in part}) / 30,
            )
    return out


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 100):
            part = batch.slice(at, 100)
            codes = [encode(t).ravel() for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(codes, pa.list_(pa.float32()))], names=["doc_id", "label", "code"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Gated-attention network on numpy arrays."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7):
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        rng = np.random.default_rng(seed)
        shapes = {"W": (FEATURES, CODE), "c": (CODE,), "V": (CODE, GATE), "U": (CODE, GATE), "w": (GATE,), "b": (CODE,), "b0": (1,)}
        self.p = {k: rng.normal(0, 0.3, s) if len(s) > 1 or k in "wb" else np.zeros(s) for k, s in shapes.items()}

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """x: passages of all bags, one after the other; starts: first passage of each bag."""
        p = self.p
        sizes = np.diff(np.append(starts, len(x)))
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ p["W"] + p["c"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(h * a[:, None], starts)
        return sizes, h, t, g, a, z, _sigmoid(z @ p["b"] + p["b0"][0])

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return self.forward(x, starts)[-1]

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> Model:
        p = self.p
        xs = np.clip((x - self.mean) / self.scale, -8, 8)
        m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
        for step in range(1, STEPS + 1):
            sizes, h, t, g, a, z, s = self.forward(x, starts)
            dz0 = (s - y) / len(y)
            dz = dz0[:, None] * p["b"]
            dz_rows = np.repeat(dz, sizes, axis=0)
            da = (dz_rows * h).sum(axis=1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
            dgt = de[:, None] * p["w"]
            dt, dg = dgt * g * (1 - t * t), dgt * t * g * (1 - g)
            dh = dz_rows * a[:, None] + dt @ p["V"].T + dg @ p["U"].T
            dpre = dh * (1 - h * h)
            grad = {"W": xs.T @ dpre, "c": dpre.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "b": z.T @ dz0, "b0": dz0.sum(keepdims=True)}
            for k, v in grad.items():
                v = v + DECAY * p[k] * (k != "b0")
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
        return self


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id as text is a multiple of 5; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """The model of at most TRAIN_DOCS labelled documents that are not held out, none of them longer than a twentieth of
    TRAIN_PASSAGES; a constant where there are no labels of both kinds."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("label"))
    known = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS), "labelled")  # bounded, so it may be broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(docs).alias("text")).join(F.broadcast(known), "doc_id")
    rows = texts.select("doc_id", "label", "text").mapInArrow(_encoded, "doc_id long, label int, code array<float>")
    rows = staged(rows.groupBy("doc_id").agg(F.min(F.struct("label", "code")).alias("r")).select("doc_id", "r.*"), "bags")
    # at most TRAIN_DOCS rows, in the order of the sample
    so_far = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.size("code") / FEATURES
    within = rows.select("doc_id", size.alias("passages")).filter(F.col("passages") <= TRAIN_PASSAGES // 20).withColumn("total", F.sum("passages").over(so_far)).filter(F.col("total") <= TRAIN_PASSAGES)
    rows = rows.join(F.broadcast(within.select("doc_id")), "doc_id", "left_semi").toPandas().sort_values("doc_id")
    y = rows["label"].to_numpy(float)
    if len(set(y)) < 2:
        return float(y.mean()) if len(y) else 0.5
    bags = [np.asarray(c, np.float32).reshape(-1, FEATURES) for c in rows["code"]]
    x = np.concatenate(bags)
    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
    scale = x.std(axis=0) + 1e-3
    scale[STATISTICS:] /= BUCKET_WEIGHT
    return Model(x.mean(axis=0), scale).fit(x, starts, y)


def _score_texts(model: Model | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            scores, bags, held = [], [], 0
            for i, text in enumerate(batch.column(at).to_pylist(), 1):
                if isinstance(model, float):
                    scores.append(model)
                    continue
                bags.append(encode(text))
                held += len(bags[-1])
                if held >= AT_ONCE or i == batch.num_rows:
                    starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
                    scores.extend(model.score(np.concatenate(bags), starts).tolist())
                    bags, held = [], 0
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[n for n in batch.schema.names if n != "text"] + ["score"])

    return run


def score(docs: DataFrame, model: Model | float) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from THRESHOLD on) of every row of ``docs(doc_id, text, ...)``.

    The whole text counts, in passages of PASSAGE words; null, empty and blank texts are one empty passage. Only the
    text enters the score. Repeated rows are scored each; other columns are not read; an empty table gives an
    empty result.
    """
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(docs).alias("text")).mapInArrow(_score_texts(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _keep_good(model: Model | float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = _score_texts(model)
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column("text").fill_null(b"")], names=["text"])
            for scored in inner(iter([texts])):
                yield batch.filter(pa.array(scored.column("score").to_numpy() >= THRESHOLD))

    return run


def drop_poor(docs: DataFrame, model: Model | float) -> DataFrame:
    """``docs`` without the rows that the model predicts to be poor; all columns stay."""
    binary = docs.withColumn("text", F.col("text").cast("binary"))
    return binary.mapInArrow(_keep_good(model), binary.schema).withColumn("text", F.col("text").cast("string"))
