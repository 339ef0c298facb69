"""Quality rules: base counts, and divergence from the language's own character and word distribution.

References come from all documents: for each value of ``lang`` (null is one) with LANGUAGE_DOCS documents and
LANGUAGE_WORDS words or more, the distribution of character classes and that of the WORDS most frequent words (and of all
other words as one). A document is compared with its language's references, its own counts left out of them, by
Jensen-Shannon distance (base 2, so 0 to 1). A language with fewer documents is no reference for itself: its documents
are compared with the character classes of all documents, and their words, of which nothing is known, with nothing.
Guards: the distances judge only documents of at least LEAST_WORDS words and LEAST_CHARS characters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelcast.llm.shared import staged, text_bytes

LANGUAGE_DOCS, LANGUAGE_WORDS = 20, 2000
WORDS = 200
LEAST_WORDS, LEAST_CHARS = 50, 200
#: Largest distances: (a, b) stands for a + b / sqrt(words), as a sample's distance from its own source shrinks.
MOST_CLASS_DISTANCE = (0.20, 0.95)
MOST_WORD_DISTANCE = (0.42, 1.2)
BASE_LEAST_WORDS, BASE_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
CLASSES = 9


def _class_table() -> np.ndarray:
    """Byte -> class: 0 lower, 1 upper, 2 digit, 3 blank, 4 sentence marks, 5 loud marks, 6 symbols, 7 other ASCII, 8 beyond ASCII."""
    table = np.full(256, 7, np.int64)
    table[128:] = 8
    for name, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"()-", b"!?", SYMBOLS)):
        table[list(members)] = name
    return table


_TABLE = _class_table()
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _class_counts(text: bytes) -> np.ndarray:
    return np.bincount(_TABLE[np.frombuffer(text, np.uint8)], minlength=CLASSES)


def base_counts(text: bytes, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words of a text and its words."""
    n = len(words)
    joined = np.frombuffer(b"".join(words), np.uint8)
    word_chars = int((joined & 0xC0 != 0x80).sum())  # bytes that begin a code point
    symbols = int(_SYMBOL[np.frombuffer(text, np.uint8)].sum())
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    repeats = 0
    if n >= 3:
        names: dict[bytes, int] = {}
        ids = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, n)
        _, pair = np.unique(ids[:-1] * len(names) + ids[1:], return_inverse=True)
        _, inverse, count = np.unique(pair[:-1] * len(names) + ids[2:], return_inverse=True, return_counts=True)
        often = count[inverse] >= 2
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= often
        repeats = int(covered.sum())
    return word_chars, symbols, len(lines) - len(set(lines)), repeats


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts (lang, kind, item, n) of a task's batches: kind 'c' for character classes, 'w' for words."""
    held: dict[str | None, tuple[Counter, np.ndarray]] = {}

    def rows():
        for lang, (words, classes) in held.items():
            items = [("w", w, n) for w, n in words.items()] + [("c", b"%d" % i, int(n)) for i, n in enumerate(classes)]
            for at in range(0, len(items), 10_000):
                kinds, names, counts = zip(*items[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(kinds), pa.string()), pa.array(kinds, pa.string()), pa.array(names, pa.binary()), pa.array(counts, pa.int64())], names=["lang", "kind", "item", "n"]
                )

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words, classes = held.setdefault(lang, (Counter(), np.zeros(CLASSES, np.int64)))
            words.update(text.lower().split())
            classes += _class_counts(text)
        if sum(len(w) for w, _ in held.values()) > 200_000:
            yield from rows()
            held = {}
    yield from rows()


#: Of a language: counts of character classes, place of each frequent word, and counts of those words and of all others.
Reference = tuple[np.ndarray, dict[bytes, int], np.ndarray]


def references(docs: DataFrame) -> tuple[dict[str | None, Reference], np.ndarray]:
    """The languages' references and the class counts of all documents.

    CLASSES + WORDS + 1 numbers and WORDS words come to the driver for each language with enough documents: about 10 KB
    for each of the world's few thousand languages at most.
    """
    lang = F.col("lang").cast("string").alias("lang")
    counted = docs.select(lang, text_bytes(docs).alias("text")).mapInArrow(_histograms, "lang string, kind string, item binary, n long")
    counted = staged(counted.groupBy("lang", "kind", "item").agg(F.sum("n").alias("n")), "histograms")
    words = counted.groupBy("lang").agg(F.sum(F.when(F.col("kind") == "w", F.col("n")).otherwise(0)).alias("words"))
    enough = docs.groupBy(lang).agg(F.count("*").alias("docs")).filter(F.col("docs") >= LANGUAGE_DOCS)
    known = enough.alias("d").join(words.alias("w"), F.expr("d.lang <=> w.lang")).filter(F.col("words") >= LANGUAGE_WORDS).select(F.col("d.lang").alias("known"), "words")
    rows = counted.join(known, F.col("lang").eqNullSafe(F.col("known")))
    top = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item"))).filter(F.col("r") <= WORDS)
    found: dict[str | None, list] = {}
    for r in top.select("lang", "kind", "item", "n", "words", "r").collect():
        found.setdefault(r["lang"], []).append(r)
    out = {}
    for key, mine in found.items():
        classes = np.zeros(CLASSES)
        for r in mine:
            if r["kind"] == "c":
                classes[int(bytes(r["item"]))] = r["n"]
        words = sorted((r for r in mine if r["kind"] == "w"), key=lambda r: r["r"])
        out[key] = classes, {bytes(r["item"]): i for i, r in enumerate(words)}, np.array([r["n"] for r in words] + [mine[0]["words"] - sum(r["n"] for r in words)], float)
    everything = np.zeros(CLASSES)
    for r in counted.filter("kind = 'c'").groupBy("item").agg(F.sum("n").alias("n")).collect():
        everything[int(bytes(r["item"]))] = r["n"]
    return out, everything


def _distance(own: np.ndarray, reference: np.ndarray) -> float | None:
    """Distance of a document's counts from a reference without them; null where nothing else is in it."""
    others = np.maximum(reference - own, 0)
    return js_distance(own / own.sum(), others / others.sum()) if own.sum() and others.sum() else None


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return float(np.sqrt(max(parts.sum() / 2, 0)))


def _limit(bound: tuple[float, float], words: int) -> float:
    return bound[0] + bound[1] / words**0.5


def _judged(found: dict[str | None, Reference], everything: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                counts = base_counts(text, words)
                n, repeats = len(words), counts[3]
                failed = n < BASE_LEAST_WORDS or 100 * repeats > BASE_REPEAT_PERCENT * n
                by_class = by_word = None
                if n >= LEAST_WORDS and len(text) >= LEAST_CHARS:
                    classes, place, share = found.get(lang, (everything, None, None))
                    by_class = _distance(_class_counts(text), classes)
                    if place is not None:
                        rest = len(place)
                        by_word = _distance(np.bincount([place.get(w, rest) for w in text.lower().split()], minlength=rest + 1), share)
                far = by_class is not None and by_class > _limit(MOST_CLASS_DISTANCE, n) or by_word is not None and by_word > _limit(MOST_WORD_DISTANCE, n)
                kept = not failed and not far
                rows.append((n, *counts, failed, kept, by_class, by_word))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"],
            )

    return run


def judge(docs: DataFrame) -> DataFrame:
    """Base counts, distances and verdict of every row of ``docs(doc_id, text, lang, ...)``.

    Null, empty and blank texts have no words and fail the base rule; distances of documents below the guards, and those to
    nothing, are null and do not count against them. A null lang is a language of its own. Repeated rows are judged each; other
    columns are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_bytes(docs).alias("text"))
    return rows.mapInArrow(
        _judged(*references(docs)),
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM (
        SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)))
    WHERE k > 1) GROUP BY 1),
l AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY 1),
base AS (
  SELECT d.*, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(l.n_dup_lines, 0) AS n_dup_lines, coalesce(r.n_repeat_words, 0) AS n_repeat_words, strlen(t) AS n_bytes FROM d LEFT JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words >= 50 AND n_bytes >= 200 AS guarded FROM base),
marks AS (
  SELECT doc_id, lang, strlen(t) AS n_bytes, strlen(t) - strlen(regexp_replace(t, '[a-z]', '', 'g')) AS c0, strlen(t) - strlen(regexp_replace(t, '[A-Z]', '', 'g')) AS c1, strlen(t) - strlen(regexp_replace(t, '[0-9]', '', 'g')) AS c2,
         strlen(t) - strlen(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS c3, strlen(t) - strlen(regexp_replace(t, '[.,;:''"()-]', '', 'g')) AS c4, strlen(t) - strlen(regexp_replace(t, '[!?]', '', 'g')) AS c5,
         strlen(t) - strlen(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS c6, strlen(t) - strlen(regexp_replace(t, '[^\x00-\x7F]', '', 'g')) AS c8 FROM d),
classes AS (SELECT doc_id, lang, unnest(range(9)) AS item, unnest([c0, c1, c2, c3, c4, c5, c6, n_bytes - c0 - c1 - c2 - c3 - c4 - c5 - c6 - c8, c8]) AS n FROM marks),
words AS (
  SELECT doc_id, lang, translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS item, count(*) AS n FROM (SELECT doc_id, lang, unnest(w) AS x FROM d) GROUP BY ALL),
per AS (SELECT lang, sum(n_words) AS total FROM judged GROUP BY 1 HAVING count(*) >= 20 AND sum(n_words) >= 2000),
top AS (
  SELECT lang, item, n FROM (SELECT w.lang, w.item, sum(w.n) AS n, row_number() OVER (PARTITION BY w.lang ORDER BY sum(w.n) DESC, w.item) AS k FROM words w JOIN per ON per.lang IS NOT DISTINCT FROM w.lang GROUP BY w.lang, w.item)
  WHERE k <= 200),
shares AS (
  SELECT lang, item, n FROM top UNION ALL SELECT per.lang, NULL, per.total - (SELECT sum(n) FROM top WHERE top.lang IS NOT DISTINCT FROM per.lang) FROM per),
mine AS (
  SELECT w.doc_id, t.item, sum(w.n) AS n FROM words w LEFT JOIN top t ON t.lang IS NOT DISTINCT FROM w.lang AND t.item = w.item GROUP BY 1, 2),
known AS (SELECT CASE WHEN per.total IS NULL THEN NULL ELSE j.doc_id END AS known_id, j.doc_id, j.lang, j.n_words, j.n_bytes FROM judged j LEFT JOIN per ON per.lang IS NOT DISTINCT FROM j.lang WHERE j.guarded),
by_word AS (
  SELECT k.doc_id, coalesce(m.n, 0)::DOUBLE / k.n_words AS p, (s.n - coalesce(m.n, 0))::DOUBLE / (sum(s.n) OVER (PARTITION BY k.doc_id) - k.n_words) AS q
  FROM known k JOIN shares s ON s.lang IS NOT DISTINCT FROM k.lang LEFT JOIN mine m ON m.doc_id = k.doc_id AND m.item IS NOT DISTINCT FROM s.item WHERE k.known_id IS NOT NULL),
class_sums AS (SELECT c.lang, c.item, sum(c.n) AS n FROM classes c GROUP BY 1, 2),
by_class AS (
  SELECT k.doc_id, c.n::DOUBLE / k.n_bytes AS p, (s.n - c.n)::DOUBLE / (sum(s.n) OVER (PARTITION BY k.doc_id) - k.n_bytes) AS q
  FROM known k JOIN classes c ON c.doc_id = k.doc_id
  JOIN (SELECT lang, item, n, true AS own FROM class_sums UNION ALL SELECT NULL, item, sum(n), false FROM class_sums GROUP BY item) s
    ON s.item = c.item AND s.own = (k.known_id IS NOT NULL) AND (NOT s.own OR s.lang IS NOT DISTINCT FROM k.lang)),
distances AS (
  SELECT doc_id, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) AS distance, kind
  FROM (SELECT *, 'class' AS kind FROM by_class UNION ALL SELECT *, 'word' FROM by_word) GROUP BY doc_id, kind)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed, round(c.distance, 6) AS class_distance, round(v.distance, 6) AS word_distance,
       NOT j.base_failed AND coalesce(c.distance <= 0.20 + 0.95 / sqrt(j.n_words), true) AND coalesce(v.distance <= 0.42 + 1.2 / sqrt(j.n_words), true) AS kept
FROM judged j LEFT JOIN distances c ON c.doc_id = j.doc_id AND c.kind = 'class' LEFT JOIN distances v ON v.doc_id = j.doc_id AND v.kind = 'word'
"""
