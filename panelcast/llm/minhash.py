"""Near-duplicate groups by MinHash with tensored banding, every link confirmed on full shingle sets.

Two small collections of half keys (``HALVES`` keys of ``WIDTH`` minhashes each) are computed for a document.
Each pair of a key of the first and a key of the second is the key of one table, so HALVES**2 tables cost only
2 * HALVES * WIDTH minhashes. A pair of documents with similarity s shares no table with probability of about
2 * (1 - s**WIDTH)**HALVES: four in a million at s = 0.75.

Steps, each over all documents:

1. shingle sets, their 128-bit fingerprint (documents with equal sets are one *node*) and half keys;
2. half keys that only one node has cannot meet another node and are left out, and so are nodes without a key left in
   either collection; the keys of the others are paired into table keys, and tables with the same members count once;
3. all members of a table are compared with one pivot, which joins large groups at a cost linear in their size;
4. half keys that do not meet another component any more are left out, and nodes that cannot reach one are peeled off
   by shingle counts. What is left is held by half key, a few rows a node, and compared with the node of the key that
   shares most of its shingles: the likely origin of its copies;
5. the same again, then every pair that still crosses two components and shares a key of the first collection is looked
   at in blocks, and compared unless exact upper bounds rule it out;
6. compared means: the intersection of full sets against 100 * both >= 75 * either. Components follow by
   large-star and small-star steps.

No bucket or candidate list has a cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.shared import Scratch, small_or_not, text_bytes

SHINGLE = 5
HALVES = 24
WIDTH = 3
SIMILAR_PERCENT = 75
#: Hash bins of a node's shingle counts, and nodes of a bucket that are compared with each other at a time.
BINS = 128
BLOCK = 2048
#: Entries of a worker's word-hash cache before it starts anew.
CACHE_WORDS = 200_000

#: Rows whose sets a task holds at a time.
SLICE = 1000

_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: bytes, words: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: of five words each, or of all words if there are fewer."""
    found = text.lower().split()  # bytes: lower() changes A-Z only, split() cuts at x20 and x09-x0D
    n = len(found)
    if not n:
        return np.empty(0, _U)
    w = np.fromiter(map(words.__getitem__, found), _U, n)
    size = min(n, SHINGLE)
    h = np.full(n - size + 1, size, _U)
    with np.errstate(over="ignore"):
        for i in range(size):
            h = h * _STEP + w[i : n - size + 1 + i]
        return np.unique(_mixed(h))


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_229)
    return rng.integers(0, 2**63, count, dtype=_U) * _U(2) + _U(1), rng.integers(0, 2**63, count, dtype=_U)


def half_keys(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """2 * HALVES keys, each from WIDTH minhashes; the position in the list is part of the key."""
    low = np.full(len(a), 2**64 - 1, _U)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 512):
            low = np.minimum(low, (h[at : at + 512, None] * a[None, :] + b[None, :]).min(axis=0))
        low = _mixed(low).reshape(2 * HALVES, WIDTH)
        key = np.arange(1, 2 * HALVES + 1, dtype=_U)
        for i in range(WIDTH):
            key = _mixed(key * _STEP + low[:, i])
    return key.view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, (a, b) = _WordHashes(), _functions(2 * HALVES * WIDTH)
    for batch in batches:
        sizes, high, low, keys = [], [], [], []
        for text in batch.column(2).to_pylist():
            h = shingle_hashes(text, words)
            sizes.append(len(h))
            if not len(h):
                high.append(None), low.append(None), keys.append(None)
                continue
            with np.errstate(over="ignore"):
                marks = b"%d %d %d" % (len(h), int(_mixed(h + _STEP).sum(dtype=_U)), int(np.bitwise_xor.reduce(_mixed(h * _STEP))))
            mark = xxhash.xxh3_128_intdigest(marks)
            high.append((mark >> 64) - 2**63), low.append((mark & (2**64 - 1)) - 2**63), keys.append(half_keys(h, a, b))
        long = pa.int64()
        columns = [pa.array(sizes, long), pa.array(high, long), pa.array(low, long), pa.array(keys, pa.list_(long))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["doc_id", "text_key", "n_shingles", "high", "low", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = _WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            sets = [shingle_hashes(t, words).view(np.int64) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (what tells rows of one doc_id apart), text as bytes."""
    text = text_bytes(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("text_key"), text.alias("text"))


def _same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Rows of ``left`` joined to ``right`` by doc_id and text_key, where null ids are equal."""
    right = right.withColumnsRenamed({"doc_id": "r_id", "text_key": "r_key"})
    out = left.join(small_or_not(right), F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("text_key") == F.col("r_key")), how)
    return out.drop("r_id", "r_key")


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, high and low (the fingerprint, null without shingles), keys of every row of ``docs``."""
    return _keyed(docs).mapInArrow(_sketches, "doc_id long, text_key string, n_shingles long, high long, low long, keys array<long>")


def _nodes(sketched: DataFrame) -> DataFrame:
    """A row per distinct shingle set: node (a number), high, low, keys, copies and the least of its rows by doc_id (nulls last)."""
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    known = sketched.filter("high IS NOT NULL").groupBy("high", "low").agg(F.first("keys").alias("keys"), F.count("*").alias("copies"), F.min(row).alias("row"))
    return known.withColumn("node", F.monotonically_increasing_id())


def _halves(live: DataFrame) -> DataFrame:
    """(node, side, key): the half keys of ``live(node, first, second)``, a row each."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("first").alias("keys")), F.struct(F.lit(1).alias("side"), F.col("second").alias("keys")))
    return live.select("node", F.explode(sides).alias("s")).select("node", "s.side", F.explode("s.keys").alias("key"))


def _live(half: DataFrame, value: str) -> DataFrame:
    """(node, first, second): half keys that meet in two values of a column or more, of the nodes with some in both collections."""
    met = half.groupBy("key").agg(F.min(value).alias("lo"), F.max(value).alias("hi")).filter("lo <> hi").select("key")
    live = half.join(met, "key", "left_semi").groupBy("node").agg(
        F.collect_set(F.when(F.col("side") == 0, F.col("key"))).alias("first"), F.collect_set(F.when(F.col("side") == 1, F.col("key"))).alias("second")
    )
    return live.filter("size(first) > 0 AND size(second) > 0")


def _once(rows: DataFrame, value: str) -> DataFrame:
    """Buckets of ``rows(bucket, node, ..)`` that hold two values of a column or more; of buckets with the same nodes, one."""
    members = (
        rows.groupBy("bucket")
        .agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("m"))
        .filter("lo <> hi")
    )
    return members.groupBy("m", "n", "x").agg(F.min("bucket").alias("bucket")).select("bucket", F.col("n").alias("size"))


def _tables(live: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, node) of all tables with two nodes or more; tables with equal members appear once."""
    paired = live.select("node", F.explode("first").alias("a"), "second").select("node", "a", F.explode("second").alias("b"))
    paired = paired.select("node", F.xxhash64("a", "b").alias("bucket"))
    return scratch.staged(paired.join(scratch.staged(_once(paired, "node"), "buckets"), "bucket", "left_semi"), "tables")


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            sets = part.column(1)
            row = np.repeat(np.arange(len(sets)), sets.value_lengths().to_numpy())
            counts = np.bincount(row * BINS + (sets.flatten().to_numpy() & (BINS - 1)), minlength=len(sets) * BINS).astype("<u4").reshape(-1, BINS)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([c.tobytes() for c in counts], pa.binary())], names=["node", "bins"])


def _compared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of one group's nodes, of the left with the right block, that their counts do not rule out."""
    lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
    node, comp, n, c = (pdf[k].to_numpy() for k in ("node", "comp", "n", "c"))
    bins = np.frombuffer(b"".join(pdf["bins"]), "<u4").reshape(-1, BINS)
    block = pdf["block"].to_numpy()
    left, right = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    out = []
    for at in range(0, len(left), 256):
        i = left[at : at + 256, None]
        most = np.minimum(c[i], c[right])
        ok = (comp[i] != comp[right]) & (100 * most >= SIMILAR_PERCENT * (n[i] + n[right] - most)) & ((lo != hi) | (i < right))
        x, y = np.nonzero(ok)
        for k in range(0, len(x), 65536):
            a, b = left[at + x[k : k + 65536]], right[y[k : k + 65536]]
            shared = np.minimum(bins[a], bins[b]).sum(axis=1, dtype=np.int64)
            good = 100 * shared >= SIMILAR_PERCENT * (n[a] + n[b] - shared)
            out.append(pd.DataFrame({"node": node[a[good]], "pivot": node[b[good]]}))
    return pd.concat(out) if out else pd.DataFrame({"node": [], "pivot": []}, dtype="int64")


def _by_half_key(live: DataFrame, alive: DataFrame, scratch: Scratch) -> DataFrame:
    """(bucket, node, comp, n, c, size) of the half keys of the first collection that still meet in two components."""
    rows = scratch.staged(live.select("node", F.explode("first").alias("bucket")).join(alive, "node"), "members")
    return rows.join(scratch.staged(_once(rows, "comp"), "crossing"), "bucket")


def _with_pivots(rows: DataFrame) -> DataFrame:
    """Pairs of a bucket's nodes with its pivot, the node with the largest share of shingles in other components."""
    best = F.max(F.struct((F.col("c") / F.col("n")).alias("r"), F.xxhash64("node").alias("h"), F.col("node").alias("pivot"), F.col("comp").alias("pcomp"), F.col("n").alias("pn"), F.col("c").alias("pc"))).alias("p")
    pivots = rows.groupBy("bucket").agg(best).select("bucket", "p.pivot", "p.pcomp", "p.pn", "p.pc")
    most = F.least("c", "pc")  # no more than c of a node's n shingles are in another component
    return rows.join(pivots, "bucket").filter("comp <> pcomp").filter(100 * most >= SIMILAR_PERCENT * (F.col("n") + F.col("pn") - most)).select("node", "pivot")


def _possible_pairs(rows: DataFrame, alive: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of nodes in different components that share a half key of the first collection and that no bound rules out.

    Two bounds hold for the shingles that two nodes share: c of either node, and the sum over BINS hash bins of the
    lesser count. Buckets are compared block by block within tasks, so only possible pairs are rows; they are a
    superset of the pairs that share a table.
    """
    binned = sets.join(alive.select("node"), "node", "left_semi").select("node", "shingles").mapInArrow(_bins, "node long, bins binary")
    rows = rows.join(binned, "node").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "comp", "n", "c", "bins")
    return rows.groupBy("bucket", "lo", "hi").applyInPandas(_compared, "node long, pivot long")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose full shingle sets are similar enough."""
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a"
    )
    small, large = F.least(F.size("sa"), F.size("sb")), F.greatest(F.size("sa"), F.size("sb"))
    near = both.filter(100 * small >= SIMILAR_PERCENT * large).withColumn("common", F.size(F.array_intersect("sa", "sb")))
    return near.filter(100 * F.col("common") >= SIMILAR_PERCENT * (F.size("sa") + F.size("sb") - F.col("common"))).select("a", "b")


def _may_cross(members: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp, n, c) of the nodes that can have a link to another component at all: n shingles, c of them in
    two components or more.

    A link needs SIMILAR_PERCENT of a node's shingles in one node of another component, so a node with fewer
    shingles that occur in two components has none. Nodes that drop out take their shingles with them; the count is
    repeated until hardly any drops out. The work is linear in the shingles, whatever the size of the groups: a shingle
    of very many nodes is a pair of minimum and maximum before any shuffle, and one of a list of crossing shingles after.
    """
    alive = scratch.staged(members, "alive")
    count = alive.count()
    while count:
        items = sets.join(alive.select("node", "comp"), "node").select("node", "comp", F.size("shingles").alias("n"), F.explode("shingles").alias("s")).repartition("s")
        crossing = items.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("s")
        held = items.join(crossing, "s", "left_semi").groupBy("node", "comp", "n").agg(F.count("*").alias("c"))
        alive = scratch.staged(held.filter(100 * F.col("c") >= SIMILAR_PERCENT * F.col("n")), "alive")
        before, count = count, alive.count()
        if count >= 0.95 * before:
            break
    return alive if "c" in alive.columns else alive.withColumns({"n": F.lit(1), "c": F.lit(1)})


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of every node of ``edges(a, b)``; comp is the component's least node.

    Large-star and small-star steps alternate, each with a partially aggregated minimum and a join, until the edges
    stay the same. Every round is a table in the shared folder.
    """
    edges = scratch.staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    before = None
    while True:
        print_now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(print_now) == before:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("comp")).union(edges.select("u", "u").distinct())
        before = tuple(print_now)
        sides = edges.union(edges.select("u", "v")).toDF("x", "y")
        least = sides.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
        large = sides.filter("y > x").join(least, "x").select(F.col("y").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v")
        small = small.select(F.col("u").alias("v"), F.col("m").alias("u")).union(least.select("v", F.col("m").alias("u")))
        edges = scratch.staged(small.filter("u <> v").distinct(), "edges")


def _linked(nodes: DataFrame, docs: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(node, comp) of the nodes with a link to another one, None if there are none."""
    half = nodes.select("node", F.posexplode("keys").alias("pos", "key")).select("node", (F.col("pos") >= HALVES).cast("int").alias("side"), "key")
    live = scratch.staged(_live(half, "node"), "halves")
    tables = _tables(live, scratch)
    first = nodes.join(tables.select("node").distinct(), "node", "left_semi").select("node", "row.doc_id", "row.text_key")
    first = scratch.staged(first, "first")
    texts = _same_row(_keyed(docs), first, "inner").select("node", "text")
    sets = scratch.staged(texts.mapInArrow(_sets, "node long, shingles array<long>").dropDuplicates(["node"]), "sets")

    comps = links = None
    for turn in ("table", "half key", "blocks"):
        if turn == "table":
            pivots = tables.groupBy("bucket").agg(F.max(F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("pivot"))).alias("p"))
            pairs = tables.join(pivots.select("bucket", "p.pivot"), "bucket").filter("node <> pivot").select("node", "pivot")
        else:
            half = _halves(live)
            half = half.withColumn("comp", F.col("node")) if comps is None else half.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            live = scratch.staged(_live(half, "comp"), "halves")
            members = live.select("node") if comps is None else live.select("node").join(comps, "node", "left")
            alive = _may_cross(members.select("node", F.col("node").alias("comp") if comps is None else F.coalesce("comp", "node").alias("comp")), sets, scratch)
            rows = _by_half_key(live, alive, scratch)
            pairs = _with_pivots(rows) if turn == "half key" else _possible_pairs(rows, alive, sets)
        pairs = scratch.staged(pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "pairs")
        if turn == "table":
            scratch.drop(tables)
        if pairs.isEmpty():
            continue
        found = scratch.staged(_similar(pairs, sets), "links")
        if found.isEmpty():
            continue
        links = found if links is None else links.union(found)
        comps = scratch.staged(components(links, scratch), "components")
    return comps


def _grouped(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_key, n_shingles of every row, and for rows in a group of two or more: first_id and first_key (the group's
    least row by doc_id, null ids last), grouped (true). Leaves nothing else in ``scratch``."""
    sketched = scratch.staged(sketches(docs), "sketches")
    nodes = scratch.staged(_nodes(sketched), "nodes")
    comps = _linked(nodes, docs, scratch)
    known = nodes.select("high", "low", "node", "copies", "row")
    known = known.withColumn("comp", F.col("node")) if comps is None else known.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    firsts = known.groupBy("comp").agg(F.min("row").alias("first"), F.sum("copies").alias("rows")).filter("rows > 1")
    groups = known.join(firsts, "comp").select("high", "low", F.col("first.doc_id").alias("first_id"), F.col("first.text_key").alias("first_key"), F.lit(True).alias("grouped"))
    groups = small_or_not(scratch.staged(groups, "groups"))
    out = sketched.select("doc_id", "text_key", "n_shingles", "high", "low").join(groups, ["high", "low"], "left").drop("high", "low")
    out = scratch.staged(out, "grouped")
    scratch.drop_all(out)
    return out


def near_groups(docs: DataFrame) -> DataFrame:
    """Group all rows of ``docs(doc_id, text, ...)`` by near-duplicate links.

    Returns doc_id, n_shingles, component_id (least doc_id reachable over links, own included) and kept
    (doc_id = component_id). Null or empty texts and texts of white space only: no shingles, linked with nothing.
    Equal rows and equal texts are linked (similarity 1); rows that repeat a doc_id each get a row, by their own text. A
    null doc_id is grouped like any other but never named as component; where a component has no other id, component_id
    is null and kept is true. Other columns are not read. An empty table gives an empty result.
    """
    out = _grouped(docs, Scratch(docs.sparkSession)).withColumn("component_id", F.when(F.col("grouped"), F.col("first_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each near-duplicate group, the least by doc_id (null ids last); all columns stay as they are.

    Rows that repeat a kept row's doc_id and text are copies of it and go too; rows without words are in no group and stay.
    """
    scratch = Scratch(docs.sparkSession)
    rows = _grouped(docs, scratch).filter("grouped")
    first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    gone = scratch.staged(rows.filter(~first).select("doc_id", "text_key").distinct(), "dropped")
    again = scratch.staged(rows.filter(first).groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key"), "repeated")
    scratch.drop_all(gone, again)
    named = docs.select(F.struct(*docs.columns).alias("whole"), F.col("doc_id").cast("long").alias("doc_id"), F.md5(text_bytes(docs)).alias("text_key"))
    left = _same_row(named, gone, "left_anti")
    once = _same_row(left, again, "left_anti").union(_same_row(left, again, "left_semi").dropDuplicates(["doc_id", "text_key"]))
    return once.select("whole.*")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN m ON m.x = doc_id
"""
