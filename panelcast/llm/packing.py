"""Best-fit packing of tokenised documents by hierarchical residual packing.

Every task packs the pieces of its own partition by best fit, largest first. Bins that are nearly full, or too full for
the smallest one left anywhere, are done. The others become items of the next round, in which fewer tasks pack the bins
of several former ones; rounds go on up the tree until one task has seen all that is left, or nothing could be merged
any more. A task never holds more than WINDOW pieces or about ROUND_BINS bins, whatever the input's size.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.shared import staged, text_bytes

CAPACITY = 2048
END_ID = 0
#: A bin with at most so many free places is done.
NEARLY_FULL = 8
#: Pieces that a task packs at once, and bins that a task of a later round gets on average.
WINDOW = 200_000
ROUND_BINS = 20_000
#: Former tasks whose bins meet in one task of the next round, at least.
FAN_IN = 8
#: Bytes, by estimate, of each of the two generations of a worker's cache of chunks, and the longest chunk that enters it.
CACHE_BYTES, ENTRY_BYTES = 48_000_000, 180
LONGEST_CHUNK = 64

ITEM = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
_BINS = "sequence_id long, fill int, done boolean, items array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>>"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_letters() -> dict[int, str]:
    """Byte -> the character by which a byte-level vocabulary writes it: printable Latin-1 as itself, the others in
    order from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Letters of ASCII and Latin-1, then other printable ASCII marks but the apostrophe: one word and one run of marks.
_WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")


class _ChunkIds(dict):
    """Ids, as little-endian bytes, of a run of bytes without ASCII white space. The tokenizer's words never cross
    white space, so a text's ids are those of its runs, one after the other. A run that is one plain word, with
    marks behind it or not, goes straight to the tokenizer's model; all others through the whole tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.held = 0
        self.older: dict[bytes, bytes] = {}

    def _word(self, word: str) -> bytes:
        text = word.lower()
        if not text.isascii():
            text = "".join(self.letters[b] for b in text.encode())
        ids = [t.id for t in self.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._encoded(chunk)
        if len(chunk) <= LONGEST_CHUNK:
            self.held += ENTRY_BYTES + len(chunk) + len(ids)
            if self.held > CACHE_BYTES:  # what is in use comes back from the older generation
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[chunk] = ids
        return ids

    def _encoded(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        if (m := _WORD.fullmatch(text)) and m[2]:
            ids = self._word(m[1]) + self[m[2].encode()]
        elif m:
            ids = self._word(m[1])
        else:
            found = self.tokenizer.encode(text, add_special_tokens=False).ids
            ids = struct.pack(f"<{len(found)}I", *found)
        return ids


@functools.cache
def _chunk_ids(path: str) -> _ChunkIds:
    """One cache for all tasks of a worker."""
    return _ChunkIds(path)


def token_bytes(text: bytes, ids: _ChunkIds) -> bytes:
    return b"".join(map(ids.__getitem__, text.split())) + END_ID.to_bytes(4, "little")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit decreasing. Returns each item's bin and the number of bins.

    A bit of ``open_at`` stands for each free size that some bin has, so the tightest bin is found by a shift.
    """
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_at, n = 0, 0
    order = np.argsort(-sizes, kind="stable")
    bins = np.empty(len(sizes), np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        if fits := open_at >> size:
            left = size + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                open_at &= ~(1 << left)
        else:
            left, b, n = capacity, n, n + 1
        bins[i] = b
        left -= size
        if left:
            free[left].append(b)
            open_at |= 1 << left
    return bins, n


def _bins(sizes: np.ndarray, starts: np.ndarray, items: pa.StructArray, first_id: int, last: bool) -> pa.RecordBatch:
    """Pack units (each a run of ``items`` from starts[i] to starts[i + 1]) and lay out the bins."""
    bins, n = best_fit(sizes, CAPACITY)
    order = np.argsort(bins, kind="stable")
    counts = np.diff(starts)[order]
    ends = np.cumsum(counts)
    take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[:-1][order] - (ends - counts), counts)
    items = items.take(pa.array(take))
    length = items.field("length").to_numpy()
    per_bin = np.bincount(np.repeat(bins[order], counts), minlength=n)
    heads = np.concatenate([[0], np.cumsum(per_bin)]).astype(np.int32)
    before = np.cumsum(length) - length
    offset = before - np.repeat(before[heads[:-1]] if n else before, per_bin)
    fill = np.bincount(bins, weights=sizes, minlength=n).astype(np.int32)
    columns = [items.field(i) for i in range(5)] + [pa.array(offset, pa.int64())]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(first_id + np.arange(n), pa.int64()),
            pa.array(fill),
            pa.array((fill >= CAPACITY - NEARLY_FULL) | last),
            pa.ListArray.from_arrays(pa.array(heads), pa.StructArray.from_arrays(columns, fields=list(ITEM))),
        ],
        names=["sequence_id", "fill", "done", "items"],
    )


def _first_id(turn: int) -> int:
    return (turn << 56) | (TaskContext.get().partitionId() << 32)


def _pack_texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at = _chunk_ids(path), _first_id(0)
        rows: list[tuple] = []

        def packed():
            nonlocal at, rows
            columns = list(zip(*rows, strict=True))
            items = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip([*columns, [0] * len(rows)], ITEM, strict=True)], fields=list(ITEM))
            out = _bins(np.array(columns[3], np.int64), np.arange(len(rows) + 1), items, at, False)
            at, rows = at + out.num_rows, []
            # rows of at most a few thousand bins go out at once
            return [out.slice(i, 4096) for i in range(0, out.num_rows, 4096)]

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = token_bytes(text, ids)
                for piece, start in enumerate(range(0, len(t), 4 * CAPACITY)):
                    part = t[start : start + 4 * CAPACITY]
                    rows.append((doc_id, piece, start // 4, len(part) // 4, zlib.crc32(part)))
            if len(rows) >= WINDOW:
                yield from packed()
        if rows:
            yield from packed()

    return run


def _merge_bins(turn: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, n = _first_id(turn), [], 0

        def packed():
            nonlocal at, held, n
            t = pa.Table.from_batches(held).combine_chunks()
            lists = t.column("items").chunk(0)
            flat = lists.flatten()
            flat = pa.StructArray.from_arrays([flat.field(i) for i in range(len(ITEM))], fields=list(ITEM))
            sizes = t.column("fill").to_numpy().astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            out = _bins(sizes, starts, flat, at, last)
            at, held, n = at + out.num_rows, [], 0
            return [out.slice(i, 4096) for i in range(0, out.num_rows, 4096)]

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= 4 * ROUND_BINS:
                yield from packed()
        if n:
            yield from packed()

    return run


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Pack all rows of ``docs(doc_id, text, ...)`` into sequences of at most CAPACITY tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is
    the closing id alone. Repeated rows are packed each; a null doc_id stays null; other columns are not read; an
    empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(docs).alias("text"))
    bins = staged(docs.mapInArrow(_pack_texts(tokenizer or default_tokenizer()), _BINS), "bins")
    turn, tasks, done = 0, max(1, bins.rdd.getNumPartitions()), None
    while True:
        # a bin without room for the smallest one that is left cannot take part any more
        least = bins.filter("NOT done").agg(F.min("fill")).first()[0]
        ready = F.col("done") | (F.col("fill") > CAPACITY - (least or 0))
        done = bins.filter(ready) if done is None else done.union(bins.filter(ready))
        left = bins.filter(~ready)
        count = left.count()
        if not count:
            break
        turn += 1
        tasks = max(-(-count // ROUND_BINS), min(tasks // FAN_IN, count), 1)
        bins = staged(left.select("fill", "items").repartition(tasks).mapInArrow(_merge_bins(turn, tasks == 1), _BINS), "bins")
        if tasks > 1 and bins.count() == count:  # no two of the bins that met fit together
            done = done.union(bins)
            break
    return done.select("sequence_id", F.explode("items").alias("i")).select("i.doc_id", "i.piece", "i.start", "i.length", "i.ids_crc32", "sequence_id", "i.offset")
