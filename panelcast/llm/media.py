"""Media columns: types by signature sniffing.

An Aho-Corasick pass over the stored bytes locates magic bytes; a validator of the format walks its structure from
there and gives the object's length, or rejects it. The object at the start corrects the declared type; those further
in are embedded media, carved by their spans.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.shared import text_bytes

#: Magic bytes by format.
MAGIC = {
    "image/png": (b"\x89PNG\r\n\x1a\n",),
    "image/jpeg": (b"\xff\xd8\xff",),
    "image/gif": (b"GIF87a", b"GIF89a"),
    "image/bmp": (b"BM",),
    "audio/wav": (b"RIFF",),
    "application/gzip": (b"\x1f\x8b\x08",),
}
BLOCK = 192
EMBEDDED = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
RATE = 8000


def _png(b: bytes, at: int) -> int | None:
    pos = at + 8
    first = True
    while pos + 12 <= len(b):
        size, kind = struct.unpack_from(">I4s", b, pos)
        end = pos + 12 + size
        if end > len(b) or (first and (kind != b"IHDR" or size != 13)) or zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if kind == b"IEND":
            return end - at
        pos, first = end, False
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    pos = at + 2
    scan = False
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        if mark == 0xD9:
            return pos + 2 - at if scan else None
        pos += 2 + struct.unpack_from(">H", b, pos + 2)[0]
        if mark == 0xDA:
            scan = True
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b) and (b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0:
                return None
            if b[pos : pos + 2] == b"\xff\xd9":
                return pos + 2 - at
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    pos = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return pos + 1 - at
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 <= len(b):
            pos += 11 + (3 << ((b[pos + 9] & 7) + 1) if b[pos + 9] & 0x80 else 0)
        else:
            return None
        while pos < len(b) and b[pos]:
            pos += b[pos] + 1
        pos += 1
    return None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, _, offset, header, width, height, planes, depth = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if planes != 1 or header not in (40, 108, 124) or depth not in (1, 4, 8, 16, 24, 32) or not 54 <= offset <= size <= len(b) - at:
        return None
    return size if width > 0 and height and offset + (width * depth + 31) // 32 * 4 * abs(height) <= size else None


def wav_data(b: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """(length of the whole object, start and length of its samples) of the WAV at ``at``."""
    if at + 12 > len(b) or b[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    pos, depth = at + 12, 0
    while pos + 8 <= end <= len(b):
        kind, size = struct.unpack_from("<4sI", b, pos)
        if pos + 8 + size > end:
            return None
        if kind == b"fmt " and size >= 16:
            depth = struct.unpack_from("<H", b, pos + 22)[0]
        if kind == b"data":
            return (end - at, pos + 8, size) if depth in (8, 16, 24, 32) else None
        pos += 8 + size + size % 2
    return None


def _wav(b: bytes, at: int) -> int | None:
    found = wav_data(b, at)
    return found and found[0]


def _gzip(b: bytes, at: int) -> int | None:
    plain = zlib.decompressobj(31)
    pos = at
    try:
        while pos < len(b) and not plain.eof:
            rest = b[pos : pos + 65536]
            while rest:  # in bounded parts: the plain form may be huge
                plain.decompress(rest, 1 << 20)
                rest = plain.unconsumed_tail
            pos += 65536
    except zlib.error:
        return None
    return min(pos, len(b)) - len(plain.unused_data) - at if plain.eof else None


_VALID = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "audio/wav": _wav, "application/gzip": _gzip}


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, forms in MAGIC.items():
        for form in forms:
            found.add_word(form.decode("latin-1"), (kind, len(form)))
    found.make_automaton()
    return found


def sniff(stored: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of every valid object in the bytes; objects within another of their own type's payload
    count as well, as they are embedded."""
    out = []
    for end, (kind, size) in _automaton().iter(stored.decode("latin-1")):
        at = end + 1 - size
        length = _VALID[kind](stored, at)
        if length is not None:
            out.append((kind, at, length))
    return out


def payload(text: bytes) -> bytes:
    return text + b" " * (max(-(-len(text) // BLOCK), 1) * BLOCK - len(text))


def to_wav(samples: bytes) -> bytes:
    """Mono PCM with one byte a sample."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples))
    return head + samples


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # bounded copies
            part = batch.slice(at, 256)
            texts = part.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([to_wav(payload(t)) for t in texts], pa.binary()), pa.array(["application/octet-stream"] * len(texts))],
                names=["doc_id", "n_bytes", "media", "declared"],
            )


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (the text's bytes as the samples of a WAV) and a declared type that says nothing."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(docs).alias("text")).mapInArrow(_store, "doc_id long, n_bytes long, media binary, declared string")


def _identified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        media, declared = batch.column("media").to_pylist(), batch.column("declared").to_pylist()
        objects = [sniff(m) if m is not None else [] for m in media]
        actual = [next((k for k, s, _ in found if s == 0), d) for found, d in zip(objects, declared, strict=True)]
        inner = [[{"type": k, "start": s, "length": n} for k, s, n in found if s] for found in objects]
        shape = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(actual, pa.string()), pa.array(inner, shape)], names=[*batch.schema.names, "actual", "embedded"])


def identify(table: DataFrame) -> DataFrame:
    """Adds actual (type by structure; the declared one where nothing is recognised) and embedded (spans of carved
    objects) to ``table(media, declared, ...)``. Null and empty media: nothing recognised, nothing embedded."""
    return table.mapInArrow(_identified, T.StructType([*table.schema.fields, T.StructField("actual", T.StringType()), T.StructField("embedded", EMBEDDED)]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, n, stored, actual, inner in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "actual", "embedded")), strict=True):
            _, start, length = wav_data(stored)
            back = stored[start : start + length]
            kinds = ",".join(f"{x['type']}@{x['start']}+{x['length']}" for x in inner)
            feature = f"{actual};samples={length};level={np.frombuffer(back, np.uint8).sum()};embedded={kinds}"
            rows.append((doc_id, n, length, hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
            names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )


def features(docs: DataFrame) -> DataFrame:
    """Stores every text of ``docs(doc_id, text, ...)`` as media, identifies it and reads it back.

    Null and empty texts are one block of blanks. Equal texts give equal values; repeated rows are stored each; other
    columns are not read; an empty table gives an empty result.
    """
    return identify(store_texts(docs)).mapInArrow(
        _features, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def carve(table: DataFrame) -> DataFrame:
    """A row per embedded object of ``identify(table)``: the table's columns without media, and type, start, length, content."""
    rows = table.withColumn("object", F.explode("embedded"))
    content = F.substring(F.col("media"), (F.col("object.start") + 1).cast("int"), F.col("object.length").cast("int"))
    kept = [c for c in table.columns if c not in ("media", "embedded")]
    return rows.select(*kept, F.col("object.type").alias("object_type"), F.col("object.start").alias("object_start"), F.col("object.length").alias("object_length"), content.alias("content"))
