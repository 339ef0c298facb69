"""Byte-level BPE by a lazily determinised transducer, and decoding by an incremental UTF-8 state machine.

A text is cut by the vocabulary's pattern; every match runs through the transducer byte by byte. Where BPE ends a prefix
in token t, the encoding of any longer prefix that has a boundary there goes on from t, and two tokens may stand side by
side just when BPE leaves their joined bytes as these two. So a state is a tree of possible boundaries: those from which
the bytes read since then still begin a longer token, each with the token before it. Reading a byte adds the one boundary
that the new prefix ends in and drops those that no token can span any more; what all survivors share is settled and
is emitted. The lookahead is bounded by the tokens' length. States and edges are made when first needed and kept.
"""

from __future__ import annotations

import base64
import functools
import gc
import hashlib
import marshal
import re
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.shared import text_bytes

#: Edges of the transducer that a worker keeps; it is grown anew from the current state beyond them.
EDGES = 500_000
#: Bytes, by estimate, of each of the two generations of a worker's cache of matches, and the longest that enters it.
CACHE_BYTES, ENTRY_BYTES, LONGEST_MATCH = 45_000_000, 200, 64

def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@functools.cache
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _members(library_probe: str) -> np.ndarray:
    """Code points of a Unicode class as the ``tiktoken`` library knows them."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    probe = tiktoken.Encoding("probe", pat_str=library_probe, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return np.array(sorted(map(ord, bytes(probe.encode_ordinary(every)).decode())))


def _ranges(at: np.ndarray) -> str:
    heads = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    tails = np.append(heads[1:] - 1, len(at) - 1)
    return "".join(f"\\U{at[a]:08x}-\\U{at[b]:08x}" for a, b in zip(heads.tolist(), tails.tolist(), strict=True))


class Splitter:
    """Matches of the pattern in a text. The tables of ``regex`` and of the tokenizer's own library are of different
    Unicode versions: texts with characters that the two class differently are split by classes spelled out in full,
    plain ASCII by a pattern of ASCII classes."""

    KINDS = (r"\p{L}", r"\p{N}")

    def __init__(self, pattern: str):
        import regex

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        members = {k: _members(k) for k in self.KINDS}
        self.differ = {c for k in self.KINDS for c in {*map(chr, members[k].tolist())} ^ {*regex.findall(k, every)}}
        self.whole = regex.compile(pattern).findall
        self.exact = regex.compile(self._spelled({k: _ranges(members[k]) for k in self.KINDS}, pattern)).findall
        self.ascii = re.compile(self._spelled({k: _ranges(members[k][members[k] < 128]) for k in self.KINDS}, pattern), re.ASCII).findall

    @staticmethod
    def _spelled(members: dict[str, str], pattern: str) -> str:
        def put(m: re.Match) -> str:
            inside = m[0].startswith("[")
            return functools.reduce(lambda part, k: part.replace(k, members[k] if inside else f"[{members[k]}]"), members, m[0])

        return re.sub(r"\[[^\]]*\]|\\p\{\w\}", put, pattern)

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        return self.whole(text) if self.differ.isdisjoint(text) else self.exact(text)


class Transducer:
    """Bytes to ids of a vocabulary given by ranks in which every token is made by merges of lower rank.

    A state's nodes are (offset in the pending bytes, token that ends there, index of the boundary before it); the
    first is the last settled boundary.
    """

    def __init__(self, ranks: dict[bytes, int], edges: int = EDGES):
        self.ranks, self.limit = ranks, edges
        self.begins = {t[:i] for t in ranks for i in range(len(t))}
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.first_parts = functools.cache(lambda t: self._edge_parts(t, 0))
        self.last_parts = functools.cache(lambda t: self._edge_parts(t, 1))
        self.beside = functools.lru_cache(1 << 16)(self._beside)
        self._restart()

    def _restart(self) -> None:
        #: States as marshal's bytes, which take a fifth of the room of their tuples.
        self.numbers: dict[bytes, int] = {}
        self.states: list[bytes] = []
        self.rest: list[bytes] = []
        #: state * 256 + byte -> next state, ids that are settled by it
        self.edges: dict[int, tuple[int, bytes]] = {}
        self.start = self._number(b"", ((0, -1, -1),))

    def _number(self, pending: bytes, nodes: tuple) -> int:
        state = marshal.dumps((pending, nodes), 2)
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            found = []
            node = nodes[-1]  # the boundary at the end of what was read
            while node[2] >= 0:
                found.append(node[1])
                node = nodes[node[2]]
            self.rest.append(struct.pack(f"<{len(found)}I", *reversed(found)))
        return n

    def halves(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts whose merge makes the token."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            i = min((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.ranks and a + b != token)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def _edge_parts(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at an end of the token (0: its first byte, 1: its last one) while it is made: every part with the
        rank of the merge that takes it."""
        part, taken, found = self.bytes_of[token], float("inf"), []
        while True:
            found.append((part, taken))
            if len(part) == 1:
                return found[::-1]
            taken = self.ranks[part]
            part = self.halves(part)[side]

    def _beside(self, left: int, right: int) -> bool:
        """Whether no merge bridges the seam of two tokens. Merges go by rank, the leftmost first among equals."""
        ls, rs = self.last_parts(left), self.first_parts(right)
        i = j = 0
        while True:
            (a, a_taken), (b, b_taken) = ls[i], rs[j]
            bridge = self.ranks.get(a + b)
            if bridge is not None and bridge < a_taken and bridge <= b_taken:
                return False
            if i == len(ls) - 1 and j == len(rs) - 1:
                return True
            if a_taken <= b_taken:
                i += 1
            else:
                j += 1

    def _grow(self, at: int, byte: int) -> tuple[int, bytes]:
        pending, nodes = marshal.loads(self.states[at])
        if len(self.edges) >= self.limit:
            self._restart()
            at = self._number(pending, nodes)
        pending += bytes([byte])
        for i, (offset, before, _) in enumerate(nodes):
            token = self.ranks.get(pending[offset:])
            if token is not None and (before < 0 or self.beside(before, token)):
                nodes = (*nodes, (len(pending), token, i))
                break
        else:
            raise ValueError("the vocabulary's tokens are not all made by merges of lower rank")
        # survivors, and what lies between them and the settled boundary
        living = [pending[n[0] :] in self.begins for n in nodes]
        needed = list(living)
        for i in range(len(nodes) - 1, 0, -1):
            if needed[i]:
                needed[nodes[i][2]] = True
        root, settled = 0, []
        while not living[root]:
            children = [i for i in range(root + 1, len(nodes)) if needed[i] and nodes[i][2] == root]
            if len(children) > 1:
                break
            root = children[0]
            settled.append(nodes[root][1])
        start = nodes[root][0]
        place = {root: 0}
        kept = [(0, nodes[root][1] if living[root] else -1, -1)]
        for i in range(root + 1, len(nodes)):
            if needed[i] and nodes[i][2] in place:
                place[i] = len(kept)
                kept.append((nodes[i][0] - start, nodes[i][1], place[nodes[i][2]]))
        edge = self._number(pending[start:], tuple(kept)), struct.pack(f"<{len(settled)}I", *settled)
        self.edges[at << 8 | byte] = edge
        return edge

    def run(self, text: bytes) -> bytes:
        """Ids of one match as little-endian unsigned 32-bit integers."""
        at, out = self.start, []
        for byte in text:
            edge = self.edges.get(at << 8 | byte) or self._grow(at, byte)
            at = edge[0]
            if edge[1]:
                out.append(edge[1])
        out.append(self.rest[at])
        return b"".join(out)


class Encoder(dict):
    """Ids of the pattern's matches; those in use are kept, in two generations of bounded size."""

    def __init__(self, path: str, pattern: str):
        self.transducer, self.split = Transducer(_ranks(path)), Splitter(pattern)
        self.held, self.older = 0, {}

    def __missing__(self, match: str) -> bytes:
        ids = self.older.get(match)
        if ids is None:
            ids = self.transducer.run(match.encode())
        if len(match) <= LONGEST_MATCH:
            self.held += ENTRY_BYTES + len(match) + len(ids)
            if self.held > CACHE_BYTES:
                self.older = dict(self)
                self.clear()
                self.held = 0
            self[match] = ids
        return ids

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))


def _utf8_states() -> tuple[list[dict[int, int]], int]:
    """Transitions of well-formed UTF-8 by the ranges of each lead byte's first trailing byte; state 0 is between
    characters, a missing transition is an error."""
    trail = range(0x80, 0xC0)
    states: list[dict[int, int]] = [{b: 0 for b in range(0x80)}, {b: 0 for b in trail}]
    states += [{b: 1 for b in trail}, {b: 2 for b in trail}]
    states[0] |= {b: 1 for b in range(0xC2, 0xE0)} | {b: 2 for b in range(0xE1, 0xF0)} | {b: 3 for b in range(0xF1, 0xF4)}
    for lead, onward, first in ((0xE0, 1, range(0xA0, 0xC0)), (0xED, 1, range(0x80, 0xA0)), (0xF0, 2, range(0x90, 0xC0)), (0xF4, 2, range(0x80, 0x90))):
        states[0][lead] = len(states)
        states.append({b: onward for b in first})
    return states, len(states)


class Utf8Stream:
    """Text of bytes that come in pieces. A character is given out with its last byte; each longest piece that begins a
    character and goes wrong, and every other stray byte, becomes U+FFFD."""

    STATES, _ = _utf8_states()

    def __init__(self):
        self.state, self.held = 0, b""

    def feed(self, piece: bytes) -> str:
        state, start, out, data = self.state, 0, [], self.held + piece
        good = 0  # up to here all is well-formed since start
        i = len(self.held)
        while i < len(data):
            onward = self.STATES[state].get(data[i])
            if onward is None:
                out.append(data[start:good].decode() + "�")
                i = i if i > good else i + 1  # a byte that cannot follow is read again as a first one
                state, start, good = 0, i, i
                continue
            state = onward
            i += 1
            if state == 0:
                good = i
        out.append(data[start:good].decode())
        self.state, self.held = state, data[good:]
        return "".join(out)

    def end(self) -> str:
        left, self.state, self.held = self.held, 0, b""
        return "�" if left else ""


class Decoder:
    """Text of ids. Tokens that are whole characters are joined as they are; the state machine reads the others."""

    def __init__(self, path: str):
        tokens = {r: t for t, r in _ranks(path).items()}
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.whole = np.array([self._whole(t) for t in self.tokens])

    @staticmethod
    def _whole(token: bytes) -> bool:
        stream = Utf8Stream()
        return "�" not in stream.feed(token) and not stream.held

    def pieces(self, ids: Iterable[int]) -> Iterator[str]:
        ids = np.asarray(ids, np.int64)
        stream = Utf8Stream()
        at, apart = 0, np.flatnonzero(~self.whole[ids])
        for k in apart.tolist():
            if at < k:
                yield stream.feed(self.tokens[ids[at]])
                yield b"".join(map(self.tokens.__getitem__, ids[at + 1 : k].tolist())).decode()
            yield stream.feed(self.tokens[ids[k]])
            at = k + 1
        if at < len(ids):
            yield stream.feed(self.tokens[ids[at]])
            yield b"".join(map(self.tokens.__getitem__, ids[at + 1 :].tolist())).decode()
        yield stream.end()

    def text(self, ids: Iterable[int]) -> str:
        return "".join(self.pieces(ids))


@functools.cache
def encoder(path: str, pattern: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, pattern)


@functools.cache
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _by_row(work: Callable[[pa.RecordBatch], list[pa.Array]], names: list[str]):
    """Few rows at a time, as texts may be long. The tables that grew meanwhile are left out of garbage collection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:1], *work(part)], names=names)
                gc.freeze()

    return run


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(docs).alias("text"))


def _ids(texts: pa.Array, path: str, pattern: str) -> list[bytes]:
    own = encoder(path, pattern)
    return [own.ids(t.decode("utf-8", "replace")) for t in texts.to_pylist()]


def _texts(ids: list[bytes | None], path: str) -> list[str]:
    own = decoder(path)
    return [own.text(np.frombuffer(x or b"", "<u4")) for x in ids]


def encode(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, and ids as little-endian unsigned 32-bit integers, of every row of ``docs(doc_id, text, ...)``.

    Null and empty texts have no ids. Bytes that are not UTF-8 count as U+FFFD. Repeated rows are encoded each, a null
    doc_id stays null, other columns are not read, an empty table gives an empty result.
    """
    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()
    return _read(docs).mapInArrow(_by_row(lambda b: [pa.array(_ids(b.column(1), path, pattern), pa.binary())], ["doc_id", "ids"]), "doc_id long, ids binary")


def decode(rows: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of ``rows(doc_id, ids)``; null ids count as none. Every id must be one of the vocabulary's."""
    path = vocabulary or default_vocabulary()
    return rows.select("doc_id", "ids").mapInArrow(_by_row(lambda b: [pa.array(_texts(b.column(1).to_pylist(), path), pa.string())], ["doc_id", "text"]), "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and digests of every document's ids and of the bytes that they decode to; rows as in ``encode``.
    Both ways in one worker, so that ids and texts are not sent to and fro."""
    path, pattern = vocabulary or default_vocabulary(), pattern or default_pattern()

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        ids = _ids(batch.column(1), path, pattern)
        digests = [hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(x.encode()).hexdigest() for x in _texts(ids, path)]
        return [pa.array([len(x) // 4 for x in ids], pa.int64()), *map(pa.array, digests)]

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return _read(docs).mapInArrow(_by_row(work, names), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
