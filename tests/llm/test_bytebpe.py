"""The transducer against the tokenizer's own library, the decoder against Python's."""

import hashlib
import random
import struct

import pytest
import tiktoken
from pyspark.sql import functions as F

from panelcast.llm import bytebpe, registry

SF = "/root/testdata/sf0.001"
LONG = ["x" * 50_000, "ab" * 30_000, "word " * 20_000, "é" * 20_000, "日" * 20_000, " " * 30_000 + "a"]


@pytest.fixture(scope="module")
def own():
    return bytebpe.encoder(bytebpe.default_vocabulary(), bytebpe.default_pattern())


@pytest.fixture(scope="module")
def theirs():
    ranks = bytebpe._ranks(bytebpe.default_vocabulary())
    return tiktoken.Encoding("own", pat_str=bytebpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})


def unpacked(ids):
    return list(struct.unpack(f"<{len(ids) // 4}I", ids))


def samples(n):
    rng = random.Random(1)
    marks = [*range(32, 127), 9, 10, 13, 0x1C, 0x85, 0xA0, 0x3000]
    pieces = [" ", "  ", "\n", "\t", "the", "ing", "'s", "'ll", "1", "22", "!!", "é", "日本", "🙂", "ՙ", "\x1c"]
    kinds = (
        lambda: chr(rng.choice(marks)), lambda: chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])), lambda: rng.choice("ab "),
        lambda: rng.choice(pieces), lambda: rng.choice("aeinorst"),
    )
    return ["".join(kinds[k % 5]() for _ in range(rng.randint(0, 30))) for k in range(n)]


def test_random_and_long_texts(own, theirs):
    decoder = bytebpe.decoder(bytebpe.default_vocabulary())
    for text in [*samples(5000), *LONG]:
        ids = unpacked(own.ids(text))
        assert ids == theirs.encode_ordinary(text)
        assert decoder.text(ids) == text


def test_splitter_agrees_on_every_character(own, theirs):
    # a letter, number, mark or space between letters shows its class by where the text is cut
    for start in range(0, 0x110000, 0x400):
        text = "".join(f"a{chr(c)}1{chr(c)} " for c in range(start, start + 0x400) if not 0xD800 <= c < 0xE000)
        assert unpacked(own.ids(text)) == theirs.encode_ordinary(text)


def test_a_small_transducer_gives_the_same(own):
    small = bytebpe.Transducer(bytebpe._ranks(bytebpe.default_vocabulary()), edges=50)
    for text in samples(400):
        for match in own.split(text):
            assert small.run(match.encode()) == own.transducer.run(match.encode())


def test_no_merge_bridges_tokens_side_by_side(own):
    rng, t = random.Random(2), own.transducer

    def merged(text):
        parts = [text[i : i + 1] for i in range(len(text))]
        while best := min(((t.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in t.ranks), default=None):
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [t.ranks[p] for p in parts]

    short = [i for token, i in t.ranks.items() if len(token) <= 4]
    for _ in range(20_000):
        a, b = rng.choice(short), rng.choice(short)
        assert t._beside(a, b) == (merged(t.bytes_of[a] + t.bytes_of[b]) == [a, b])


def test_utf8_in_pieces_like_python(own):
    rng = random.Random(3)
    odd = [0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xF4, 0x90, 0xC0]
    for _ in range(20_000):
        data = bytes(rng.choice([rng.randrange(256), *odd]) for _ in range(rng.randint(0, 12)))
        stream, out, i = bytebpe.Utf8Stream(), "", 0
        while i < len(data):
            j = i + rng.randint(1, 4)
            out, i = out + stream.feed(data[i:j]), j
        assert out + stream.end() == data.decode("utf-8", "replace")


def digests(theirs, text):
    ids = theirs.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_against_the_library(spark, theirs):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.queries()["op12_byte_bpe"](spark, SF).collect()
    assert len(got) == len(texts)
    assert all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digests(theirs, texts[r["doc_id"]]) for r in got)


def test_odd_rows_and_both_ways_apart(spark, theirs):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "x" * 40_000), (4, "x" * 40_000), (None, "日本 🙂 it's"), (5, "ՙa")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("k"), "n_tokens": F.lit(0)})
    got = sorted(((r["doc_id"] or 0, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bytebpe.round_trip(df).collect()))
    assert got == sorted((d or 0, *digests(theirs, t)) for d, t in rows)
    back = bytebpe.decode(bytebpe.encode(df)).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((d or 0, t or "") for d, t in rows)
    assert bytebpe.round_trip(df.limit(0)).count() == 0
