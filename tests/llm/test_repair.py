"""Conversation repair against a plain recursion over suffixes."""

import functools
import hashlib
import random
import re
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from panelcast.llm import registry, repair

SF = "/root/testdata/sf0.001"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
GO = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows):
    """(cost, audit, repaired lines) of [(role, text, must go, truncated)]: every edit is tried at every place."""

    @functools.cache
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for role in ("user", "assistant"):
            if inserts < 3 and (state, role[0]) in GO and (rest := best(i, GO[state, role[0]], inserts + 1)):
                found.append((3 + rest[0], "I" + rest[1], (f"{role}:", *rest[2])))
        if i < len(rows):
            role, text, must_go, truncated = rows[i]
            if rest := best(i + 1, state, 0):
                found.append((4 + rest[0], "D" + rest[1], rest[2]))
            for name, cost, edit in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                if not must_go and (state, name[:1]) in GO and (rest := best(i + 1, GO[state, name[:1]], 0)):
                    found.append((cost + 3 * truncated + rest[0], edit + rest[1], (f"{name}:{text}", *rest[2])))
        return min(found, default=None)

    return best(0, "", 0)


def plain(rows):
    """conv_id -> the row of the contract, of [(conv_id, turn, role, text)]."""
    spoken = lambda x: " " if x is None else str(x)
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = spoken(role), spoken(text)
        what = zlib.crc32(f"{spoken(conv)}:{spoken(turn)}".encode()) % 20
        by[conv] += [(turn is not None, turn or 0, "user" if what == 4 else role, "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text)] * (0 if what == 0 else 2 if what == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort()
        seen, judged, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            bare = text.strip(SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                n[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for known, t, _, _ in own if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
        cost, audit, lines = cheapest(tuple(judged))
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def test_query_against_the_recursion(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(registry.queries()["op13_conversation_repair"](spark, SF)) == plain(rows)


def test_random_conversations(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No!", "and so", "  ", "", None, "Why?", "end. \n", "open ,", "日本", "ja。"]
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    rows = [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(600) for t in (rng.sample(range(-3, 12), rng.randint(0, 7)) or [None])]
    rows += [(c, None, "user", "No turn.") for c in range(0, 600, 7)] + [(None, t, rng.choice(roles), rng.choice(texts)) for t in range(6)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"times": F.lit(9), "own": F.lit("x"), "fault": F.lit(1)})
    assert got(repair.repair(df)) == plain(rows)
    assert repair.repair(df.limit(0)).count() == 0


def test_repeated_rows_and_ids_of_text(spark):
    rows = [("a:1", 1, "user", "Hi there."), ("a:1", 1, "user", "Hi there."), ("a:1", 2, "assistant", "Hello."), ("b", 1, None, None)]
    assert got(repair.repair(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))) == plain(rows)


def test_trellis_on_long_rows_of_one_role():
    rng = random.Random(3)
    for _ in range(300):
        rows = tuple((rng.choice(["user", "user", "assistant", "system"]), f"t{i}", rng.random() < 0.2, rng.random() < 0.2) for i in range(rng.randint(1, 40)))
        trellis = repair.Trellis()
        for role, text, must_go, truncated in rows:
            trellis.read(role[:1], role.encode(), text.encode(), must_go, truncated)
        cost, audit, lines = cheapest(rows)
        assert trellis.end() == (cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_settled_edits_are_let_go():
    trellis, most = repair.Trellis(), 0
    for i in range(30_000):
        role = ("user", "assistant")[i % 2]
        trellis.read(role[0], role.encode(), b"Text %d." % i, i % 50 == 7, i % 11 == 3)
        most = max(most, trellis.open_edits())
    assert most < 400 and len(trellis.audit) > 29_000
