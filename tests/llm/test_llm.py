"""Corpus operators against brute force, on the smallest tables and on odd rows."""

import hashlib
import html as entities
import io
import math
import re
import wave
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.llm import html, media, milquality, minhash, mixing, packing, pii, rules, sharding, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None, None, None, None), (2, "", "en", "s", 0), (3, "  \n\t ", "en", "s", 5), (4, "One two", "en", None, 7), (4, "one TWO", "xx", None, 7), (None, "one two", "en", "s", 7),
    (5, "Mail a@b.co now", "en", "s", 15), (6, "word " * 30_000, "en", "s", 150_000), (7, "äöü 日本 🙂 " * 40, "de", "t", 400), (8, "x" * 50_000, "en", "t", 50_000), (8, "x" * 50_000, "en", "t", 50_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r for r in docs.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return rows.withColumns({"shard": F.lit(1), "node": F.lit("x"), "score": F.lit(0.5), "size": F.lit(None).cast("int"), "keys": F.lit("k"), "rank": F.lit(3)})


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def groups(rows):
    """doc_id -> least doc_id reachable, by all pairs."""
    sets = [(r["doc_id"], shingles(r["text"])) for r in rows]
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[top(i)] = top(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(sets):
        least[top(i)].append(d)
    return {d: min(least[top(i)]) for i, (d, _) in enumerate(sets)}


def test_near_groups_against_all_pairs(docs, texts):
    got = {r["doc_id"]: r for r in minhash.near_groups(docs).collect()}
    assert {d: r["component_id"] for d, r in got.items()} == groups(list(texts.values()))
    assert all(r["n_shingles"] == len(shingles(texts[d]["text"])) and r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_chains_are_one_group(spark):
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(words[i * 3 : i * 3 + 60])) for i in range(12)]  # each like its neighbour only
    got = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_large_group_of_edited_copies(spark):
    rng = np.random.default_rng(0)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(150):
        w = list(base)
        for k in rng.choice(150, rng.integers(0, 9), replace=False):
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups([{"doc_id": d, "text": t} for d, t in rows])


def test_near_groups_of_odd_rows(odd, spark):
    got = minhash.near_groups(odd).collect()
    assert len(got) == len(ODD)
    by = defaultdict(set)
    for r in got:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"], r["kept"]))
    assert by[1] == by[1] & {(0, 1, True)} and by[2] == {(0, 2, True)} and by[3] == {(0, 3, True)}
    assert by[4] == {(1, 4, True)} and by[None] == {(1, 4, False)}
    assert minhash.near_groups(odd.limit(0)).count() == 0


def test_repeated_and_null_ids_are_grouped_by_their_own_texts(spark):
    x, y = [f"x{i}" for i in range(60)], [f"y{i}" for i in range(60)]
    near = lambda w: " ".join([*w[:-1], "z"])
    rows = [(1, " ".join(x)), (1, " ".join(y)), (2, near(x)), (3, near(y)), (None, "a b c d e f g h"), (7, "a b c d e f g h"), (None, "q r s t u v"), (None, "q r s t u v w x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("whole", F.lit(1))
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_groups(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 7, False), (7, 7, True), (None, None, True), (None, None, True)], key=str)
    kept = [(r["doc_id"], r["text"]) for r in minhash.drop_near_copies(df.union(df)).collect()]
    assert sorted(kept, key=str) == sorted([rows[i] for i in (0, 1, 5, 6, 7)], key=str)


def test_drop_near_copies_keeps_one_of_each_group(docs, texts):
    kept = {r["doc_id"] for r in minhash.drop_near_copies(docs).collect()}
    assert kept == set(groups(list(texts.values())).values())


def article(page):
    body = page.split("<article>")[1].split("</article>")[0]
    body = re.sub(r"</?b>", "", re.sub(r"<(/?(p|h1)|br)[^>]*>", " ", body))
    return " ".join(entities.unescape(body).split())


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    html_of = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html.extract(pages).collect():
        assert r["text"] == article(html_of[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_template_text_is_dropped_without_an_article_element(spark):
    page = '<html><body><div id="top"><span>Our Site</span></div><div class="box"><div>{}</div><p>Sign up today for our weekly letter</p></div><div class="comments"><p>nice {}</p></div></body></html>'
    rows = [(i, f"http://h.example/{i}", page.format(f"Story number {i} is about {i * 7} things", i)) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Story number 3 is about 21 things"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (3, "http://a.b/c", "plain &amp; simple"), (4, "http://a.b/c", "<p>open <b>bold<br>x<script>var a='</p>'</script><!-- c --><p title='a>b'>y&nbsp;&#233;"), (4, "http://a.b/c", "<" * 2000), (5, "http://a.b", "<div>" * 3000 + "deep")]
    got = [(r["page_id"], r["text"]) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1))).collect()]
    assert len(got) == 6 and (1, "") in got and (2, "") in got and (3, "plain & simple") in got and (4, "open bold x y é") in got and (5, "deep") in got


def test_tree_matching_pairs_inserted_nodes():
    assert html.align("page(div,p,footer)", "page(div,aside,p,footer)") == (0, 1, -1, 2, 3)


def test_packing_is_exact_and_tight(docs, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    rows = packing.pack(docs).collect()
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    for d, r in texts.items():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        parts = sorted(pieces[d], key=lambda p: p["piece"])
        assert [p["start"] for p in parts] == list(range(0, len(ids), 2048))
        for p in parts:
            part = ids[p["start"] : p["start"] + 2048]
            assert p["length"] == len(part) and p["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
    assert len(seqs) <= math.ceil(sum(r["length"] for r in rows) / 2048) * 1.01 + 1


def test_chunks_give_the_tokenizers_ids():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    ids, t = packing._ChunkIds(packing.default_tokenizer()), packing._tokenizer(packing.default_tokenizer())

    @settings(max_examples=1500, deadline=None)
    @given(st.text(st.sampled_from("abcXYZ'sSt 09.,!?<|>éàÉßñøµªſςΣİ\u0301\u0085 \t\n\x0b\x1c日🙂-_\"`") | st.characters(codec="utf-8"), max_size=30))
    def same(text):
        assert np.frombuffer(packing.token_bytes(text.encode(), ids), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids + [0]

    same()


def test_best_fit_uses_the_tightest_bin():
    bins, n = packing.best_fit(np.array([1200, 1000, 800, 900, 48]), 2048)
    assert n == 2 and bins[0] == bins[2] == bins[4] and bins[1] == bins[3]


def test_packing_of_odd_rows(odd):
    rows = packing.pack(odd).collect()
    assert len({(r["doc_id"], r["piece"]) for r in rows}) < len(rows) and sum(r["doc_id"] in (1, 2, 3) for r in rows) == 3
    assert packing.pack(odd.limit(0)).count() == 0


def test_media_round_trip(docs, texts):
    for r in media.features(docs).collect():
        text = (texts[r["doc_id"]]["text"] or "").encode()
        padded = text + b" " * (max(-(-len(text) // 192), 1) * 192 - len(text))
        buffer = io.BytesIO()
        with wave.open(buffer, "wb") as out:
            out.setnchannels(1), out.setsampwidth(1), out.setframerate(media.RATE)
            out.writeframes(padded)
        stored = buffer.getvalue()
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(text), len(padded), len(stored))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(padded[-16:]) and r["feature"].startswith("audio/wav;")


def test_sniffing_corrects_types_and_carves(spark):
    import gzip
    import struct

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
    gif = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
    jpg = b"\xff\xd8\xff\xe0\0\x04ab\xff\xda\0\x04ab1\xff\x002\xff\xd9"
    cases = [png, gif, jpg, gzip.compress(b"hello"), media.to_wav(b"ab" * 96)]
    assert [media.sniff(c)[0] for c in cases] == [(k, 0, len(c)) for k, c in zip(("image/png", "image/gif", "image/jpeg", "application/gzip", "audio/wav"), cases)]
    assert media.sniff(png[:-3]) == [] and media.sniff(b"BM is not a picture, nor is RIFF") == []
    rows = [(1, b"junk" + png + b"more" + gif, "image/jpeg"), (2, None, "x"), (3, jpg, None), (4, b"", "y")]
    found = media.identify(spark.createDataFrame(rows, "id int, media binary, declared string"))
    got = {r["id"]: r for r in found.collect()}
    assert got[3]["actual"] == "image/jpeg" and got[1]["actual"] == "image/jpeg" and got[2]["actual"] == "x"
    carved = {(r["object_type"], bytes(r["content"])) for r in media.carve(found).collect()}
    assert carved == {("image/png", png), ("image/gif", gif)}


def hilbert(point, bits):
    """Index by walking the curve's definition: rotate and flip the sub-cube of each level (Butz, via Gray codes)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    return int("".join(str(x[i] >> b & 1) for b in range(bits - 1, -1, -1) for i in range(n)), 2)


def test_the_curve_visits_neighbours(spark):
    cube = spark.range(512).select((F.col("id") % 8).alias("x"), (F.col("id") / 8).cast("int").alias("y0")).select("x", (F.col("y0") % 8).alias("y"), (F.col("y0") / 8).cast("int").alias("z"))
    rows = cube.withColumn("h", sharding.hilbert_index([F.col("x"), F.col("y"), F.col("z")], 3)).orderBy("h").collect()
    assert [r["h"] for r in rows] == list(range(512))
    assert all(sum(abs(a[c] - b[c]) for c in "xyz") == 1 for a, b in zip(rows, rows[1:]))
    assert all(r["h"] == hilbert((r["x"], r["y"], r["z"]), 3) for r in rows)


def test_shards_are_even_and_gapless(docs, texts, odd):
    for frame, n in ((docs, len(texts)), (odd, len(ODD))):
        rows = sharding.assign_shards(frame).collect()
        assert len(rows) == n
        slots = defaultdict(list)
        for r in rows:
            slots[r["shard"]].append((r["slot"], r["curve"]))
        counts = [len(slots[s]) for s in range(40)]
        assert max(counts) - min(counts) <= 1
        assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in slots.values())
        order = [c for s in range(40) for _, c in sorted(slots[s])]
        assert order == sorted(order)
    for r in sharding.assign_shards(docs).collect():
        raw = texts[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    assert sharding.assign_shards(odd.limit(0)).count() == 0


def test_base_counts_and_verdicts(docs, texts, labels):
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    for r in rules.judge(docs).collect():
        text = texts[r["doc_id"]]["text"]
        w = WORD.findall(text)
        at = defaultdict(list)
        for i in range(len(w) - 2):
            at[tuple(w[i : i + 3])].append(i)
        covered = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert expected == tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w)) and not (r["base_failed"] and r["kept"])
        if quality.get(r["doc_id"]) == 1 and not r["base_failed"]:
            assert r["kept"]


def plain_distance(own, others):
    p, q = ({k: v / sum(c.values()) for k, v in c.items() if v} for c in (own, others))
    m = {k: (p.get(k, 0) + q.get(k, 0)) / 2 for k in {*p, *q}}
    return math.sqrt(max(sum(v * math.log2(v / m[k]) for d in (p, q) for k, v in d.items()) / 2, 0))


def test_distances_and_verdicts_against_plain_counting(docs, texts):
    def kind(b):
        for i, members in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"()-", b"!?", b"#*$%&|<>")):
            if b in members:
                return i
        return 8 if b > 127 else 7

    lower = lambda t: t.encode().lower().split()
    classes, words = defaultdict(Counter), defaultdict(Counter)
    for r in texts.values():
        classes[r["lang"]].update(map(kind, r["text"].encode()))
        words[r["lang"]].update(lower(r["text"]))
    count = Counter(r["lang"] for r in texts.values())
    known = {k for k in count if count[k] >= rules.LANGUAGE_DOCS and sum(words[k].values()) >= rules.LANGUAGE_WORDS}
    assert 0 < len(known) < len(count)
    for r in rules.judge(docs).collect():
        t = texts[r["doc_id"]]
        n = len(t["text"].split())
        if n < 50 or len(t["text"].encode()) < 200:
            assert r["class_distance"] is None and r["word_distance"] is None
            continue
        own = Counter(map(kind, t["text"].encode()))
        if t["lang"] not in known:
            by_class = plain_distance(own, sum(classes.values(), Counter()) - own)
            assert r["class_distance"] == pytest.approx(by_class, abs=1e-9) and r["word_distance"] is None
            assert r["kept"] == (not r["base_failed"] and by_class <= 0.20 + 0.95 / n**0.5)
            continue
        top = {w for w, _ in sorted(words[t["lang"]].items(), key=lambda x: (-x[1], x[0]))[: rules.WORDS]}
        mine = Counter(w if w in top else None for w in lower(t["text"]))
        everything = Counter({w: k for w, k in words[t["lang"]].items() if w in top})
        everything[None] = sum(words[t["lang"]].values()) - sum(everything.values())
        by_class, by_word = plain_distance(own, classes[t["lang"]] - own), plain_distance(mine, everything - mine)
        assert r["class_distance"] == pytest.approx(by_class, abs=1e-9) and r["word_distance"] == pytest.approx(by_word, abs=1e-9)
        far = by_class > 0.20 + 0.95 / n**0.5 or by_word > 0.42 + 1.2 / n**0.5
        assert r["kept"] == (not r["base_failed"] and not far)


def test_a_language_is_no_reference_for_its_only_document(spark, docs):
    junk = ("#$%& |<>* ~^`= " * 60).strip()
    rows = spark.createDataFrame([(-1, junk, "zz"), (-2, junk, None)], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in rules.judge(docs.select("doc_id", "text", "lang").union(rows)).filter("doc_id < 0").collect()}
    assert all(not r["kept"] and r["class_distance"] > 0.3 and r["word_distance"] is None for r in got.values()) and len(got) == 2


def test_rules_of_odd_rows(odd):
    rows = rules.judge(odd).collect()
    assert len(rows) == len(ODD) and all(r["base_failed"] for r in rows if r["doc_id"] in (1, 2, 3, 4, 6))
    assert rules.judge(odd.limit(0)).count() == 0


def test_js_distance_bounds():
    p = np.array([0.5, 0.5, 0])
    assert rules.js_distance(p, p) == 0 and rules.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == pytest.approx(1)


def plain_mix(rows, shards, seed):
    """Draws by source: sort by rank, cut into blocks, walk passes until the target is met, then look up the shard's run."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    by = defaultdict(list)
    for r in rows:
        key = "null" if r["source"] is None else "=" + r["source"]
        by[key].append((md5(f"{mixing.SEED}:{'null' if r['doc_id'] is None else r['doc_id']}:{key}:{md5(r['text'] or '')}"), len(WORD.findall(r["text"] or "")), r["doc_id"]))
    keys = sorted(by, key=lambda k: (k == "null", k))
    sizes = {k: sum(n for _, n, _ in by[k]) for k in keys}
    weight = {k: mixing.WEIGHTS[i % 3] for i, k in enumerate(keys)}
    left, target, open_ = float(sum(sizes.values())), {}, list(keys)
    while True:
        share = {k: left * weight[k] / sum(weight[j] for j in open_) for k in open_}
        full = [k for k in open_ if share[k] >= 3 * sizes[k]]
        if not full:
            target |= share
            break
        for k in full:
            target[k], left = 3.0 * sizes[k], left - 3 * sizes[k]
            open_.remove(k)
    quota, chosen = [], {}
    for k in keys:
        whole = math.floor(target[k] / sizes[k] + 1e-12) if sizes[k] else 0
        rest, at, last = target[k] - whole * sizes[k], 0, -1
        if rest > 1e-6:
            for block in sorted({r[0][:3] for r in by[k]}):
                if at <= rest:
                    last, before = block, at
                at += sum(n for h, n, _ in by[k] if h[:3] == block)
        quota.append(whole * 4096 + (int(last, 16) + 1 if last != -1 else 0))
        for h, n, d in by[k]:
            head = last != -1 and h[:3] == last and before + sum(m for g, m, _ in by[k] if g[:3] == last and g <= h) - n / 2 <= rest
            more = last != -1 and (h[:3] < last or head)
            chosen[h] = [p * 4096 + int(h[:3], 16) for p in range(whole + more)]
    ends = np.cumsum(mixing.split_quotas(np.array(quota), shards, seed), axis=1)
    return {(d, n): sorted(int(np.searchsorted(ends[i], p, "right")) for p in chosen[h]) for i, k in enumerate(keys) for h, n, d in by[k]}, target


def test_mix_meets_its_targets(docs, texts):
    rows = mixing.mix(docs).collect()
    per = defaultdict(lambda: [0, 0, 0.0])
    for r in rows:
        words = len(WORD.findall(texts[r["doc_id"]]["text"]))
        assert r["size"] == words and len(r["draws"]) <= 3
        s = per[texts[r["doc_id"]]["source"]]
        s[0] += words
        s[1] += words * len(r["draws"])
        s[2] = r["target"]
    assert sum(s[2] for s in per.values()) == pytest.approx(sum(s[0] for s in per.values()))
    assert all(s[2] <= 3 * s[0] + 1e-6 for s in per.values())
    longest = max(r["size"] for r in rows)
    assert all(abs(s[1] - s[2]) <= longest / 2 + 1 for s in per.values())
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, rows))


def test_draws_are_the_shards_runs_of_blocks(docs, texts):
    rows = mixing.mix(docs).collect()
    want, target = plain_mix(list(texts.values()), mixing.SHARDS, mixing.SEED)
    assert {(r["doc_id"], r["size"]): sorted(d["shard"] for d in r["draws"]) for r in rows} == want
    places = [(d["shard"], d["place"]) for r in rows for d in r["draws"]]
    assert len(set(places)) == len(places) and {s for s, _ in places} <= set(range(mixing.SHARDS))
    drawn = mixing.draw(docs)
    got = defaultdict(int)
    for r in drawn.collect():
        got[r["doc_id"]] += 1
    assert got == {d: len(s) for (d, _), s in want.items() if s} and drawn.columns == docs.columns


def test_draw_keeps_null_and_repeated_ids(spark):
    rows = [(None, "a b c d", "s"), (1, "e f g h", "s"), (1, "i j k l", "s"), (2, "m n o p", "t"), (2, "m n o p", "t"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("shard", F.lit("x"))
    taken = {(r["doc_id"], r["source"], r["size"]): len(r["draws"]) for r in mixing.mix(df).collect()}
    got = mixing.draw(df).collect()
    assert all(0 <= n <= 3 for n in taken.values()) and {r["shard"] for r in got} == {"x"}
    assert len(got) == sum(len(r["draws"]) for r in mixing.mix(df).collect())
    assert sum(r["doc_id"] is None for r in got) == taken[None, "s", 4]


def test_quotas_split_exactly():
    q = np.array([400, 90, 0, 7])
    out = mixing.split_quotas(q, 10, "s")
    assert (out.sum(axis=1) == q).all() and out.sum(axis=0).max() - out.sum(axis=0).min() <= 1 and (out >= 0).all()


def test_mix_of_odd_rows(odd):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD) and all(len(r["draws"]) <= 3 for r in rows)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_quality_on_held_out_documents(docs, labels):
    model = milquality.fit(docs, labels)
    rows = milquality.score(docs, model).collect()
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    seen = [(r["predicted"], quality[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in quality]
    assert sum(p == q for p, q in seen) >= 0.9 * len(seen)
    kept = {r["doc_id"] for r in milquality.drop_poor(docs, model).collect()}
    assert kept == {r["doc_id"] for r in rows if r["predicted"] == 1}


def plain_passages(text):
    """Statistics of each passage by counting, without arrays."""
    words = text.encode().split()
    parts = [words[i : i + milquality.PASSAGE] for i in range(0, len(words), milquality.PASSAGE)] or [[]]
    for part in parts:
        k = len(part)
        if k:
            yield len(set(part)) / k, max(part.count(w) for w in set(part)) / k, sum(a == b for a, b in zip(part, part[1:])) / k


def test_passages_and_forward_pass_against_a_plain_twin(texts, docs, labels):
    model = milquality.fit(docs, labels)
    p, some = model.p, list(texts.values())[:40]
    for r in some:
        x = milquality.encode(r["text"].encode()).astype(float)
        for row, want in zip(x, plain_passages(r["text"])):
            assert row[10:13] == pytest.approx(want, abs=1e-6)
        assert (x[:, milquality.STATISTICS :] ** 2).sum(axis=1) == pytest.approx([1.0 if r["text"].split() else 0.0] * len(x), abs=1e-5)
        weights, codes = [], []
        for row in x:
            h = np.tanh(np.clip((row - model.mean) / model.scale, -8, 8) @ p["W"] + p["c"])
            codes.append(h)
            weights.append(math.exp((np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]))
        z = sum(w * h for w, h in zip(weights, codes)) / sum(weights)
        want = 1 / (1 + math.exp(-(z @ p["b"] + p["b0"][0])))
        assert model.score(milquality.encode(r["text"].encode()), np.array([0]))[0] == pytest.approx(want, abs=1e-4)


def test_quality_of_odd_rows(odd, labels):
    model = milquality.fit(odd, labels)
    assert milquality.score(odd, model).count() == len(ODD)
    assert milquality.score(odd, milquality.fit(odd, labels.limit(0))).filter("score = 0.5").count() == len(ODD)
    assert milquality.score(odd.limit(0), model).count() == 0


def test_attention_weighs_passages_and_sums_to_one():
    rng = np.random.default_rng(0)
    bags = [rng.normal(size=(rng.integers(1, 6), milquality.FEATURES)) for _ in range(60)]
    y = np.array([float((b[:, 0] > 0.8).any()) for b in bags])
    x, starts = np.concatenate(bags), np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]])
    m = milquality.Model(x.mean(axis=0), x.std(axis=0)).fit(x, starts, y)
    a, p = m.forward(x, starts)[4], m.score(x, starts)
    assert np.add.reduceat(a, starts) == pytest.approx(1) and ((p > 0.5) == y).mean() > 0.9


def test_toxic_documents_unseen_by_the_fit_are_found(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0
    rows = toxicity.score(docs.join(labels.filter(unseen), "doc_id", "left_semi"), toxicity.fit(docs, labels.filter(~unseen))).collect()
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    clean, bad = ([r for r in rows if truth[r["doc_id"]] == k] for k in (0, 1))
    assert len(bad) > 50 and sum(r["toxic"] for r in bad) >= 0.8 * len(bad) and sum(r["toxic"] for r in clean) <= 0.01 * len(clean)
    assert all(0 <= r[f"p_{c}"] <= 1 for r in rows for c in toxicity.CHAIN)


def test_few_labels_still_give_a_vocabulary(docs, labels):
    vocabulary, models = toxicity.fit(docs, labels)
    assert len(vocabulary) >= toxicity.LEAST_WORDS // 2 and len(models) == len(toxicity.CHAIN)


def test_later_links_see_earlier_probabilities():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (300, 4)).astype(float)
    y = np.column_stack([x[:, 0], x[:, 0] * x[:, 1]])
    models = toxicity.fit_chain(x, y, np.arange(300) % 3)
    assert [len(m) for m in models] == [5, 6]
    p = toxicity.apply_chain(models, x)
    assert ((p[:, 1] > 0.5) == (y[:, 1] > 0)).mean() > 0.95


def test_toxicity_of_odd_rows(odd, labels):
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).filter("p_toxic = 0").count() == len(ODD)
    assert toxicity.score(odd.limit(0), ([], [])).count() == 0


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def plain_spans(text):
    out = {"email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]}
    out["ip"] = [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(v) <= 255 for v in m[0].split("."))]
    cards = [(m.span(), re.sub("[ -]", "", m[0])) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)]
    out["card"] = [s for s, c in cards if 13 <= len(c) <= 19 and luhn(c)]
    out["phone"] = [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return out


def test_base_spans_equal_the_patterns():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=3000, deadline=None)
    @given(st.text(st.sampled_from("ab@@..--%+_ 0123456789()é\n:/"), max_size=40) | st.from_regex(r"([+]?[0-9 .()-]{6,24} ?){1,3}", fullmatch=True))
    def same(text):
        found = pii.find(text)
        assert {k: found[k] for k in pii.BASE_KINDS} == plain_spans(text)

    same()


def test_personal_data_rows(docs, texts):
    for r in pii.personal_data(docs).collect():
        spans = plain_spans(texts[r["doc_id"]]["text"])
        joined = ",".join(f"{k}:{a}:{b}" for k in spans for a, b in spans[k])
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and r["spans"].startswith(joined)
        assert [r[f"n_{k}"] for k in spans] == [len(v) for v in spans.values()]


def test_added_kinds_and_masks(odd):
    text = "see https://a.example.org/x?y=1. IBAN: GB82 WEST 1234 5698 7654 32, token = \"ab12cd34ef\" Account none"
    found = pii.find(text)
    assert [text[a:b] for a, b in found["url"]] == ["https://a.example.org/x?y=1"] and [text[a:b] for a, b in found["iban"]] == ["GB82 WEST 1234 5698 7654 32"]
    assert [text[a:b] for a, b in found["account"]] == ["ab12cd34ef"]
    assert pii.masked("to a@b.co or 1.2.3.4!") == "to <EMAIL> or <IP>!"
    rows = pii.mask(odd).collect()
    assert len(rows) == len(ODD) and [r["text"] for r in rows if r["doc_id"] == 5] == ["Mail <EMAIL> now"] and [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    assert pii.personal_data(odd).count() == len(ODD) and pii.personal_data(odd.limit(0)).count() == 0


def test_features_of_odd_media(odd):
    assert media.features(odd).count() == len(ODD) and media.features(odd.limit(0)).count() == 0


def test_pipeline_stages_follow_each_other(spark, texts):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "personal_data", "source_mixing", "best_fit_packing"]
    rows = corpus_pipeline.run(spark, SF).collect()
    used = {r["doc_id"] for r in rows}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert used <= set(texts) and sum(labels.get(d) == 0 for d in used) <= 0.02 * len(used)
    groups_of = groups([r for r in texts.values() if r["doc_id"] in used])
    assert len(set(groups_of.values())) == len(used)
