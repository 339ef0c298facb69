"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, ends of schemes, digits, plus signs before a digit and the
words that announce an identifier. From each anchor a small deterministic parser expands to the left and right and
validates what it found. Per kind the spans are leftmost and never overlap; a failing candidate is dropped and the
scan goes on behind it.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.shared import text_bytes

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account")
#: In any case; each before "://".
SCHEMES = ("https", "http", "ftp")
#: Words that announce an identifier; each also in upper case and with a capital.
CUES = ("iban", "account", "acct", "passport", "ssn", "token", "api_key", "api-key", "apikey", "password", "secret")

#: Rows of results that leave a Python worker together.
ROWS_OUT = 1000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_CUED = re.compile(r"[\s:=#\"'-]{1,6}((?=[A-Za-z0-9_-]*[0-9])[A-Za-z0-9_-]{6,})(?![A-Za-z0-9_-])")

_RUN = re.compile(r"[\s:=#\"'-]{0,6}[A-Za-z0-9_-]*")
_HAS_DIGIT = re.compile(r"[0-9]")


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", ("at", 1))
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
        found.add_word(f"+{d}", ("plus", 2))
    found.add_word("://", ("scheme", 3))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def _emails(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    out, last = [], 0
    for at in anchors:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, last := m.end()))
    return out


def _quads(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    out, last = [], 0
    for at in anchors:
        if at < last:
            continue
        if m := _QUAD.match(text, at):
            if all(len(x) <= 3 and int(x or "0") <= 255 for x in (g.lstrip("0") for g in m.groups())):
                out.append(m.span())
            last = m.end()
        else:
            last = _DIGITS.match(text, at).end()
    return out


def _luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(doubled) + sum(int(d) for d in digits[-1::-2])) % 10 == 0


def _cards(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    out, last = [], 0
    for at in anchors:
        if at >= last and (m := _CARD.match(text, at)):
            last = m.end()
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(m.span())
    return out


def _phones(text: str, anchors: list[int]) -> list[tuple[int, int]]:
    out, last = [], 0
    for at in anchors:
        if at >= last and (m := _PHONE.match(text, at)):
            last = m.end()
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(m.span())
    return out


def _urls(text: str, anchors: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, last = [], 0
    for start, end in anchors:
        before = text[max(start - 5, 0) : start].lower()
        start -= next((len(s) for s in SCHEMES if before.endswith(s)), end)
        if start >= last and (m := _URL.match(text, end)):
            stop = m.end() - (len(m[0]) - len(m[0].rstrip(".,;:!?)")))
            out.append((start, last := stop))
    return out


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """The longest stretch of an IBAN's form from ``at`` whose check digits hold."""
    m = _IBAN.match(text, at)
    while m:
        code = m[0].replace(" ", "")
        if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1:
            return m.span()
        m = _IBAN.fullmatch(text, at, at + m[0].rfind(" ")) if " " in m[0] else None
    return None


def _ibans(text: str, digits: list[int], cued: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """``cued`` and those that no word announces; leftmost, without overlap."""
    spans, last = list(cued), 0
    for d in digits:
        at = d - 2
        if at >= last and text[at:d].isascii() and text[at:d].isalpha() and text[at:d].isupper() and not (at and text[at - 1].isalnum()) and (span := _iban(text, at)):
            spans.append(span)
            last = span[1]
    out: list[tuple[int, int]] = []
    for span in sorted(spans):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def _accounts(text: str, anchors: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    # text before ``bare`` is a run of identifier characters without a digit: read once, whatever cues it holds
    ibans, others, last, bare = [], [], 0, 0
    for start, end in anchors:
        if start < last or (start and text[start - 1].isalnum()):
            continue
        at = end
        while at < len(text) and at < end + 6 and text[at] in " :=#\"'":
            at += 1
        if span := _iban(text, at):
            ibans.append(span)
            last = span[1]
            continue
        if bare - end >= 6 or text[end:bare].strip("-"):
            continue
        if m := _CUED.match(text, end):
            others.append(m.span(1))
            last = m.end()
        elif not _HAS_DIGIT.search((m := _RUN.match(text, end))[0]):
            bare = m.end()
    return ibans, others


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans (start, end in code points, end exclusive) of a text by kind."""
    at: dict[str, list] = {"at": [], "digit": [], "plus": [], "scheme": [], "cue": []}
    for end, (kind, size) in _automaton().iter(text):
        at[kind].append((end + 1 - size, end + 1) if kind in ("scheme", "cue") else end + 1 - size)
    ibans, accounts = _accounts(text, at["cue"])
    ibans = _ibans(text, at["digit"], ibans)
    found = (_emails(text, at["at"]), _quads(text, at["digit"]), _cards(text, at["digit"]), _phones(text, at["plus"]), _urls(text, at["scheme"]), ibans, accounts)
    return dict(zip(KINDS, found, strict=True))


def _joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One text is decoded at a time, and of its spans only their digests stay; results leave in parts of a batch."""
    for batch in batches:
        for part in (batch.slice(at, ROWS_OUT) for at in range(0, batch.num_rows, ROWS_OUT)):
            counts: list[list[int]] = [[] for _ in BASE_KINDS]
            base, spans = [], []
            for text in part.column(1):
                found = find(str(text.as_buffer(), "utf-8", "replace"))
                for n, k in zip(counts, BASE_KINDS, strict=True):
                    n.append(len(found[k]))
                base.append(hashlib.sha256(_joined(found, BASE_KINDS).encode()).hexdigest())
                spans.append(_joined(found, KINDS))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(n, pa.int64()) for n in counts), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"],
            )


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text, ...)``: counts of the base kinds, a digest of their spans, and all spans.

    Null and empty texts: no spans. Repeated rows give repeated results; a null doc_id stays null; other columns are
    not read; an empty table gives an empty result.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes(docs).alias("text")).mapInArrow(
        _digests, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    )


def masked(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans, one mark for all."""
    spans = sorted((s, e, k) for k, found in find(text).items() for s, e in found)
    out, last = [], 0
    for s, e, k in spans:
        if s >= last:
            out += [text[last:s], f"<{k.upper()}>"]
        last = max(last, e)
    return "".join([*out, text[last:]])


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        texts = [None if t is None else masked(t.decode("utf-8", "replace")) for t in batch.column(at).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names
        )


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with all personal data in ``text`` masked, and ``n_chars`` (if there) brought in line."""
    out = docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(_masked, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


#: The four base kinds' counts by regular expressions alone.
COUNTS_SQL = r"""
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+(?:\.[0-9]+){3}'), lambda q: len(list_filter(string_split(q, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(try_cast(right(p, 4) AS INTEGER), 999) > 255)) = 0)) AS n_ip,
  len(list_filter(list_transform(regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), lambda c: regexp_replace(c, '[ -]', '', 'g')), lambda c: len(c) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(c[-i] AS INTEGER) ELSE (2 * CAST(c[-i] AS INTEGER)) // 10 + (2 * CAST(c[-i] AS INTEGER)) % 10 END)) % 10 = 0)) AS n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda h: len(regexp_replace(h, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
