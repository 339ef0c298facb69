"""Repair of conversation structure by survivor-coalescence Viterbi.

A conversation's rows pass in order through a trellis of four states, by the last role that the repaired conversation
has: none, system, user, assistant. Each state keeps its cheapest way there, the ASCII-least string of edits among equals.
Ways share a tree of backpointers with reference counts: a way that is given up frees its nodes up to the first that
another one needs. As soon as all survivors go through one node, the edits up to it are settled; they are emitted into
the audit string and the digest, and are forgotten. Only edits that are still open are held.

Ties are settled by the complete open suffixes. Survivors are ordered right behind an edit that takes a row, where none
is the beginning of another, so their order, carried from row to row, is that of their suffixes and no tie walks back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: ``[\\x20\\x09-\\x0D]``.
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role leads from a state.
_GO = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_ROLE = {USER: b"user:", ASSISTANT: b"assistant:"}
#: (x, y) -> by how much the best that can follow x may cost more than the best that can follow y, at most. A survivor
#: that is dearer than another one by more than that is never on a cheapest way.
_BEHIND = {
    (ASSISTANT, NONE): DELETE, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): INSERT,
    (USER, ASSISTANT): INSERT, (USER, NONE): INSERT + DELETE, (USER, SYSTEM): INSERT,
    (NONE, ASSISTANT): 0, (NONE, SYSTEM): 0, (NONE, USER): INSERT,
    (SYSTEM, ASSISTANT): 2 * INSERT, (SYSTEM, NONE): 2 * INSERT, (SYSTEM, USER): INSERT,
}


class _Node:
    """An edit; ``refs`` counts the nodes and survivors that point to it."""

    __slots__ = ("edit", "line", "parent", "kids", "refs")

    def __init__(self, parent: _Node | None, edit: str, line: tuple[bytes, bytes] | None):
        self.parent, self.edit, self.line, self.kids, self.refs = parent, edit, line, [], 0
        if parent is not None:
            parent.kids.append(self)
            parent.refs += 1


class Trellis:
    """The cheapest edits of one conversation; rows are given by ``read``, the result by ``end``."""

    def __init__(self):
        self.root = _Node(None, "", None)
        self.root.refs = 1
        #: state -> (cost, place in the order of suffixes, node)
        self.alive: dict[int, tuple[int, int, _Node]] = {NONE: (0, 0, self.root)}
        self.audit: list[str] = []
        self.digest = hashlib.sha256()
        self.lines = 0

    def _ways(self) -> Iterator[tuple[int, int, str, int, list[bytes], _Node]]:
        """(state, cost, inserts, place, inserted roles, survivor) of every survivor with up to two inserts."""
        for state, (cost, place, node) in self.alive.items():
            edits, roles = "", []
            yield state, cost, edits, place, roles, node
            for _ in range(2):
                state = ASSISTANT if state == USER else USER
                edits, roles, cost = edits + "I", [*roles, _ROLE[state]], cost + INSERT
                yield state, cost, edits, place, roles, node

    def _settle(self, best: dict[int, tuple]) -> None:
        """Make the nodes of the best ways, let go of all others, and emit what all survivors share."""
        best = {x: w for x, w in best.items() if all(w[0][0] <= best[y][0][0] + _BEHIND[y, x] for y in best if y != x)}
        order = sorted(best, key=lambda x: best[x][0][1:])
        alive = {}
        for place, x in enumerate(order):
            (cost, *_), node, roles, edit, line = best[x]
            for role in roles:
                node = _Node(node, "I", (role, b""))
            if edit:
                node = _Node(node, edit, line)
            node.refs += 1
            alive[x] = (cost, place, node)
        for _, _, node in self.alive.values():
            self._release(node)
        self.alive = alive
        self._coalesce()

    def _release(self, node: _Node | None) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            parent = node.parent
            parent.kids.remove(node)
            parent.refs -= 1
            node = parent

    def _coalesce(self) -> None:
        while self.root.refs == 1 and self.root.kids:
            self.root = self.root.kids[0]
            self.root.parent = None
            self.audit.append(self.root.edit)
            if self.root.line is not None:
                self.digest.update(b"\n" * bool(self.lines) + self.root.line[0])
                self.digest.update(self.root.line[1])
                self.lines += 1

    def open_edits(self) -> int:
        """Edits that are held, for tests of the bound."""
        seen, stack = 0, list(self.root.kids)
        while stack:
            node = stack.pop()
            seen += 1
            stack += node.kids
        return seen

    def read(self, initial: str, role: bytes, text: bytes, must_go: bool, truncated: bool) -> None:
        """The next row: its role's initial, its role and text, whether it is blank or a duplicate, or truncated."""
        best: dict[int, tuple] = {}

        def offer(state: int, cost: int, way: tuple, edit: str, line: tuple[bytes, bytes] | None) -> None:
            _, _, edits, place, roles, node = way
            key = (cost, place, edits + edit)
            if state not in best or key < best[state][0]:
                best[state] = (key, node, roles, edit, line)

        more = TRUNCATED if truncated else 0
        for way in self._ways():
            state, cost = way[0], way[1]
            offer(state, cost + DELETE, way, "D", None)
            if not must_go:
                kept = _GO.get(initial, {}).get(state)
                if kept is not None:
                    offer(kept, cost + KEEP + more, way, "K", (role + b":", text))
                other = ASSISTANT if state == USER else USER
                offer(other, cost + REROLE + more, way, "R", (_ROLE[other], text))
        self._settle(best)

    def end(self) -> tuple[int, str, str]:
        """Cost, audit string and digest."""
        last = min((cost, place, edits, state, roles, node) for state, cost, edits, place, roles, node in self._ways() if state in (NONE, ASSISTANT))
        cost, place, edits, state, roles, node = last
        self._settle({state: ((cost, place, edits), node, roles, "", None)})
        return cost, "".join(self.audit), self.digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations(conv_id, turn, role, text)`` with the damage that the checksum of their place asks for:
    role and text as damaged (a null is one space) and times, 0 for a dropped row and 2 for a repeated one."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    what = F.crc32(F.concat(spoken("conv_id"), F.lit(":"), spoken("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), spoken("role").alias("role"), spoken("text").alias("text"), what.alias("what"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("what") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("what").isin(0, 1), "").when(F.col("what") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("what") == 0, 0).when(F.col("what") == 3, 2).otherwise(1).alias("times"),
    )


def _fault(seen_before: Column) -> Column:
    """A row's first fault: 1 blank, 2 duplicate, 3 truncated, else 0."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    return F.when(trimmed == "", 1).when(seen_before, 2).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.trellis = conv_id, Trellis()
        self.faults = [0, 0, 0, 0]
        self.illegal, self.rows, self.before = 0, 0, None
        self.least = self.most = None
        self.turns = 0

    def read(self, turn, role: str, text: str, times: int, fault: int) -> None:
        if turn is not None and times:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        name, said, initial = role.encode(), text.encode(), role[:1]
        for k in range(times):
            fault = 2 if k and fault != 1 else fault
            self.faults[fault] += 1
            self.illegal += self.rows > 0 and self.before + initial not in ("su", "ua", "au")
            self.before, self.rows = initial, self.rows + 1
            self.trellis.read(initial, name, said, fault in (1, 2), fault == 3)

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, *self.faults[1:], self.illegal, *self.trellis.end())


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _repair_sorted(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def packed():
            nonlocal done
            columns = list(zip(*done, strict=True))
            done = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                for conv_id, turn, role, text, times, fault in zip(*(c.to_pylist() for c in batch.slice(k, 512).columns), strict=True):
                    if now is None or conv_id != now.conv_id:
                        if now is not None:
                            done.append(now.result())
                        now = _Conversation(conv_id)
                    now.read(turn, role, text, times, fault)
                if len(done) >= 1000:
                    yield packed()
        if now is not None:
            done.append(now.result())
        if done:
            yield packed()

    return run


def repair(conversations: DataFrame) -> DataFrame:
    """Faults and cheapest repair of every damaged conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost,
    audit, repaired_sha256.

    Rows of one turn go by role and text; a repeated row of the table counts as often as it is there. A null conv_id is
    a conversation of its own, null turns come first, other columns are not read, an empty table gives an empty
    result. A role's initial is its first character, of an empty role none. Rows are shuffled once and streamed
    through their conversation's trellis, so a conversation may be longer than memory; its digest is a chain over its
    text and keeps it in one task. Which rows repeat an earlier one is found by sorting digests, which may spill.
    """
    kind = conversations.schema["conv_id"].dataType
    own = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    rows = damaged(conversations).withColumn("own", F.when(F.col("times") > 0, own)).repartition("conv_id")
    earlier = F.row_number().over(Window.partitionBy("conv_id", "own").orderBy(F.col("turn").asc_nulls_first())) > 1
    judged = rows.select("conv_id", "turn", "role", "text", "times", _fault(earlier).alias("fault"))
    schema = StructType([StructField("conv_id", kind), *(StructField(c, LongType()) for c in _COUNTS), StructField("audit", StringType()), StructField("repaired_sha256", StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    return judged.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(_repair_sorted(to_arrow_schema(schema)), schema)
