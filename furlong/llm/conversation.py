"""Operator 11: repair of conversation structure by iterative-deepening A*.

A conversation is its turns in order (nulls first, then role, then the SHA-256
of the text).  Its roles' initials shall read ``(s?(ua)+)?``.  The edits of a
turn are Delete (cost 2, required for blank turns and duplicates), Keep (0) and
Rerole to user or assistant (1); an empty user or assistant turn can be
Inserted anywhere (5); a truncated turn that stays adds 5.

The cheapest edits are found depth first in ASCII order of the edits' initials
(D, I, K, R) under rising cost bounds.  What the rest must cost at least, turn
by turn, prunes; so does a table of states that failed with at least as much
left to spend.  The first path that is accepted under the first bound that
accepts one is the answer: no path is cheaper, and no path of its cost comes
before it.

A search spans at most ``BLOCK`` turns.  A longer conversation is cut there,
each block is searched between every pair of states at its ends, and the blocks
are chained from left to right: all paths up to a cut have as many turns behind
them and end in a turn's edit, so none is a prefix of another, and their order
among themselves decides ties whatever follows.

Turns go through Spark without their texts (a digest each) until the edits are
known; a conversation then needs a byte a turn.  The second pass has the texts
and streams them in order, so that no conversation is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furlong.llm._shared import lean, small_batches

BLOCK = 64
DELETE, INSERT, KEEP, REROLE = "DIKR"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5
#: States between turns: nothing yet, after a system turn, after a user turn, after an assistant turn.
BEGUN, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(BEGUN, "s"): SYSTEM, (BEGUN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an inserted or renamed turn has in each state, and the state after it.
_NEW = {BEGUN: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
ACCEPTED = frozenset({BEGUN, ASSISTANT})
WHOLE, BLANK, DUPLICATE, TRUNCATED = range(4)
_BLANKS = " \t\n\x0b\x0c\r"
_OUT_ROWS, _OUT_BYTES = 2000, 1 << 20

Turn = tuple[str, int]  # initial of the role, fault


def _least(turn: Turn) -> int:
    """What any edit of a turn costs at least."""
    initial, fault = turn
    return DELETE_COST if fault else 0 if initial in ("s", "u", "a") else REROLE_COST


def search(turns: list[Turn], start: int = BEGUN, goals: frozenset[int] = ACCEPTED, last: bool = True) -> tuple[int, str] | None:
    """The cost and the edits of the cheapest path from a state to one of the goals, ASCII-least among the cheapest.

    Inserts after the last turn are for the conversation's end alone (``last``).  None if no path leads there.
    """
    n = len(turns)
    ahead = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        ahead[i] = ahead[i + 1] + _least(turns[i])

    def moves(i: int, q: int) -> Iterator[tuple[str, int, int, int]]:
        if i < n:
            yield DELETE, DELETE_COST, i + 1, q
        if i < n or last:
            yield INSERT, INSERT_COST, i, _NEW[q][1]
        if i < n and turns[i][1] not in (BLANK, DUPLICATE):
            initial, fault = turns[i]
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            if (q, initial) in _NEXT:
                yield KEEP, more, i + 1, _NEXT[q, initial]
            yield REROLE, REROLE_COST + more, i + 1, _NEW[q][1]

    bound = ahead[0]
    most = DELETE_COST * n + INSERT_COST * 4  # deleting all and inserting what is missing; beyond it there is no path
    failed: dict[tuple[int, int], int] = {}  # the most that was left to spend when a state failed
    while bound <= most:
        beyond = most + 1
        path: list[str] = []
        stack = [(0, start, 0, moves(0, start))]
        while stack:
            i, q, cost, left = stack[-1]
            if i == n and q in goals:
                return cost, "".join(path)
            for edit, price, j, r in left:
                total = cost + price
                least = max(ahead[j], failed.get((j, r), -1) + 1)
                if total + least > bound:
                    beyond = min(beyond, total + least)
                    continue
                path.append(edit)
                stack.append((j, r, total, moves(j, r)))
                break
            else:
                failed[i, q] = max(failed.get((i, q), -1), bound - cost)
                stack.pop()
                if path:
                    path.pop()
        bound = beyond
    return None


def cheapest(turns: list[Turn], block: int = BLOCK) -> tuple[int, str]:
    """The cost and the edits of a whole conversation, block by block."""
    cuts = list(range(0, len(turns), block)) or [0]
    here: dict[int, tuple[int, int, tuple]] = {BEGUN: (0, 0, ())}  # state: cost, place among all paths so far, edits as a chain
    for at in cuts[:-1]:
        found: dict[int, tuple[int, int, str, int]] = {}
        for r in range(4):
            options = [(here[q][0] + part[0], here[q][1], part[1], q) for q in here if (q == r or q < r != SYSTEM or (q, r) in ((BEGUN, SYSTEM), (ASSISTANT, USER))) and (part := search(turns[at : at + block], q, frozenset({r}), False))]
            if options:
                found[r] = min(options)
        order = sorted(found, key=lambda r: found[r][1:3])
        here = {r: (found[r][0], order.index(r), (here[found[r][3]][2], found[r][2])) for r in found}
    ends = []
    for q in here:
        part = search(turns[cuts[-1] :], q)
        if part:
            ends.append((here[q][0] + part[0], here[q][1], part[1], q))
    cost, _, tail, q = min(ends)
    parts, chain = [tail], here[q][2]
    while chain:
        chain, part = chain
        parts.append(part)
    return cost, "".join(reversed(parts))


def faults(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(c, t, role, digest, fault) of each turn; a null role or text counts as one space.  Texts stay behind."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    end = F.right(F.rtrim(text, F.lit(_BLANKS)), F.lit(1))
    rows = turns.select(F.col(id_col).alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.sha2(text, 256).alias("digest"), end.alias("end"))
    before = F.row_number().over(Window.partitionBy("c", "role", "digest").orderBy(F.col("t").asc_nulls_first()))
    fault = F.when(F.col("end") == "", BLANK).when(before > 1, DUPLICATE).when(~F.col("end").isin(".", "!", "?"), TRUNCATED).otherwise(WHOLE)
    return rows.withColumn("fault", fault).drop("end")


@dataclass
class _Held:
    """A conversation while its turns pass by."""

    key: object
    turns: list[Turn]
    low: int | None = None
    high: int | None = None
    distinct: int = 0
    at: object = None
    illegal: int = 0
    counts: tuple[int, ...] = ()

    def add(self, t: int | None, role: str, fault: int) -> None:
        initial = role[:1]
        if self.turns and self.turns[-1][0] + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.turns.append((initial, fault))
        if t is not None:
            self.low = t if self.low is None else self.low
            self.distinct += t != self.high
            self.high = t

    def row(self) -> dict:
        faulty = [f for _, f in self.turns]
        cost, audit = cheapest(self.turns)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return {"c": self.key, "gaps": gaps, "blank": faulty.count(BLANK), "duplicate": faulty.count(DUPLICATE), "truncated": faulty.count(TRUNCATED), "illegal": self.illegal, "cost": cost, "audit": audit}


_SUMMARY = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
_SUMMARY_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


@lean("conversation")
def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to a summary of each conversation; a row whose fault is null only names its conversation."""
    held, out, size, kind = None, [], 0, None

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([("c", kind), *_SUMMARY]))

    for batch in batches:
        kind = batch.schema.field("c").type
        for c, t, role, fault in zip(*(batch.column(x).to_pylist() for x in ("c", "t", "role", "fault")), strict=True):
            if held is None or held.key != c:
                if held is not None:
                    out.append(held.row())
                    size += len(held.turns)
                    if len(out) >= _OUT_ROWS or size >= _OUT_BYTES:
                        yield flush()
                        out, size = [], 0
                held = _Held(c, [])
            if fault is not None:
                held.add(t, role, fault)
    if held is not None:
        out.append(held.row())
        yield flush()


def audits(turns: DataFrame, ids: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, gaps (missing turn numbers), blank, duplicate, truncated (turns by their first fault), illegal (adjacent
    initials of roles other than su, ua and au), cost and audit (initials of the edits in order).

    ``ids`` names conversations that may have no turns: zeros and an empty audit.  A null id is a conversation of its own, null turns come
    first, null roles and texts count as one space.  Turns of one number go by role, then by the text's SHA-256; equal rows are duplicates.
    An initial other than s, u, a can't be kept.  An empty table gives an empty one; other columns are ignored.
    """
    rows = faults(turns, id_col, turn_col, role_col, text_col)
    if ids is not None:
        empty = {x: F.lit(None).cast(rows.schema[x].dataType).alias(x) for x in ("t", "role", "digest", "fault")}
        rows = rows.unionByName(ids.select(F.col(id_col).alias("c")).distinct().select("c", *empty.values()))
    kind = rows.schema["c"].dataType.simpleString()
    dealt = rows.repartition("c").sortWithinPartitions("c", F.col("t").asc_nulls_first(), "role", "digest")
    return dealt.select("c", "t", "role", "fault").mapInArrow(_audit, f"c {kind}, {_SUMMARY_DDL}").withColumnRenamed("c", id_col)


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, dict | None, str | None, str | None, object, str | None]]:
    """(conversation, its summary or None, edit, role, turn, text): the summary first, then the repaired turns in order."""
    audit, at, q = "", 0, BEGUN

    def inserted(c: object) -> Iterator[tuple]:
        nonlocal at, q
        while at < len(audit) and audit[at] == INSERT:
            at += 1
            role, q = _NEW[q]
            yield c, None, INSERT, role, None, ""

    last = None
    for batch in batches:
        names = batch.schema.names
        for row in zip(*(batch.column(x).to_pylist() for x in names), strict=True):
            r = dict(zip(names, row, strict=True))
            if r["audit"] is not None:  # begins a conversation
                if last is not None:
                    yield from inserted(last["c"])
                last, audit, at, q = r, r["audit"], 0, BEGUN
                yield r["c"], r, None, None, None, None
                continue
            yield from inserted(r["c"])
            edit = audit[at]
            at += 1
            if edit == KEEP:
                q = _NEXT[q, r["role"][:1]]
                yield r["c"], None, edit, r["role"], r["t"], r["text"]
            elif edit == REROLE:
                role, q = _NEW[q]
                yield r["c"], None, edit, role, r["t"], r["text"]
    if last is not None:
        yield from inserted(last["c"])


@lean("conversation")
def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, size, place, schema = [], 0, 0, None

    def typed() -> Iterator[pa.RecordBatch]:
        nonlocal schema
        for batch in batches:
            schema = pa.schema([("c", batch.schema.field("c").type), ("place", pa.int64()), ("edit", pa.string()), ("t", batch.schema.field("t").type), ("role", pa.string()), ("text", pa.string())])
            yield batch

    for c, summary, edit, role, t, text in _replayed(typed()):
        if summary is not None:
            place = 0
            continue
        out.append({"c": c, "place": place, "edit": edit, "t": t, "role": role, "text": text})
        place += 1
        size += len(text)
        if len(out) >= _OUT_ROWS or size >= _OUT_BYTES:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


@lean("conversation")
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A summary of each conversation with the SHA-256 of its repaired ``role:text`` lines, fed as they pass."""
    out, kind, held, digest, first = [], None, None, None, True

    def typed() -> Iterator[pa.RecordBatch]:
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("c").type
            yield batch

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([("c", kind), *_SUMMARY, ("repaired_sha256", pa.string())]))

    for _c, summary, _edit, role, _t, text in _replayed(typed()):
        if summary is not None:
            if held is not None:
                out.append(held | {"repaired_sha256": digest.hexdigest()})
                if len(out) >= _OUT_ROWS:
                    yield flush()
                    out = []
            held, digest, first = {x: summary[x] for x in ("c", *(n for n, _ in _SUMMARY))}, hashlib.sha256(), True
        else:
            digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False
    if held is not None:
        out.append(held | {"repaired_sha256": digest.hexdigest()})
        yield flush()


def _in_order(turns: DataFrame, found: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Summaries and whole turns together, each conversation's summary first and then its turns in order."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    names = [n for n, _ in _SUMMARY]
    rows = turns.select(F.col(id_col).alias("c"), F.col(turn_col).alias("t"), F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), text.alias("text"), F.sha2(text, 256).alias("digest"))
    heads = found.select(F.col(id_col).alias("c"), *names)
    both = rows.unionByName(heads, allowMissingColumns=True)
    small_batches(turns.sparkSession)
    return both.repartition("c").sortWithinPartitions("c", F.col("audit").isNull(), F.col("t").asc_nulls_first(), "role", "digest").drop("digest")


def repaired(turns: DataFrame, found: DataFrame | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns that the edits leave: id, place (from 0), edit (K, R or I), turn (null if inserted), role, text.  ``found`` are the turns' ``audits``."""
    found = audits(turns, None, id_col, turn_col, role_col, text_col) if found is None else found
    both = _in_order(turns, found, id_col, turn_col, role_col, text_col)
    kinds = {x: both.schema[x].dataType.simpleString() for x in ("c", "t")}
    out = both.mapInArrow(_rebuild, f"c {kinds['c']}, place long, edit string, t {kinds['t']}, role string, text string")
    return out.withColumnsRenamed({"c": id_col, "t": turn_col, "role": role_col, "text": text_col})


def repaired_digests(turns: DataFrame, found: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``found`` (the turns' ``audits``) with repaired_sha256, the hash of the repaired ``role:text`` lines joined by newlines."""
    both = _in_order(turns, found, id_col, turn_col, role_col, text_col)
    kind = both.schema["c"].dataType.simpleString()
    return both.mapInArrow(_digest, f"c {kind}, {_SUMMARY_DDL}, repaired_sha256 string").withColumnRenamed("c", id_col)


def damaged(turns: DataFrame, kind: Column) -> DataFrame:
    """Turns (conv_id, turn, role, text) with faults put in by ``kind``: 0 drops a turn, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes it the user's."""
    rows = turns.select("conv_id", "turn", *(F.coalesce(F.col(x).cast("string"), F.lit(" ")).alias(x) for x in ("role", "text")), kind.alias("kind")).filter("kind != 0")
    rows = rows.withColumn("n", F.explode(F.expr("sequence(1, if(kind = 3, 2, 1))")))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
