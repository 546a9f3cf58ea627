"""Repair of conversations: the cheapest edits that make their roles alternate.

The role initials of a good conversation are ``(s?(ua)+)?``, which four states read: nothing yet,
after s, after u, after a. A row may be kept (0), get the role user or assistant (2) or be deleted (3);
empty user and assistant rows may be inserted anywhere (2); a truncated row that stays costs 1 more;
blank and repeated rows must be deleted. Among the cheapest edits those count whose initials, in
order, come first in ASCII: given the letters before it, a letter leads to one state only, so the
letters also fix the roles.

Hirschberg's divide and conquer: the cost vector of the four states forward from the start and the one
backward from the end meet in the middle; the best crossing is chosen and both halves are solved for
themselves. Equally good crossings are told apart by the rank of their audits so far. Audits that
reach a row's end in different states differ before either ends, so ranks are carried along with the
costs and no audit is stored.

Rows are dealt in ranges of (conversation, turn, role, text), so no task holds more than a range. A
conversation across ranges is solved over blocks: a block is a 4 x 4 matrix of costs and ranks, the
same recursion over a conversation's blocks (one small row for each range it touches) gives each block
the states it begins and ends in, and then every block is solved for itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorascope.llm.store import small, written

INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
NONE, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40  # cost of what cannot be reached
# the state after a letter; from each state only one of user and assistant may follow
_AFTER = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_NEXT = (USER, USER, ASSISTANT, USER)
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_ENDS = ("", "II", "I", "")  # what completes a conversation that ends in a state
END = tuple(INSERT * len(e) for e in _ENDS)


@lru_cache(None)
def _row(initial: str, fault: str) -> tuple[tuple, tuple, tuple]:
    """Costs, ranks and letters of a row, from each state to each state."""
    costs, letters = [[FAR] * 4 for _ in range(4)], [[""] * 4 for _ in range(4)]
    for start in range(4):
        ways = [(DELETE, "D", start)]
        if fault not in ("blank", "duplicate"):
            more, state = TRUNCATED if fault == "truncated" else 0, start
            for n in range(3):
                before = "I" * n
                if (state, initial) in _AFTER:
                    ways.append((INSERT * n + more, before + "K", _AFTER[state, initial]))
                ways.append((INSERT * n + REROLE + more, before + "R", _NEXT[state]))
                state = _NEXT[state]
        for cost, text, end in sorted(ways, reverse=True):
            if (cost, text) <= (costs[start][end], letters[start][end] or "~"):
                costs[start][end], letters[start][end] = cost, text
    ranks = tuple(tuple(sorted(l).index(x) for x in l) for l in letters)
    return tuple(map(tuple, costs)), ranks, tuple(map(tuple, letters))


@lru_cache(1 << 16)
def _forward(costs: tuple, ranks: tuple, step: tuple) -> tuple[int, tuple, tuple]:
    """Least costs and audit ranks of the states after a step (a row's or block's costs and ranks);
    the costs are relative to the number returned first."""
    best = [min((costs[s] + step[0][s][t], ranks[s], step[1][s][t]) for s in range(4)) for t in range(4)]
    low = min(b[0] for b in best)
    order = sorted((b[1:], t) for t, b in enumerate(best))
    place = {t: i for i, (_, t) in enumerate(order)}
    return low, tuple(min(b[0] - low, FAR) for b in best), tuple(place[t] for t in range(4))


@lru_cache(1 << 16)
def _backward(costs: tuple, step: tuple) -> tuple[int, tuple]:
    best = [min(step[0][s][t] + costs[t] for t in range(4)) for s in range(4)]
    low = min(best)
    return low, tuple(min(b - low, FAR) for b in best)


def _only(state: int) -> tuple:
    return tuple(0 if s == state else FAR for s in range(4))


def crossings(steps: list[tuple], start: int, end: tuple) -> list[int]:
    """The state after each step of the cheapest, audit-least way from ``start``; ``end``: what each
    last state costs. Beyond its result it holds a vector per level of the recursion."""
    out = [0] * len(steps)
    work = [(0, len(steps), start, end)] if steps else []
    while work:
        low, high, state, goal = work.pop()
        middle = (low + high) // 2 if high - low > 1 else high
        costs, ranks = _only(state), (0, 1, 2, 3)
        for step in steps[low:middle]:
            _, costs, ranks = _forward(costs, ranks, step)
        back = goal
        for step in reversed(steps[middle:high]):
            _, back = _backward(back, step)
        cross = min(range(4), key=lambda s: (costs[s] + back[s], ranks[s]))
        out[middle - 1] = cross
        if high - low > 1:
            work.append((low, middle, state, _only(cross)))
            work.append((middle, high, cross, goal))
    return out


def matrix(steps: list[tuple]) -> tuple[tuple, tuple]:
    """Costs and ranks of several steps as one."""
    costs, ranks = [], []
    for start in range(4):
        total, c, r = 0, _only(start), (0, 1, 2, 3)
        for step in steps:
            low, c, r = _forward(c, r, step)
            total += low
        costs.append(tuple(FAR if x >= FAR >> 1 else total + x for x in c))
        ranks.append(r)
    return tuple(costs), tuple(ranks)


def _edits(rows: list[tuple], states: list[int], start: int, last: bool) -> Iterator[tuple]:
    """(row, number, edit, role, text, cost) of the rows (role, text, fault) that go through ``states``."""
    state = start
    for i, ((role, text, fault), after) in enumerate(zip(rows, states)):
        letters = _row(role[:1], fault)[2][state][after]
        more = TRUNCATED if fault == "truncated" else 0
        for k, letter in enumerate(letters):
            if letter == "D":
                yield i, k, "D", None, None, DELETE
                continue
            state = _NEXT[state] if letter in "IR" else after
            if letter == "I":
                yield i, k, "I", _ROLE[state], "", INSERT
            else:
                yield i, k, letter, _ROLE[state] if letter == "R" else role, text, (REROLE if letter == "R" else 0) + more
    if last:
        for k, letter in enumerate(_ENDS[state]):
            state = _NEXT[state]
            yield len(rows) - 1, 8 + k, letter, _ROLE[state], "", INSERT


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults planted by crc32(conv_id:turn) % 20: 0 drops a
    row, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 makes it a user's. Nulls
    count as one space (conv_id and turn keep their null); the other columns go."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    hurt = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind != 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Ranges of rows in their order, each row with what its own text tells of its fault."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault: Column = F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    rows = rows.withColumn("fault", fault).withColumn("_head", F.substring("text", 1, 64))
    return (
        rows.repartitionByRange("conv_id", "turn", "role", "_head").drop("_head")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )


_FIELDS = [
    ("block", pa.int32()), ("at", pa.int64()), ("step", pa.int32()), ("edit", pa.string()), ("turn", pa.int64()),
    ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("illegal", pa.bool_()),
    ("cost", pa.int32()), ("key", pa.binary()),
]
_SQL = "block int, at long, step int, edit string, turn long, role string, text string, fault string, illegal boolean, cost int, key binary"
FLUSH = 1 << 14


def _batch(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * (len(_FIELDS) + 1)
    fields = [("conv_id", kind), *_FIELDS]
    return pa.record_batch([pa.array(list(c), t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


_LEGAL = {"su", "ua", "au"}


def _illegal(before: str | None, role: str) -> bool:
    return before is not None and before[:1] + role[:1] not in _LEGAL


def _solved(conv, block: int, first: int, rows: list[tuple], start: int, states: list[int], last: bool, before: str | None) -> Iterator[tuple]:
    """Output rows of ``rows`` (turn, role, text, fault), the first of which is row ``first`` of its block."""
    edits = _edits([r[1:] for r in rows], states, start, last)
    for i, step, edit, role, text, cost in edits:
        turn, own, _, fault = rows[i]
        if edit == "I":
            yield conv, block, first + i, step, edit, None, role, text, None, None, cost, None
        else:
            bad = _illegal(rows[i - 1][1] if i else before, own)
            yield conv, block, first + i, step, edit, turn, role, text, fault, bad, cost, None


def _whole(kind: pa.DataType):
    """Solves the conversations that begin and end within a range; the rows of its first and last one,
    which may go on in other ranges, come without an edit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, out, held, at, conv, n = TaskContext.get().partitionId(), [], [], 0, None, 0

        def close(whole: bool) -> Iterator[tuple]:
            seen, rows, keys = set(), [], []
            for turn, role, text, fault in held:
                key = xxhash.xxh3_128_digest(f"{len(role)}:{role}{text}")
                if not fault == "blank" and key in seen:
                    fault = "duplicate"
                seen.add(key)
                rows.append((turn, role, text, fault))
                keys.append(key)
            first = at - len(held)
            if whole:
                steps = [_row(r[1][:1], r[3])[:2] for r in rows]
                yield from _solved(conv, block, first, rows, NONE, crossings(steps, NONE, END), True, None)
                return
            for i, ((turn, role, text, fault), key) in enumerate(zip(rows, keys)):
                bad = _illegal(rows[i - 1][1], role) if i else None
                yield conv, block, first + i, 0, None, turn, role, text, fault, bad, None, key

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]):
                if held and row[0] != conv:
                    out += close(n > 0)
                    held, n = [], n + 1
                conv = row[0]
                held.append(row[1:])
                at += 1
                if len(out) >= FLUSH:
                    yield _batch(kind, out)
                    out = []
        if held:
            out += close(False)
        yield _batch(kind, out)

    return run


def _symbols(rows: pa.Table) -> list[tuple]:
    return [_row(r[:1], f)[:2] for r, f in zip(rows.column("role").to_pylist(), rows.column("fault").to_pylist())]


def _block_matrix(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("at")
    costs, ranks = matrix(_symbols(rows))
    role = rows.column("role")
    return pa.table(
        {
            "conv_key": rows.column("conv_key").slice(0, 1), "block": rows.column("block").slice(0, 1),
            "costs": pa.array([sum(costs, ())], pa.list_(pa.int64())), "ranks": pa.array([sum(ranks, ())], pa.list_(pa.int64())),
            "head": pa.array([role[0].as_py()]), "tail": pa.array([role[-1].as_py()]),
        }
    )


def _block_states(rows: pa.Table) -> pa.Table:
    """For each block of a conversation the state before and after it, and the last role before it."""
    rows = rows.sort_by("block")
    four = lambda v: tuple(tuple(v[i : i + 4]) for i in range(0, 16, 4))
    steps = [(four(c), four(r)) for c, r in zip(rows.column("costs").to_pylist(), rows.column("ranks").to_pylist())]
    states = crossings(steps, NONE, END)
    return pa.table(
        {
            "conv_key": rows.column("conv_key"), "block": rows.column("block"),
            "enter": pa.array([NONE, *states[:-1]], pa.int32()), "leave": pa.array(states, pa.int32()),
            "last": pa.array([False] * (len(states) - 1) + [True]), "before": pa.array([None, *rows.column("tail").to_pylist()[:-1]], pa.string()),
        }
    )


def _block_edits(kind: pa.DataType):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        of = lambda c: rows.column(c)[0].as_py()
        states = crossings(_symbols(rows), of("enter"), _only(of("leave")))
        plain = list(zip(*[rows.column(c).to_pylist() for c in ("turn", "role", "text", "fault")]))
        done = _solved(of("conv_id"), of("block"), of("at"), plain, of("enter"), states, of("last"), of("before"))
        return pa.Table.from_batches([_batch(kind, list(done))])

    return run


def repair(rows: DataFrame) -> DataFrame:
    """The edits of all conversations of ``rows`` (conv_id, turn, role, text), a row per edit.

    ``edit`` is K, R, D or I; role and text are those of the repaired row (null if deleted); block, at,
    step give the order within a conversation. ``fault`` is blank, duplicate, truncated or "" (null for
    an insert), ``illegal`` tells that the row's role may not follow the row before it, as given.

    Rows are taken by turn, nulls first, equal turns by role, then text. A null role or text is one
    space; a null conv_id is a conversation of its own; equal rows are duplicates. A role that does not
    begin with s, u or a, an empty one too, cannot be kept. Other columns are ignored; an empty table
    gives no rows.
    """
    ordered = _ordered(rows)
    kind = pa.string() if ordered.schema["conv_id"].dataType.typeName() == "string" else pa.int64()
    if kind == pa.int64():
        ordered = ordered.withColumn("conv_id", F.col("conv_id").cast("long"))
    schema = f"conv_id {'string' if kind == pa.string() else 'long'}, {_SQL}"
    first = written(ordered.mapInArrow(_whole(kind), schema), "turns")
    done = first.where("edit IS NOT NULL")
    # conversations at the ends of ranges: at most two for each range, whatever their length
    key = F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("null"))
    open_ = first.where("edit IS NULL").withColumn("conv_key", key)
    # a block has each key once among the rows that are not yet duplicates, so no group is large
    seen = open_.where("fault NOT IN ('blank', 'duplicate')").groupBy("conv_key", "key").agg(F.min("block").alias("first_block"), F.count("*").alias("blocks"))
    seen = seen.where("blocks > 1").select("conv_key", "key", "first_block")
    again = (F.col("first_block") < F.col("block")) & ~F.col("fault").isin("blank", "duplicate")
    open_ = open_.join(seen, ["conv_key", "key"], "left").withColumn("fault", F.when(again, "duplicate").otherwise(F.col("fault")))
    open_ = written(open_.drop("key", "first_block"), "open-turns")
    narrow = open_.select("conv_key", "block", "at", "role", "fault")
    blocks = narrow.groupBy("conv_key", "block").applyInArrow(
        _block_matrix, "conv_key string, block int, costs array<long>, ranks array<long>, head string, tail string"
    )
    states = blocks.groupBy("conv_key").applyInArrow(
        _block_states, "conv_key string, block int, enter int, leave int, last boolean, before string"
    )
    states = small(written(states, "block-states"))
    late = open_.join(states, ["conv_key", "block"]).groupBy("conv_key", "block").applyInArrow(_block_edits(kind), schema)
    return done.unionByName(late).drop("key")


_DIGEST = "audit string, repaired_sha256 string"


def _digest(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        conv, audit, sha, any_, out, open_ = None, [], None, False, [], False
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "edit", "role", "text")]):
                if not open_ or row[0] != conv:
                    if open_:
                        out.append((conv, "".join(audit), sha.hexdigest()))
                    conv, audit, sha, any_, open_ = row[0], [], hashlib.sha256(), False, True
                audit.append(row[1])
                if row[1] != "D":
                    sha.update(("\n" if any_ else "").encode() + f"{row[2]}:{row[3]}".encode())
                    any_ = True
            if len(out) >= FLUSH:
                yield _digests(kind, out)
                out = []
        if open_:
            out.append((conv, "".join(audit), sha.hexdigest()))
        yield _digests(kind, out)

    return run


def _digests(kind: pa.DataType, rows: list[tuple]) -> pa.RecordBatch:
    conv, audit, sha = zip(*rows) if rows else ([], [], [])
    return pa.record_batch([pa.array(conv, kind), pa.array(audit, pa.string()), pa.array(sha, pa.string())], names=["conv_id", "audit", "repaired_sha256"])


def report(original: DataFrame, edits: DataFrame) -> DataFrame:
    """A row per conversation of ``original`` (conv_id): counts of what was wrong, cost, audit and the
    hash of the repaired rows ``role:text``, joined by line feeds; ``edits`` as repair gives them.

    A hash needs its rows in order, so a conversation's edits stream through one task, which holds
    their letters only. A conversation without rows has zeros, an empty audit and the hash of nothing.
    """
    conv_type = edits.schema["conv_id"].dataType.simpleString()
    kind = pa.string() if conv_type == "string" else pa.int64()
    edits = written(edits, "edits")
    ordered = edits.select("conv_id", "block", "at", "step", "edit", "role", "text").repartition("conv_id")
    ordered = ordered.sortWithinPartitions("conv_id", "block", "at", "step").select("conv_id", "edit", "role", "text")
    digests = ordered.mapInArrow(_digest(kind), f"conv_id {conv_type}, {_DIGEST}")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    turns = edits.where("edit != 'I'")
    spans = turns.where("turn IS NOT NULL").groupBy("conv_id", "turn").count().groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps")
    )
    sums = edits.groupBy("conv_id").agg(
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"), F.sum(F.col("cost").cast("long")).alias("cost"),
    )
    # null ids are equal in a grouping, not in a join
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    parts = [original.select(F.col("conv_id").cast(conv_type).alias("conv_id")).distinct(), spans, sums, digests]
    wide = parts[0]
    for part in parts[1:]:
        wide = wide.unionByName(part, allowMissingColumns=True)
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    return wide.groupBy("conv_id").agg(
        *[F.coalesce(F.max(n), F.lit(0).cast("long")).alias(n) for n in names],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"),
    )
