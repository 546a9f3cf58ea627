import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from agorascope.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, block int, edit string, `a.b` int, fault string"
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def cheapest(rows):
    """(cost, audit, repaired) by a search over all edit sequences in order of (cost, audit)."""
    heap = [(0, "", 0, "", "")]
    while True:
        cost, audit, i, initials, done = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, done[1:]
        more = []
        if len(audit) < 2 * len(rows) + 2:
            more += [("I", 2, i, r, "") for r in ("user", "assistant")]
        if i < len(rows):
            role, text, fault = rows[i]
            more.append(("D", 3, i + 1, None, ""))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                more.append(("K", extra, i + 1, role, text))
                more += [("R", 2 + extra, i + 1, r, text) for r in ("user", "assistant")]
        for letter, price, at, role, text in more:
            now = initials + (role[:1] or "?" if role is not None else "")
            if re.fullmatch("(s?(ua)*u?)?", now):
                heapq.heappush(heap, (cost + price, audit + letter, at, now, done if role is None else f"{done}\n{role}:{text}"))


def brute(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in rows:
            fault = ""
            if BLANK.fullmatch(text):
                fault = "blank"
            elif (role, text) in seen:
                fault = "duplicate"
            elif re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1] not in ".!?":
                fault = "truncated"
            seen.add((role, text))
            marked.append((role, text, fault))
        numbers = {r[0] for r in rows if r[0] is not None}
        cost, audit, repaired = cheapest(marked)
        faults = [m[2] for m in marked]
        out[conv] = (
            max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:])),
            cost, audit, hashlib.sha256(repaired.encode()).hexdigest(),
        )
    return out


def made(seed, conversations, most):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "why", "Go on?  \n", "", " \t", "Yes.\x1c", "é.", None]
    return [
        (c, r.choice([t, t, t, None]), r.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), r.choice(texts))
        for c in range(conversations) for t in range(r.randint(1, most))
    ]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], SCHEMA)


def result(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = df.collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in got}


def repaired(rows):
    return turns.report(rows, turns.repair(turns.damaged(rows)))


@pytest.mark.parametrize("partitions", [1, 40])
def test_cheapest_edits(spark, partitions):
    rows = made(1, 60, 7) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (7, 5, "user", "Yes."), (7, 5, "user", "Yes.")]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # forty ranges stay forty
    try:
        assert result(repaired(frame(spark, rows))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])


def test_long_conversation_over_ranges(spark):
    """One conversation holds nearly all rows; its blocks are solved apart and give the same edits."""
    r = random.Random(3)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", ""]) + (f"{t % 700}." if r.random() < 0.9 else "")) for t in range(3000)]
    rows += [(c + 100, *x) for c, *x in made(5, 4, 3)]
    df = frame(spark, rows)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    got = {}
    for partitions in (1, 16):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        got[partitions] = result(repaired(df))
    spark.conf.set("spark.sql.shuffle.partitions", before[0])
    spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert got[1] == got[16]
    # forward costs and audits of all rows, without meeting in the middle
    marked, seen = [], set()
    for _, t, role, text in sorted(x for x in rows if x[0] == 1):
        kind = zlib.crc32(f"1:{t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            fault = "blank" if not text else "duplicate" if (role, text) in seen else "" if text[-1] in ".!?" else "truncated"
            seen.add((role, text))
            marked.append((role, fault))
    best = {turns.NONE: (0, "")}
    for role, fault in marked:
        costs, _, letters = turns._row(role[:1], fault)
        best = {
            t: min((c + costs[s][t], a + letters[s][t]) for s, (c, a) in best.items() if costs[s][t] < turns.FAR)
            for t in range(4) if any(costs[s][t] < turns.FAR for s in best)
        }
    cost, audit = min((c + turns.END[s], a + turns._ENDS[s]) for s, (c, a) in best.items())
    assert got[16][1][5:7] == (cost, audit)


def test_crossings_meet_anywhere():
    """The same states whether rows are taken one by one or as blocks."""
    r = random.Random(9)
    for _ in range(200):
        steps = [turns._row(r.choice("suax"), r.choice(["", "", "truncated", "blank"]))[:2] for _ in range(r.randint(1, 12))]
        states = turns.crossings(steps, turns.NONE, turns.END)
        cut = r.randint(0, len(steps))
        parts = [p for p in (steps[:cut], steps[cut:]) if p]
        ends = turns.crossings([turns.matrix(p) for p in parts], turns.NONE, turns.END)
        assert ends == [states[i] for i in ([cut - 1, len(steps) - 1] if len(parts) > 1 else [len(steps) - 1])]


def test_empty_table_and_dropped_conversation(spark):
    assert result(repaired(frame(spark, []))) == {}
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = result(repaired(frame(spark, [(conv, 0, "user", "Hi.")])))
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_edits_are_rows(spark):
    """The operator itself returns texts and faults; very long texts are whole."""
    long = "word " * 200_000 + "end."
    rows = spark.createDataFrame(
        [("x", 1, "user", long), ("x", 2, "user", long), ("x", 3, "assistant", "no end"), ("x", 4, "user", "Bye.")],
        "conv_id string, turn int, role string, text string",
    )
    got = turns.repair(rows).orderBy("block", "at", "step").select("edit", "role", F.length("text").alias("n"), "fault", "cost").collect()
    assert [(x.edit, x.role, x.n, x.fault, x.cost) for x in got] == [
        ("K", "user", 1_000_004, "", 0), ("D", None, None, "duplicate", 3), ("K", "assistant", 6, "truncated", 1),
        ("K", "user", 4, "", 0), ("I", "assistant", 0, None, 2),
    ]
    assert sum(x.cost for x in got) == 6
