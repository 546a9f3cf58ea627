"""What a message's author and the other authors look like in the message's context.

The context of a message is either its thread up to this message ("tree") or the message and
its ancestors ("branch").  In both cases a message is part of the contexts of a contiguous
range of thread positions: all later rows, or the own subtree in depth-first order.  So an
author's running numbers change only where one of the author's messages enters or leaves, and
a context is never listed row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import SCALED
from ..settings import stage, unstage
from .corpus import Corpus
from .intervals import covering_extremes
from .skew import running

AUTHOR = ["tree_id", "author"]


def author_events(
    corpus: Corpus, level: str, values: DataFrame, columns: list[str], with_time: bool = False
) -> DataFrame:
    """One row per position where an author's state in the thread changes, with the new state.

    `values` has message_id, author, the numeric `columns` and, `with_time`, ts.  The result
    has, per event, `pos`, `step` (order of events), `kind` (1 when a message enters, 0 when
    old ones leave), `message_id` of what enters, the change of each column and its running
    total `sum_<column>` over the author's messages that are visible at `pos`.  `next_pos` is
    where the author's state changes again, or the end of the thread.
    """
    visits = corpus.visits(level).join(values.where(F.col("author").isNotNull()), "message_id")
    time = [F.col("ts").cast("double").alias("ts")] if with_time else []
    events = visits.select(
        *AUTHOR, F.col("lo").alias("pos"), F.lit(1).alias("kind"),
        "message_id", "size", *columns, *time,
    )
    if level == "branch":
        # what leaves at one position is summed first, however many messages that are
        leave = (
            visits.where("hi < size")
            .groupBy(*AUTHOR, F.col("hi").alias("pos"))
            .agg(F.max("size").alias("size"), *[F.expr(f"-sum({c}) AS {c}") for c in columns])
            .withColumns({"kind": F.lit(0), "message_id": F.lit(None).cast("long")})
        )
        if with_time:
            leave = leave.withColumn("ts", F.lit(None).cast("double"))
        events = events.unionByName(leave)
    # at one position the old messages leave before the new one enters
    events = events.withColumn("step", F.col("pos") * 2 + F.col("kind"))
    block = F.shiftright("pos", corpus.limits.block_bits) if corpus.wide else None
    aggs = {f"sum_{c}": ("sum", c) for c in columns}
    if with_time:
        # exact where nothing leaves again, which is the tree level
        aggs |= {"min_ts": ("min", "ts"), "max_ts": ("max", "ts")}
    stated = running(events, AUTHOR, "step", aggs, block, {"next_pos": "pos"})
    return stated.withColumn("next_pos", F.coalesce("next_pos", "size"))


def _visible_times(corpus: Corpus, events: DataFrame) -> DataFrame:
    """First and last time over the author's messages on the way to the root.

    Minima cannot be taken back when a message leaves, so they come from the intervals in
    which the author's messages are visible.  A message enters with its own time; everything
    else it can see are messages with replies.
    """
    seen = (
        corpus.branch_visits.where("hi > lo + 1")
        .join(corpus.messages.select("message_id", "author", "ts"), "message_id")
        .where(F.col("author").isNotNull())
        .select(*AUTHOR, (F.col("lo") + 1).alias("lo"), "hi", "size", F.col("ts").cast("double").alias("ts"))
    )
    points = events.where((F.col("sum_one") > F.col("kind"))).select(
        *AUTHOR, "step", "pos", "size"
    )
    times = covering_extremes(seen, points, AUTHOR, ["ts"], corpus.widest, corpus.limits, corpus.wide or corpus.narrow)
    return (
        events.drop("min_ts", "max_ts")
        .join(times.select(*AUTHOR, "step", "lo_ts", "hi_ts"), [*AUTHOR, "step"], "left")
        .withColumns({"min_ts": F.least("ts", "lo_ts"), "max_ts": F.greatest("ts", "hi_ts")})
        .drop("lo_ts", "hi_ts")
    )


def author_states(corpus: Corpus, level: str) -> DataFrame:
    """Running activity of each author at each change, materialised.

    `history` holds the tag sums over the author's visible messages without the entering one.
    """
    tags = range(len(corpus.tags))
    values = corpus.messages.selectExpr(
        "message_id", "author", "ts", "words", "marks", "1L AS one",
        *[f"CAST(tags[{i}] AS BIGINT) AS t{i}" for i in tags],
    )
    columns = ["one", "words", "marks", *[f"t{i}" for i in tags]]
    events = author_events(corpus, level, values, columns, with_time=True)
    earlier = ", ".join(f"sum_t{i} - t{i}" for i in tags)
    events = events.selectExpr(
        *AUTHOR, "step", "pos", "kind", "message_id", "size", "next_pos",
        "sum_one", "sum_words", "sum_marks", "ts", "min_ts", "max_ts",
        f"CAST(array({earlier}) AS ARRAY<DOUBLE>) AS history",
    )
    if level != "branch":
        return stage(events.drop("ts"))
    written = stage(events)
    states = stage(_visible_times(corpus, written).drop("ts"))
    unstage(written)
    return states


def measures(count: Column, words: Column, marks: Column) -> dict[str, Column]:
    """The numbers of an author that are compared over the authors of a context."""
    count = count.cast("double")
    return {
        "num_comment": count,
        "min_ts": F.col("min_ts"),
        "sending_rate": (F.col("max_ts") - F.col("min_ts")) / count,
        "avg_word_text": words / count,
        "avg_tag_msg": marks / count,
    }


def written_contexts(corpus: Corpus, levels: list[str]) -> DataFrame:
    """`message_contexts`, written; the states they are made of are not kept."""
    states = []
    contexts = stage(message_contexts(corpus, levels, states))
    for part in states:
        unstage(part)
    return contexts


def message_contexts(corpus: Corpus, levels: list[str], made: list[DataFrame] | None = None) -> DataFrame:
    """One row per level and message: the author's own state, and the others' extremes.

    Columns: level, message_id, tree_id, author, n (own messages so far, this one included),
    history (tag sums without this one), the own num_comment, min_ts, sending_rate and
    avg_word_text, and lo_/hi_ of the five scaled numbers over the other authors, NULL where
    the author is alone.  `made` gets the written tables that the rows are made of.
    """
    states = None
    for level in levels:
        part = author_states(corpus, level)
        if made is not None:
            made.append(part)
        part = part.withColumn("level", F.lit(level))
        states = part if states is None else states.unionByName(part)
    keys = ["level", "tree_id"]
    values = measures(F.col("sum_one"), F.col("sum_words"), F.col("sum_marks"))
    # while an author writes, the context sees the author without the new message's tags; so
    # the state counts for others only from the next position on
    spells = states.where("sum_one > 0").select(
        *keys,
        (F.col("pos") + F.col("kind")).alias("lo"),
        F.col("next_pos").alias("hi"),
        "size",
        *[c.alias(name) for name, c in values.items()],
    )
    entering = states.where("kind = 1")
    points = entering.select(*keys, "message_id", "pos", "size")
    others = covering_extremes(spells, points, keys, SCALED, corpus.widest, corpus.limits, corpus.wide or corpus.narrow)
    own = entering.select(
        *keys, "message_id", "author", F.col("sum_one").alias("n"), "history",
        *[c.alias(name) for name, c in values.items() if name != "avg_tag_msg"],
    )
    return own.join(
        others.drop("tree_id", "pos", "size"), ["level", "message_id"], "left"
    )
