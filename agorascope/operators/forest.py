"""Reply forest: depth, subtree size and preorder number of every message.

All loops double the reach of a pointer per round, so a reply chain of length d takes log2(d)
rounds, and every round is a join on message ids.  No root-to-message path is ever built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import NO_PARENT
from ..settings import DEFAULT_LIMITS, Limits, cut, stage
from .skew import lookup_join, ranged, running


def parent_links(messages: DataFrame, rows: int, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(message_id, tree_id, up): `up` is the parent if it is a message of the same thread."""
    nodes = messages.select("message_id", "tree_id", "parent")
    replies = nodes.where(F.col("parent") != NO_PARENT).select(
        "message_id", "tree_id", F.col("parent").alias("asked")
    )
    known = nodes.select("tree_id", F.col("message_id").alias("asked"), F.lit(True).alias("found"))
    linked = lookup_join(replies, known, ["tree_id", "asked"], rows, "left", limits)
    roots = nodes.where(F.col("parent").isNull() | (F.col("parent") == NO_PARENT))
    return linked.select(
        "message_id", "tree_id", F.when(F.col("found"), F.col("asked")).alias("up")
    ).unionByName(roots.select("message_id", "tree_id", F.lit(None).cast("long").alias("up")))


def doubled(state: DataFrame, add: list[str], rows: int, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """`state` (message_id, up, arrays `add`) with the arrays added up, element by element, over the
    message and all it reaches by following `up`. Only additions, of what is really reached."""

    def step(state: DataFrame) -> DataFrame:
        both = [F.zip_with(c, f"_{c}", lambda x, y: x + y).alias(c) for c in add]
        moved = _double(state, add, rows, limits).select("message_id", F.col("_up").alias("up"), *both)
        return moved.unionByName(state.where(F.col("up").isNull()).select("message_id", "up", *add))

    return _run(cut(state), step, rows)


def _double(state: DataFrame, add: list[str], rows: int, limits: Limits) -> DataFrame:
    """Rows that still point somewhere, moved to where their target points."""
    target = state.select(
        F.col("message_id").alias("up"),
        F.col("up").alias("_up"),
        *[F.col(c).alias(f"_{c}") for c in add],
    )
    moving = state.where(F.col("up").isNotNull())
    return lookup_join(moving, target, ["up"], rows, "inner", limits)


def _run(state: DataFrame, step, rows: int) -> DataFrame:
    reach = 1
    while not state.where(F.col("up").isNotNull()).isEmpty():
        if reach > 2 * rows:
            raise ValueError("the parent links contain a cycle")
        state = cut(step(state))
        reach *= 2
    return state


def depth_and_size(links: DataFrame, rows: int, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(message_id, depth, size): replies up to the root, and messages in the own subtree."""

    def step(state: DataFrame) -> DataFrame:
        moved = _double(state, ["depth"], rows, limits).select(
            "message_id",
            F.col("_up").alias("up"),
            (F.col("depth") + F.col("_depth")).alias("depth"),
            "size",
        )
        still = state.where(F.col("up").isNull())
        none = F.lit(None).cast("long")
        # what a message has counted so far also belongs to the message it points at
        passed_on = state.where(F.col("up").isNotNull()).select(
            F.col("up").alias("message_id"), none.alias("up"), none.alias("depth"), "size"
        )
        return (
            moved.unionByName(still)
            .unionByName(passed_on)
            .groupBy("message_id")
            .agg(F.max("up").alias("up"), F.max("depth").alias("depth"), F.sum("size").alias("size"))
        )

    start = links.select(
        "message_id",
        "up",
        F.col("up").isNotNull().cast("long").alias("depth"),
        F.lit(1).cast("long").alias("size"),
    )
    return _run(start, step, rows).select("message_id", "depth", "size")


def preorder(
    links: DataFrame, sizes: DataFrame, rows: int, widest: int, limits: Limits = DEFAULT_LIMITS
) -> DataFrame:
    """(message_id, pre): position in a depth-first walk of the thread, siblings by id.

    The subtree of a message is then exactly the positions [pre, pre + size).
    """
    siblings = links.join(sizes, "message_id").withColumn(
        "under", F.coalesce("up", F.lit(NO_PARENT))
    )
    block = None
    if widest > 1 << limits.block_bits:
        siblings = ranged(siblings, "tree_id", "under", "message_id")
        block = F.col("range")
    offsets = running(
        siblings, ["tree_id", "under"], "message_id", {"upto": ("sum", "size")}, block
    )
    start = offsets.select(
        "message_id",
        "up",
        (F.col("upto") - F.col("size") + F.col("up").isNotNull().cast("long")).alias("pre"),
    )

    def step(state: DataFrame) -> DataFrame:
        moved = _double(state, ["pre"], rows, limits).select(
            "message_id", F.col("_up").alias("up"), (F.col("pre") + F.col("_pre")).alias("pre")
        )
        return moved.unionByName(state.where(F.col("up").isNull()))

    return _run(cut(start), step, rows).select("message_id", "pre")


def leaves(messages: DataFrame) -> DataFrame:
    """Messages nobody answered."""
    parents = messages.select("tree_id", F.col("parent").alias("message_id")).where(
        F.col("message_id") != NO_PARENT
    )
    # one row per answered message, so a much-answered one does not skew the join
    return messages.join(parents.distinct(), ["tree_id", "message_id"], "left_anti")


def leaf_paths(links: DataFrame, rows: int, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """(leaf_id, up_steps, message_id): all messages on the way from each leaf to its root.

    The result is the paths themselves, one row per step.  Round k adds the steps
    2**k .. 2**(k+1)-1, each exactly once, by following a pointer 2**k long.
    """
    parents = links.select(F.col("up").alias("message_id")).distinct()
    ends = links.join(parents, "message_id", "left_anti")
    jump = cut(links.select("message_id", "up"))
    paths = stage(
        ends.select(
            F.col("message_id").alias("leaf_id"), F.lit(0).cast("long").alias("up_steps"),
            "message_id",
        )
    )
    known, reach = paths.count(), 1
    while not jump.where(F.col("up").isNotNull()).isEmpty():
        if reach > 2 * rows:
            raise ValueError("the parent links contain a cycle")
        further = lookup_join(
            paths, jump.where(F.col("up").isNotNull()), ["message_id"], known, "inner", limits
        )
        # only the new steps are written; what earlier rounds wrote is read where it is
        new = stage(
            further.select(
                "leaf_id", (F.col("up_steps") + reach).alias("up_steps"),
                F.col("up").alias("message_id"),
            )
        )
        paths, known = paths.unionByName(new), known + new.count()
        moved = _double(jump, [], rows, limits).select("message_id", F.col("_up").alias("up"))
        jump = cut(moved.unionByName(jump.where(F.col("up").isNull())))
        reach *= 2
    return paths
