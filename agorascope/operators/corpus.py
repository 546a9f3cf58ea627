"""A message table together with the sizes and thread positions its operators share."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scaling import array_sum
from ..functions.threads import NUMBERED, number
from ..schema import TAGS
from ..settings import DEFAULT_LIMITS, Limits, cut, stage
from .forest import depth_and_size, parent_links, preorder
from .skew import lookup_join, ranged, running


class Corpus:
    """Messages with `words` and the `tags` array, plus measured sizes.

    What the operators need of a message is written once without its text, so texts are read
    and counted a single time however many operators follow.
    """

    # messages without times or tags (plain threads) serve the thread operators only
    COLUMNS = ["message_id", "tree_id", "parent", "author", "ts", "words", "tags"]

    def __init__(
        self, messages: DataFrame, tags: list[str] = TAGS, limits: Limits = DEFAULT_LIMITS
    ):
        self._source = messages
        self.tags = list(tags)
        self.limits = limits

    @cached_property
    def messages(self) -> DataFrame:
        core = self._source.select(*[c for c in self.COLUMNS if c in self._source.columns])
        if "tags" in core.columns:
            core = core.withColumn("marks", array_sum(F.col("tags")).cast("long"))
        return stage(core)

    def columns(self, *names: str) -> DataFrame:
        """Some columns of the messages: from the written table if there is one or if it is
        needed, else straight from the source, where the text is pruned away."""
        if "messages" in self.__dict__ or {"words", "marks"} & set(names):
            return self.messages.select(*names)
        return self._source.select(*names)

    @cached_property
    def thread_sizes(self) -> DataFrame:
        return self.columns("tree_id").groupBy("tree_id").agg(F.count(F.lit(1)).alias("thread_size"))

    @cached_property
    def _shape(self) -> tuple[int, int]:
        row = self.thread_sizes.agg(F.sum("thread_size"), F.max("thread_size")).first()
        return row[0] or 0, row[1] or 0

    @property
    def rows(self) -> int:
        return self._shape[0]

    @property
    def widest(self) -> int:
        """Messages in the largest thread."""
        return self._shape[1]

    @property
    def wide(self) -> bool:
        """Some thread is too large for one task."""
        return self.widest > 1 << self.limits.block_bits

    @cached_property
    def narrow(self) -> bool:
        """Every thread fits into one task, and no two messages share an id."""
        return not self.wide and self.unique

    @cached_property
    def unique(self) -> bool:
        """No two messages share an id."""
        ids = self.columns("message_id").groupBy("message_id").count()
        return ids.where("count > 1 OR message_id IS NULL").isEmpty()

    @cached_property
    def links(self) -> DataFrame:
        return cut(
            parent_links(self.columns("message_id", "tree_id", "parent"), self.rows, self.limits)
        )

    @cached_property
    def tree_visits(self) -> DataFrame:
        """(message_id, tree_id, lo, hi, size): seen from the own row of the thread onwards."""
        rows = self.columns("message_id", "tree_id").withColumn("one", F.lit(1).cast("long"))
        if self.wide:
            rows = ranged(rows, "tree_id", "message_id")
        block = F.col("range") if self.wide else None
        ranked = running(rows, ["tree_id"], "message_id", {"rank": ("sum", "one")}, block)
        if self.wide:
            sized = lookup_join(
                ranked, self.thread_sizes, ["tree_id"], self.rows, "inner", self.limits, self.widest
            )
        else:
            sized = ranked.withColumn("thread_size", F.count("*").over(Window.partitionBy("tree_id"))).where(
                F.col("tree_id").isNotNull()
            )
        return sized.select(
            "message_id",
            "tree_id",
            (F.col("rank") - 1).alias("lo"),
            F.col("thread_size").alias("hi"),
            F.col("thread_size").alias("size"),
        )

    @cached_property
    def _walked(self) -> DataFrame:
        """`numbered` and `thread_size`, each thread by one task."""
        rows = self.columns("message_id", "tree_id", "parent")
        kind = rows.schema["tree_id"].dataType.simpleString()
        dealt = rows.repartition("tree_id").sortWithinPartitions("tree_id")
        walked = stage(dealt.mapInArrow(number, NUMBERED.format(kind)))
        if not walked.where(F.col("depth").isNull()).isEmpty():
            raise ValueError("the parent links contain a cycle")
        return walked

    @cached_property
    def numbered(self) -> DataFrame:
        """(message_id, tree_id, up, depth, size, pre) of the reply forest."""
        if self.narrow:
            return self._walked.drop("thread_size")
        sizes = depth_and_size(self.links, self.rows, self.limits)
        pre = preorder(self.links, sizes, self.rows, self.widest, self.limits)
        return stage(self.links.join(sizes, "message_id").join(pre, "message_id"))

    @cached_property
    def branch_visits(self) -> DataFrame:
        """(message_id, tree_id, lo, hi, size): seen from the own subtree only."""
        if self.narrow:
            sized = self._walked.withColumnRenamed("size", "below").where(F.col("tree_id").isNotNull())
        else:
            sized = lookup_join(
                self.numbered.withColumnRenamed("size", "below"),
                self.thread_sizes, ["tree_id"], self.rows, "inner", self.limits, self.widest,
            )
        return sized.select(
            "message_id",
            "tree_id",
            F.col("pre").alias("lo"),
            (F.col("pre") + F.col("below")).alias("hi"),
            F.col("thread_size").alias("size"),
        )

    def visits(self, level: str) -> DataFrame:
        if level == "tree":
            return self.tree_visits
        if level == "branch":
            return self.branch_visits
        raise ValueError("level must be 'tree' or 'branch'")
