"""Multi-label metrics over a long score table.

`scores` has message_id, fold, tag_pos, y (0/1) and p (score).  Everything is a hash
aggregation with few groups, combined before the shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.arrow import changes, ordered
from ..functions.scaling import ratio_or_zero
from ..schema import TAG_CATEGORY, TAGS
from ..settings import stage

EPSILON = 1e-7  # fixed value: scores are clipped to [EPSILON, 1 - EPSILON] before the logarithm
METRICS = ["Loss", "Accuracy", "Macro F1-score", "Weighted F1-score"]


def tag_table(spark: SparkSession, tags: list[str] = TAGS) -> DataFrame:
    """(tag_pos, tag, category): one row per tag."""
    rows = [(i, t, TAG_CATEGORY.get(t)) for i, t in enumerate(tags)]
    return spark.createDataFrame(rows, "tag_pos int, tag string, category string")


def labels_long(messages: DataFrame, *keep: str) -> DataFrame:
    """(message_id, ..., tag_pos, y): one row per message and tag."""
    return messages.select(
        "message_id", *keep, F.posexplode("tags").alias("tag_pos", "y")
    )


def binarize(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scores.withColumn("predicted", (F.col("p") > threshold).cast("int"))


def tag_support(labels: DataFrame) -> DataFrame:
    return labels.groupBy("tag_pos").agg(F.sum("y").alias("support"))


def with_category(df: DataFrame, tags: list[str] = TAGS) -> DataFrame:
    """Add tag and category; the tag table has one row per tag."""
    return df.join(F.broadcast(tag_table(df.sparkSession, tags)), "tag_pos")


def tag_prf(scores: DataFrame, keys: list[str] = ("fold",), threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support per tag; 0 where undefined."""
    hit = binarize(scores, threshold)
    y, z = F.col("y").cast("long"), F.col("predicted").cast("long")
    counts = hit.groupBy(*keys, "tag_pos").agg(
        F.sum(y * z).alias("tp"), F.sum(z).alias("found"), F.sum(y).alias("support")
    )
    tp = F.col("tp").cast("double")
    return counts.select(
        *keys,
        "tag_pos",
        ratio_or_zero(tp, F.col("found").cast("double")).alias("precision"),
        ratio_or_zero(tp, F.col("support").cast("double")).alias("recall"),
        ratio_or_zero(2.0 * tp, (F.col("found") + F.col("support")).cast("double")).alias("f1"),
        "support",
    )


def tag_weights(prf: DataFrame, keys: list[str] = ("fold",), tags: list[str] = TAGS) -> DataFrame:
    """Add category, its support, and the tag's share of it (0 if the category is empty)."""
    spec = Window.partitionBy(*keys, "category")  # at most one row per tag
    df = with_category(prf, tags).withColumn("category_support", F.sum("support").over(spec))
    return df.withColumn(
        "weight",
        ratio_or_zero(F.col("support").cast("double"), F.col("category_support").cast("double")),
    )


def overall_f1(prf: DataFrame, keys: list[str] = ("fold",)) -> DataFrame:
    total = F.sum("support").cast("double")
    return prf.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"),
        ratio_or_zero(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"),
    )


def category_f1(weights: DataFrame, keys: list[str] = (), folds: str = "fold") -> DataFrame:
    """Per category over its tags and all folds.

    `weighted_mean` averages f1 * weight over the tags and folds; `weighted_sum` adds it up
    within a fold, which is the support-weighted F1, and averages over the folds.
    """
    part = F.col("f1") * F.col("weight")
    return weights.groupBy(*keys, "category").agg(
        F.avg("f1").alias("macro_f1"),
        F.avg(part).alias("weighted_mean"),
        (F.sum(part) / F.count_distinct(folds)).alias("weighted_sum"),
    )


def bce(y: Column, p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    return -(y * F.log(clipped) + (1 - y) * F.log(1.0 - clipped))


def bce_loss(scores: DataFrame, keys: list[str] = ("fold",)) -> DataFrame:
    return scores.groupBy(*keys).agg(F.avg(bce(F.col("y"), F.col("p"))).alias("loss"))


def _best_of_runs(group: list[str]):
    """Per run of rows with the same group: its first tag, and where y and p are highest first."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            new = changes([batch.column(c) for c in group])
            starts, pos = np.flatnonzero(new), batch.column("tag_pos").to_numpy()
            of = np.cumsum(new) - 1
            columns = [batch.column(c).take(pa.array(starts)) for c in group]
            columns.append(pa.array(np.minimum.reduceat(pos, starts), pa.int32()))
            for c in ("y", "p"):
                value = ordered(batch.column(c))
                top = np.maximum.reduceat(value, starts)
                at = np.where(value == top[of], pos, np.iinfo(pos.dtype).max)  # the lowest position wins a tie
                columns += [pa.array(top), pa.array(-np.minimum.reduceat(at, starts), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*group, "first", "y", "y_at", "p", "p_at"])

    return run


def message_hits(scores: DataFrame, keys: list[str] = ("fold",)) -> DataFrame:
    """(keys, message_id, first, hit): the message's first tag, and whether its highest score is at the
    first set tag.

    A message's rows mostly follow one another, so each task first makes one row of every run; only those
    are dealt by message.
    """
    group = [*keys, "message_id"]
    found = scores.select(*group, F.col("tag_pos").cast("int").alias("tag_pos"), "y", "p")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema.fields[: len(group)])
    runs = found.mapInArrow(_best_of_runs(group), f"{kinds}, first int, y long, y_at int, p long, p_at int")
    best = runs.groupBy(*group).agg(
        F.min("first").alias("first"), F.max(F.struct("y", "y_at")).alias("truth"), F.max(F.struct("p", "p_at")).alias("guess")
    )
    return best.select(*group, "first", (F.col("truth.y_at") == F.col("guess.p_at")).alias("hit"))


def argmax_accuracy(scores: DataFrame, keys: list[str] = ("fold",)) -> DataFrame:
    """Share of messages whose highest score is at the first set tag."""
    return message_hits(scores, keys).groupBy(*keys).agg(F.avg(F.col("hit").cast("double")).alias("accuracy"))


def binary_accuracy(scores: DataFrame, keys: list[str] = ("fold",), threshold: float = 0.5) -> DataFrame:
    same = (F.col("predicted") == F.col("y")).cast("double")
    return binarize(scores, threshold).groupBy(*keys).agg(F.avg(same).alias("binary_accuracy"))


def tag_statistics(rows: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, fold, tag_pos, tp, found, support, n, loss, hits, messages): sums that all metrics follow
    from, in one pass over ``rows`` (keys, fold, v), where v is a message's array of (tag_pos, y, p).

    hits counts messages whose highest score is at the first set tag, messages all of them; both
    stand with the message's first tag, so that sums over the tags count a message once.
    """
    best = lambda c: F.expr(f"array_max(transform(v, x -> named_struct('value', x.{c}, 'at', -x.tag_pos))).at")
    tall = rows.select(*keys, "fold", (best("y") == best("p")).cast("long").alias("hit"), F.posexplode("v").alias("place", "x"))
    y, z = F.col("x.y").cast("long"), (F.col("x.p") > 0.5).cast("long")
    first = F.col("place") == 0
    return tall.groupBy(*keys, "fold", F.col("x.tag_pos").alias("tag_pos")).agg(
        F.sum(y * z).alias("tp"), F.sum(z).alias("found"), F.sum(y).alias("support"), F.count("*").alias("n"),
        F.sum(bce(F.col("x.y"), F.col("x.p"))).alias("loss"),
        F.sum(F.when(first, F.col("hit")).otherwise(0)).alias("hits"), F.sum(first.cast("long")).alias("messages"),
    )


def long_statistics(scores: DataFrame, keys: list[str] = ()) -> DataFrame:
    """What tag_statistics gives of by_message, from a long score table that is never put together by
    message: sums per tag are added up in the tasks, and so is a row per message for the hits."""
    per_fold = [*keys, "fold"]
    y, z = F.col("y").cast("long"), (F.col("p") > 0.5).cast("long")
    none = F.lit(0).cast("long")
    sums = scores.groupBy(*per_fold, "tag_pos").agg(
        F.sum(y * z).alias("tp"), F.sum(z).alias("found"), F.sum(y).alias("support"), F.count("*").alias("n"),
        F.sum(bce(F.col("y"), F.col("p"))).alias("loss"), none.alias("hits"), none.alias("messages"),
    )
    hits = message_hits(scores, per_fold).groupBy(*per_fold, F.col("first").alias("tag_pos")).agg(
        F.sum(F.col("hit").cast("long")).alias("hits"), F.count("*").alias("messages")
    )
    parts = sums.unionByName(hits, allowMissingColumns=True)  # a few rows per fold and tag
    return parts.groupBy(*per_fold, "tag_pos").agg(
        *[F.sum(c).alias(c) for c in ("tp", "found", "support", "n", "loss", "hits", "messages")]
    )


def by_message(scores: DataFrame, keys: list[str] = ()) -> DataFrame:
    """A long score table as one row per message, for tag_statistics."""
    values = F.array_sort(F.collect_list(F.struct("tag_pos", "y", "p")))  # one element per tag
    return scores.groupBy(*keys, "fold", "message_id").agg(values.alias("v"))


def statistics_prf(stats: DataFrame, keys: list[str] = ()) -> DataFrame:
    """What tag_prf gives, from tag_statistics."""
    tp, found, support = (F.col(c).cast("double") for c in ("tp", "found", "support"))
    return stats.select(
        *keys, "fold", "tag_pos", ratio_or_zero(tp, found).alias("precision"), ratio_or_zero(tp, support).alias("recall"),
        ratio_or_zero(2.0 * tp, found + support).alias("f1"), "support",
    )


def fold_metrics_of(stats: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, fold, loss, accuracy, macro_f1, weighted_f1) from tag_statistics."""
    per_fold = [*keys, "fold"]
    sums = stats.groupBy(*per_fold).agg(
        (F.sum("loss") / F.sum("n")).alias("loss"), (F.sum("hits") / F.sum("messages")).alias("accuracy")
    )
    return overall_f1(statistics_prf(stats, keys), per_fold).join(sums, per_fold)


def fold_metrics(scores: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, fold, loss, accuracy, macro_f1, weighted_f1) of a long score table."""
    return fold_metrics_of(stage(long_statistics(scores, keys)), keys)


def results(scores: DataFrame, keys: list[str] = (), tags: list[str] = TAGS) -> DataFrame:
    """(keys, metric, value): everything that is reported, averaged over the folds."""
    return results_of(stage(long_statistics(scores, keys)), list(keys), tags)


def results_of(stats: DataFrame, keys: list[str] = (), tags: list[str] = TAGS) -> DataFrame:
    """The same from tag_statistics, a row per fold and tag."""
    keys = list(keys)
    names = dict(zip(["loss", "accuracy", "macro_f1", "weighted_f1"], METRICS))
    over_folds = fold_metrics_of(stats, keys).groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in names]
    )
    overall = over_folds.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value")) for c, m in names.items()])
        ).alias("r"),
    ).select(*keys, "r.*")
    weights = tag_weights(statistics_prf(stats, keys), [*keys, "fold"], tags)
    by_category = category_f1(weights, keys).select(
        *keys,
        F.explode(
            F.array(
                F.struct(F.concat(F.lit("Macro F1-"), "category").alias("metric"), F.col("macro_f1").alias("value")),
                F.struct(F.concat(F.lit("Weighted F1-"), "category").alias("metric"), F.col("weighted_mean").alias("value")),
            )
        ).alias("r"),
    ).select(*keys, "r.*")
    return overall.unionByName(by_category)


def report_lines(table: DataFrame) -> DataFrame:
    """Each result as text with four decimals."""
    return table.withColumn("line", F.format_string("%s: %.4f", F.col("metric"), F.col("value")))
