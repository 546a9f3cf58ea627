"""Cross-validation folds by thread, and the splits they define."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..schema import N_FOLDS
from .corpus import Corpus
from .skew import lookup_join, running

PHASES = "thread_size long, phases array<struct<start: long, cycle: array<int>>>"


def assignment_phases(histogram: list[tuple[int, int]], n_folds: int) -> list[tuple]:
    """How threads of each size are dealt out, largest size first, always to the lightest fold.

    Threads of one size s go out in rounds: a fold that is q*s + r above the lightest one joins
    in round q, and within a round the folds come in the order of r, then of their number.  So
    the deal for one size is at most `n_folds` phases, each a cycle over the folds taking part.
    """
    load = [0] * n_folds
    out = []
    for size, count in sorted(histogram, reverse=True):
        lightest = min(load)
        joins = [divmod(x - lightest, size) for x in load]
        turn = sorted(range(n_folds), key=lambda f: (joins[f][1], f))
        starts = sorted({q for q, _ in joins})
        dealt, phases = 0, []
        for i, q in enumerate(starts):
            cycle = [f for f in turn if joins[f][0] <= q]
            phases.append((dealt, cycle))
            left = count - dealt
            rounds = starts[i + 1] - q if i + 1 < len(starts) else left
            here = min(left, rounds * len(cycle))
            for place, f in enumerate(cycle):
                load[f] += size * ((here - place + len(cycle) - 1) // len(cycle))
            dealt += here
            if dealt == count:
                break
        out.append((size, phases))
    return out


def group_folds(corpus: Corpus, n_folds: int = N_FOLDS) -> DataFrame:
    """(tree_id, thread_size, fold): whole threads, largest first, to the lightest fold.

    Equal sizes are ordered by the MD5 of the thread id, which also cuts a large size class
    into even blocks for ranking.  Only the histogram of sizes reaches the driver; N messages
    have at most sqrt(2 N) different thread sizes.
    """
    spark = corpus.thread_sizes.sparkSession
    histogram = [
        (r["thread_size"], r["count"])
        for r in corpus.thread_sizes.groupBy("thread_size").count().collect()
    ]
    phases = spark.createDataFrame(assignment_phases(histogram, n_folds), PHASES)
    largest = max((n for _, n in histogram), default=0)
    keyed = corpus.thread_sizes.withColumn(
        "tie", F.md5(F.col("tree_id").cast("string"))
    ).withColumn("one", F.lit(1).cast("long"))
    block = F.substring("tie", 1, 4) if largest > 1 << corpus.limits.block_bits else None
    ranked = running(keyed, ["thread_size"], "tie", {"rank": ("sum", "one")}, block)
    threads = sum(n for _, n in histogram)
    return (
        lookup_join(ranked, phases, ["thread_size"], threads, "inner", corpus.limits)
        .withColumn("at", F.col("rank") - 1)
        .withColumn("phase", F.expr("element_at(filter(phases, p -> p.start <= at), -1)"))
        .select(
            "tree_id",
            "thread_size",
            F.expr("element_at(phase.cycle, int((at - phase.start) % size(phase.cycle)) + 1)")
            .cast("int").alias("fold"),
        )
    )


def in_folds(corpus: Corpus, folds: DataFrame, columns: list[str]) -> DataFrame:
    """Columns of the messages, tree_id among them, with the `fold` of their thread."""
    return lookup_join(
        corpus.columns(*columns), folds.select("tree_id", "fold"), ["tree_id"], corpus.rows, "inner", corpus.limits,
        corpus.widest,
    )


def fits(placed: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """Each message once per fit, as `train` or `test`."""
    return placed.withColumn("fit", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))).withColumn(
        "split", F.when(F.col("fit") == F.col("fold"), "test").otherwise("train")
    )


def split_sizes(placed: DataFrame, n_folds: int = N_FOLDS) -> DataFrame:
    """(fit, split, messages): counted per fold first, then added up per fit."""
    per_fold = placed.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
    return fits(per_fold, n_folds).groupBy("fit", "split").agg(F.sum("n").alias("messages"))


def _fold_authors(placed: DataFrame) -> DataFrame:
    return placed.where(F.col("author").isNotNull()).select("fold", "author").distinct()


def test_authors(placed: DataFrame, n_folds: int, seen_in_training: bool) -> DataFrame:
    """(fit, author) of test authors that are, or are not, among the fit's training authors."""
    both = fits(_fold_authors(placed), n_folds)
    test = both.where("split = 'test'").select("fit", "author")
    train = both.where("split = 'train'").select("fit", "author").distinct()
    return test.join(train, ["fit", "author"], "left_semi" if seen_in_training else "left_anti")
