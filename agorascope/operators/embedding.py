"""Mean text embeddings of authors: over the forum, the thread so far, and the branch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.sums import fit_means as means_per_fit, partial_sums
from ..functions.threads import both_means, chain_means
from ..schema import N_FOLDS
from ..settings import stage
from .context import AUTHOR, author_events
from .corpus import Corpus
from .folds import in_folds
from .forest import doubled
from .intervals import covering_extremes
from .profile import ALL
from .skew import lookup_join


def width(embeddings: DataFrame) -> int:
    """Length of the vectors, read from one of them."""
    row = embeddings.select(F.size("embedding").alias("d")).first()
    return row["d"] if row else 0


def _components(d: int, named: bool = True) -> list[str]:
    """The components as columns; NaN counts as missing, as NULL does."""
    if not named:
        return [f"embedding[{i}]" for i in range(d)]
    return [f"nanvl(CAST(embedding[{i}] AS DOUBLE), NULL) AS e{i}" for i in range(d)]


def fit_means(
    corpus: Corpus, embeddings: DataFrame, d: int, folds: DataFrame | None = None,
    n_folds: int = N_FOLDS,
) -> DataFrame:
    """(author, which, vectors): the author's different element-wise means over training messages, and for
    each fit the place of its mean among them, NULL if the fit trains on none of the author's messages.

    Sums are made before the only shuffle by author; an author of one fold has one mean, whatever the
    number of fits.  Without folds there is one fit of all messages.
    """
    columns = ["message_id", "tree_id", "author"]
    if folds is None:
        placed, n_folds = corpus.columns(*columns).withColumn("fold", F.lit(-1)), 1
    else:
        placed = in_folds(corpus, folds, columns)
    kind = placed.schema["author"].dataType.simpleString()
    values = placed.where(F.col("author").isNotNull()).join(
        embeddings.selectExpr("message_id", f"array({', '.join(_components(d, False))}) AS embedding"), "message_id"
    ).select("author", F.col("fold").cast("int").alias("fold"), "embedding")
    sums = values.mapInArrow(partial_sums(d), f"author {kind}, fold int, n array<long>, total array<double>")
    return sums.repartition("author").sortWithinPartitions("author", "fold").mapInArrow(
        means_per_fit(d, n_folds), f"author {kind}, which array<int>, vectors array<array<double>>"
    )


def author_means(
    corpus: Corpus, embeddings: DataFrame, d: int, folds: DataFrame | None = None,
    n_folds: int = N_FOLDS,
) -> DataFrame:
    """(fit, author, mean): element-wise mean over the author's training messages."""
    each = fit_means(corpus, embeddings, d, folds, n_folds).select(
        F.posexplode("which").alias("fit", "at"), "author", "vectors"
    )
    fit = F.lit(ALL) if folds is None else F.col("fit")
    return each.where("at IS NOT NULL").select(fit.alias("fit"), "author", F.expr("vectors[at]").alias("mean"))


def default_mean(means: DataFrame, d: int) -> DataFrame:
    """(fit, mean): every author counts once.  `means` are those of `fit_means` or of `author_means`.

    A mean that several fits share is added up once, for all of them."""
    if "vectors" in means.columns:
        at = F.posexplode("vectors").alias("at", "mean")
        means = means.select("which", at).select("mean", F.expr(
            "transform(filter(transform(which, (w, i) -> struct(w, i)), x -> x.w = at), x -> x.i) AS fits"
        ))
    else:
        means = means.select("mean", F.array("fit").alias("fits"))
    sums = means.groupBy("fits").agg(
        *[F.expr(f"sum(mean[{i}]) AS s{i}") for i in range(d)], *[F.expr(f"count(mean[{i}]) AS n{i}") for i in range(d)]
    )
    mean = ", ".join(f"sum(s{i}) / nullif(sum(n{i}), 0)" for i in range(d))
    return sums.withColumn("fit", F.explode("fits")).groupBy("fit").agg(F.expr(f"array({mean}) AS mean"))


def context_means(corpus: Corpus, embeddings: DataFrame, d: int, level: str) -> DataFrame:
    """(message_id, mean): the author's messages in the context, this one included.

    Missing components are left out of their mean; a component that is always missing is NULL.
    """
    if level == "branch":
        return _branch_means(corpus, embeddings, d)
    if corpus.narrow:
        rows = corpus.columns("message_id", "tree_id", "author").where("author IS NOT NULL AND tree_id IS NOT NULL")
        rows = rows.join(embeddings.select("message_id"), "message_id", "left_semi")
        chain = rows.selectExpr(
            "message_id", "tree_id", "message_id AS lo",
            "lag(message_id) OVER (PARTITION BY tree_id, author ORDER BY message_id) AS at",
        )
        return _means_in_tasks(chain, embeddings, d)
    names = [f"e{i}" for i in range(d)]
    # nothing leaves a thread's context again, so running sums only add
    values = corpus.columns("message_id", "author").join(
        embeddings.selectExpr("message_id", *_components(d)), "message_id"
    ).selectExpr(
        "message_id", "author",
        *[f"coalesce({c}, 0D) AS {c}" for c in names],
        *[f"CAST({c} IS NOT NULL AS BIGINT) AS n_{c}" for c in names],
    )
    events = author_events(corpus, level, values, [*names, *[f"n_{c}" for c in names]])
    means = ", ".join(f"sum_{c} / nullif(sum_n_{c}, 0)" for c in names)
    return events.where("kind = 1").selectExpr("message_id", f"array({means}) AS mean")


def _means_in_tasks(chain: DataFrame, embeddings: DataFrame, d: int) -> DataFrame:
    """(message_id, mean) over chains (message_id, tree_id, lo, at) inside threads that fit into a task."""
    vector = embeddings.selectExpr("message_id", f"array({', '.join(_components(d, False))}) AS embedding")
    rows = chain.join(vector, "message_id")
    return rows.repartition("tree_id").sortWithinPartitions("tree_id", "lo").mapInArrow(
        chain_means(d), "message_id long, mean array<double>"
    )


def _nearest(corpus: Corpus) -> tuple[DataFrame, DataFrame]:
    """Messages with an author by their place in the thread, and the place (hi_at) of the nearest one above
    by the same author."""
    visits = stage(
        corpus.branch_visits.join(corpus.columns("message_id", "author"), "message_id")
        .where(F.col("author").isNotNull())
        .select("message_id", *AUTHOR, "lo", "hi", "size")
    )
    seen = visits.where("hi > lo + 1").select(
        *AUTHOR, (F.col("lo") + 1).alias("lo"), "hi", "size", F.col("lo").alias("at")
    )
    points = visits.select(*AUTHOR, "message_id", F.col("lo").alias("pos"), "size")
    # of the same author's open subtrees the one that began last is the nearest ancestor's
    nearest = covering_extremes(seen, points, AUTHOR, ["at"], corpus.widest, corpus.limits, corpus.wide or corpus.narrow)
    return visits, nearest


def thread_means(corpus: Corpus, embeddings: DataFrame, d: int, rows: DataFrame) -> DataFrame:
    """`rows` (message_id, author, ...) of the messages, with their means as floats, mean_tree and
    mean_branch: those of `context_means`, NULL where there is none. Threads that fit into a task have both
    worked out there, with one shuffle of the vectors."""
    kept = rows.columns
    if not corpus.narrow:
        for level in ("tree", "branch"):
            part = context_means(corpus, embeddings, d, level)
            rows = rows.join(
                part.select("message_id", F.col("mean").cast("array<float>").alias(f"mean_{level}")), "message_id", "left"
            )
        return rows
    _, nearest = _nearest(corpus)
    places = corpus.branch_visits.select("message_id", "tree_id", "lo")
    at = nearest.select("message_id", F.col("hi_at").alias("at"))
    vector = embeddings.selectExpr("message_id", f"array({', '.join(_components(d, False))}) AS embedding")
    full = rows.join(places, "message_id").join(at, "message_id", "left").join(vector, "message_id", "left")
    schema = ", ".join(f"`{c}` {full.schema[c].dataType.simpleString()}" for c in kept)
    return full.select(*kept, "tree_id", "lo", "at", "embedding").repartition("tree_id").sortWithinPartitions(
        "tree_id", "lo"
    ).mapInArrow(both_means(d, kept), f"{schema}, mean_tree array<float>, mean_branch array<float>")


def _branch_means(corpus: Corpus, embeddings: DataFrame, d: int) -> DataFrame:
    """A message's ancestors by the same author form a chain: each points to the nearest one above
    it. Sums over the chain come from doubling these pointers, so a sibling branch never enters a
    sum, and a value that is not finite stays with those that see it."""
    visits, nearest = _nearest(corpus)
    if corpus.narrow:
        chain = visits.select("message_id", "tree_id", "lo").join(
            nearest.select("message_id", F.col("hi_at").alias("at")), "message_id", "left"
        )
        return _means_in_tasks(chain, embeddings, d)
    above = visits.select("tree_id", F.col("lo").alias("hi_at"), F.col("message_id").alias("up"))
    links = nearest.select("message_id", "tree_id", "hi_at").join(above, ["tree_id", "hi_at"]).select("message_id", "up")
    values = embeddings.selectExpr("message_id", *_components(d)).selectExpr(
        "message_id",
        f"array({', '.join(f'coalesce(e{i}, 0D)' for i in range(d))}) AS total",
        f"array({', '.join(f'CAST(e{i} IS NOT NULL AS BIGINT)' for i in range(d))}) AS n",
    )
    start = visits.select("message_id").join(links, "message_id", "left").join(values, "message_id")
    summed = doubled(start.select("message_id", "up", "total", "n"), ["total", "n"], corpus.rows, corpus.limits)
    mean = F.zip_with("total", "n", lambda x, k: F.when(k > 0, x / k))
    return summed.select("message_id", mean.alias("mean"))


def forum_means(corpus: Corpus, means: DataFrame, messages: DataFrame, repeats: int = 1) -> DataFrame:
    """Author mean on each row of `messages` (fit, author, ...); NULL for unknown authors."""
    return lookup_join(
        messages, means, ["fit", "author"], corpus.rows * repeats, "left", corpus.limits
    )
