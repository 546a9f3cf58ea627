"""Speaker profiles: 38 numbers per author and context."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scaling import array_sum, diversity, minmax, ratio_or_zero, scale_row
from ..functions.tags import left_out, scaled_sums
from ..schema import N_FOLDS, SCALED, TAGS, profile_columns
from .context import written_contexts
from ..settings import stage
from .corpus import Corpus
from .skew import lookup_join

# number of the fit that uses every message; fits 0..n_folds-1 leave one fold out
ALL = -1


def author_totals(messages: DataFrame, extra_keys: list[str] = (), n_tags: int = len(TAGS)) -> DataFrame:
    """Mergeable totals per author: one hash aggregation, combined before the shuffle."""
    return messages.where(F.col("author").isNotNull()).groupBy("author", *extra_keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("words").alias("words"),
        F.min(F.col("ts").cast("double")).alias("min_ts"),
        F.max(F.col("ts").cast("double")).alias("max_ts"),
        *[F.expr(f"sum(CAST(tags[{i}] AS DOUBLE)) AS t{i}") for i in range(n_tags)],
    )


def fit_totals(messages: DataFrame, folds: DataFrame | None, n_folds: int, corpus: Corpus) -> DataFrame:
    """(fit, author, totals): all messages, or for every fold k the messages outside of k.

    The messages are summed once per (author, fold); only those small totals are repeated.
    """
    n_tags = len(corpus.tags)
    if folds is None:
        return author_totals(messages, n_tags=n_tags).withColumn("fit", F.lit(ALL))
    placed = lookup_join(messages, folds, ["tree_id"], corpus.rows, "inner", corpus.limits, corpus.widest)
    totals = _shared_totals(author_totals(placed, ["fold"], n_tags), n_tags, n_folds)
    return totals.withColumn("fit", F.explode("fits")).drop("fits")


def _shared_totals(per_fold: DataFrame, n_tags: int, n_folds: int) -> DataFrame:
    """(fits, author, totals): what several fits share stands once.  An author of one fold has the same
    totals in all others; only the totals of authors of several folds are repeated."""
    alone = F.count(F.lit(1)).over(Window.partitionBy("author"))
    counted = per_fold.withColumn("folds", alone)
    fits = F.sequence(F.lit(0), F.lit(n_folds - 1))
    once = counted.where("folds = 1").withColumn("fits", F.filter(fits, lambda k: k != F.col("fold"))).where("size(fits) > 0")
    each = (
        counted.where("folds > 1")
        .withColumn("fit", F.explode(fits))
        .where(F.col("fit") != F.col("fold"))
        .groupBy("fit", "author")
        .agg(
            F.sum("n").alias("n"),
            F.sum("words").alias("words"),
            F.min("min_ts").alias("min_ts"),
            F.max("max_ts").alias("max_ts"),
            *[F.expr(f"sum(t{i}) AS t{i}") for i in range(n_tags)],
        )
        .withColumn("fits", F.array("fit"))
    )
    columns = ["fits", "author", "n", "words", "min_ts", "max_ts", *[f"t{i}" for i in range(n_tags)]]
    return once.select(*columns).unionByName(each.select(*columns))


def raw_profile(totals: DataFrame, n_tags: int) -> DataFrame:
    """Unscaled forum numbers per (fit, author)."""
    count = F.col("n").cast("double")
    sums = F.array(*[f"t{i}" for i in range(n_tags)])
    return (
        totals.withColumn("tag_sums", sums)
        .select(
            *[c for c in ("fit", "fits") if c in totals.columns],
            "author",
            count.alias("num_comment"),
            "min_ts",
            "max_ts",
            ((F.col("max_ts") - F.col("min_ts")) / count).alias("sending_rate"),
            (F.col("words") / count).alias("avg_word_text"),
            "tag_sums",
            diversity(F.col("tag_sums")).alias("diversity"),
            ratio_or_zero(array_sum(F.col("tag_sums")), count).alias("avg_tag_msg"),
        )
    )


def _scaled(low: dict[str, Column], high: dict[str, Column], tags: Column):
    """Profile columns out of the unscaled ones, the extremes of the context, and the scaled tags."""
    scaled = {c: minmax(F.col(c), low[c], high[c]) for c in SCALED}
    return [
        (1.0 - scaled["min_ts"]).alias("duration"),
        scaled["num_comment"].alias("num_comment"),
        scaled["sending_rate"].alias("sending_rate"),
        scaled["avg_word_text"].alias("avg_word_text"),
        tags.alias("tags"),
        F.col("diversity"),
        scaled["avg_tag_msg"].alias("avg_tag_msg"),
    ]


def forum_profile(
    corpus: Corpus, folds: DataFrame | None = None, n_folds: int = N_FOLDS, mode: str = "sequential"
) -> DataFrame:
    """(fit, author, profile): each author over all training messages of the fit.

    The scale of a fit is one row, found by aggregation; the join on `fit` sees as many rows
    on that side as there are fits.
    """
    n_tags = len(corpus.tags)
    if folds is None:
        totals = fit_totals(corpus.messages, None, n_folds, corpus).withColumn("fits", F.array("fit")).drop("fit")
    else:
        placed = lookup_join(corpus.messages, folds, ["tree_id"], corpus.rows, "inner", corpus.limits, corpus.widest)
        totals = _shared_totals(stage(author_totals(placed, ["fold"], n_tags)), n_tags, n_folds)
    raw = raw_profile(totals, n_tags)
    extremes = raw.groupBy("fits").agg(
        *[F.min(c).alias(f"lo_{c}") for c in SCALED], *[F.max(c).alias(f"hi_{c}") for c in SCALED]
    )
    scale = extremes.withColumn("fit", F.explode("fits")).groupBy("fit").agg(
        *[F.min(f"lo_{c}").alias(f"lo_{c}") for c in SCALED], *[F.max(f"hi_{c}").alias(f"hi_{c}") for c in SCALED]
    )
    low = {c: F.col(f"lo_{c}") for c in SCALED}
    high = {c: F.col(f"hi_{c}") for c in SCALED}
    # tags are scaled before the rows are repeated for the fits
    rows = raw.withColumn("tag_sums", scale_row(F.col("tag_sums"), n_tags, mode)).withColumn("fit", F.explode("fits"))
    return rows.join(F.broadcast(scale), "fit").select(
        "fit", "author", *_scaled(low, high, F.col("tag_sums"))
    )


def default_profile(forum: DataFrame, n_tags: int = len(TAGS)) -> DataFrame:
    """(fit, profile): unweighted mean over the authors, one row per fit."""
    plain = [c for c in profile_columns([]) if c in forum.columns]
    return forum.groupBy("fit").agg(
        *[F.avg(c).alias(c) for c in plain],
        F.expr(f"array({', '.join(f'avg(tags[{i}])' for i in range(n_tags))}) AS tags"),
    )


def fallback_values(profiles: DataFrame, n_tags: int = len(TAGS), mode: str = "sequential") -> list[Column]:
    """What contexts without history take from `profiles`, the forum's or the default: tag_sums, scaled_tags,
    and diversity and sum of the tags.  All depend on the author and the fit alone."""
    tags = F.transform(profiles["tags"], lambda t: F.coalesce(t, F.lit(0.0)))
    return [
        tags.alias("tag_sums"), scale_row(tags, n_tags, mode).alias("scaled_tags"),
        diversity(tags).alias("diversity"), array_sum(tags).alias("tag_total"),
    ]


def with_fallback(
    contexts: DataFrame, forum: DataFrame, default: DataFrame, corpus: Corpus, fits: list[int],
    mode: str = "sequential",
) -> DataFrame:
    """Contexts without history, once per fit, with the `fallback_values` of the author or else of the default.

    One look-up per context finds the values of all fits, and they are made per author, not per context.
    """
    n_tags = len(corpus.tags)
    values = forum.select("fit", "author", F.struct(*fallback_values(forum, n_tags, mode)).alias("of"))
    per_author = values.groupBy("author").agg(
        F.map_from_entries(F.collect_list(F.struct("fit", "of"))).alias("_known")  # an entry per fit
    )
    known = lookup_join(contexts, per_author, ["author"], corpus.rows * 2, "left", corpus.limits)
    each = F.explode(
        F.array(*[F.struct(F.lit(k).alias("fit"), F.try_element_at("_known", F.lit(k)).alias("of")) for k in fits])
    )
    rows = known.withColumn("_each", each).drop("_known").select("*", "_each.fit", F.col("_each.of").alias("_own")).drop("_each")
    # one row per fit
    base = default.select("fit", F.struct(*fallback_values(default, n_tags, mode)).alias("_default"))
    rows = rows.join(F.broadcast(base), "fit").withColumn("_of", F.coalesce("_own", "_default"))
    return rows.select("*", "_of.*").drop("_own", "_default", "_of")


def with_fallback_left_out(
    contexts: DataFrame,
    totals: DataFrame,
    folds: DataFrame | None,
    corpus: Corpus,
    fits: list[int],
    mode: str = "sequential",
) -> DataFrame:
    """As `with_fallback`, but without the message itself in what it falls back on.

    Tag counts are sums, so the message's tags are taken from its author's; nobody is counted anew.
    An author without another training message leaves the mean over the authors in the same way. A
    message that the fit does not train on has nothing to leave out.  `totals` are those of `fit_totals`.
    One look-up per context finds the author's totals of all fits; tags are scaled a batch at a time.
    """
    n_tags, kept = len(corpus.tags), contexts.columns
    own = contexts.join(corpus.messages.select("message_id", F.col("tags").alias("own_tags")), "message_id")
    if folds is None:
        own = own.withColumn("fold", F.lit(-2))
    else:
        own = lookup_join(
            own, folds.select("tree_id", "fold"), ["tree_id"], corpus.rows * 2, "left", corpus.limits, corpus.widest * 2
        )
    tags = F.array(*[f"t{i}" for i in range(n_tags)]).alias("tags")
    sums = totals.select("fit", tags).mapInArrow(scaled_sums(n_tags, mode), "fit int, sums array<double>, counts array<long>")
    each = [F.array(*[F.sum(F.col(c)[i]) for i in range(n_tags)]).alias(c) for c in ("sums", "counts")]
    # one row per fit
    means = {r["fit"]: (np.array(r["sums"]), np.array(r["counts"])) for r in sums.groupBy("fit").agg(*each).collect()}
    forum = totals.select("author", F.struct(F.col("fit").cast("int").alias("fit"), F.col("n").cast("long").alias("n"), tags).alias("v"))
    per_author = forum.groupBy("author").agg(F.collect_list("v").alias("known"))  # an entry per fit
    found = lookup_join(own, per_author, ["author"], corpus.rows * 2, "left", corpus.limits)
    schema = ", ".join(f"`{c}` {contexts.schema[c].dataType.simpleString()}" for c in kept)
    return found.select(*kept, "own_tags", F.col("fold").cast("int").alias("fold"), "known").mapInArrow(
        left_out(kept, n_tags, {k: means[k] for k in fits if k in means}, mode), f"{schema}, fit int, tag_sums array<double>"
    )


def with_tags(
    contexts: DataFrame,
    forum: DataFrame,
    corpus: Corpus,
    fits: list[int],
    fallback: Callable[[DataFrame], DataFrame] | None = None,
    mode: str = "sequential",
) -> tuple[DataFrame, DataFrame]:
    """Contexts with `tag_sums`, in two parts: those that have a history, which are the same
    for every fit, and those that have none, once per fit with that fit's fallback."""
    has_history = F.col("n") > 1
    old = contexts.where(has_history).withColumn("tag_sums", F.col("history"))
    new = contexts.where(~has_history).drop("history")
    if fallback:
        return old, fallback(new)
    default = default_profile(forum, len(corpus.tags))
    return old, with_fallback(new, forum, default, corpus, fits, mode)


def _extremes() -> tuple[dict[str, Column], dict[str, Column]]:
    """Of a context, its own author included."""
    low = {c: F.least(F.col(c), F.col(f"lo_{c}")) for c in SCALED}
    high = {c: F.greatest(F.col(c), F.col(f"hi_{c}")) for c in SCALED}
    return low, high


def context_profile(contexts: DataFrame, n_tags: int = len(TAGS), mode: str = "sequential") -> DataFrame:
    """(fit, level, message_id, profile) of contexts that carry `tag_sums`, and the other `fallback_values` if
    those are known already."""
    found = contexts.columns
    tags = F.col("scaled_tags") if "scaled_tags" in found else scale_row(F.col("tag_sums"), n_tags, mode)
    total = F.col("tag_total") if "tag_total" in found else array_sum(F.col("tag_sums"))
    low, high = _extremes()
    return contexts.withColumns(
        {
            "diversity": F.col("diversity") if "diversity" in found else diversity(F.col("tag_sums")),
            "avg_tag_msg": ratio_or_zero(total, F.col("n").cast("double")),
        }
    ).select(
        *[c for c in ("fit", "level", "message_id", "author") if c in found],
        *_scaled(low, high, tags),
    )


def late_parts(
    corpus: Corpus, levels: list[str], mode: str = "sequential"
) -> tuple[DataFrame, DataFrame]:
    """What profiles have of the contexts alone: whole profiles of messages whose author has a history, and
    of the others (level, message_id, late): the first numbers, and `n` and the others' extremes of the
    last, which waits for the tags of a fit."""
    contexts = written_contexts(corpus, levels)
    has_history = F.col("n") > 1
    old = contexts.where(has_history).withColumn("tag_sums", F.col("history"))
    new = contexts.where(~has_history).withColumn("avg_tag_msg", F.lit(0.0))
    scaled = _scaled(*_extremes(), F.lit(None))[:4]
    late = F.struct(
        F.array(*scaled).cast("array<float>").alias("first"), F.col("n").cast("double").alias("n"),
        F.col("lo_avg_tag_msg").alias("low"), F.col("hi_avg_tag_msg").alias("high"),
    )
    return context_profile(old, len(corpus.tags), mode), new.select("level", "message_id", late.alias("late"))


def late_vector(late: Column, tags: Column, diverse: Column, total: Column) -> Column:
    """A profile as one array, of a context's part of `late_parts` and a fit's `fallback_values`."""
    average = ratio_or_zero(total, late["n"])
    scaled = minmax(average, F.least(average, late["low"]), F.greatest(average, late["high"]))
    return F.concat(late["first"], tags, F.array(diverse.cast("float"), scaled.cast("float")))


def profile_parts(
    corpus: Corpus,
    levels: list[str],
    folds: DataFrame | None = None,
    n_folds: int = N_FOLDS,
    mode: str = "sequential",
    forum: DataFrame | None = None,
    leave_one_out: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Tree and branch profiles in two parts: of messages whose author has a history, without `fit`
    because they are the same for all fits, and of the others, once per fit.

    The contexts do not depend on the fit, because threads are never divided between folds;
    they are built once and only the fallback tags differ.  With `leave_one_out` those tags are
    computed without the message they are for.
    """
    fallback = None
    if leave_one_out:
        totals = stage(fit_totals(corpus.messages, folds, n_folds, corpus))
        each = [ALL] if folds is None else list(range(n_folds))
        fallback = lambda new: with_fallback_left_out(new, totals, folds, corpus, each, mode)
    elif forum is None:
        forum = stage(forum_profile(corpus, folds, n_folds, mode))
    fits = [ALL] if folds is None else list(range(n_folds))
    contexts = written_contexts(corpus, levels)
    old, new = with_tags(contexts, forum, corpus, fits, fallback, mode)
    n_tags = len(corpus.tags)
    return context_profile(old, n_tags, mode), context_profile(new, n_tags, mode)


def message_profiles(
    corpus: Corpus,
    levels: list[str],
    folds: DataFrame | None = None,
    n_folds: int = N_FOLDS,
    mode: str = "sequential",
    forum: DataFrame | None = None,
    leave_one_out: bool = False,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Tree and branch profile of every message, for every fit, each row by `finish` if there is one."""
    once, each = profile_parts(corpus, levels, folds, n_folds, mode, forum, leave_one_out)
    if finish:
        once, each = finish(once), finish(each)
    fits = [ALL] if folds is None else list(range(n_folds))
    # profiles with a history are scaled once, and repeated for the fits afterwards
    every = F.explode(F.array(*[F.lit(k) for k in fits]))
    return once.withColumn("fit", every).unionByName(each)


def flatten(profiles: DataFrame, tags: list[str], suffix: str = "", cast: str = "double") -> DataFrame:
    """Spread the `tags` array, and name every profile column `<name><suffix>`."""
    names = profile_columns(tags)
    source = {t: f"tags[{i}]" for i, t in enumerate(tags)}
    return profiles.selectExpr(
        *[c for c in profiles.columns if c not in names and c != "tags"],
        *[f"CAST({source.get(c, c)} AS {cast}) AS `{c}{suffix}`" for c in names],
    )
