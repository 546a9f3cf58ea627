"""Registered queries: one per operator, over the benchmark tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.embedding import hashed_counts, hashed_embedding, model_embedding
from .functions.scaling import minmax, rounded, scale_row
from .functions.text import word_count
from .operators import folds as fold_ops
from .operators.authors import author_one_hot, row_positions
from .operators.context import message_contexts, written_contexts
from .operators.corpus import Corpus
from .operators.embedding import (
    author_means, context_means, default_mean, forum_means, width,
)
from .operators.forest import leaf_paths, leaves
from .operators.profile import (
    ALL, author_totals, default_profile, flatten, forum_profile, fit_totals, message_profiles,
    raw_profile, with_fallback_left_out, with_tags,
)
from .operators.skew import ranged, running
from .plans import classifier, experiment, metrics
from .plans.design import Design, behaviour_names, spread
from .schema import ANNOTATED_TAGS, CSV_SCHEMA, N_FOLDS, SCALED, TAGS, profile_columns
from .settings import ensure_checkpoint_dir, shuffles_end, stage
from .sources.messages import (
    benchmark_embeddings, benchmark_messages, conversation_messages, ingest_report, pack, read_annotated_csv,
)
from .sources.store import FeatureStore, fingerprint, nested_results, write_results

DIGITS = 6
# rows of an annotated CSV file
CSV_RECORDS = 4096


def _r(c):
    """Rounded, and without a negative zero."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), DIGITS) + F.lit(0.0)


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    shown = {c: f"{rounded(f'CAST(`{c}` AS DOUBLE)', DIGITS)} + 0.0D AS `{c}`" for c in names}
    return df.selectExpr(*[shown.get(c, f"`{c}`") for c in df.columns])


def _corpus(spark: SparkSession, sf: str) -> Corpus:
    return Corpus(benchmark_messages(spark, sf))


def _folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


# --- scans, projections, scalar functions ---------------------------------------------------


def scan_messages(spark, sf):
    return benchmark_messages(spark, sf).select(
        "message_id", "node_id", "tree_id", "parent", "author", "ts",
        F.md5("text").alias("text_md5"),
    )


def _annotated(spark, sf):
    """The messages as a folder of annotated CSV."""
    m = benchmark_messages(spark, sf)
    wide = m.select(
        F.col("message_id").alias("Unnamed: 0"), "node_id", F.col("tree_id").cast("string").alias("tree_id"),
        "parent", "author", "text", F.col("ts").alias("timestamp"),
        *[F.col("tags")[i].alias(t) for i, t in enumerate(ANNOTATED_TAGS)],
    )
    path = _folder(spark, "annotated")
    # a file with texts over several lines is read by one task, so no file may grow with the input
    with shuffles_end(spark):
        wide.write.option("maxRecordsPerFile", CSV_RECORDS).csv(
            path, header=True, escape='"', emptyValue="", compression="gzip",
            ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
        )
    return path


def scan_csv(spark, sf):
    """The messages written as annotated CSV and read back with the fixed schema."""
    path = _annotated(spark, sf)
    back = read_annotated_csv(spark, path)
    return back.select(
        "message_id", "tree_id", "parent", "author", "ts", F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"),
        *[F.col(t) for t in TAGS],
    )


def csv_tree_profile(spark, sf):
    """From annotated CSV to tree profiles, as a user of the files would go."""
    rows = read_annotated_csv(spark, _annotated(spark, sf), corrupt="_bad")
    corpus = Corpus(pack(rows.where(F.col("_bad").isNull())))
    out = flatten(message_profiles(corpus, ["tree"]), TAGS).drop("fit", "level")
    return _rounded(out, profile_columns())


def ingest_faults(spark, sf):
    """The ingest report of messages with planted faults: some lost, some twice, some astray."""
    m = benchmark_messages(spark, sf).select("message_id", "tree_id", "parent")
    at = F.col("message_id")
    hurt = m.where(at % 11 != 0).select(
        F.when(at % 23 != 0, at).alias("message_id"), F.when(at % 19 == 0, F.col("tree_id") + 1).otherwise(F.col("tree_id")).alias("tree_id"),
        F.when(at % 17 != 0, F.col("parent")).alias("parent"),
        F.explode(F.array_repeat(F.lit(0), F.when(at % 13 == 0, 2).otherwise(1))).alias("copy"),
    )
    return ingest_report(hurt.drop("copy"))


def word_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", word_count(F.col("text")).alias("word_count"))


def untagged_flag(spark, sf):
    return benchmark_messages(spark, sf).select("message_id", F.col("tags")[len(TAGS) - 1].alias("untagged"))


def label_matrix(spark, sf):
    return benchmark_messages(spark, sf).select(
        "message_id", *[F.col("tags")[i].alias(t) for i, t in enumerate(TAGS)]
    )


def labels_long(spark, sf):
    return metrics.labels_long(benchmark_messages(spark, sf))


def tag_category(spark, sf):
    return metrics.with_category(metrics.labels_long(benchmark_messages(spark, sf)).where("y = 1")).select(
        "message_id", "tag_pos", "tag", "category"
    )


# --- threads --------------------------------------------------------------------------------


def thread_members(spark, sf):
    return _corpus(spark, sf).tree_visits.select("tree_id", F.col("lo").alias("member_pos"), "message_id")


def thread_leaves(spark, sf):
    return leaves(benchmark_messages(spark, sf).select("message_id", "tree_id", "parent"))


def root_paths(spark, sf):
    c = _corpus(spark, sf)
    return leaf_paths(c.links, c.rows, c.limits)


def conversation_paths(spark, sf):
    c = Corpus(conversation_messages(spark, sf))
    return leaf_paths(c.links, c.rows, c.limits)


def conversation_leaves(spark, sf):
    return leaves(conversation_messages(spark, sf).select("message_id", "tree_id", "parent"))


def thread_shape(spark, sf):
    return _corpus(spark, sf).numbered.select("message_id", "depth", F.col("size").alias("subtree_size"))


def row_position(spark, sf):
    return row_positions(benchmark_messages(spark, sf))


def _context(spark, sf, level):
    c = _corpus(spark, sf)
    states = message_contexts(c, [level])
    before = c.tree_visits.select("message_id", (F.col("lo") + 1).alias("context_size")) if level == "tree" else (
        c.numbered.select("message_id", (F.col("depth") + 1).alias("context_size")))
    out = states.join(before, "message_id").select(
        "message_id", "author", "context_size", F.col("n").alias("own_messages"),
        F.col("min_ts").alias("own_first_ts"),
        *[F.col(f"{side}_{m}").alias(f"{side}_{m}") for m in SCALED for side in ("lo", "hi")],
    )
    return _rounded(out, [f"{side}_{m}" for m in SCALED for side in ("lo", "hi")])


def context_tree(spark, sf):
    return _context(spark, sf, "tree")


def context_branch(spark, sf):
    return _context(spark, sf, "branch")


def running_activity(spark, sf):
    c = _corpus(spark, sf)
    rows = c.columns("message_id", "tree_id", "author", "ts").withColumn("one", F.lit(1).cast("long"))
    if c.wide:
        rows = ranged(rows, "tree_id", "author", "message_id")
    block = F.col("range") if c.wide else None
    out = running(
        rows, ["tree_id", "author"], "message_id",
        {"num_comment": ("sum", "one"), "first_ts": ("min", "ts"), "last_ts": ("max", "ts")}, block,
    )
    return out.select("message_id", "num_comment", "first_ts", "last_ts")


# --- folds ----------------------------------------------------------------------------------


def group_kfold(spark, sf):
    return fold_ops.group_folds(_corpus(spark, sf))


def _placed(spark, sf):
    c = _corpus(spark, sf)
    columns = ["message_id", "tree_id", "author"]
    return c, fold_ops.in_folds(c, fold_ops.group_folds(c), columns)


def fold_split_sizes(spark, sf):
    return fold_ops.split_sizes(_placed(spark, sf)[1])


def train_test_union(spark, sf):
    """Train and test rows of every fit put together again, with the split they came from."""
    rows = fold_ops.fits(_placed(spark, sf)[1])
    train = rows.where("split = 'train'").select("fit", "split", "message_id")
    return train.unionByName(rows.where("split = 'test'").select("fit", "split", "message_id"))


def unseen_authors(spark, sf):
    return fold_ops.test_authors(_placed(spark, sf)[1], N_FOLDS, False)


def returning_authors(spark, sf):
    return fold_ops.test_authors(_placed(spark, sf)[1], N_FOLDS, True)


# --- behaviour profiles ---------------------------------------------------------------------


def author_word_avg(spark, sf):
    m = benchmark_messages(spark, sf).where(F.col("author").isNotNull())
    return m.groupBy("author").agg(_r(F.avg("words")).alias("avg_word_text"))


def author_activity(spark, sf):
    m = benchmark_messages(spark, sf).where(F.col("author").isNotNull())
    out = m.groupBy("author").agg(
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count(F.lit(1)).alias("num_comment")
    )
    return out.withColumn("sending_rate", _r((F.col("max_ts") - F.col("min_ts")) / F.col("num_comment")))


def author_tag_sums(spark, sf):
    totals = author_totals(benchmark_messages(spark, sf))
    return totals.select("author", *[F.col(f"t{i}").cast("long").alias(t) for i, t in enumerate(TAGS)])


def _raw(spark, sf):
    c = _corpus(spark, sf)
    return raw_profile(fit_totals(c.messages, None, N_FOLDS, c), len(TAGS))


def author_diversity(spark, sf):
    return _raw(spark, sf).select("author", _r("diversity").alias("diversity"), _r("avg_tag_msg").alias("avg_tag_msg"))


def minmax_columns(spark, sf):
    raw = _raw(spark, sf)
    scale = raw.groupBy("fit").agg(
        *[F.min(c).alias(f"lo_{c}") for c in SCALED], *[F.max(c).alias(f"hi_{c}") for c in SCALED]
    )
    return raw.join(F.broadcast(scale), "fit").select(
        "author", *[_r(minmax(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"))).alias(c) for c in SCALED]
    )


def minmax_tags_sequential(spark, sf):
    scaled = _raw(spark, sf).select("author", scale_row(F.col("tag_sums"), len(TAGS)).alias("s"))
    return spread(scaled, "s", TAGS)


def forum_profile_query(spark, sf):
    out = flatten(forum_profile(_corpus(spark, sf)), TAGS).drop("fit")
    return _rounded(out, profile_columns())


def default_profile_query(spark, sf):
    c = _corpus(spark, sf)
    out = flatten(default_profile(forum_profile(c, fold_ops.group_folds(c))), TAGS)
    return _rounded(out, profile_columns())


def tag_history_fallback(spark, sf):
    c = _corpus(spark, sf)
    forum = forum_profile(c)
    old, new = with_tags(message_contexts(c, ["tree"]), forum, c, [ALL])
    both = old.select("message_id", "tag_sums").unionByName(new.select("message_id", "tag_sums"))
    return spread(both, "tag_sums", TAGS)


def tag_history_loo(spark, sf):
    c = _corpus(spark, sf)
    folds = stage(fold_ops.group_folds(c))
    totals = stage(fit_totals(c.messages, folds, N_FOLDS, c))
    contexts = written_contexts(c, ["tree"])
    _, new = with_tags(
        contexts, None, c, list(range(N_FOLDS)), lambda x: with_fallback_left_out(x, totals, folds, c, list(range(N_FOLDS)))
    )
    return spread(new.select("fit", "message_id", "tag_sums"), "tag_sums", TAGS)


def _profile(spark, sf, level):
    out = flatten(message_profiles(_corpus(spark, sf), [level]), TAGS).drop("fit", "level")
    return _rounded(out, profile_columns())


def tree_profile(spark, sf):
    return _profile(spark, sf, "tree")


def branch_profile(spark, sf):
    return _profile(spark, sf, "branch")


def profiles_for_fold(spark, sf):
    c = _corpus(spark, sf)
    # rounded before what all fits share is repeated for them
    return message_profiles(
        c, ["tree", "branch"], fold_ops.group_folds(c), finish=lambda x: _rounded(flatten(x.drop("author"), TAGS), profile_columns())
    )


# --- embeddings -----------------------------------------------------------------------------


def _vectors(spark, sf):
    c = _corpus(spark, sf)
    e = benchmark_embeddings(spark, sf, c.columns("message_id"))
    return c, e, width(e)


def _names(d, prefix="e"):
    return [f"{prefix}{i}" for i in range(d)]


def author_mean_embedding(spark, sf):
    c, e, d = _vectors(spark, sf)
    return spread(author_means(c, e, d).drop("fit"), "mean", _names(d))


def emb_forum(spark, sf):
    c, e, d = _vectors(spark, sf)
    rows = c.columns("message_id", "author").withColumn("fit", F.lit(ALL))
    out = forum_means(c, author_means(c, e, d), rows)
    return spread(out.select("message_id", "mean"), "mean", _names(d))


def emb_tree(spark, sf):
    c, e, d = _vectors(spark, sf)
    return spread(context_means(c, e, d, "tree"), "mean", _names(d))


def emb_branch(spark, sf):
    c, e, d = _vectors(spark, sf)
    return spread(context_means(c, e, d, "branch"), "mean", _names(d))


def embed_text_hashed(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return hashed_counts(docs, "doc_id").select("doc_id", "bucket", _r("value").alias("value"))


def _letters_model():
    """A deterministic stand-in for an encoder: shares of code points by their remainder."""

    def predict(texts):
        out = np.zeros((len(texts), 8), np.float32)
        for i, text in enumerate(texts):
            if text:
                points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                out[i] = np.bincount(points % 8, minlength=8) / len(points)
        return out

    return predict


def embed_text_model(spark, sf):
    """Text embeddings through the hook for models, which runs them batch by batch."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = model_embedding(docs, "doc_id", _letters_model)
    return spread(out, "embedding", [f"e{i}" for i in range(8)])


# --- matrices -------------------------------------------------------------------------------


def _design(spark, sf, vectors=False):
    c = _corpus(spark, sf)
    return Design(c, benchmark_embeddings(spark, sf, c.columns("message_id")) if vectors else None)


def _embedding_names(d):
    return [f"{level}_e{i}" for level in ("forum", "tree", "branch") for i in range(d)]


def forum_attach_train(spark, sf):
    out = _design(spark, sf).forum_vectors().where("split = 'train'").select("fit", "message_id", "forum")
    return spread(out, "forum", profile_columns())


def forum_attach_test(spark, sf):
    out = _design(spark, sf).forum_vectors().where("split = 'test'").select("fit", "message_id", "forum")
    return spread(out, "forum", profile_columns())


def design_behaviour(spark, sf):
    return spread(_design(spark, sf).behaviour, "features", behaviour_names(TAGS))


def design_embedding(spark, sf):
    d = _design(spark, sf, True)
    return spread(d.embedding, "features", _embedding_names(d.width))


def design_combined(spark, sf):
    d = _design(spark, sf, True)
    return spread(d.combined, "features", behaviour_names(TAGS) + _embedding_names(d.width))


def last_user(spark, sf):
    return _design(spark, sf).last_user


def last_user_features(spark, sf):
    return spread(_design(spark, sf).last_user_features("behaviour"), "features", behaviour_names(TAGS))


def default_vector(spark, sf):
    d = _design(spark, sf, True)
    names = behaviour_names(TAGS) + _embedding_names(d.width)
    return spread(d.default_vector("combined"), "vector", names)


def model_inputs(spark, sf):
    d = _design(spark, sf, True)
    names = _names(d.width, "now_e") + _embedding_names(d.width) + [f"last_{n}" for n in _embedding_names(d.width)]
    return spread(d.model_inputs("embedding", d.embeddings), "inputs", names)


def author_one_hot_query(spark, sf):
    return author_one_hot(_corpus(spark, sf))


def feature_store_roundtrip(spark, sf):
    """Forum profiles of all fits through the partitioned store."""
    c = _corpus(spark, sf)
    features = flatten(forum_profile(c, fold_ops.group_folds(c)), TAGS).select(
        F.lit("behaviour").alias("method"), F.col("fit").alias("fold"), F.lit("forum").alias("level"),
        F.lit("train").alias("split"), "*",
    ).drop("fit")
    store = FeatureStore(spark, _folder(spark, "features"), fingerprint(c.columns(*Corpus.COLUMNS)))
    store.write(features)
    out = store.read(method="behaviour", level="forum", split="train")
    return _rounded(out.select("fold", "author", *profile_columns()), profile_columns())


def feature_store_resume(spark, sf):
    """The embedding matrix as a second run finds it: stored by the first, not computed again."""
    first = _design(spark, sf, True)
    base = _folder(spark, "features")

    def resumed():
        data = fingerprint(first.corpus.columns(*Corpus.COLUMNS))
        vectors = fingerprint(first.embeddings)
        return FeatureStore(spark, base, f"{data}-{vectors}")

    Design(first.corpus, first.embeddings, store=resumed()).matrix("embedding")
    store = resumed()
    if store.finished().count() != 1:
        raise RuntimeError("the first run left no finished table")
    # without embeddings and folds nothing could be computed
    again = Design(first.corpus, None, folds=first.folds, store=store)
    return spread(again.matrix("embedding"), "features", _embedding_names(first.width))


# --- metrics --------------------------------------------------------------------------------


def score_table(spark, sf):
    """Deterministic scores in place of a model's, so that every metric has an exact value."""
    c = _corpus(spark, sf)
    placed = fold_ops.in_folds(c, fold_ops.group_folds(c), ["message_id", "tree_id", "tags"])
    p = ((F.col("message_id") * 31 + F.col("tag_pos") * 17) % 100) / F.lit(100.0)
    return metrics.labels_long(placed, "fold").withColumn("p", p)


def binarize_scores(spark, sf):
    return metrics.binarize(score_table(spark, sf)).select("message_id", "tag_pos", "predicted")


def tag_support(spark, sf):
    return metrics.tag_support(metrics.labels_long(benchmark_messages(spark, sf)))


def tag_prf(spark, sf):
    return _rounded(metrics.tag_prf(score_table(spark, sf)), ["precision", "recall", "f1"])


def tag_weights(spark, sf):
    out = metrics.tag_weights(metrics.tag_prf(score_table(spark, sf)))
    return out.select("fold", "tag", "category", "support", "category_support", _r("weight").alias("weight"))


def overall_f1(spark, sf):
    out = metrics.overall_f1(metrics.tag_prf(score_table(spark, sf)))
    return _rounded(out, ["macro_f1", "weighted_f1"])


def category_f1(spark, sf):
    out = metrics.category_f1(metrics.tag_weights(metrics.tag_prf(score_table(spark, sf))))
    return _rounded(out, ["macro_f1", "weighted_mean", "weighted_sum"])


def fold_average(spark, sf):
    out = metrics.fold_metrics(score_table(spark, sf)).agg(
        *[_r(F.avg(c)).alias(c) for c in ("loss", "accuracy", "macro_f1", "weighted_f1")]
    )
    return out


def bce_loss(spark, sf):
    return _rounded(metrics.bce_loss(score_table(spark, sf)), ["loss"])


def argmax_accuracy(spark, sf):
    return _rounded(metrics.argmax_accuracy(score_table(spark, sf)), ["accuracy"])


def binary_accuracy(spark, sf):
    return _rounded(metrics.binary_accuracy(score_table(spark, sf)), ["binary_accuracy"])


def _results(spark, sf):
    return metrics.results(score_table(spark, sf)).select(
        F.lit("scores").alias("config"), F.lit("BCE").alias("loss"), "metric", "value"
    )


def results_json(spark, sf):
    """The result table through its JSON sink."""
    path = _folder(spark, "results")
    write_results(_results(spark, sf), path)
    back = spark.read.schema("config string, loss string, metric string, value double").json(path)
    return _rounded(back, ["value"])


def results_nested(spark, sf):
    """The nested form of the results, read back as objects."""
    nested = nested_results(_results(spark, sf))
    read = F.from_json("json", "map<string, map<string, double>>")
    per_loss = nested.select("config", F.explode(read).alias("loss", "metrics"))
    return _rounded(per_loss.select("config", "loss", F.explode("metrics").alias("metric", "value")), ["value"])


def metric_report(spark, sf):
    return metrics.report_lines(_results(spark, sf)).select("metric", "line")


def experiment_grid(spark, sf):
    return experiment.runs(["stored", "hashed"], fold_ops.split_sizes(_placed(spark, sf)[1]))


# --- model ----------------------------------------------------------------------------------


def tag_scores(spark, sf):
    d = _design(spark, sf, True)
    return experiment.tag_scores(d, "combined", d.embeddings)


def _own_inputs(spark, sf):
    """(fit, split, message_id, inputs, y): each message's stored embedding and its tags."""
    d = _design(spark, sf, True)
    now = d.embeddings.select("message_id", F.col("embedding").cast("array<float>").alias("inputs"))
    labels = d.corpus.columns("message_id", "tags").withColumnRenamed("tags", "y")
    return d.rows.select("fit", "split", "message_id").join(now, "message_id").join(labels, "message_id")


def gradient_step(spark, sf):
    """The classifier's first gradient: at the weights that training starts from."""
    train = stage(_own_inputs(spark, sf).where("split = 'train'"))
    return _rounded(classifier.gradient_rows(train, 64, len(TAGS)), ["gradient"])


def score_fixed_weights(spark, sf):
    """Out-of-fold scores by weights that a formula gives."""
    i, t = np.arange(65)[:, None], np.arange(len(TAGS))[None, :]
    weights = {fit: ((i * 7 + t * 3 + fit) % 11 - 5) / 10.0 for fit in range(N_FOLDS)}
    test = _own_inputs(spark, sf).where("split = 'test'")
    return _rounded(classifier.score(test, weights, 64, len(TAGS)), ["p"])


def cv_results(spark, sf):
    """The whole grid: both text encoders for the message and for the user."""
    stored = _design(spark, sf, True)
    texts = benchmark_messages(spark, sf).select("message_id", "text")
    hashed = stage(hashed_embedding(texts, "message_id"))
    designs = {"stored": stored, "hashed": Design(stored.corpus, hashed, folds=stored.folds)}
    return experiment.evaluate(designs, {"stored": stored.embeddings, "hashed": hashed})


QUERIES = {
    "scan_messages": scan_messages,
    "scan_csv": scan_csv,
    "csv_tree_profile": csv_tree_profile,
    "ingest_faults": ingest_faults,
    "word_count": word_counts,
    "untagged_flag": untagged_flag,
    "label_matrix": label_matrix,
    "labels_long": labels_long,
    "tag_category": tag_category,
    "thread_members": thread_members,
    "thread_leaves": thread_leaves,
    "thread_shape": thread_shape,
    "root_paths": root_paths,
    "conversation_paths": conversation_paths,
    "conversation_leaves": conversation_leaves,
    "row_positions": row_position,
    "context_tree": context_tree,
    "context_branch": context_branch,
    "running_activity": running_activity,
    "group_kfold": group_kfold,
    "fold_split_sizes": fold_split_sizes,
    "train_test_union": train_test_union,
    "unseen_authors": unseen_authors,
    "returning_authors": returning_authors,
    "author_word_avg": author_word_avg,
    "author_activity": author_activity,
    "author_tag_sums": author_tag_sums,
    "author_diversity": author_diversity,
    "minmax_columns": minmax_columns,
    "minmax_tags_sequential": minmax_tags_sequential,
    "forum_profile": forum_profile_query,
    "default_profile": default_profile_query,
    "tag_history_fallback": tag_history_fallback,
    "tag_history_loo": tag_history_loo,
    "tree_profile": tree_profile,
    "branch_profile": branch_profile,
    "profiles_for_fold": profiles_for_fold,
    "author_mean_embedding": author_mean_embedding,
    "emb_forum": emb_forum,
    "emb_tree": emb_tree,
    "emb_branch": emb_branch,
    "embed_text_hashed": embed_text_hashed,
    "embed_text_model": embed_text_model,
    "forum_attach_train": forum_attach_train,
    "forum_attach_test": forum_attach_test,
    "design_behaviour": design_behaviour,
    "design_embedding": design_embedding,
    "design_combined": design_combined,
    "default_vector": default_vector,
    "last_user": last_user,
    "last_user_features": last_user_features,
    "model_inputs": model_inputs,
    "author_one_hot": author_one_hot_query,
    "feature_store_roundtrip": feature_store_roundtrip,
    "feature_store_resume": feature_store_resume,
    "binarize_scores": binarize_scores,
    "tag_support": tag_support,
    "tag_prf": tag_prf,
    "tag_weights": tag_weights,
    "overall_f1": overall_f1,
    "category_f1": category_f1,
    "fold_average": fold_average,
    "bce_loss": bce_loss,
    "argmax_accuracy": argmax_accuracy,
    "binary_accuracy": binary_accuracy,
    "results_json": results_json,
    "results_nested": results_nested,
    "metric_report": metric_report,
    "experiment_grid": experiment_grid,
    "tag_scores": tag_scores,
    "gradient_step": gradient_step,
    "score_fixed_weights": score_fixed_weights,
    "cv_results": cv_results,
}
