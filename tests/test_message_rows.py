"""Rows per message from which matrices and inputs of all fits are put together."""

import os
import random

import pytest
from pyspark.sql import functions as F

from agorascope.operators.corpus import Corpus
from agorascope.operators.embedding import context_means, thread_means
from agorascope.plans.design import Design
from agorascope.sources.store import FeatureStore
from test_profiles import TAGS, TINY, messages


def fixture(spark, *limits):
    rng = random.Random(4)
    threads = {f"T{i}": i % 3 for i in range(5)}
    rows = []
    for i in range(60):
        parent = rng.choice([-1, *range(i), 999])  # in any thread, or nowhere
        rows.append((i, f"T{rng.randrange(5)}", parent, rng.choice(["a", "b", "c", None]), float(i), 1, [1, 0, 0]))
    corpus = Corpus(messages(spark, rows), TAGS, *limits)
    # some messages have no vector
    vectors = [(i, [rng.choice([1.5, -2.0, None]), float(i)]) for i in range(60) if i % 9]
    e = spark.createDataFrame(vectors, "message_id long, embedding array<double>")
    return corpus, e, spark.createDataFrame(list(threads.items()), "tree_id string, fold int")


@pytest.mark.parametrize("limits", [[], [TINY]])
def test_both_means_are_those_of_each_level(spark, limits):
    corpus, e, _ = fixture(spark, *limits)
    e = e.unionByName(e.where("message_id = 10")) if not limits else e
    rows = corpus.columns("message_id", "author")
    got = {}
    for r in thread_means(corpus, e, 2, rows).collect():
        got.setdefault(r.message_id, []).append(r)
    assert set(got) == set(range(60)) and (limits or len(got[10]) == 2)
    for level in ("tree", "branch"):
        want = {r.message_id: r["mean"] for r in context_means(corpus, e, 2, level).collect()}
        for i, found in got.items():
            for r in found:
                value = r[f"mean_{level}"]
                assert (value is None) == (i not in want)
                assert value is None or value == pytest.approx(want[i], abs=1e-5), (level, i)


def test_inputs_of_all_fits_from_one_row_per_message(spark):
    corpus, e, folds = fixture(spark)
    design = Design(corpus, e, 3, folds)
    inputs = design.model_inputs("embedding", e)
    on = ["fit", "split", "message_id"]
    last = design.last_user_features("embedding").withColumnRenamed("features", "last")
    now = e.select("message_id", F.col("embedding").cast("array<float>").alias("now"))
    plain = design.matrix("embedding").join(last, on).join(now, "message_id")
    want = {(r.fit, r.split, r.message_id): r.now + r.features + r["last"] for r in plain.collect()}
    got = {(r.fit, r.split, r.message_id): r.inputs for r in inputs.collect()}
    assert got == want and len(got) == 3 * 53
    # repeated for the fits after all joins by message; the other is the mean over the authors
    assert inputs._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2


def test_stored_matrices_are_packed(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path), "x")
    keys = {"method": "b", "fold": "a", "level": "a", "split": "a"}
    assert store.get_or_compute(keys, lambda: spark.range(5)).count() == 5
    found = [f for _, _, files in os.walk(store._folder(keys)) for f in files]
    assert any(f.endswith(".zstd.parquet") for f in found)
