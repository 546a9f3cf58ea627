import csv
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from agorascope.functions.embedding import hashed_embedding, model_embedding
from agorascope.operators.corpus import Corpus
from agorascope.operators.profile import message_profiles
from agorascope.plans import classifier, experiment, metrics
from agorascope.plans.design import Design
from agorascope.queries import QUERIES
from agorascope.schema import ANNOTATED_TAGS, NO_PARENT, TAG_CATEGORY, TAGS as ALL_TAGS
from agorascope.sources.messages import pack, read_annotated_csv
from agorascope.sources.store import FeatureStore, fingerprint, nested_results, write_results
from test_profiles import TAGS, TINY, fixture_rows, folds, messages


def fixture_design(spark, limits=None):
    corpus = Corpus(messages(spark, fixture_rows()), TAGS, *([limits] if limits else []))
    vectors = spark.createDataFrame(
        [(i, [float(i), 1.0]) for i in range(11)], "message_id long, embedding array<float>"
    )
    return Design(corpus, vectors, 1, folds(spark))


def test_last_user_pointers(spark):
    design = fixture_design(spark, TINY)
    got = {r["message_id"]: r["last_user"] for r in design.last_user.collect()}
    assert [got[i] for i in range(8)] == [-1, 0, 1, 0, 2, -1, 5, 6]
    assert [got[i] for i in range(8, 11)] == [-1, 8, 9]


def test_matrices(spark):
    design = fixture_design(spark)
    x = {m: {r["message_id"]: r["features"] for r in design.matrix(m).collect()} for m in
         ("behaviour", "embedding", "combined")}
    assert all(len(v) == 11 for v in x.values())
    assert {len(v) for v in x["behaviour"].values()} == {27}
    assert {len(v) for v in x["embedding"].values()} == {6}
    assert all(x["combined"][i] == x["behaviour"][i] + x["embedding"][i] for i in range(11))
    # u9 is not among the training authors: mean of the authors' means in the forum part
    means = [(0 + 2 + 6) / 3, (1 + 4 + 5 + 7) / 4, 3.0]
    assert x["embedding"][8][0] == pytest.approx(sum(means) / 3, abs=1e-6)
    assert x["embedding"][10][2:] == pytest.approx([9.0, 1.0, 9.0, 1.0])
    last = {r["message_id"]: r["features"] for r in design.last_user_features("combined").collect()}
    default = design.default_vector("combined").first()["vector"]
    assert last[9] == x["combined"][8] and last[4] == x["combined"][2]
    assert last[0] == default and last[8] == default and len(default) == 33
    inputs = design.model_inputs("embedding", design.embeddings).collect()
    assert {len(r["inputs"]) for r in inputs} == {2 + 6 + 6}


def test_plan_has_no_pairs(spark):
    corpus = Corpus(messages(spark, fixture_rows()), TAGS)
    plan = message_profiles(corpus, ["tree"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_annotated_csv(spark, tmp_path):
    texts = ['two words', 'quote " and, comma', "line\nbreak", " padded ", ""]
    with open(tmp_path / "m.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["Unnamed: 0", "node_id", "tree_id", "parent", "author", "text", "timestamp", *ANNOTATED_TAGS])
        for i, t in enumerate(texts):
            out.writerow([i, f"n{i}", "t", i - 1, "a", t, 10.5 * i, *[int(i == j) for j in range(31)]])
        out.writerow([5, "n5", "t", NO_PARENT, "b", "none", 1, *[0] * 31])
    df = read_annotated_csv(spark, str(tmp_path / "m.csv"))
    rows = {r["message_id"]: r for r in df.collect()}
    assert [rows[i]["text"] or "" for i in range(5)] == texts
    assert [rows[i]["Untagged"] for i in range(6)] == [0, 0, 0, 0, 0, 1]
    packed = {r["message_id"]: r for r in pack(df).collect()}
    assert [packed[i]["words"] for i in range(6)] == [2, 4, 2, 1, 0, 1]
    assert packed[2]["tags"] == [int(j == 2) for j in range(32)] and packed[5]["tags"][-1] == 1


def test_feature_store(spark, tmp_path):
    data = spark.createDataFrame([(i, i % 3) for i in range(20)], "a int, b int")
    assert fingerprint(data) == fingerprint(data.orderBy(F.desc("a")))
    assert fingerprint(data) != fingerprint(data.where("a > 0"))
    store = FeatureStore(spark, str(tmp_path), fingerprint(data))
    calls = []

    def compute():
        calls.append(1)
        return data

    keys = {"method": "behaviour", "fold": 0, "level": "tree", "split": "train"}
    for _ in range(2):
        assert store.get_or_compute(keys, compute).count() == 20
    assert len(calls) == 1
    store.get_or_compute(keys | {"fold": 1}, compute)
    assert len(calls) == 2
    assert store.read(fold=1).count() == 20
    assert "PartitionFilters: [isnotnull(fold" in store.read(fold=1)._jdf.queryExecution().toString()


def scores(spark, seed=1, n=60, n_tags=6):
    rng = random.Random(seed)
    rows = [
        (i, i % 2, t, int(rng.random() < 0.3), rng.randrange(11) / 10) for i in range(n) for t in range(n_tags)
    ]
    return rows, spark.createDataFrame(rows, "message_id long, fold int, tag_pos int, y int, p double")


def test_metrics(spark):
    rows, df = scores(spark)
    got = {(r["fold"], r["tag_pos"]): r for r in metrics.tag_prf(df).collect()}
    for (fold, tag), r in got.items():
        mine = [x for x in rows if x[1] == fold and x[2] == tag]
        tp = sum(y == 1 and p > 0.5 for *_, y, p in mine)
        found, real = sum(p > 0.5 for *_, p in mine), sum(y for *_, y, _ in mine)
        assert r["precision"] == pytest.approx(tp / found if found else 0)
        assert r["recall"] == pytest.approx(tp / real if real else 0)
        assert r["f1"] == pytest.approx(2 * tp / (found + real) if found + real else 0)
    by_category = {r["category"]: r for r in metrics.category_f1(metrics.tag_weights(metrics.tag_prf(df))).collect()}
    for category, r in by_category.items():
        tags = [t for t in range(6) if TAG_CATEGORY[ALL_TAGS[t]] == category]
        parts = []
        for fold in (0, 1):
            support = sum(got[fold, t]["support"] for t in tags)
            parts += [got[fold, t]["f1"] * (got[fold, t]["support"] / support if support else 0) for t in tags]
        assert r["weighted_mean"] == pytest.approx(sum(parts) / len(parts))
        assert r["weighted_sum"] == pytest.approx(sum(parts) / 2)
    accuracy = {r["fold"]: r["accuracy"] for r in metrics.argmax_accuracy(df).collect()}
    for fold in (0, 1):
        hits = []
        for i in {x[0] for x in rows if x[1] == fold}:
            y = [x[3] for x in rows if x[0] == i]
            p = [x[4] for x in rows if x[0] == i]
            hits.append(int(np.argmax(y)) == int(np.argmax(p)))
        assert accuracy[fold] == pytest.approx(sum(hits) / len(hits))


def test_undefined_metrics_are_zero(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0.1)], "message_id long, fold int, tag_pos int, y int, p double")
    r = metrics.tag_prf(df).first()
    assert (r["precision"], r["recall"], r["f1"], r["support"]) == (0, 0, 0, 0)
    assert metrics.overall_f1(metrics.tag_prf(df)).first()["weighted_f1"] == 0


def test_results_sink(spark, tmp_path):
    table = metrics.results(scores(spark)[1]).select(
        F.lit("c").alias("config"), F.lit("BCE").alias("loss"), "metric", "value"
    )
    write_results(table, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == table.count()
    import json

    want = {r.metric: r.value for r in table.collect()}
    assert json.loads(nested_results(table).first()["json"]) == {table.first().loss: want}


def test_store_keeps_other_tables(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path), "x")
    rows = spark.range(3).withColumns({k: F.lit("a") for k in ("method", "fold", "level", "split")})
    store.write(rows)
    store.write(rows.withColumn("method", F.lit("b")))
    assert store.read(method="a").count() == store.read(method="b").count() == 3
    keys = {"method": "b", "fold": "a", "level": "a", "split": "a"}

    def never():
        raise AssertionError("computed again")

    assert store.get_or_compute(keys, never).count() == 3
    keys["fold"] = "c"
    assert store.get_or_compute(keys, lambda: spark.range(2)).count() == 2
    assert store.get_or_compute(keys, never).count() == 2


def test_second_run_finds_the_matrix(spark, tmp_path):
    """A stored matrix is read without a job and without what it was made of."""
    from agorascope.plans.design import Design
    from agorascope.operators.corpus import Corpus

    keys = {"method": "behaviour", "fold": "all_5", "level": "all", "split": "all"}
    matrix = spark.createDataFrame([(0, "train", 7, [1.0, 2.0])], "fit int, split string, message_id long, features array<float>")
    first = FeatureStore(spark, str(tmp_path), "y")
    assert first.finished().count() == 0
    first.get_or_compute(keys, lambda: matrix)
    assert [tuple(r) for r in FeatureStore(spark, str(tmp_path), "y").finished().collect()] == [tuple(keys.values())]
    design = Design(Corpus(spark.range(0)), store=FeatureStore(spark, str(tmp_path), "y"))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("resume", "")
    found = design.matrix("behaviour")
    assert not tracker.getJobIdsForGroup("resume")
    assert found.collect() == matrix.collect()
    spark.sparkContext.setJobGroup("", "")


def test_store_computes_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def counted(v):
        runs.add(1)
        return v

    rows = spark.range(4).withColumn("x", F.udf(counted, "long")("id"))
    store = FeatureStore(spark, str(tmp_path), "z")
    store.write(rows.withColumns({k: F.lit("a") for k in ("method", "fold", "level", "split")}))
    assert runs.value == 4 and store.read().count() == 4


def test_ingest_report_and_corrupt_records(spark, tmp_path):
    from agorascope.sources.messages import ingest_report

    rows = [(1, "a", -1), (2, "a", 1), (2, "a", 1), (3, "b", 1), (4, "b", 99), (None, "b", 3), (5, "b", None)]
    got = ingest_report(spark.createDataFrame(rows, "message_id long, tree_id string, parent long")).first().asDict()
    assert got == {"rows": 7, "no_id": 1, "no_parent": 1, "repeated_ids": 1, "lost_parents": 1, "foreign_parents": 1}
    empty = ingest_report(spark.createDataFrame([], "message_id long, tree_id string, parent long")).first()
    assert set(empty.asDict().values()) == {0}
    head = ["Unnamed: 0", "node_id", "tree_id", "parent", "author", "text", "timestamp", *ALL_TAGS[:-1]]
    good = ["1", "n", "t", "-1", "u", "x", "5.0"] + ["0"] * 31
    (tmp_path / "m.csv").write_text("\n".join([",".join(head), ",".join(good), ",".join(["bad"] + good[1:])]))
    back = read_annotated_csv(spark, str(tmp_path / "m.csv"), corrupt="_bad").collect()
    assert sorted((r.message_id is None, r["_bad"] is None) for r in back) == [(False, True), (True, False)]


def test_grid():
    names = [g[0] for g in experiment.grid(["x", "y"])]
    assert len(names) == len(set(names)) == 12
    assert "one_hot_vector_x" in names and "combined_y_x" in names


def test_classifier_learns(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(400):
        x, who = rng.normal(size=3), int(rng.integers(4))
        y = [int(x[0] + x[1] > 0), int(who == 2)]
        for fit in (0, 1):
            rows.append((fit, i, [float(v) for v in x], [who, -1], y))
    df = spark.createDataFrame(
        rows, "fit int, message_id long, inputs array<float>, ids array<int>, y array<int>"
    ).repartition(3)
    weights, authors = classifier.fit(df, 3, 2, 2, rounds=25, rate=0.4)
    out = classifier.score(df, weights, 3, 2, 2, authors)
    assert out.count() == 1600
    right = out.select(F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    assert right > 0.95


def test_every_author_has_a_weight(spark, monkeypatch):
    # more authors than any fixed table would hold; those 4096 apart have opposite labels
    many = [(0, i, [0.0], [i, (i + 7) % 6000], [int(i >= 4096)]) for i in range(6000)]
    df = spark.createDataFrame(many, "fit int, message_id long, inputs array<float>, ids array<int>, y array<int>")
    results = []
    for rows in (classifier.BROADCAST_ROWS, 0):  # attached by broadcast, and by shuffle
        monkeypatch.setattr(classifier, "BROADCAST_ROWS", rows)
        weights, authors = classifier.fit(df.repartition(5), 1, 1, 2, rounds=4, rate=0.5)
        assert authors.count() == 12000
        out = classifier.score(df, weights, 1, 1, 2, authors)
        results.append({r.message_id: r.p for r in out.collect()})
        assert all((results[-1][i] > 0.5) == (i >= 4096) for i in (0, 5, 1000, 4096, 4101, 5096))
    assert results[0] == pytest.approx(results[1])


def test_gradients_meet_in_levels(spark, monkeypatch):
    monkeypatch.setattr(classifier, "FAN_IN", 2)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(40, 2)), rng.integers(0, 2, size=(40, 1))
    rows = [(0, i, [float(v) for v in x[i]], [int(y[i, 0])]) for i in range(40)]
    df = spark.createDataFrame(rows, "fit int, message_id long, inputs array<double>, y array<int>").repartition(9)
    weights, _ = classifier.fit(df, 2, 1, rounds=1, rate=0.1)
    share = y.mean()
    grad = np.append(x.T @ (share - y), (share - y).sum(keepdims=True).reshape(1, 1), axis=0) / 40
    start = np.array([[0.0], [0.0], [np.log(share / (1 - share))]])
    assert weights[0] == pytest.approx(start - 0.1 * grad / (np.abs(grad) + 1e-8), abs=1e-6)


def test_models_together_are_models_alone(spark):
    """One pass for many models gives each the weights and scores it gets alone."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        a, b = rng.normal(size=3), rng.normal(size=2)
        who = [int(rng.integers(5)), int(rng.integers(-1, 5))]
        rows.append((i % 3, i, [float(v) for v in a], [float(v) for v in b], who, [int(a[0] + b[0] > 0), int(who[0] == 2)]))
    df = spark.createDataFrame(
        rows, "fit int, message_id long, a array<double>, b array<double>, ids array<int>, y array<int>"
    ).repartition(4)
    models = [
        classifier.Model("wide", ("a", "b")), classifier.Model("own", ("b",), True),
        classifier.Model("turned", ("b", "a")), classifier.Model("both", ("a",), True),
    ]
    weights, authors = classifier.fit(df, {"a": 3, "b": 2}, 2, 2, 4, 0.3, models)
    got = {
        (r.model, r.message_id): (r.fold, list(r.y), list(r.p))
        for r in classifier.score_rows(df, weights, {"a": 3, "b": 2}, 2, 2, authors, models).collect()
    }
    assert len(got) == 480
    for m, one in enumerate(models):
        alone = df.withColumn("inputs", F.concat(*one.blocks))
        n_ids, d = (2 if one.sparse else 0), {"wide": 5, "own": 2, "turned": 5, "both": 3}[one.name]
        w, own = classifier.fit(alone, d, 2, n_ids, 4, 0.3)
        for k in w:
            assert weights[k][m] == pytest.approx(w[k], abs=1e-9)
        for r in classifier.score_rows(alone, w, d, 2, n_ids, own).collect():
            fold, y, p = got[one.name, r.message_id]
            assert (fold, y) == (r.fold, list(r.y)) and p == pytest.approx(list(r.p), abs=1e-9)


def test_metrics_in_one_pass(spark):
    """All metrics from one row per fold and tag, and from one scan of the scores."""
    _, df = scores(spark, 7)
    got = {r.fold: r for r in metrics.fold_metrics(df).collect()}
    prf = metrics.tag_prf(df)
    for want in metrics.overall_f1(prf).join(metrics.bce_loss(df), "fold").join(metrics.argmax_accuracy(df), "fold").collect():
        for name in ("macro_f1", "weighted_f1", "loss", "accuracy"):
            assert got[want.fold][name] == pytest.approx(want[name], abs=1e-12)
    plan = metrics.tag_statistics(metrics.by_message(df))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


def test_text_embeddings(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "b a a")], "id long, text string")
    got = {r["id"]: r["embedding"] for r in hashed_embedding(df, "id", 16).collect()}
    assert got[1] == got[3] and sum(v * v for v in got[1]) == pytest.approx(1, abs=1e-6)
    assert got[2] == [0.0] * 16

    def make_predict():
        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    assert {r["id"]: r["embedding"] for r in model_embedding(df, "id", make_predict).collect()} == {
        1: [5.0, 1.0], 2: [0.0, 1.0], 3: [5.0, 1.0]
    }


def test_registered_queries(spark):
    import duckdb

    from check import TABLES, compare

    sql, registered = contract.oracle_sql(), contract.queries()
    assert set(sql) <= set(registered)
    # the optional queries have tests of their own
    assert set(QUERIES) - set(sql) == {"tag_scores", "cv_results"}
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name in ["scan_messages", "group_kfold", "tree_profile", "root_paths", "last_user", "tag_weights"]:
        assert compare(registered[name](spark, sf).toPandas(), con.execute(sql[name]).fetchdf()) == "ok", name


def test_cv_results_trains_as_long_as_tag_scores(spark, monkeypatch):
    import inspect

    from agorascope import queries
    from agorascope.plans import experiment

    class Fit(Exception):
        pass

    def fit(train, d, n_tags, n_ids=0, rounds=20, rate=0.1, **_):
        raise Fit(rounds)

    monkeypatch.setattr(experiment.classifier, "fit", fit)
    for query in (queries.cv_results, queries.tag_scores):
        with pytest.raises(Fit) as found:
            query(spark, "/root/testdata/sf0.001")
        assert found.value.args == (inspect.signature(experiment.evaluate).parameters["rounds"].default,) == (20,)


def test_metrics_of_a_long_table_in_any_order(spark):
    """Ties, missing and odd scores, and messages in pieces count as when they are put together; no more
    than a row per message and task is dealt by message."""
    rng = random.Random(3)
    odd = [None, math.nan, math.inf, -math.inf, -0.0, 0.0, 0.25, 0.5, 0.75]
    rows = [(m, m % 2, t, rng.choice([0, 0, 1]), rng.choice(odd)) for m in range(60) for t in range(5)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "message_id long, fold int, tag_pos int, y int, p double").repartition(4)
    names = ("fold", "tag_pos", "tp", "found", "support", "n", "hits", "messages")
    want = sorted(tuple(r[c] for c in names) for r in metrics.tag_statistics(metrics.by_message(df)).collect())
    assert sorted(tuple(r[c] for c in names) for r in metrics.long_statistics(df).collect()) == want
    best = df.groupBy("fold", "message_id").agg(
        F.max(F.struct("y", -F.col("tag_pos"))).alias("y"), F.max(F.struct("p", -F.col("tag_pos"))).alias("p")
    )
    share = best.groupBy("fold").agg(F.avg((F.col("y.col2") == F.col("p.col2")).cast("double")).alias("a"))
    got = {r.fold: r.accuracy for r in metrics.argmax_accuracy(df).collect()}
    assert got == pytest.approx({r.fold: r.a for r in share.collect()})
    plan = metrics.results(df)
    dealt = metrics.long_statistics(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in dealt and plan.count() == 12
