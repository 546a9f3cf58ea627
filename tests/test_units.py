"""Training rows of all fits, stored once per message; hashed embeddings and scaled tags where the rows are."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agorascope.functions.embedding import hashed_counts, hashed_embedding
from agorascope.operators.corpus import Corpus
from agorascope.operators.profile import with_tags
from agorascope.plans import classifier, experiment
from agorascope.plans.design import Design
from agorascope.plans.units import units
from test_profiles import TAGS, messages


def fixture(spark):
    rng = random.Random(4)
    rows, thread = [], 0
    for i in range(90):
        start = i % 9 == 0
        thread += start
        # parents in other threads and missing ones too
        parent = -1 if start else rng.choice([i - 1, i - i % 9, rng.randrange(90), 500])
        parent = -1 if parent >= i and parent != 500 else parent
        author = rng.choice(["a", "b", f"only_{thread}", None, "c"])
        rows.append((i, f"T{thread}", parent, author, float(i), rng.randrange(9), [rng.randrange(2) for _ in TAGS]))
    corpus = Corpus(messages(spark, rows).repartition(3), TAGS)
    folds = spark.createDataFrame([(f"T{t}", t % 3) for t in range(1, thread + 1)], "tree_id string, fold int")
    vectors = [(i, [rng.choice([1.5, -2.0, None, 7.0]), float(i) / 90]) for i in range(90)]
    e = spark.createDataFrame(vectors, "message_id long, embedding array<float>")
    return Design(corpus, e, 3, folds), e


def test_units_are_the_rows_of_all_fits(spark):
    design, e = fixture(spark)
    packed = units({"": design}, {"": e}, {"behaviour": ("behaviour", ""), "embedding": ("embedding", "")})
    stored = packed.table.select(F.sum("n")).first()[0]
    assert stored == 90  # once per message, whatever the number of fits
    want = {(r.fit, r.message_id): (r.split, [0.0 if v is None else v for v in r.inputs]) for r in design.model_inputs("combined", e).collect()}
    blocks = ["now_", "behaviour", "embedding", "last_behaviour", "last_embedding"]
    got = {}
    for batch in packed.table.toArrow().to_batches():
        for split in ("train", "test"):
            for k, unit, mine, x, y in packed.of(split).reader(blocks)(batch):
                ids = np.frombuffer(batch.column("message_id")[unit].as_buffer(), np.int64)[mine]
                for i, row in zip(ids.tolist(), np.hstack([x[b] for b in blocks]).tolist()):
                    got[k, i] = split, row
    assert got.keys() == want.keys() and len(got) == 270
    for key, (split, row) in want.items():
        assert got[key][0] == split and got[key][1] == pytest.approx(row, nan_ok=True)


def test_scores_by_units_are_those_by_rows(spark, monkeypatch):
    design, e = fixture(spark)
    labels = design.corpus.columns("message_id", "tags").withColumnRenamed("tags", "y")
    filled = F.transform("inputs", lambda v: F.coalesce(v, F.lit(0.0).cast("float")))
    data = design.model_inputs("combined", e).withColumn("inputs", filled).join(labels, "message_id")
    d = data.select(F.size("inputs")).first()[0]
    weights, _ = classifier.fit(data.where("split = 'train'"), d, len(TAGS), rounds=3)
    want = {(r.fold, r.message_id, r.tag_pos): (r.y, r.p) for r in classifier.score(data.where("split = 'test'"), weights, d, len(TAGS)).collect()}
    # no table of a row per message and fit is made
    monkeypatch.setattr(Design, "model_inputs", None)
    got = {(r.fold, r.message_id, r.tag_pos): (r.y, r.p) for r in experiment.tag_scores(design, "combined", e, 3).collect()}
    assert got.keys() == want.keys() and len(got) == 90 * len(TAGS)
    for key, (y, p) in want.items():
        assert got[key][0] == y and got[key][1] == pytest.approx(p, abs=1e-9)


def test_grid_by_units_is_the_grid_by_rows(spark):
    design, e = fixture(spark)
    other = e.select("message_id", F.transform("embedding", lambda v: F.coalesce(v, F.lit(0.5)) * 2).cast("array<float>").alias("embedding"))
    designs = {"x": design, "y": Design(design.corpus, other, 3, design.folds)}
    encoders = {"x": e, "y": other}
    found = []
    for unique in (True, False):  # rows of repeated ids go by fit
        design.corpus.__dict__["unique"] = unique
        found.append({(r.config, r.metric): r.value for r in experiment.evaluate(designs, encoders, rounds=2).collect()})
    assert found[0].keys() == found[1].keys() and len({c for c, _ in found[0]}) == 12
    for key, value in found[1].items():
        assert found[0][key] == pytest.approx(value, abs=1e-9, nan_ok=True)


def test_hashed_counts_are_made_where_the_texts_are(spark):
    texts = {1: "a b\x1ca", 2: "", 3: None, 4: " é é x\x85y ", 5: "one two three two"}
    rows = [*texts.items(), (5, "two four")]  # the texts of a key count together
    df = spark.createDataFrame(rows, "id long, text string")
    want = {}
    for key, text in rows:
        for word in (text or "").split():
            at = key, int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % 16
            want[at] = want.get(at, 0) + 1
    norm = {k: math.sqrt(sum(n * n for (i, _), n in want.items() if i == k)) for k in texts}
    got = {(r.id, r.bucket): r.value for r in hashed_counts(df, "id", 16).collect()}
    assert got == pytest.approx({(k, b): n / norm[k] for (k, b), n in want.items()})
    dense = hashed_embedding(df, "id", 16).collect()
    assert len(dense) == 6 and all(r.embedding == pytest.approx([got.get((r.id, b), 0.0) for b in range(16)]) for r in dense)
    plan = hashed_counts(df, "id", 16)._jdf.queryExecution().executedPlan().toString()
    assert "explode(filter(split" not in plan  # words are not dealt as rows


def test_fallback_tags_are_scaled_per_author(spark):
    design, _ = fixture(spark)
    from agorascope.operators.context import message_contexts

    contexts = message_contexts(design.corpus, ["tree"])
    _, new = with_tags(contexts, design.forum, design.corpus, [0, 1, 2])
    assert "scaled_tags" in new.columns
