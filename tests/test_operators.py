import random

import pytest
from pyspark.sql import functions as F

from agorascope.operators.authors import author_index, author_one_hot, row_positions
from agorascope.operators.corpus import Corpus
from agorascope.operators.embedding import author_means, context_means
from agorascope.operators.folds import assignment_phases, group_folds, in_folds, test_authors as fold_test_authors
from agorascope.operators.intervals import covering_extremes
from agorascope.operators.skew import lookup_join, ranged, running
from agorascope.settings import Limits
from test_profiles import TAGS, TINY, messages, random_threads


def greedy(sizes, n_folds):
    load, out = [0] * n_folds, []
    for s in sorted(sizes, reverse=True):
        f = min(range(n_folds), key=lambda k: (load[k], k))
        load[f] += s
        out.append((s, f))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_assignment_phases(seed):
    rng = random.Random(seed)
    n_folds = rng.choice([2, 3, 5])
    sizes = [rng.randrange(1, 12) for _ in range(rng.randrange(1, 200))] + [rng.randrange(1, 900)]
    histogram = {s: sizes.count(s) for s in sizes}
    got = []
    for size, phases in assignment_phases(list(histogram.items()), n_folds):
        for at in range(histogram[size]):
            start, cycle = [p for p in phases if p[0] <= at][-1]
            got.append((size, cycle[(at - start) % len(cycle)]))
    assert got == greedy(sizes, n_folds)


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_group_folds(spark, limits):
    rng = random.Random(11)
    sizes = {f"t{i}": rng.randrange(1, 9) for i in range(60)} | {"hot": 120}
    rows, i = [], 0
    for tree, n in sizes.items():
        for _ in range(n):
            rows.append((i, tree, -1, "a", 0.0, 1, [1, 0, 0]))
            i += 1
    corpus = Corpus(messages(spark, rows), TAGS, limits)
    folds = group_folds(corpus)
    got = {r["tree_id"]: r for r in folds.collect()}
    assert {t: r["thread_size"] for t, r in got.items()} == sizes
    assert sorted((r["thread_size"], r["fold"]) for r in got.values()) == sorted(greedy(sizes.values(), 5))
    placed = in_folds(corpus, folds, ["message_id", "tree_id", "author"])
    assert placed.count() == len(rows)
    loads = sorted(r["count"] for r in placed.groupBy("fold").count().collect())
    assert loads[-1] - loads[0] <= max(sizes.values())
    assert fold_test_authors(placed, 5, True).count() == 5
    assert fold_test_authors(placed, 5, False).count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_with_hot_keys(spark, how):
    rng = random.Random(2)
    keys = ["hot"] * 40 + ["warm"] * 10 + [f"k{rng.randrange(30)}" for _ in range(60)] + [None] * 20
    probe = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    table = spark.createDataFrame(
        [("hot", 1), *[(f"k{j}", j) for j in range(20)]], "k string, v int"
    )
    plain = sorted(map(tuple, lookup_join(probe, table, ["k"], 130, how).select("i", "k", "v").collect()))
    split = lookup_join(probe, table, ["k"], 130, how, Limits(hot_rows=5, max_hot_keys=20))
    assert sorted(map(tuple, split.select("i", "k", "v").collect())) == plain


def test_running_in_blocks(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), i, rng.randrange(9), float(rng.randrange(9))) for i in range(80)]
    df = spark.createDataFrame(rows, "k string, pos long, v long, t double")
    aggs = {"s": ("sum", "v"), "lo": ("min", "t"), "hi": ("max", "t")}
    plain = running(df, ["k"], "pos", aggs, None, {"nxt": "pos"})
    blocks = running(df, ["k"], "pos", aggs, F.shiftright("pos", 3), {"nxt": "pos"})
    assert sorted(map(str, plain.collect())) == sorted(map(str, blocks.select(*plain.columns).collect()))


@pytest.mark.parametrize("fine", [1, 2, 12])
def test_covering_extremes(spark, fine):
    rng = random.Random(fine)
    size = {"a": 37, "b": 1, "c": 64}
    spans = []
    for k, n in size.items():
        for _ in range(40):
            lo, hi = sorted((rng.randrange(n + 1), rng.randrange(n + 1)))
            spans.append((k, lo, hi, float(rng.randrange(100))))
    points = [(k, p, n) for k, n in size.items() for p in range(n)]
    got = covering_extremes(
        spark.createDataFrame(spans, "k string, lo long, hi long, v double"),
        spark.createDataFrame(points, "k string, pos long, size long"),
        ["k"], ["v"], 64, Limits(fine_bits=fine),
    )
    got = {(r["k"], r["pos"]): (r["lo_v"], r["hi_v"]) for r in got.collect()}
    for k, p, _ in points:
        inside = [v for key, lo, hi, v in spans if key == k and lo <= p < hi]
        assert got.get((k, p)) == ((min(inside), max(inside)) if inside else None)


@pytest.mark.parametrize("limits", [Limits(), TINY])
@pytest.mark.parametrize("shape", ["mixed", "chain"])
def test_mean_embeddings(spark, shape, limits):
    rows = random_threads(9, 40, shape)
    rng = random.Random(1)
    vec = {r[0]: [rng.random() for _ in range(3)] for r in rows}
    corpus = Corpus(messages(spark, rows), TAGS, limits)
    e = spark.createDataFrame(list(vec.items()), "message_id long, embedding array<float>")
    by_id = {r[0]: r for r in rows}

    def path(i):
        out = [i]
        while by_id[out[-1]][2] in by_id and by_id[by_id[out[-1]][2]][1] == by_id[i][1]:
            out.append(by_id[out[-1]][2])
        return out

    def mean(ids):
        return [sum(vec[i][j] for i in ids) / len(ids) for j in range(3)]

    for level in ("tree", "branch"):
        got = {r["message_id"]: r["mean"] for r in context_means(corpus, e, 3, level).collect()}
        assert set(got) == {r[0] for r in rows if r[3] is not None}
        for i in got:
            near = path(i) if level == "branch" else [
                j for j in by_id if by_id[j][1] == by_id[i][1] and j <= i
            ]
            want = mean([j for j in near if by_id[j][3] == by_id[i][3]])
            assert got[i] == pytest.approx(want, abs=1e-6)
    for r in author_means(corpus, e, 3).collect():
        assert r["mean"] == pytest.approx(mean([i for i in vec if by_id[i][3] == r["author"]]), abs=1e-6)


def test_author_positions(spark):
    rows = random_threads(13, 60, "mixed")
    corpus = Corpus(messages(spark, rows), TAGS)
    names = sorted({r[3] for r in rows if r[3] is not None})
    assert {r["author"]: r["author_idx"] for r in author_index(corpus).collect()} == {
        a: i for i, a in enumerate(names)
    }
    assert {r["message_id"]: names[r["author_idx"]] for r in author_one_hot(corpus).collect()} == {
        r[0]: r[3] for r in rows if r[3] is not None
    }
    positions = row_positions(corpus.messages).collect()
    assert {r["message_id"]: r["position"] for r in positions} == {r[0]: i for i, r in enumerate(rows)}


def test_blocks_of_sparse_ids(spark):
    """Ids far apart fill no fewer ranges than dense ones, and no window sees more than a range."""
    ids = [i << 20 for i in range(300)]
    rows = spark.createDataFrame([(i,) for i in ids], "message_id long")
    # such small ranges would be put together
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.message_id: r.position for r in row_positions(rows).collect()}
    assert got == {m: k for k, m in enumerate(ids)}
    ranges = [r["count"] for r in ranged(rows, "message_id").groupBy("range").count().collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(ranges) == 3 and max(ranges) < 200


def test_threads_by_one_task_as_by_joins(spark):
    """Intervals, numbering and means inside tasks give what the joins for large threads give."""
    for shape in ("mixed", "chain"):
        rows = random_threads(21, 50, shape)
        small, large = (Corpus(messages(spark, rows), TAGS, x) for x in (Limits(), Limits(block_bits=0)))
        assert small.narrow and not large.narrow
        columns = ["message_id", "tree_id", "up", "depth", "size", "pre"]
        assert sorted(map(str, small.numbered.select(columns).collect())) == sorted(map(str, large.numbered.select(columns).collect()))
        for level in ("tree", "branch"):
            both = [sorted(map(str, c.visits(level).collect())) for c in (small, large)]
            assert both[0] == both[1]
    twice = Corpus(messages(spark, rows + rows[:1]), TAGS)
    assert not twice.narrow


@pytest.mark.parametrize("kind", ["double", "long"])
def test_extremes_in_tasks_as_by_nodes(spark, kind):
    rng = random.Random(8)
    value = (lambda: rng.choice([None, -1.5, 0.0, float("nan"), 7.25])) if kind == "double" else (lambda: rng.randrange(-5, 5))
    spans = [(k, *sorted((rng.randrange(41), rng.randrange(41))), 40, value()) for k in "abc" for _ in range(12)]
    points = [(k, p, 40) for k in "abcd" for p in range(40)] + [("a", 3, 40)]
    a = spark.createDataFrame(spans, f"k string, lo long, hi long, size long, v {kind}")
    b = spark.createDataFrame(points, "k string, pos long, size long")
    got = covering_extremes(a, b, ["k"], ["v"], 40)
    want = covering_extremes(a, b, ["k"], ["v"], 40, Limits(block_bits=2, fine_bits=2))
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_rounding_is_that_of_round(spark):
    from agorascope.functions.scaling import rounded

    rng = random.Random(5)
    values = [rng.choice([1, -1]) * rng.random() * 10 ** rng.randrange(-8, 9) for _ in range(3000)]
    values += [k / 2e6 for k in range(-40, 40)] + [0.0, -0.0, 1e300, float("nan"), float("inf"), None, 999999.9999995]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert df.selectExpr("round(x, 6) + 0D AS a", f"{rounded('x', 6)} + 0D AS b").where("NOT (a <=> b)").count() == 0


def test_csv_files_are_bounded(spark, tmp_path, monkeypatch):
    from agorascope import queries

    spark.sql("SELECT id AS event_id, TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts, id % 7 AS user_id FROM range(0, 900, 1, 1)").write.parquet(f"{tmp_path}/events.parquet")
    spark.sql("SELECT id AS doc_id, 'two words' AS text FROM range(5)").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(queries, "CSV_RECORDS", 100)
    sizes = spark.read.text(queries._annotated(spark, str(tmp_path))).groupBy(F.input_file_name()).count()
    assert sizes.agg(F.max("count")).first()[0] <= 101  # with the header
