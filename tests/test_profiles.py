import random

import pytest
from pyspark.sql import functions as F

from agorascope.functions.scaling import scale_row
from agorascope.functions.text import word_count
from agorascope.operators.corpus import Corpus
from agorascope.operators.forest import leaf_paths, leaves
from agorascope.operators.profile import (
    default_profile,
    flatten,
    forum_profile,
    message_profiles,
)
from agorascope.schema import profile_columns
from agorascope.settings import Limits

import spec

TINY = Limits(hot_rows=2, max_hot_keys=8, block_bits=1, fine_bits=1)
TAGS = ["A", "B", "Untagged"]

FIXTURE = [
    (0, "T1", -1, "u1", 100, "a b c", 1, 0),
    (1, "T1", 0, "u2", 110, "a b", 0, 1),
    (2, "T1", 1, "u1", 130, "a b c d", 0, 0),
    (3, "T1", 0, "u3", 140, "a", 1, 1),
    (4, "T1", 2, "u2", 150, "a b c d e", 1, 0),
    (5, "T2", -1, "u2", 90, "a b", 0, 1),
    (6, "T2", 5, "u1", 120, "a", 1, 1),
    (7, "T2", 6, "u2", 135, "", 0, 0),
    (8, "T3", -1, "u9", 200, "x y", 1, 0),
    (9, "T3", 8, "u1", 210, "x", 0, 1),
    (10, "T3", 9, "u9", 230, "x y z", 0, 1),
]

FORUM = {
    "u1": [0.8, 0.666667, 0.666667, 1, 1, None, None, 0.5, 0.333333],
    "u2": [1, 1, 1, 0.75, 0, 1, 1, 0.5, 0],
    "u3": [0, 0, 0, 0, 1, 1, 0, 0.5, 1],
}
DEFAULT = [0.6, 0.555556, 0.555556, 0.583333, 0.666667, 1, 0.5, 0.5, 0.444444]
TREE = {
    0: [0, 1, 1, 1, 1, 0, 0, 0, 1],
    1: [0, 1, 1, 0, 0, 1, 1, 0.5, 1],
    2: [1, 1, 1, 1, 1, 0, 0, 0, 0],
    3: [0, 0, 0, 0, 1, 1, 0, 0.5, 1],
    4: [0.75, 1, 1, 1, 0, 1, 0, 0, 0],
    5: [0, 1, 1, 1, 0, 1, 1, 0.5, 1],
    6: [0, 1, 1, 0, 1, 0, 0, 0, 1],
    7: [1, 1, 1, 1, 0, 1, 0, 0, 0],
    8: [0, 1, 1, 1, 0.333333, 1, 0.25, 0.538462, 1],
    9: [0, 1, 1, 0, 1, 0, 0, 0, 1],
    10: [1, 1, 1, 1, 1, 0, 0, 0, 0],
}
BRANCH = TREE | {
    3: [0, 1, 1, 0, 1, 1, 0, 0.5, 1],
    4: [0, 1, 1, 1, 0, 1, 0, 0, 0],
}


def messages(spark, rows):
    df = spark.createDataFrame(
        rows, "message_id long, tree_id string, parent long, author string, ts double, "
        "words long, tags array<int>"
    )
    return df


def fixture_rows():
    return [
        (i, t, p, a, float(ts), len(text.split()), [x, y, int(x + y == 0)])
        for i, t, p, a, ts, text, x, y in FIXTURE
    ]


def folds(spark):
    # T1 and T2 train fit 0, T3 is its test thread; fit 1 is not looked at
    return spark.createDataFrame([("T1", 1), ("T2", 1), ("T3", 0)], "tree_id string, fold int")


def rounded(rows, key):
    names = profile_columns(TAGS)
    return {
        r[key]: [None if r[n] is None else round(r[n], 6) for n in names] for r in rows
    }


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_fixture_values(spark, limits):
    corpus = Corpus(messages(spark, fixture_rows()), TAGS, limits)
    forum = forum_profile(corpus, folds(spark), 1)
    assert rounded(flatten(forum, TAGS).collect(), "author") == FORUM
    base = default_profile(forum, 3).withColumn("author", F.lit("default"))
    assert rounded(flatten(base, TAGS).collect(), "author") == {"default": DEFAULT}
    out = flatten(message_profiles(corpus, ["tree", "branch"], folds(spark), 1), TAGS).collect()
    assert rounded([r for r in out if r["level"] == "tree"], "message_id") == TREE
    assert rounded([r for r in out if r["level"] == "branch"], "message_id") == BRANCH


def test_row_order_does_not_matter(spark):
    rows = fixture_rows()
    random.Random(3).shuffle(rows)
    corpus = Corpus(messages(spark, rows), TAGS)
    out = flatten(message_profiles(corpus, ["tree"], folds(spark), 1), TAGS).collect()
    assert rounded(out, "message_id") == TREE


SCALED_ROWS = [
    ([4, 2, 0, 1], [1, 1, 0, 1]),
    ([1, 2, 3, 0], [1 / 3, 2 / 3, 1, 0]),
    ([2, 3, 4, 5], [0, 0.6, 0.8, 1]),
    ([0, 0, 0, 5], [0, 0, 0, 1]),
    ([1, 1, 1], [None, None, None]),
    ([2, 1, 1], [1, None, None]),
    ([0, 0], [None, None]),
    ([0.5, 0, 1], [0.5, 0, 1]),
    ([0.5, 0, 0.25], [1, 0, 0.25]),
]


@pytest.mark.parametrize("values,expected", SCALED_ROWS)
def test_scale_row(spark, values, expected):
    df = spark.createDataFrame([([float(v) for v in values],)], "v array<double>")
    got = df.select(scale_row(F.col("v"), len(values)).alias("s")).first()["s"]
    assert [None if v is None else round(v, 12) for v in got] == [
        None if v is None else round(v, 12) for v in expected
    ]
    # arrays whose elements cannot be null must still give NULLs
    strict = df.select(F.transform("v", lambda v: F.coalesce(v, F.lit(0.0))).alias("v"))
    assert strict.select(scale_row(F.col("v"), len(values)).alias("s")).first()["s"] == got


def test_scale_row_random(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(400):
        n, kind = 5, rng.randrange(3)
        if kind == 0:
            rows.append([float(rng.randrange(4)) for _ in range(n)])
        elif kind == 1:
            rows.append([rng.choice([0.0, 0.25, 0.5, 1.0, 1.5]) for _ in range(n)])
        else:
            rows.append([float(rng.randrange(1, 4)) for _ in range(n)])
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, v array<double>")
    got = {r["i"]: r["s"] for r in df.select("i", scale_row(F.col("v"), 5).alias("s")).collect()}
    for i, r in enumerate(rows):
        assert all(spec.close(a, b) for a, b in zip(got[i], spec.scale_row(r), strict=True)), r


def random_threads(seed, n, shape):
    """Threads of one shape: random replies, one chain, a star, with times out of order."""
    rng = random.Random(seed)
    rows, first = [], {}
    for i in range(n):
        tree = "hot" if rng.random() < 0.5 else f"t{rng.randrange(3)}"
        earlier = first.setdefault(tree, [])
        if not earlier:
            parent = -1
        elif shape == "chain":
            parent = earlier[-1]
        elif shape == "star":
            parent = earlier[0] if rng.random() < 0.8 else rng.choice(earlier)
        else:
            parent = rng.choice([*earlier, -1, 10_000])  # second roots, missing parents
        earlier.append(i)
        author = None if rng.random() < 0.05 else ("hot" if rng.random() < 0.4 else f"a{rng.randrange(5)}")
        tags = [int(rng.random() < 0.3) for _ in range(3)]
        rows.append((i, tree, parent, author, float(rng.randrange(50)), rng.randrange(6), tags))
    return rows


@pytest.mark.parametrize("shape,seed", [("mixed", 1), ("chain", 2), ("star", 3)])
@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_against_row_by_row_rules(spark, shape, seed, limits):
    rows = random_threads(seed, 60, shape)
    corpus = Corpus(messages(spark, rows), TAGS, limits)
    out = flatten(message_profiles(corpus, ["tree", "branch"]), TAGS).collect()
    names = ["message_id", "tree_id", "parent", "author", "ts", "words", "tags"]
    plain = [dict(zip(names, r)) for r in rows]
    forum = spec.forum(plain, 3)
    base = spec.default(forum)
    by_id = {r["message_id"]: r for r in plain}
    expected = sum(r["author"] is not None for r in plain) * 2
    assert len(out) == expected
    for r in out:
        anchor = by_id[r["message_id"]]
        want = spec.message_profile(plain, anchor, r["level"], 3, forum, base)
        got = [r[c] for c in profile_columns(TAGS)]
        assert all(spec.close(a, b) for a, b in zip(got, want, strict=True)), (r, want)


@pytest.mark.parametrize("shape", ["mixed", "chain", "star"])
@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_forest_numbers(spark, shape, limits):
    rows = random_threads(7, 50, shape)
    corpus = Corpus(messages(spark, rows), TAGS, limits)
    by_id = {r[0]: r for r in rows}

    def path(i):
        out = [i]
        while by_id[out[-1]][2] in by_id and by_id[by_id[out[-1]][2]][1] == by_id[i][1]:
            out.append(by_id[out[-1]][2])
        return out

    numbered = {r["message_id"]: r for r in corpus.numbered.collect()}
    assert set(numbered) == set(by_id)
    for i in by_id:
        assert numbered[i]["depth"] == len(path(i)) - 1
        below = {j for j in by_id if i in path(j)}
        assert numbered[i]["size"] == len(below)
        lo = numbered[i]["pre"]
        inside = {
            j for j in by_id
            if by_id[j][1] == by_id[i][1] and lo <= numbered[j]["pre"] < lo + len(below)
        }
        assert inside == below
    parents = {r[2] for r in rows}
    ends = {r[0] for r in rows} - parents
    assert {r["message_id"] for r in leaves(corpus.messages).collect()} == ends
    got = {}
    for r in leaf_paths(corpus.links, corpus.rows, limits).collect():
        got.setdefault(r["leaf_id"], {})[r["up_steps"]] = r["message_id"]
    want = {i: dict(enumerate(path(i))) for i in by_id if not any(i in path(j)[1:] for j in by_id)}
    assert got == want


def test_cycle_is_reported(spark):
    rows = [(0, "t", 1, "a", 0.0, 1, [1, 0, 0]), (1, "t", 0, "a", 0.0, 1, [1, 0, 0])]
    with pytest.raises(ValueError, match="cycle"):
        Corpus(messages(spark, rows), TAGS).numbered


WORDS = [
    ("", 0), ("  ", 0), (" a  b ", 2), ("a b", 2), ("a\x1cb", 2), ("a\x85b", 2),
    ("a​b", 1), ("a\tb\nc\r\nd", 4), ("　x y", 2), (None, 0),
]


def test_word_count(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WORDS)], "i int, t string")
    got = {r["i"]: r["n"] for r in df.select("i", word_count(F.col("t")).alias("n")).collect()}
    assert got == {i: n for i, (_, n) in enumerate(WORDS)}
    assert all(n == len((t or "").split()) for t, n in WORDS)


@pytest.mark.parametrize("limits", [Limits(), TINY])
def test_leave_one_out(spark, limits):
    """Against profiles of the training messages without the message, each computed anew."""
    names = ["message_id", "tree_id", "parent", "author", "ts", "words", "tags"]
    rows = [dict(zip(names, r)) for r in fixture_rows()]
    rows.append(dict(zip(names, (11, "T3", 10, "u4", 240.0, 1, [1, 1, 0]))))  # no message but this one
    table = messages(spark, [tuple(r.values()) for r in rows])
    placed = {"T1": 1, "T2": 1, "T3": 0}
    dealt = spark.createDataFrame(list(placed.items()), "tree_id string, fold int")
    corpus = Corpus(table, TAGS, limits)
    for given, n_folds, fits in ((dealt, 2, [0, 1]), (None, 1, [-1])):
        out = flatten(message_profiles(corpus, ["tree", "branch"], given, n_folds, leave_one_out=True), TAGS).collect()
        assert len(out) == 2 * len(rows) * len(fits)
        for r in out:
            anchor = next(x for x in rows if x["message_id"] == r["message_id"])
            rest = [x for x in rows if x is not anchor and (given is None or placed[x["tree_id"]] != r["fit"])]
            forum = spec.forum(rest, 3)
            want = spec.message_profile(rows, anchor, r["level"], 3, forum, [v or 0.0 for v in spec.default(forum)])
            got = [spec.NULL if r[n] is None else r[n] for n in profile_columns(TAGS)]
            assert all(spec.close(a, b, 1e-9) for a, b in zip(got, want, strict=True)), (r, want)
