"""Means per author and fit: each different mean once."""

import math
import random

import pytest

from agorascope.operators.corpus import Corpus
from agorascope.operators.embedding import author_means, default_mean, fit_means
from agorascope.operators.profile import _shared_totals, author_totals
from test_profiles import TAGS, messages


def mean(values):
    known = [v for v in values if v is not None and not math.isnan(v)]
    return sum(known) / len(known) if known else None


def same(a, b):
    return (a is None and b is None) or a == pytest.approx(b, nan_ok=True)


def fixture(spark):
    rng = random.Random(2)
    threads = {f"T{i}": i % 4 for i in range(9)}
    rows, vectors = [], []
    for i in range(200):
        thread = f"T{rng.randrange(9)}"
        author = rng.choice(["a", "b", f"only_{thread}", None, "" if thread == "T1" else "c"])
        rows.append((i, thread, -1, author, float(i), 1, [1, 0, 0]))
        vectors.append((i, [rng.choice([1.5, -2.0, None, math.nan, math.inf, 7.0]), float(i)]))
    corpus = Corpus(messages(spark, rows).repartition(5), TAGS)
    folds = spark.createDataFrame(list(threads.items()), "tree_id string, fold int")
    e = spark.createDataFrame(vectors, "message_id long, embedding array<double>")
    return rows, dict(vectors), threads, corpus, folds, e


def test_means_of_all_fits(spark):
    rows, value, threads, corpus, folds, e = fixture(spark)
    want = {}
    for fit in range(4):
        for i, thread, _, author, *_ in rows:
            if author is not None and threads[thread] != fit:
                want.setdefault((fit, author), []).append(value[i])
    got = {(r.fit, r.author): r["mean"] for r in author_means(corpus, e, 2, folds, 4).collect()}
    assert set(got) == set(want)
    for key, members in want.items():
        assert all(same(got[key][j], mean([v[j] for v in members])) for j in (0, 1)), key
    table = fit_means(corpus, e, 2, folds, 4)
    of = {r.author: r for r in table.collect()}
    # one mean, not one per fit, for an author whose messages are all in one fold
    assert [len(of[a]["vectors"]) for a in ("only_T2", "", "a")] == [1, 1, 4]
    assert of["only_T2"].which == [0, 0, None, 0]
    by_fit = {r.fit: r["mean"] for r in default_mean(table, 2).collect()}
    plain = {r.fit: r["mean"] for r in default_mean(author_means(corpus, e, 2, folds, 4), 2).collect()}
    for fit in range(4):
        each = [got[k][1] for k in got if k[0] == fit]
        assert by_fit[fit][1] == pytest.approx(sum(each) / len(each)) == plain[fit][1]
        assert same(by_fit[fit][0], plain[fit][0])


def test_totals_shared_by_fits_stand_once(spark):
    rows, _, threads, corpus, folds, _ = fixture(spark)
    placed = corpus.messages.join(folds, "tree_id")
    found = _shared_totals(author_totals(placed, ["fold"], len(TAGS)), len(TAGS), 4).collect()
    assert sum(r.author == "only_T2" for r in found) == 1
    got = {(k, r.author): (r.n, r.min_ts, r.max_ts, r.t0) for r in found for k in r.fits}
    want = {}
    for i, thread, _, author, *_ in rows:
        for k in range(4):
            if author is not None and threads[thread] != k:
                want.setdefault((k, author), []).append(i)
    assert got == {k: (len(v), float(min(v)), float(max(v)), float(len(v))) for k, v in want.items()}
