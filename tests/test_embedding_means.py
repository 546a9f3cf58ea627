"""Means over branches with values that are missing or not finite, or that drown others."""

import math

import pytest

from agorascope.operators.corpus import Corpus
from agorascope.operators.embedding import author_means, context_means
from test_profiles import TAGS, TINY, messages

# a root with two branches by the same author, then a chain below each
ROWS = [
    (0, "T", -1, "u", float(1), 1, [1, 0, 0]),
    (1, "T", 0, "u", float(2), 1, [1, 0, 0]),
    (2, "T", 0, "v", float(3), 1, [1, 0, 0]),
    (3, "T", 2, "u", float(4), 1, [1, 0, 0]),
    (4, "T", 1, "u", float(5), 1, [1, 0, 0]),
    (5, "T", 3, "w", float(6), 1, [1, 0, 0]),
    (6, "T", 5, "u", float(7), 1, [1, 0, 0]),
]
CHAIN = {0: [0], 1: [0, 1], 2: [2], 3: [0, 3], 4: [0, 1, 4], 5: [5], 6: [0, 3, 6]}
SO_FAR = {0: [0], 1: [0, 1], 2: [2], 3: [0, 1, 3], 4: [0, 1, 3, 4], 5: [5], 6: [0, 1, 3, 4, 6]}


def mean(values):
    known = [v for v in values if v is not None and not math.isnan(v)]
    return sum(known) / len(known) if known else None


@pytest.mark.parametrize("bad", [None, math.nan, math.inf, 1e17])
@pytest.mark.parametrize("where", [1, 4])
@pytest.mark.parametrize("limits", [[], [TINY]])
def test_odd_values_stay_where_they_are_seen(spark, bad, where, limits):
    corpus = Corpus(messages(spark, ROWS), TAGS, *limits)
    value = {i: float(i + 1) for i in range(7)} | {where: bad}
    vectors = spark.createDataFrame([(i, [v, 1.0]) for i, v in value.items()], "message_id long, embedding array<double>")
    for level, members in (("branch", CHAIN), ("tree", SO_FAR)):
        got = {r.message_id: list(r.mean) for r in context_means(corpus, vectors, 2, level).collect()}
        for i, own in members.items():
            assert got[i] == pytest.approx([mean([value[k] for k in own]), 1.0]), (level, i)
    if not limits and where == 1:
        got = {r.author: r["mean"][0] for r in author_means(corpus, vectors, 2).collect()}
        assert got["u"] == pytest.approx(mean([value[k] for k in (0, 1, 3, 4, 6)]))
