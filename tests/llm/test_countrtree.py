import random

import numpy as np
import pytest

from agorascope.llm import countrtree
from agorascope.llm.queries import ORACLES
from tests.llm import brute


def plain(rows, percent=80):
    """Components by comparison of all pairs; a document of several texts links them."""
    sets = [(d, frozenset(brute.shingles(t))) for d, t, _ in rows]
    known = sorted({d for d, _ in sets if d is not None})
    nodes = [(d, s) for d, s in sets if d is not None and s]
    linked = [
        (a, b) for i, (a, x) in enumerate(nodes) for b, y in nodes[i + 1 :] if a != b and 100 * len(x & y) >= percent * len(x | y)
    ]
    root = brute.components(known, linked)
    return sorted((-1 if d is None else d, len(s), -1 if d is None else root[d]) for d, s in sets)


def found(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((-1 if d is None else d, n, -1 if c is None else c) for d, n, c in df.collect())


def variants(seed=2, families=6, of=25):
    """Families of texts with more and less than the threshold in common, and a passage in most texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage, out = r.choices(vocabulary, k=30), []
    for f in range(families):
        base = r.choices(vocabulary, k=r.choice([8, 40, 200]))
        for _ in range(of):
            words = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 25))):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            if r.random() < 0.5:
                words += passage
            out.append((len(out), " ".join(words), "s"))
    return out


def test_fixture(docs, fixture_rows):
    assert found(countrtree.components_of(docs)) == plain(fixture_rows)


@pytest.mark.parametrize("points, shingles", [(8192, 1 << 19), (7, 900)])
def test_families_in_units_of_any_size(table, points, shingles):
    rows = variants()
    got = found(countrtree.components_of(table(rows), points, shingles))
    assert got == plain(rows) and 6 < len({c for *_, c in got}) < 120


def test_odd_ids_and_empty_table(table, empty):
    assert found(countrtree.components_of(empty)) == []
    text, other = " ".join(map(str, range(50))), " ".join(map(str, range(100, 150)))
    rows = [(None, text, "s"), (5, text, "s"), (3, other, "s"), (3, text, "s"), (None, None, None), (9, other, "s"), (2, "", "s")]
    assert found(countrtree.components_of(table(rows))) == plain(rows)


def test_sql_counterpart(spark, table):
    duckdb = pytest.importorskip("duckdb")
    rows = variants(8, 4, 12) + [(1000, None, "s"), (1001, "", "s"), (1002, "one two", "s"), (1003, "ONE  two", "s")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    names = [d[0] for d in con.execute(ORACLES["op13_count_rtree"]).description]
    assert names == ["doc_id", "n_shingles", "component_id"]
    assert sorted(con.fetchall()) == plain(rows)


def test_tree_misses_nothing():
    """Search gives all sets that are similar enough, and bounds far ones away."""
    r = np.random.default_rng(4)
    sets = []
    for _ in range(60):
        base = r.integers(0, 1 << 63, r.integers(4, 300)).astype(np.uint64)
        for _ in range(6):
            drop = r.random(len(base)) < r.choice([0.02, 0.1, 0.2])
            sets.append(np.unique(np.where(drop, r.integers(0, 1 << 63, len(base)).astype(np.uint64), base)))
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    counts = countrtree.points(np.concatenate(sets), first)
    order = np.argsort(np.diff(first), kind="stable")
    tree = countrtree.CountTree(np.diff(first)[order], countrtree._open(counts[order]))
    seen = pairs = 0
    for i in range(len(sets)):
        hits = set(order[tree.search(len(sets[i]), tree.counts[list(order).index(i)])].tolist())
        seen += len(hits)
        for j in range(len(sets)):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                pairs += 1
                assert j in hits
    assert pairs <= seen < 6 * pairs


def test_cut_off_counts_bound_nothing():
    values = np.full(70_000, 7, np.uint64)  # as if all shingles fell into one group
    counts = countrtree.points(values, np.array([0, 70_000]))
    assert counts.max() == countrtree.FULL and countrtree._open(counts).max() > 70_000


def test_prefixes_meet():
    """Sets of exactly the threshold share a prefix shingle, whatever the order."""
    r = np.random.default_rng(6)
    for n in (4, 5, 9, 10, 50, 200):
        for _ in range(30):
            pool = r.integers(0, 1 << 63, 2 * n + 2).astype(np.uint64)
            shared = -(-80 * (2 * n) // 180)
            for m in (n, n + 1):
                both = -(-80 * (n + m) // 180)
                if both > n:
                    continue
                a, b = np.sort(pool[:n]), np.sort(np.concatenate([pool[:both], pool[n : n + m - both]]))
                common = r.integers(0, 3, 1 << countrtree.TABLE_BITS).astype(np.uint8)
                found, doc = countrtree.prefixes(np.concatenate([a, b]), np.array([0, n, n + m]), common)
                assert set(found[doc == 0].tolist()) & set(found[doc == 1].tolist())
            assert shared <= n


def test_finer_points_still_bound():
    """Points over any number of groups bound what two sets share, and large strangers apart."""
    r = np.random.default_rng(11)
    big = np.unique(r.integers(0, 1 << 63, 9000).astype(np.uint64))
    near = np.unique(np.concatenate([big[: int(len(big) * 0.93)], r.integers(0, 1 << 63, 300).astype(np.uint64)]))
    small = np.unique(big[:950])
    other = np.unique(r.integers(0, 1 << 63, 9000).astype(np.uint64))
    sets = [big, near, small, other]
    sizes = np.array([len(s) for s in sets])
    fine = countrtree.fine_points(np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)]))
    assert [len(f) for f in fine] == [2048, 2048, 128, 2048] and [int(f.sum()) for f in fine] == sizes.tolist()
    may = countrtree._bound(sizes, fine)
    assert may(0, 1) and may(0, 0) and not may(0, 3) and not may(0, 2)
    coarse = countrtree.points(np.concatenate([big, other]), np.array([0, len(big), len(big) + len(other)]))
    assert (countrtree._folded(fine[0], 128) == coarse[0]).all()
