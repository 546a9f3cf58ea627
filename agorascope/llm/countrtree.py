"""Exact Jaccard join of shingle sets with R-trees over count vectors.

A set's shingles are hashed into GROUPS groups; the counts of its groups are a point. Two sets have at
most the sum of the smaller counts of each group in common. An R-tree keeps for a page of points the
largest count of each group and the least set size, so the same sum bounds what any set of the page
can share with a query, and whole pages are passed over. Pairs that survive are verified on full sets,
unless both are already connected: the result are components, so each unit gives a spanning forest.

No single tree can hold all sets. Which sets may meet at all is told by the same bound over as many
groups as there are shingles: sets of similarity 0.8 share one of the first n - ceil(0.8 n) + 1
shingles of either, in any order common to all. Rare shingles come first, by a table of counts of fixed
size, so passages of many documents seldom bring sets together. Sets with a shingle in common there are
a bucket; equal buckets are one. Trees of the buckets' points give clusters, outside of which there
are no links; trees of the clusters' points, with the sets at hand, give the links.

A bucket or cluster of more than a unit's sets is dealt into units twice, by two hashes, which connects
large groups of near copies; what stays outside its largest component is then compared with all of the
bucket or cluster, unit by unit. So no pair is left out, and no task holds more than two units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.llm import arrowwords
from agorascope.llm.components import components
from agorascope.llm.minhash import _groups, _stars, shingle_sets, slices
from agorascope.llm.store import small, written

PERCENT = 80
GROUPS, PER_GROUP = 128, 8
LEAF, FAN = 32, 16  # points of a page, pages of a node
TABLE_BITS = 20
POINTS, SHINGLES = 8192, 1 << 19  # of a unit: points alone, and shingles of sets with their texts
FULL = (1 << 16) - 1  # a count that was cut off: no bound
STEP = 2_000_000

_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def points(values: np.ndarray, first: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """How many shingles of each set fall into each group."""
    n = len(first) - 1
    own = np.repeat(np.arange(n), np.diff(first))
    group = ((values * _SPREAD) >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64)
    return np.bincount(own * groups + group, minlength=n * groups).reshape(n, groups).clip(max=FULL).astype(np.uint16)


def fine_points(values: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The point of each set over four times as many groups for each four-fold size over PER_GROUP
    shingles a group: over few groups, large sets of nothing in common look alike."""
    size = np.diff(first)
    level = np.ceil(np.log2(np.maximum(size, 1) / (PER_GROUP * GROUPS)) / 2).clip(0).astype(int)
    out: list = [None] * len(size)
    for k in np.unique(level).tolist():
        own = np.flatnonzero(level == k)
        picked = values[np.repeat(level == k, size)]
        found = points(picked, np.concatenate([[0], np.cumsum(size[own])]), GROUPS << 2 * k)
        for i, counts in zip(own.tolist(), found):
            out[i] = counts
    return out


def _folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The same point over fewer groups."""
    return counts if len(counts) == groups else _open(counts).reshape(groups, -1).sum(1)


def _bound(sizes: np.ndarray, fine: list[np.ndarray], percent: int = PERCENT) -> Callable[[int, int], bool]:
    def similar(i: int, j: int) -> bool:
        groups = min(len(fine[i]), len(fine[j]))
        shared = int(np.minimum(_open(_folded(fine[i], groups)), _open(_folded(fine[j], groups))).sum())
        return (100 + percent) * shared >= percent * int(sizes[i] + sizes[j])

    return similar


def _open(counts: np.ndarray) -> np.ndarray:
    out = counts.astype(np.int32)
    out[counts == FULL] = 1 << 24
    return out


class CountTree:
    """R-tree of count vectors, loaded in the order given: neighbours share pages."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray):
        self.sizes, self.counts = sizes, counts
        self.levels = []  # (largest counts, least size, greatest size) of the pages, leaves first
        high, least, most, fan = counts, sizes, sizes, LEAF
        while len(high) > 1:
            at = np.arange(0, len(high), fan)
            high, least, most = np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            self.levels.append((high, least, most, fan))
            fan = FAN

    def search(self, size: int, counts: np.ndarray, percent: int = PERCENT, among: np.ndarray | None = None) -> np.ndarray:
        """Points that may be as similar as ``percent`` to a set, by the bound on what they share.
        ``among``: only these, where they are few."""
        found = among
        if found is None:
            found = np.arange(len(self.levels[-1][0]) if self.levels else len(self.sizes))
        for depth in range(len(self.levels) - 1, -1, -1) if among is None else ():
            high, least, most, fan = self.levels[depth]
            found = found[self._may(size, counts, high[found], least[found], most[found], percent)]
            below = len(self.levels[depth - 1][0]) if depth else len(self.sizes)
            found = (found[:, None] * fan + np.arange(fan)).ravel()
            found = found[found < below]
        return found[self._may(size, counts, self.counts[found], self.sizes[found], self.sizes[found], percent)]

    @staticmethod
    def _may(size, counts, high, least, most, percent) -> np.ndarray:
        shared = np.minimum(high, counts).sum(1, dtype=np.int64)
        return ((100 + percent) * shared >= percent * (size + least)) & (100 * size >= percent * least) & (100 * most >= percent * size)


def linked(
    sizes: np.ndarray, counts: np.ndarray, labels: np.ndarray, asking: np.ndarray,
    similar: Callable[[int, int], bool] | None = None, percent: int = PERCENT,
) -> np.ndarray:
    """``labels`` with those of linked sets made equal: each set of ``asking`` against all others.
    ``similar`` verifies a pair; without it the bound decides."""
    order = np.lexsort((*counts.reshape(len(sizes), 8, -1).sum(2).T, sizes))
    tree = CountTree(sizes[order], _open(counts[order]))
    labels, asks = np.unique(labels[order], return_inverse=True)[1], asking[order]
    done = np.zeros(len(order), bool)
    for i in np.flatnonzero(asks):
        done[i] = True
        others = np.flatnonzero((labels != labels[i]) & ~done)
        if not len(others):
            continue
        found = tree.search(int(tree.sizes[i]), tree.counts[i], percent, others if len(others) * FAN < len(order) else None)
        found = found[(labels[found] != labels[i]) & ~done[found]]
        if similar is None:
            labels[np.isin(labels, labels[found])] = labels[i]
            continue
        for j in found:
            if labels[j] != labels[i] and similar(int(order[i]), int(order[j])):
                labels[labels == labels[j]] = labels[i]
    out = np.empty_like(labels)
    out[order] = labels
    return out


def _verifier(values: np.ndarray, first: np.ndarray, percent: int = PERCENT) -> Callable[[int, int], bool]:
    def similar(i: int, j: int) -> bool:
        a, b = values[first[i] : first[i + 1]], values[first[j] : first[j + 1]]
        if len(a) > len(b):
            a, b = b, a
        at = np.searchsorted(b, a)
        shared = int((b[np.minimum(at, len(b) - 1)] == a).sum())
        return 100 * shared >= percent * (len(a) + len(b) - shared)

    return similar


def _sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingle sets of texts, a slice at a time."""
    values, sizes = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
    for _, column in slices(texts, STEP):
        found, first = shingle_sets(column)
        values.append(found)
        sizes.append(np.diff(first))
    return np.concatenate(values), np.cumsum(np.concatenate(sizes))


EDGES = "a long, b long"


def _units(exact: bool):
    """Spanning forests of units: rows (unit, side, node, label, payload) sorted by unit. Only sets of
    side 0 ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, "unit"):
            unit = rows.column("unit").to_numpy()
            bounds = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1], [True]]))
            a, b = [], []
            for low, high in zip(bounds[:-1], bounds[1:]):
                if high - low < 2:
                    continue
                part = rows.slice(low, high - low)
                node, label, side = (part.column(c).to_numpy() for c in ("node", "label", "side"))
                one = np.flatnonzero((side == 0) | ~np.isin(node, node[side == 0]))  # who asks is not asked again
                if len(one) < len(node):
                    part, node, label, side = part.take(pa.array(one)), node[one], label[one], side[one]
                payload = part.column("payload").combine_chunks()
                if exact:
                    values, first = _sets(payload)
                    after = linked(np.diff(first), points(values, first), label, side == 0, _verifier(values, first))
                else:
                    sizes, fine = part.column("n").to_numpy(), [np.frombuffer(p, np.uint16) for p in payload.to_pylist()]
                    flat = np.stack([_folded(p, GROUPS).clip(max=FULL) for p in fine]).astype(np.uint16)
                    after = linked(sizes, flat, label, side == 0, _bound(sizes, fine) if max(map(len, fine)) > GROUPS else None)
                least, other = _stars(node, after)
                a.append(least)
                b.append(other)
            none = [np.zeros(0, np.int64)]
            yield pa.record_batch([pa.array(np.concatenate(a or none), pa.int64()), pa.array(np.concatenate(b or none), pa.int64())], names=["a", "b"])

    return run


def forests(members: DataFrame, payload: DataFrame, exact: bool, limit: int) -> DataFrame:
    """Edges (a, b) that connect what is linked within each group of ``members`` (grp, node, weight);
    ``payload``: (node, n, payload). ``limit``: weight of a unit; a set of more is a unit's only one or so."""

    def solved(units: DataFrame) -> DataFrame:
        return (
            units.join(payload, "node").select("unit", "side", "node", "label", "n", "payload").repartition("unit")
            .sortWithinPartitions("unit").mapInArrow(_units(exact), EDGES)
        )

    weighed = members.groupBy("grp").agg(F.count("*").alias("count"), F.sum("weight").alias("total")).where("count > 1")
    sizes = written(weighed.select("grp", "total"), "group-sizes")
    sized = members.join(small(sizes), "grp")
    spread = lambda n, *salt: F.pmod(F.xxhash64("node", *salt), F.ceil(n / F.lit(limit)))
    salts = F.when(F.col("total") > limit, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    first = sized.withColumn("salt", F.explode(salts)).select(
        F.xxhash64("grp", "salt", spread(F.col("total"), "salt")).alias("unit"), F.lit(0).alias("side"), "node", F.col("node").alias("label")
    )
    edges = written(solved(first), "unit-edges")
    large = sizes.where(F.col("total") > limit)
    if large.isEmpty():
        return edges
    known = components(edges)
    whole = members.join(small(large), "grp").join(known, "node", "left")
    whole = written(whole.select("grp", "node", "weight", F.coalesce("component", "node").alias("label")), "large-groups")
    parts = whole.groupBy("grp", "label").agg(F.sum("weight").alias("w")).groupBy("grp").agg(
        F.sum("w").alias("n"), F.max(F.struct("w", "label")).alias("most")
    )
    parts = parts.select("grp", "n", F.col("most.label").alias("main"), (F.col("n") - F.col("most.w")).alias("rest")).where("rest > 0")
    whole = whole.join(small(written(parts, "large-rests")), "grp")
    blocks = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col(n) / F.lit(limit)) - 1))
    asking = whole.where("label != main").select(
        "grp", "node", "label", F.lit(0).alias("side"), spread(F.col("rest")).alias("x"), blocks("n").alias("y")
    )
    asked = whole.select("grp", "node", "label", F.lit(1).alias("side"), blocks("rest").alias("x"), spread(F.col("n")).alias("y"))
    second = asking.unionByName(asked).select(F.xxhash64("grp", "x", "y").alias("unit"), "side", "node", "label")
    # the components of the first round hold; the units of the second only add to them
    return edges.unionByName(solved(second))


SKETCH = "doc_id long, n_shingles long, set_key binary, slot int, counts binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and at the end the counts of the table's buckets."""
    table = np.zeros(1 << TABLE_BITS, np.int32)
    for batch in batches:
        for row, column in slices(batch.column("text"), STEP):
            values, first = shingle_sets(column)
            table += np.bincount((values >> np.uint64(64 - TABLE_BITS)).astype(np.int64), minlength=len(table)).astype(np.int32)
            keys = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(first[:-1], first[1:])]
            none = pa.nulls(len(column))
            yield pa.record_batch(
                [batch.column("doc_id").slice(row, len(column)), pa.array(np.diff(first).astype(np.int64)), pa.array(keys, pa.binary()),
                 none.cast(pa.int32()), none.cast(pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "slot", "counts"],
            )
    parts = table.reshape(64, -1)
    used = [i for i in range(64) if parts[i].any()]
    none = pa.nulls(len(used))
    yield pa.record_batch(
        [none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(used, pa.int32()),
         pa.array([parts[i].astype("<i4").tobytes() for i in used], pa.binary())],
        names=["doc_id", "n_shingles", "set_key", "slot", "counts"],
    )


def _sum_slot(rows: pa.Table) -> pa.Table:
    total = np.zeros((1 << TABLE_BITS) // 64, np.int64)
    for counts in rows.column("counts"):
        total += np.frombuffer(counts.as_buffer(), "<i4")
    # how common, in steps of doubling: all that the order needs
    common = np.ceil(np.log2(total + 1)).astype(np.uint8)
    return pa.table({"slot": rows.column("slot").slice(0, 1), "counts": pa.array([common.tobytes()], pa.binary())})


def _rarity(sketched: DataFrame) -> np.ndarray:
    """A byte for each bucket of the table; 1 MB whatever the corpus."""
    sums = sketched.where("slot IS NOT NULL").select("slot", "counts").groupBy("slot").applyInArrow(_sum_slot, "slot int, counts binary")
    out = np.zeros((64, (1 << TABLE_BITS) // 64), np.uint8)
    for row in sums.toLocalIterator():  # at most 64 rows of 16 KB
        out[row.slot] = np.frombuffer(row.counts, np.uint8)
    return out.ravel()


def prefixes(values: np.ndarray, first: np.ndarray, common: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The rarest shingles of each set, one of which it shares with any set so similar, and their set's
    number. Sets too small to be similar to another one have none."""
    size = np.diff(first)
    need = -(-percent * size // 100)
    # the set most similar to one of n shingles has n + 1
    length = np.where(size * 100 // percent > size, size - need + 1, 0)
    doc = np.repeat(np.arange(len(size)), size)
    order = np.argsort(doc * 64 + common[(values >> np.uint64(64 - TABLE_BITS)).astype(np.int64)], kind="stable")
    keep = np.arange(len(values)) - np.repeat(first[:-1], size) < np.repeat(length, size)
    return values[order][keep], doc[keep]


def _route(common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy()
            for row, column in slices(batch.column("text"), STEP):
                bucket, doc = prefixes(*shingle_sets(column), common.value)
                for low in range(0, len(bucket), 1 << 16):
                    part = slice(low, low + (1 << 16))
                    yield pa.record_batch([pa.array(bucket[part].view(np.int64)), pa.array(node[row + doc[part]])], names=["bucket", "node"])

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of more than one set, named after their members: equal ones have the same name."""
    seen: set[int] = set()
    for rows in _groups(batches, "bucket"):
        bucket, node = rows.column("bucket").to_numpy(), rows.column("node").to_numpy()
        bounds = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        size = np.diff(bounds)
        names = np.add.reduceat(arrowwords.mix(node.view(np.uint64) + np.uint64(1)), bounds[:-1])
        names = arrowwords.mix(names + size.astype(np.uint64)).view(np.int64)
        keep = (size > 1) & (np.unique(names, return_index=True)[1][np.unique(names, return_inverse=True)[1]] == np.arange(len(names)))
        keep &= np.array([n not in seen for n in names.tolist()], bool)
        if len(seen) < 200_000:  # only spares rows: distinct() finds the other repeats
            seen.update(names[keep].tolist())
        pick = np.repeat(keep, size)
        yield pa.record_batch([pa.array(np.repeat(names, size)[pick]), pa.array(node[pick])], names=["grp", "node"])


def _point_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, column in slices(batch.column("text"), STEP):
            values, first = shingle_sets(column)
            found = fine_points(values, first)
            yield pa.record_batch(
                [batch.column("node").slice(row, len(column)), pa.array(np.diff(first).astype(np.int64)), pa.array([p.tobytes() for p in found], pa.binary())],
                names=["node", "n", "payload"],
            )


def components_of(docs: DataFrame, points_of_unit: int = POINTS, shingles_of_unit: int = SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    A set: the distinct 5-word shingles of the lower-cased (A-Z) text, the whole sequence if it has
    fewer words. Sets with 100 * intersection >= 80 * union are linked. Null and empty texts and texts
    without words have no shingles and are linked with nothing; rows of one doc_id are the same document,
    so what links one links the others; a row without doc_id has no component; other columns are
    ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched = written(docs.mapInArrow(_sketch, SKETCH), "set-sketches")
    common = docs.sparkSession.sparkContext.broadcast(_rarity(sketched))
    has_set = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    found = sketched.where("slot IS NULL").select("doc_id", "n_shingles", F.when(has_set, F.col("set_key")).alias("set_key"))
    counted = found.where("set_key IS NOT NULL")
    sets = written(counted.groupBy("set_key").agg(F.min("doc_id").alias("least"), F.first("n_shingles").alias("n")), "distinct-sets")
    nodes = small(sets.select(F.col("least").alias("node")).distinct())
    texts = docs.withColumnRenamed("doc_id", "node").join(nodes, "node")
    routed = texts.select("node", "text").mapInArrow(_route(common), "bucket long, node long")
    ordered = routed.repartition("bucket").sortWithinPartitions("bucket", "node")
    members = written(ordered.mapInArrow(_buckets, "grp long, node long").distinct(), "buckets")
    used = small(written(members.select("node").distinct(), "used"))
    vectors = texts.join(used, "node").select("node", "text").mapInArrow(_point_rows, "node long, n long, payload binary")
    weights = written(sets.groupBy(F.col("least").alias("node")).agg(F.sum("n").alias("weight")), "weights")
    a_point = F.ceil(F.col("weight") / F.lit(PER_GROUP * GROUPS))
    members = members.join(small(weights), "node").withColumn("weight", a_point)
    clusters = written(components(forests(members, written(vectors, "points"), False, points_of_unit)), "set-clusters")
    again = texts.join(small(clusters.select("node")), "node")
    again = again.select("node", F.lit(0).cast("long").alias("n"), F.col("text").alias("payload"))
    clusters = clusters.join(small(weights), "node").select(F.col("component").alias("grp"), "node", "weight")
    links = forests(clusters, again, True, shingles_of_unit)
    # a document of several texts links them
    placed = written(found.join(sets.select("set_key", "least"), "set_key", "left"), "placed")
    several = placed.where("least IS NOT NULL").groupBy("doc_id").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("a < b")
    linked_sets = components(links.unionByName(several.select("a", "b")))
    out = placed.join(linked_sets.withColumnRenamed("node", "least"), "least", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "least", "doc_id").alias("component_id"))
