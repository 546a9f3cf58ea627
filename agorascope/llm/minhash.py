"""MinHash near-duplicates with an LSH forest.

Each distinct shingle set has a signature of LANES minimum hashes. A tree of the forest is an order
of the signatures by some sequence of lanes; sets that share their first lanes there form a region.
A region has MIN_DEPTH lanes, which a pair of similarity 0.75 misses in all TREES trees with a
probability of 5e-5, whatever the region's size. Within a region the sets are sorted, neighbours with
the longest common prefix are compared first, and then only sets that are not yet connected. Connected
means an estimated similarity of at least ESTIMATE, over four standard deviations below the threshold,
so a region yields a spanning forest, never all its pairs.

No task holds more than some REGION sets. A region of more is first connected as far as deeper prefixes
and salted blocks of the deepest go, which settles large groups of variants. What is then outside the
region's largest component is compared with all of the region that is in another component, in pairs of
blocks. So no pair of a region is left out; the cost is the product of the region and its remainder.

Sets so connected form clusters; all links lie within a cluster. Each cluster's full sets are then
compared exactly by an inverted list, once, in blocks of at most BLOCK sets and every pair of
blocks if it is larger. The links found are again spanning forests; components of these are the
result. Exact copies of a set are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.llm import arrowwords
from agorascope.llm.components import components
from agorascope.llm.store import small, written

SHINGLE = 5
PERCENT = 75
LANES = 64
TREES = 12
MIN_DEPTH, MAX_DEPTH = 2, 8
REGION = 1 << 16
ESTIMATE = 0.5
BLOCK = 2048
STEP = 4_000_000  # bytes of text handled together

_multipliers = np.random.default_rng(7).integers(1, 1 << 62, LANES).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and where each text's begin: of its
    ``size``-word shingles, or of the whole word sequence if it is shorter."""
    found = arrowwords.words(column, fold=True)
    n, count = len(column), np.diff(found.first)
    shingles = np.maximum(count - size + 1, 0)
    doc = np.repeat(np.arange(n), shingles)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + np.repeat(found.first[:-1], shingles)
    values = arrowwords.grams(found.hashes, size)[at] if len(at) else np.zeros(0, np.uint64)
    few = np.flatnonzero((count > 0) & (count < size))
    if len(few):
        whole = [int(arrowwords.grams(found.hashes[found.first[i] : found.first[i + 1]], int(count[i]))[0]) for i in few]
        values = np.concatenate([values, arrowwords.mix(np.array(whole, np.uint64) + count[few].astype(np.uint64))])
        doc = np.concatenate([doc, few])
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (values[1:] != values[:-1]) | (doc[1:] != doc[:-1])
    values, doc = values[new], doc[new]
    return values, np.searchsorted(doc, np.arange(n + 1))


def slices(column: pa.Array, step: int = STEP) -> Iterator[tuple[int, pa.Array]]:
    """Runs of rows of about ``step`` bytes, with the first row's number."""
    if not len(column):
        return
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1)
        stop = min(stop, len(column))
        yield row, column.slice(row, stop - row)
        row = stop


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """LANES minimum hashes of each non-empty set; zeros for empty ones."""
    out = np.zeros((len(first) - 1, LANES), np.uint32)
    filled = np.flatnonzero(np.diff(first) > 0)
    if len(filled):
        folded = values ^ (values >> np.uint64(31))
        for lane, by in enumerate(_multipliers):
            out[filled, lane] = np.minimum.reduceat((folded * by) >> np.uint64(32), first[filled])
    return out


SKETCH = "doc_id long, n_shingles long, set_key binary, signature binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, column in slices(batch.column("text")):
            values, first = shingle_sets(column)
            signed = signatures(values, first)
            keys = [xxhash.xxh3_128_digest(values[a:b].tobytes()) for a, b in zip(first[:-1], first[1:])]
            yield pa.record_batch(
                [
                    batch.column("doc_id").slice(row, len(column)),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(keys, pa.binary()),
                    pa.array([s.tobytes() for s in signed], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "set_key", "signature"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(_sketch, SKETCH)


def _roots(n: int):
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(x: int, y: int) -> None:
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)

    return root, join


def connect(signed: np.ndarray, estimate: float = ESTIMATE) -> np.ndarray:
    """A label for each member of a sorted region: connected members have the same one."""
    n, need = len(signed), int(np.ceil(estimate * signed.shape[1]))
    root, join = _roots(n)
    near = (signed[1:] == signed[:-1]).sum(1) >= need
    for i in np.flatnonzero(near):
        join(int(i), int(i) + 1)
    labels = np.array([root(i) for i in range(n)])
    # breadth first over what is left: a member is compared only with those outside its component
    open_ = np.ones(n, bool)
    for start in range(n):
        if not open_[start]:
            continue
        group = np.flatnonzero(open_ & (labels == labels[start]))
        open_[group] = False
        work = list(group)
        while work and open_.any():
            rest = np.flatnonzero(open_)
            hit = rest[(signed[rest] == signed[work.pop()]).sum(1) >= need]
            if len(hit):
                more = np.flatnonzero(open_ & np.isin(labels, labels[hit]))
                labels[more] = labels[start]
                open_[more] = False
                work += list(more)
    return labels


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Runs of whole groups of a stream sorted by ``key``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[-1]
        if held and held[-1].column(key)[-1] == last:  # the whole batch may go on with the open group
            if keys[0] == last:
                held.append(batch)
                continue
        cut_at = batch.num_rows
        values = keys.to_numpy(zero_copy_only=False)
        cut_at = int(np.flatnonzero(values != values[-1])[-1]) + 1 if (values != values[-1]).any() else 0
        if cut_at:
            yield pa.Table.from_batches([*held, batch.slice(0, cut_at)])
            held = []
        elif held:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut_at))
    if held:
        yield pa.Table.from_batches(held)


EDGES = "a long, b long"


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    b = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _stars(nodes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from the least node of each label to its other nodes."""
    order = np.lexsort((nodes, labels))
    nodes, labels = nodes[order], labels[order]
    new = np.ones(len(nodes), bool)
    new[1:] = labels[1:] != labels[:-1]
    least = nodes[np.flatnonzero(new)][np.cumsum(new) - 1]
    other = least != nodes
    return least[other], nodes[other]


def _connect_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches, "region"):
        region = rows.column("region").to_numpy()
        node = rows.column("node").to_numpy()
        signed = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(len(node), LANES)
        bounds = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1], [True]]))
        first, size = bounds[:-1], np.diff(bounds)
        pairs = first[size == 2]
        near = (signed[pairs] == signed[pairs + 1]).sum(1) >= ESTIMATE * LANES
        found = [(node[pairs[near]], node[pairs[near] + 1])]
        for low, n in zip(first[size > 2], size[size > 2]):
            found.append(_stars(node[low : low + n], connect(signed[low : low + n])))
        yield _edges(found)


def _connect_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components: of sets of side 0 with sets of side 1 of the same part."""
    need = int(np.ceil(ESTIMATE * LANES))
    for rows in _groups(batches, "part"):
        part = rows.column("part").to_numpy()
        node, side = rows.column("node").to_numpy(), rows.column("side").to_numpy()
        signed = np.frombuffer(b"".join(rows.column("signature").to_pylist()), np.uint32).reshape(len(node), LANES)
        _, label = np.unique(rows.column("component").to_numpy(), return_inverse=True)
        bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        found = []
        for low, high in zip(bounds[:-1], bounds[1:]):
            own = label[low:high].copy()
            split = int((side[low:high] == 0).sum())
            sets, other = signed[low:high], own[split:]
            for i in range(split):
                rest = np.flatnonzero(other != own[i])
                hit = split + rest[(sets[split:][rest] == sets[i]).sum(1) >= need]
                if len(hit):
                    joined, one = np.unique(own[hit], return_index=True)
                    b = node[low + hit[one]]
                    found.append((np.full(len(b), node[low + i]), b))
                    own[np.isin(own, joined)] = own[i]
        yield _edges(found)


def _rest_edges(nodes: DataFrame, large: DataFrame, edges: DataFrame, region: int) -> DataFrame:
    """What ``edges`` leave unconnected in the regions ``large`` (region, node), each over ``region`` sets."""
    known = components(edges)
    members = large.join(known, "node", "left").select("region", "node", F.coalesce("component", "node").alias("component"))
    members = written(members, "region-members")
    sizes = members.groupBy("region", "component").count().groupBy("region").agg(
        F.sum("count").alias("n"), F.max(F.struct("count", "component")).alias("most")
    )
    blocks = lambda n: F.ceil(n / F.lit(region))
    sizes = sizes.where(F.col("n") > F.col("most.count")).select(
        "region",
        F.col("most.component").alias("main"),
        blocks(F.col("n")).alias("blocks"),
        blocks(F.col("n") - F.col("most.count")).alias("rest_blocks"),
    )
    members = members.join(small(written(sizes, "large-regions")), "region")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    rest = members.where("component != main").select(
        "node", "component", "region", dealt("rest_blocks").alias("x"), upto("blocks").alias("y"), F.lit(0).alias("side")
    )
    whole = members.select(
        "node", "component", "region", upto("rest_blocks").alias("x"), dealt("blocks").alias("y"), F.lit(1).alias("side")
    )
    parts = rest.unionByName(whole).select("node", "component", F.xxhash64("region", "x", "y").alias("part"), "side")
    return (
        parts.join(nodes, "node")
        .repartition("part")
        .sortWithinPartitions("part", "side", "node")
        .select("part", "side", "node", "component", "signature")
        .mapInArrow(_connect_parts, EDGES)
    )


def forest_edges(nodes: DataFrame, region: int = REGION) -> DataFrame:
    """Spanning forests of all regions of ``nodes`` (node, signature)."""
    lane = lambda i: F.substring("signature", i % LANES * 4 + 1, 4)
    prefix = lambda t, depth: F.xxhash64(F.lit(t), *[lane(MIN_DEPTH * t + i) for i in range(depth)])
    trees = F.array(*[F.struct(F.lit(t).alias("tree"), prefix(t, MIN_DEPTH).alias("region")) for t in range(TREES)])
    left = nodes.select("node", F.explode(trees).alias("t")).select("node", "t.tree", "t.region")
    done = whole = None
    for depth in range(MIN_DEPTH, MAX_DEPTH + 1):
        sizes = left.groupBy("region").count().where("count > 1")
        sizes = written(sizes, "regions")
        large = sizes.where(F.col("count") > region)
        placed = left.join(sizes.where(F.col("count") <= region), "region").select("node", "tree", "region")
        done = placed if done is None else done.unionByName(placed)
        if large.isEmpty():
            break
        if whole is None:
            whole = written(left.join(large, "region", "left_semi").select("region", "node"), "large-members")
        if depth == MAX_DEPTH:
            # each tree deals its blocks anew, so the blocks of a large group meet in other trees
            block = F.pmod(F.xxhash64("node", "tree"), F.ceil(F.col("count") / region))
            dealt = left.join(large, "region").select("node", "tree", F.xxhash64("region", block).alias("region"))
            done = done.unionByName(dealt)
            break
        deeper = F.element_at(
            F.array(*[prefix(t, depth + 1) for t in range(TREES)]), F.col("tree") + 1
        )
        left = left.join(large, "region", "left_semi").join(nodes, "node").select("node", "tree", deeper.alias("region"))
    signed = done.select("region", "node").join(nodes, "node")
    edges = (
        signed.repartition("region")
        .sortWithinPartitions("region", "signature", "node")
        .select("region", "node", "signature")
        .mapInArrow(_connect_regions, EDGES)
    )
    if whole is None:
        return edges
    edges = written(edges, "region-edges")
    return edges.unionByName(_rest_edges(nodes, whole, edges, region))


def exact_links(values: np.ndarray, first: np.ndarray, split: int = 0, percent: int = PERCENT) -> np.ndarray:
    """Labels of sets linked by exact similarity. ``split``: only links between the sets before and
    after this number count; 0 for all."""
    n, size = len(first) - 1, np.diff(first)
    doc = np.repeat(np.arange(n), size)
    _, term = np.unique(values, return_inverse=True)
    order = np.argsort(term, kind="stable")
    docs = doc[order]
    begin = np.searchsorted(term[order], np.arange(int(term.max()) + 2))
    root, join = _roots(n)
    for i in range(split or n):
        terms = term[first[i] : first[i + 1]]
        low, count = begin[terms], begin[terms + 1] - begin[terms]
        ends = np.cumsum(count)
        at = np.repeat(low - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
        common = np.bincount(docs[at], minlength=n)
        hit = 100 * common >= percent * (size + size[i] - common)
        hit[: max(split, i + 1)] = False
        for j in np.flatnonzero(hit).tolist():
            join(i, j)
    return np.array([root(i) for i in range(n)])


def _link_clusters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches, "part"):
        part = rows.column("part").to_numpy()
        node = rows.column("node").to_numpy()
        side = rows.column("side").to_numpy()
        text = rows.column("text").combine_chunks()
        bounds = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        found = []
        for low, high in zip(bounds[:-1], bounds[1:]):
            values, first = shingle_sets(text.slice(low, high - low))
            sides = side[low:high]
            split = int((sides == 0).sum()) if sides.any() else 0
            if split < high - low:
                found.append(_stars(node[low:high], exact_links(values, first, split)))
        yield _edges(found)


def verified_edges(docs: DataFrame, clusters: DataFrame, block: int = BLOCK) -> DataFrame:
    """Exact links within clusters (node, component), as spanning forests of each pair of blocks."""
    sizes = clusters.groupBy("component").count().select("component", F.ceil(F.col("count") / block).alias("blocks"))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), "blocks")).otherwise(F.lit(0).cast("long"))
    parts = clusters.join(sizes, "component").withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    parts = parts.select("node", "component", "own", other).select(
        "node",
        F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("part"),
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    parts = small(written(parts, "cluster-parts"))
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text"))
    return (
        texts.join(parts, "node")
        .repartition("part")
        .sortWithinPartitions("part", "side", "node")
        .select("part", "side", "node", "text")
        .mapInArrow(_link_clusters, EDGES)
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Null or empty texts and texts without words have no shingles and stand alone; rows with the same
    doc_id are the same document, so what links one links the other; a row without doc_id stands
    alone and is kept; other columns are ignored; an empty table gives no rows.
    """
    sketched = written(sketches(docs), "sketches")
    counted = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sets = written(
        counted.groupBy("set_key").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")), "sets"
    )
    clusters = written(components(forest_edges(sets.select("node", "signature"))), "clusters")
    linked = components(verified_edges(docs, clusters))
    of_set = sets.select("set_key", "node").join(linked, "node", "left").select(
        "set_key", F.coalesce("component", "node").alias("component_id")
    )
    out = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    out = out.join(of_set, "set_key", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select(
        "doc_id",
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that near_duplicates does not keep; same columns, whatever their names."""
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("gone")).distinct()
    gone = small(written(gone, "near-duplicates"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
