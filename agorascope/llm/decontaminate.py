"""Benchmark passages in documents, up to a share of edited words.

The CGK embedding reads a window with a pointer that moves on or stays by a random bit of the
word read; the words read in 2L steps are the embedding, and windows at a small edit distance have
embeddings at a small Hamming distance. Bit-sampling LSH on it: a key is made of the words at BITS
random steps; SAMPLES keys from each of WALKS walks make it likely that one key of two near windows
agrees. Windows are sized by the items: items of [c, 2c) words share windows of L = 5c/8 words (short items: c - s + 1).
Documents are cut into windows only every s words, as the items are cut at every word, so one
alignment always falls on a document window; s is a quarter of c.

Every agreement of keys is a candidate, and the item is then aligned with the words around it
exactly (edit distance of the item to any run of words). Items are a stated query set: they are
indexed in blocks of at most ITEMS, each broadcast to the tasks that read the documents; nothing is
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.llm import arrowwords
from agorascope.llm.minhash import slices

EDITS_PERCENT = 10  # edited words, of the item's words, rounded down
WALKS, SAMPLES, BITS = 2, 10, 5
ITEMS = 4096  # items per block; an index has about 1 KB per word of them

_KEY = np.uint64(0x9FB21C651E98DF25)


@dataclass
class Family:
    """Items whose lengths are in [low, 2 low)."""

    low: int
    stride: int
    length: int  # words of a window
    steps: np.ndarray  # (WALKS, SAMPLES, BITS) sampled steps
    keys: np.ndarray | None = None  # sorted
    items: np.ndarray | None = None
    offsets: np.ndarray | None = None
    marks: np.ndarray | None = None  # which leading bits of a key occur


def _family(low: int) -> Family:
    stride = max(1, low // 4)
    length = low - stride + 1 if low < 8 else low * 5 // 8
    random = np.random.default_rng(low)
    steps = random.integers(0, 2 * length, (WALKS, SAMPLES, BITS))
    steps.sort(axis=2)
    return Family(low, stride, length, steps)


def _window_keys(family: Family, hashes: np.ndarray, begin: np.ndarray) -> Iterator[np.ndarray]:
    """Keys of the windows that begin at these words, one array per walk and sample."""
    for walk in range(WALKS):
        steps = family.steps[walk]
        keys = [np.full(len(begin), sample + 1, np.uint64) for sample in range(SAMPLES)]
        at, end = begin.copy(), begin + family.length
        for step in range(int(steps.max()) + 1):
            if step % 64 == 0:
                bits = arrowwords.mix(hashes + np.uint64((1 + walk + WALKS * (step // 64)) * int(_KEY) % (1 << 64)))
                bits = np.append(bits, np.uint64(0))
                words = np.append(hashes, np.uint64(0))
            inside = at < end
            place = np.where(inside, at, len(hashes))  # past the window there is one blank
            for sample, times in zip(*np.unique(np.nonzero(steps == step)[0], return_counts=True)):
                for _ in range(int(times)):
                    keys[sample] = (keys[sample] ^ words[place]) * _KEY
            at += (bits[place] >> np.uint64(step % 64) & np.uint64(1)).astype(at.dtype)
        for sample, key in enumerate(keys):
            yield arrowwords.mix(key + np.uint64(walk * SAMPLES + sample))


class Index:
    """LSH index over items: lists of word hashes."""

    def __init__(self, items: list[np.ndarray]):
        self.items = items
        self.words = [set(i.tolist()) for i in items]
        lengths = sorted({len(i) for i in items if len(i)})
        self.families: list[Family] = []
        while lengths:
            family = _family(lengths[0])
            lengths = [n for n in lengths if n >= 2 * family.low]
            keys, owners, offsets = [], [], []
            for number, words in enumerate(items):
                if family.low <= len(words) < 2 * family.low:
                    begin = np.arange(len(words) - family.length + 1)
                    for key in _window_keys(family, words, begin):
                        keys.append(key)
                        owners.append(np.full(len(begin), number))
                        offsets.append(begin)
            key = np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            family.keys = key[order]
            family.items = np.concatenate(owners)[order].astype(np.int32)
            family.offsets = np.concatenate(offsets)[order].astype(np.int32)
            family.marks = np.zeros(1 << 22, bool)
            family.marks[(family.keys >> np.uint64(42)).astype(np.int64)] = True
            self.families.append(family)

    def candidates(self, hashes: np.ndarray, first: np.ndarray, step: int = 1 << 15) -> np.ndarray:
        """Distinct (text, item, assumed first word of the item) rows for texts with words
        first[i] to first[i + 1]."""
        found = []
        for family in self.families:
            fit = np.maximum(np.diff(first) - family.length, -1) // family.stride + 1
            text = np.repeat(np.arange(len(fit)), fit)
            number = np.arange(len(text)) - np.repeat(np.cumsum(fit) - fit, fit)
            begin = first[:-1][text] + number * family.stride
            for low in range(0, len(begin), step):
                part = begin[low : low + step]
                if not len(part):
                    continue
                lo, hi = int(part[0]), int(part[-1]) + family.length
                for key in _window_keys(family, hashes[lo:hi], part - lo):
                    some = np.flatnonzero(family.marks[(key >> np.uint64(42)).astype(np.int64)])
                    left = np.searchsorted(family.keys, key[some], "left")
                    count = np.searchsorted(family.keys, key[some], "right") - left
                    ends = np.cumsum(count)
                    entry = np.repeat(left - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)
                    window = np.repeat(some, count)
                    found.append(
                        np.stack([text[low + window], family.items[entry], part[window] - family.offsets[entry]], axis=1)
                    )
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """(distance, begin, end) of the run of ``words`` nearest to ``item``; the first of equals."""
    n = len(words)
    column = np.arange(n + 1)
    distance, begin = np.zeros(n + 1, np.int64), column.copy()
    scale = n + 2  # distance first, then the later begin: one number orders both
    cost = distance * scale + (n - begin)
    for word in item:
        moved = cost + scale
        moved[1:] = np.minimum(moved[1:], cost[:-1] + scale * (words != word))
        cost = np.minimum.accumulate(moved - column * scale) + column * scale
    end = int(np.argmin(cost // scale))
    return int(cost[end] // scale), int(n - cost[end] % scale), end


def matches(index: Index, column: pa.Array, edits_percent: int = EDITS_PERCENT) -> list[tuple[int, int, int, int, int]]:
    """(row, item, first word, end word, distance) of every item found in a text, at its best place."""
    found = arrowwords.words(column, fold=True)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    for text, number, begin in index.candidates(found.hashes, found.first).tolist():
        item, key = index.items[number], (text, number)
        low, high = int(found.first[text]), int(found.first[text + 1])
        if best.get(key, (1,))[0] == 0:
            continue
        most = len(item) * edits_percent // 100
        if begin >= low and begin + len(item) <= high and np.array_equal(found.hashes[begin : begin + len(item)], item):
            result = 0, begin - low, begin - low + len(item)
        elif not most:
            continue
        else:
            start, stop = max(low, begin - 2 * most - 1), min(high, begin + len(item) + 2 * most + 1)
            # an edit takes away one of the item's different words at most
            if len(index.words[number].intersection(found.hashes[start:stop].tolist())) < len(index.words[number]) - most:
                continue
            distance, a, b = align(item, found.hashes[start:stop])
            if distance > most:
                continue
            result = distance, a + start - low, b + start - low
        best[key] = min(best.get(key, result), result)
    return [(*key, a, b, d) for key, (d, a, b) in sorted(best.items())]


def index_blocks(benchmark: DataFrame, items: int = ITEMS) -> Iterator[tuple[Index, list]]:
    """An index and the item_ids for each block of ``benchmark`` (item_id, text)."""
    chosen = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    blocks = -(-chosen.count() // items)
    for block in range(blocks):
        part = chosen.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else chosen
        rows = sorted(part.collect(), key=lambda r: (r.item_id is None, r.item_id or 0, r.text))  # about ``items`` rows
        found = arrowwords.words(pa.array([r.text for r in rows], pa.large_string()), fold=True)
        words = [found.hashes[a:b] for a, b in zip(found.first[:-1], found.first[1:])]
        yield Index(words), [r.item_id for r in rows]


MATCHES = "doc_id long, item_id long, first_word long, end_word long, distance long"


def contaminated(docs: DataFrame, benchmark: DataFrame, edits_percent: int = EDITS_PERCENT) -> DataFrame:
    """Every pair of a document and an item found in it, at the best place: columns of MATCHES.

    Null and empty texts and items match nothing; rows with the same id are searched one by one;
    null ids stay null; of equally good places the first is given; other columns are ignored.
    """
    spark = docs.sparkSession
    out = spark.createDataFrame([], MATCHES)
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for index, item_ids in index_blocks(benchmark):
        shared = spark.sparkContext.broadcast((index, item_ids))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index, item_ids = shared.value
            for batch in batches:
                doc_ids = batch.column("doc_id")
                for row, column in slices(batch.column("text")):
                    found = matches(index, column, edits_percent)
                    yield pa.record_batch(
                        [
                            doc_ids.take(pa.array([row + f[0] for f in found], pa.int64())),
                            pa.array([item_ids[f[1]] for f in found], pa.int64()),
                            *(pa.array([f[i] for f in found], pa.int64()) for i in (2, 3, 4)),
                        ],
                        names=["doc_id", "item_id", "first_word", "end_word", "distance"],
                    )

        out = out.unionByName(chosen.mapInArrow(search, MATCHES))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, edits_percent: int = EDITS_PERCENT) -> DataFrame:
    """``docs`` without the rows in whose text an item is found; same columns, whatever their names."""
    spark, names = docs.sparkSession, docs.columns
    # Arrow functions resolve columns by name; plain ones cannot be misread
    docs = docs.toDF(*[f"c{i}" for i in range(len(names))])
    text = f"c{[n.lower() for n in names].index('text')}"
    for index, _ in index_blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = np.ones(batch.num_rows, bool)
                for row, column in slices(batch.column(text)):
                    good[[row + f[0] for f in matches(shared.value, column, edits_percent)]] = False
                yield batch.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs.toDF(*names)
