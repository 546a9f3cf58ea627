"""Packing by lexical retrieval: documents that share rare terms go into the same sequence.

The table is cut into shards, runs of documents of SHARD tokens within a partition, and each shard
gets a BM25 inverted index over its token ids. The first unused document is the seed of a sequence;
the index returns the unused documents of the shard that score best for it, and they fill the
sequence greedily. A document that does not fit is cut, and its rest is the next seed, so all
sequences but a shard's last are full. That last one is cut at powers of two, which need no padding.

No shuffle is needed: a shard is a bounded run of rows of one partition, whatever their keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.llm import tokens

WINDOW = 4096
SHARD = 1 << 22  # tokens after which a shard is closed
K1, B = 1.2, 0.75

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class Index:
    """BM25 postings of a shard. A term in more than half of the documents has no weight."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray):
        n = len(counts)
        key = np.repeat(np.arange(n, dtype=np.int64) << 32, counts)
        key |= ids
        key.sort()
        at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        tf = np.diff(np.append(at, len(key))).astype(np.float32)
        key = key[at]
        doc, term = (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.uint32)
        del key, at
        df = np.bincount(term)  # by id: at most as long as the vocabulary
        self.n = n
        idf = np.log((n - df + 0.5) / (df + 0.5)).clip(0).astype(np.float32)
        norm = (K1 * (1 - B + B * counts / max(counts.mean(), 1))).astype(np.float32)
        weight = idf[term] * tf * np.float32(K1 + 1) / (tf + norm[doc])
        keep = weight > 0
        doc, term, weight = doc[keep], term[keep], weight[keep]
        self.doc_from = np.searchsorted(doc, np.arange(n + 1))
        self.doc_terms = term
        # a stable sort of short integers takes time in proportion
        order = np.argsort(term.astype(np.uint16) if len(df) <= 1 << 16 else term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.term_from = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(df)))])

    def scores(self, seed: int) -> np.ndarray:
        query = self.doc_terms[self.doc_from[seed] : self.doc_from[seed + 1]]
        first, size = self.term_from[query], self.term_from[query + 1] - self.term_from[query]
        ends = np.cumsum(size)
        at = np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.docs[at], self.weights[at], self.n)


def pack_shard(ids: np.ndarray, counts: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard's documents."""
    index, pieces = Index(ids, counts), []
    unused = np.ones(index.n, bool)
    sequence, filled, first, seed = 0, 0, 0, -1

    def place(doc: int) -> None:
        nonlocal sequence, filled, seed
        unused[doc] = False
        start = 0
        while start < counts[doc]:
            length = min(int(counts[doc]) - start, window - filled)
            if filled == 0:
                seed = doc
            pieces.append((doc, start, length, sequence, filled))
            start, filled = start + length, filled + length
            if filled == window:
                sequence, filled = sequence + 1, 0

    while True:
        while first < index.n and not unused[first]:
            first += 1
        if first == index.n:
            break
        if not filled:
            place(first)
            continue
        scores = np.where(unused, index.scores(seed), -1.0)
        at = sequence
        while sequence == at:
            best = int(scores.argmax())
            if scores[best] <= 0:  # nothing left that shares a term: take the next in order
                best = next((d for d in range(first, index.n) if unused[d]), -1)
                if best < 0:
                    break
            place(best)
            scores[best] = -1
    if filled:
        pieces = _halved(pieces, sequence, filled)
    return pieces


def _halved(pieces: list, sequence: int, filled: int) -> list:
    """Cut the last sequence, of ``filled`` ids, into sequences with a power of two each."""
    bounds, at = [], 0
    while at < filled:
        size = 1 << ((filled - at).bit_length() - 1)
        bounds.append((at, at + size))
        at += size
    out = [p for p in pieces if p[3] != sequence]
    for doc, start, length, _, offset in (p for p in pieces if p[3] == sequence):
        for i, (low, high) in enumerate(bounds):
            a, b = max(low, offset), min(high, offset + length)
            if a < b:
                out.append((doc, start + a - offset, b - a, sequence + i, a - low))
    return out


def _packer(path: str, spaces: bool, window: int, shard: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        held: list[tuple[np.ndarray, np.ndarray, list]] = []

        def close():
            nonlocal base
            ids, counts = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            doc_ids = [d for h in held for d in h[2]]
            held.clear()
            ids = ids.astype("<u4")
            begin = np.cumsum(counts) - counts
            pieces = pack_shard(ids, counts, window)
            for low in range(0, len(pieces), 2048):
                some = pieces[low : low + 2048]
                doc, start, length, sequence, offset = map(list, zip(*some))
                columns = [
                    pa.array([doc_ids[d] for d in doc], pa.int64()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array([ids[begin[d] + s : begin[d] + s + n].tobytes() for d, s, n in zip(doc, start, length)], pa.binary()),
                    pa.array(counts[doc], pa.int64()),
                    pa.array([base + s for s in sequence], pa.int64()),
                    pa.array(offset, pa.int64()),
                ]
                yield pa.record_batch(columns, names=[c.split()[0] for c in PIECES.split(", ")])
            base += pieces[-1][3] + 1

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, ids, counts in tokens.encode_column(batch.column("text"), path, spaces):
                held.append((ids, counts, doc_ids[first : first + len(counts)]))
                if sum(len(h[0]) for h in held) >= shard:
                    yield from close()
        if held:
            yield from close()

    return write


def pack(docs: DataFrame, path: str, spaces: bool = False, window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) in sequences of at most ``window`` ids. Columns of PIECES:
    ``ids`` are the piece's ids as little-endian unsigned 32-bit integers.

    A null text is empty: its end id is a piece of its own. Null and repeated doc_ids are kept, each
    row is packed for itself. Equal scores: the earlier row first. Other columns are ignored; an
    empty table has no pieces. A document longer than a shard makes a shard of its own size.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(_packer(path, spaces, window, shard), PIECES)
