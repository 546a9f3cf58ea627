"""Token files as directly addressable codes (DACs).

An id is cut into 8-bit chunks, low chunk first. Level 0 holds the first chunk of every id,
level 1 the second chunk of the ids that have one, and so on; a bitmap per level marks the ids
that go on, and a directory holds the number of marks before each 64-bit word. The chunk of id i
on the next level is at rank(i), so any token is read by one look-up per level and nothing else is
decoded. A file image holds about SEGMENT tokens of whole documents with their directory.

Images are rows of a Parquet table, so they can be written to any store Spark writes to and only
images of committed tasks are seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.llm import tokens

SEGMENT = 1 << 20  # tokens after which an image is closed at the next document's end
MAGIC = 0x31434144  # "DAC1"

IMAGES = "shard int, segment int, start_in_shard long, n_tokens long, image binary"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def encode(ids: np.ndarray, doc_ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A file image. Layout, little-endian 64-bit words: magic, number of documents, of tokens and
    of levels; document ids, their validity and token counts; then per level its length, chunks,
    bitmap and directory. Each part starts at a multiple of 8 bytes."""
    out, rest, levels = [], ids.astype(np.uint64), []
    while True:
        chunk, rest = (rest & 0xFF).astype(np.uint8), rest >> 8
        more = rest > 0
        marks = np.packbits(np.pad(more, (0, -len(more) % 64)), bitorder="little").view(np.uint64)
        before = np.cumsum(np.bitwise_count(marks), dtype=np.uint64) - np.bitwise_count(marks)
        levels.append((chunk, marks, before.astype(np.uint32)))
        rest = rest[more]
        if not len(rest):
            break
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], np.int64)
    parts = [np.array([MAGIC, len(counts), len(ids), len(levels)], np.int64), known, valid, counts.astype(np.int64)]
    for chunk, marks, before in levels:
        parts += [np.array([len(chunk)], np.int64), chunk, marks, before]
    for part in parts:
        raw = part.tobytes()
        out += [raw, b"\0" * (-len(raw) % 8)]
    return b"".join(out)


class Reader:
    """Random access to an image."""

    def __init__(self, image: bytes):
        self._image, self._at = image, 0
        magic, docs, self.n_tokens, levels = self._take(np.int64, 4).tolist()
        if magic != MAGIC:
            raise ValueError("not a DAC image")
        ids = self._take(np.int64, docs).tolist()
        valid = self._take(np.uint8, docs).tolist()
        self.doc_ids = [i if v else None for i, v in zip(ids, valid)]
        self.counts = self._take(np.int64, docs)
        self.starts = np.cumsum(self.counts) - self.counts
        self.levels = []
        for _ in range(levels):
            n = int(self._take(np.int64, 1)[0])
            words = -(-n // 64)
            self.levels.append((self._take(np.uint8, n), self._take(np.uint64, words), self._take(np.uint32, words)))

    def _take(self, kind, n: int) -> np.ndarray:
        found = np.frombuffer(self._image, kind, n, self._at)
        self._at += -(-found.nbytes // 8) * 8
        return found

    def get(self, at: np.ndarray) -> np.ndarray:
        """The ids at these positions of the image."""
        at = np.asarray(at, np.int64)
        out, rows = np.zeros(len(at), np.uint32), slice(None)
        for depth, (chunk, marks, before) in enumerate(self.levels):
            out[rows] |= chunk[at].astype(np.uint32) << np.uint32(8 * depth)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            goes_on = (marks[word] >> bit & np.uint64(1)).astype(bool)
            word, bit = word[goes_on], bit[goes_on]
            below = marks[word] & ((np.uint64(1) << bit) - np.uint64(1))
            at = before[word].astype(np.int64) + np.bitwise_count(below)
            rows = np.arange(len(out))[rows][goes_on]
        return out

    def document(self, k: int) -> np.ndarray:
        return self.get(np.arange(self.starts[k], self.starts[k] + self.counts[k]))


def _images(path: str, spaces: bool, segment: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number, written = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, list, np.ndarray]] = []

        def close():
            nonlocal number, written
            ids, counts = (np.concatenate([h[i] for h in held]) for i in (0, 2))
            image = encode(ids, [d for h in held for d in h[1]], counts)
            row = [[shard], [number], [written], [len(ids)], [image]]
            held.clear()
            number, written = number + 1, written + len(ids)
            return pa.record_batch(
                [pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))],
                names=["shard", "segment", "start_in_shard", "n_tokens", "image"],
            )

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, ids, counts in tokens.encode_column(batch.column("text"), path, spaces):
                held.append((ids, doc_ids[first : first + len(counts)], counts))
                if sum(len(h[0]) for h in held) >= segment:
                    yield close()
        if held:
            yield close()

    return write


def write_images(docs: DataFrame, path: str, spaces: bool = True, segment: int = SEGMENT) -> DataFrame:
    """Images of ``docs`` (doc_id, text) in ascending doc_id order: range partitions in order, a
    shard each, sorted within. Columns of IMAGES.

    A null text is empty; a null doc_id sorts first and stays null; rows with the same id are all
    written, ordered by text; other columns are ignored; an empty table has no image.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(_images(path, spaces, segment), IMAGES)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, image in zip(batch.column("base").to_pylist(), batch.column("image")):
            reader = Reader(image.as_py())
            yield pa.record_batch(
                [
                    pa.array(reader.doc_ids, pa.int64()),
                    pa.array(reader.starts + base, pa.int64()),
                    pa.array(reader.counts, pa.int64()),
                    pa.array([reader.document(k).astype("<u4").tobytes() for k in range(len(reader.counts))], pa.binary()),
                ],
                names=["doc_id", "start", "n_tokens", "ids"],
            )


def read_images(images: DataFrame) -> DataFrame:
    """Every document of written images, by random access: columns of DOCUMENTS. ``start`` counts
    the ids of all documents before; the shards' totals (a row per shard, at most the number of
    partitions) are summed up and broadcast."""
    spark = images.sparkSession
    # a row per written partition: bounded by the number of partitions, whatever the data
    totals = images.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()
    bases, before = [], 0
    for row in totals:
        bases.append((row.shard, before))
        before += row.n
    bases = spark.createDataFrame(bases, "shard int, shard_base long")
    based = images.join(F.broadcast(bases), "shard").select(
        (F.col("shard_base") + F.col("start_in_shard")).alias("base"), "image"
    )
    return based.mapInArrow(_read, DOCUMENTS)
