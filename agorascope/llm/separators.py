"""Token counts of flat, unindexed token files: a scan for end-of-document ids.

A flat file is one run of fixed-width ids; nothing says where a document starts. It is kept as
blocks of raw bytes (rows of a Parquet table: file, block, data), cut at a fixed number of ids
whatever the documents, so a document may lie in many blocks and a block may hold none of its ends.

Each block is searched alone, with one vector comparison. A prefix scan over the blocks'
summaries (a row per block) then gives every block the number of documents that ended before it
and the place where its first document began, which stitches documents across blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agorascope.llm import tokens

BLOCK = 1 << 18  # ids in a block
FLAT = "file long, block long, data binary, doc_ids array<long>"
ENDS = "file long, block long, n_ids long, k int, at long, previous long"


def _flat(path: str, spaces: bool, end: int, width: int, block: int):
    kind = f"<u{width}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, number, documents = TaskContext.get().partitionId(), 0, 0
        rest = np.zeros(0, kind)

        def rows(first: int, blocks: list[bytes | None], doc_ids: list[list | None]):
            numbers = range(first, first + len(blocks))
            return pa.record_batch(
                [
                    pa.array([file] * len(blocks), pa.int64()),
                    pa.array(list(numbers), pa.int64()),
                    pa.array(blocks, pa.binary()),
                    pa.array(doc_ids, pa.list_(pa.int64())),
                ],
                names=["file", "block", "data", "doc_ids"],
            )

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, ids, counts in tokens.encode_column(batch.column("text"), path, spaces, end):
                if width < 4 and len(ids) and int(ids.max()) >= 1 << (8 * width):
                    raise ValueError(f"an id needs more than {width} bytes")
                rest = np.concatenate([rest, ids.astype(kind)])
                full = len(rest) // block
                found = [rest[i * block : (i + 1) * block].tobytes() for i in range(full)]
                rest = rest[full * block :]
                if found:
                    yield rows(number, found, [None] * full)
                    number += full
            # which documents the file holds in which order, but not where: no index
            yield rows(documents, [None], [names])
            documents += len(names)
        if len(rest):
            yield rows(number, [rest.tobytes()], [None])

    return write


def write_flat(docs: DataFrame, path: str, spaces: bool = True, end: int = 50256, width: int = 2, block: int = BLOCK) -> DataFrame:
    """``docs`` (doc_id, text) as flat files, one per partition, in the order of its rows; an
    ``end`` id after each document. Rows with doc_ids and no data are the manifest of the file; their
    ``block`` is the ordinal of their first document.

    A null text is empty (only its end id); null and repeated ids are kept; an empty table has no
    file. ``width``: bytes of an id.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(_flat(path, spaces, end, width, block), FLAT)


def _search(end: int, width: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, data in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "data"))):
                ids = np.frombuffer(data, f"<u{width}")
                at = np.flatnonzero(ids == end)
                # the last row stands for what follows the last end id; it closes no document
                places = np.append(at, len(ids))
                before = np.concatenate([[-1], at])
                n = len(places)
                yield pa.record_batch(
                    [
                        pa.array(np.full(n, file)),
                        pa.array(np.full(n, block)),
                        pa.array(np.full(n, len(ids), np.int64)),
                        pa.array(np.arange(n, dtype=np.int32)),
                        pa.array([*at.tolist(), None], pa.int64()),
                        pa.array(before, pa.int64()),
                    ],
                    names=["file", "block", "n_ids", "k", "at", "previous"],
                )

    return search


def scan_flat(blocks: DataFrame, end: int = 50256, width: int = 2) -> DataFrame:
    """Documents of flat files (file, block, data): file, ordinal (from 0 in the file), start and
    n_tokens (with the end id), ended (false for ids after a file's last end id)."""
    found = (
        blocks.where(F.col("data").isNotNull())
        .select("file", "block", "data")
        .mapInArrow(_search(end, width), ENDS)
    )
    # one row per block: k of its last row counts the ends in the block
    summary = found.where("at IS NULL").select("file", "block", "n_ids", F.col("k").alias("ends"), F.col("previous").alias("last_end"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    summary = summary.select(
        "file",
        "block",
        F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("base"),
        F.coalesce(F.sum("ends").over(earlier), F.lit(0)).alias("ended_before"),
        (F.row_number().over(Window.partitionBy("file").orderBy(F.col("block").desc())) == 1).alias("is_last"),
        F.when(F.col("ends") > 0, F.sum("n_ids").over(upto) - F.col("n_ids") + F.col("last_end") + 1).alias("open_from"),
    )
    summary = summary.withColumn(
        "carried", F.coalesce(F.last("open_from", ignorenulls=True).over(earlier), F.lit(0))
    ).drop("open_from")
    placed = found.join(summary, ["file", "block"]).select(
        "file",
        (F.col("ended_before") + F.col("k")).alias("ordinal"),
        F.when(F.col("k") == 0, F.col("carried")).otherwise(F.col("base") + F.col("previous") + 1).alias("start"),
        (F.col("base") + F.coalesce("at", F.col("n_ids") - 1) + 1).alias("stop"),
        F.col("at").isNotNull().alias("ended"),
        "is_last",
    )
    # ids after the last end id of the file are a document that has not ended
    return placed.where(F.col("ended") | (F.col("is_last") & (F.col("stop") > F.col("start")))).select(
        "file", "ordinal", "start", (F.col("stop") - F.col("start")).alias("n_tokens"), "ended"
    )


def manifest(flat: DataFrame) -> DataFrame:
    """file, ordinal, doc_id of files that write_flat made."""
    lists = flat.where(F.col("doc_ids").isNotNull())
    return lists.select("file", "block", F.posexplode("doc_ids").alias("i", "doc_id")).select(
        "file", (F.col("block") + F.col("i")).alias("ordinal"), "doc_id"
    )
