"""Substring dedup: words covered by a window of WINDOW words that also starts earlier.

Every window has an anchor, its least GRAM-word hash; consecutive windows with the same anchor are a
segment. Equal windows have equal anchors, so segments are dealt by anchor and each shard, some whole
anchors, decides on its windows alone; the work grows with the corpus and not with its square. Segments
whose anchor occurs once are dropped before any word is moved, and equal segments are represented by
their first copy, so many copies cost no more than one.

Each shard builds an FM-index over its segments' words and streams the segments through it: backward
search gives every window the rows that begin with it, and the earliest of their places decides
whether the window is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agorascope.llm import arrowwords
from agorascope.llm.fmindex import FMIndex, window_rows
from agorascope.llm.minhash import _groups, slices
from agorascope.llm.store import written

WINDOW = 20
GRAM = 8
SHARD = 400_000  # words after which a shard is closed at the next anchor

SEGMENTS = "anchor long, content long, doc_id long, text_hash long, start int, n int"
PLACED = "doc_id long, text_hash long, start int, n int, anchor long, content long, first boolean"
WORDS = "anchor long, doc_id long, text_hash long, start int, words binary"
REPEATS = "doc_id long, text_hash long, start int, n int"


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of ``size`` consecutive values from each place."""
    out, have = values, 1
    while have < size:
        step = min(have, size - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def segments(hashes: np.ndarray, first: np.ndarray, window: int, gram: int):
    """(text, start, windows, anchor) of the segments of texts with words first[i] to first[i + 1]."""
    grams = arrowwords.grams(hashes, gram)
    span = window - gram + 1
    if len(grams) < span:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    # order by hash, then by place; equal windows see equal hashes at equal distances
    place = np.arange(len(grams), dtype=np.uint64)
    low = np.uint64((1 << 26) - 1)
    chosen = (_least((grams & ~low) | place, span) & low).astype(np.int64)
    per_text = np.maximum(np.diff(first) - window + 1, 0)
    text = np.repeat(np.arange(len(per_text)), per_text)
    number = np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
    at = first[:-1][text] + number
    anchor = chosen[at]
    new = np.ones(len(at), bool)
    new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
    begin = np.flatnonzero(new)
    return text[begin], number[begin], np.diff(np.append(begin, len(at))), grams[anchor[begin]]


def _find_segments(window: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, column in slices(batch.column("text")):
                found = arrowwords.words(column)
                text, start, n, anchor = segments(found.hashes, found.first, window, gram)
                # a running polynomial gives the content of any run of words
                powers, inverse = arrowwords._power(len(found.hashes) + 1)
                sums = np.concatenate([[np.uint64(0)], np.cumsum(found.hashes * powers[: len(found.hashes)], dtype=np.uint64)])
                begin = found.first[:-1][text] + start
                content = arrowwords.mix((sums[begin + n + window - 1] - sums[begin]) * inverse[begin] + n.astype(np.uint64))
                # a segment that its own text already has is a repeat whatever the others have; it is
                # marked by a negative n and spread, so that repetitive texts fill no anchor
                order = np.lexsort((start, content, text))
                again = np.zeros(len(text), bool)
                again[order[1:]] = (content[order[1:]] == content[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
                anchor = np.where(again, arrowwords.mix(content + start.astype(np.uint64)), anchor)
                n = np.where(again, -n, n)
                at = pa.array(row + text)
                yield pa.record_batch(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(content.view(np.int64)),
                        batch.column("doc_id").take(at),
                        batch.column("text_hash").take(at),
                        pa.array(start.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    names=["anchor", "content", "doc_id", "text_hash", "start", "n"],
                )

    return find


def _keep_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of anchors that occur more than once; the stream is sorted by anchor, content and place."""
    for rows in _groups(batches, "anchor"):
        rows = rows.combine_chunks()
        anchor, content = rows.column("anchor").to_numpy(), rows.column("content").to_numpy()
        n = rows.column("n").to_numpy()
        mine = np.flatnonzero(n > 0)
        new = np.ones(len(mine) + 1, bool)
        new[1:-1] = anchor[mine[1:]] != anchor[mine[:-1]]
        starts = np.flatnonzero(new)
        several = np.repeat(np.diff(starts) > 1, np.diff(starts))
        first = new[:-1].copy()
        first[1:] |= content[mine[1:]] != content[mine[:-1]]
        # rows of one document at one place are no copies of each other
        head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
        doc, start = rows.column("doc_id").to_numpy()[mine], rows.column("start").to_numpy()[mine]
        first |= (doc == doc[head]) & (start == start[head])
        known = np.flatnonzero(n < 0)  # repeats within a text
        keep = pa.array(np.concatenate([mine[several], known]))
        columns = [rows.column(c).take(keep).combine_chunks() for c in ("doc_id", "text_hash", "start", "anchor", "content")]
        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
        columns.insert(3, pa.array(np.abs(n[keep.to_numpy()])))
        yield pa.record_batch(
            [*columns, pa.array(np.concatenate([first[several], np.zeros(len(known), bool)]))],
            names=["doc_id", "text_hash", "start", "n", "anchor", "content", "first"],
        )


def _cut_words(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, column in slices(batch.column("text")):
                found = arrowwords.words(column)
                lists = batch.column("segments").slice(row, len(column))
                owner = np.repeat(np.arange(len(column)), np.diff(lists.offsets.to_numpy()))
                flat = lists.flatten()
                begin = found.first[:-1][owner] + flat.field("start").to_numpy()
                length = flat.field("n").to_numpy().astype(np.int64) + window - 1
                ends = np.cumsum(length)
                words = found.hashes[np.repeat(begin - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]
                offsets = np.concatenate([[0], ends]) * 8
                data = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(words)]
                )
                at = pa.array(row + owner)
                yield pa.record_batch(
                    [
                        flat.field("anchor"),
                        batch.column("doc_id").take(at),
                        batch.column("text_hash").take(at),
                        flat.field("start"),
                        data.cast(pa.binary()),
                    ],
                    names=["anchor", "doc_id", "text_hash", "start", "words"],
                )

    return cut


def repeated_windows(words: list[bytes], docs: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window within it) of windows that start earlier in some segment of the shard."""
    lengths = np.fromiter((len(w) // 8 for w in words), np.int64, len(words))
    symbols = np.unique(np.frombuffer(b"".join(words), np.uint64), return_inverse=True)[1] + 1
    ends = np.cumsum(lengths + 1) - 1  # place of each segment's end mark
    text = np.zeros(int(ends[-1]) + 1, np.int64)
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = symbols
    index = FMIndex(text, window)
    rows = window_rows(index, text, ends, lengths)
    segment = np.repeat(np.arange(len(words)), lengths + 1)
    offset = np.arange(len(text)) - (ends - lengths)[segment]
    # the order of places: by document, then by word
    order = np.empty(len(text), np.int64)
    order[np.lexsort((starts[segment] + offset, docs[segment]))] = np.arange(len(text))
    sorted_rank = index.rows[window][index.suffix]
    begins = np.flatnonzero(np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]]))
    earliest = np.minimum.reduceat(order[index.suffix], begins)
    group = np.searchsorted(begins, np.arange(len(text)), "right") - 1
    at = np.flatnonzero(rows >= 0)
    best = earliest[group[rows[at]]]
    # the same document and word is no earlier place
    place = np.empty(len(text), np.int64)
    place[order] = np.arange(len(text))
    other = place[best]
    earlier = (best < order[at]) & (
        (docs[segment[other]] != docs[segment[at]])
        | (starts[segment[other]] + offset[other] != starts[segment[at]] + offset[at])
    )
    return segment[at[earlier]], offset[at[earlier]]


def _search(window: int, shard: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def close() -> pa.RecordBatch:
            rows = pa.concat_tables(held).combine_chunks()
            held.clear()
            docs, starts = rows.column("doc_id").to_numpy(), rows.column("start").to_numpy().astype(np.int64)
            segment, offset = repeated_windows(rows.column("words").to_pylist(), docs, starts, window)
            new = np.ones(len(segment), bool)
            new[1:] = (segment[1:] != segment[:-1]) | (offset[1:] != offset[:-1] + 1)
            begin = np.flatnonzero(new)
            run = np.diff(np.append(begin, len(segment)))
            at = segment[begin]
            return pa.record_batch(
                [
                    pa.array(docs[at]),
                    pa.array(rows.column("text_hash").to_numpy()[at]),
                    pa.array((starts[at] + offset[begin]).astype(np.int32)),
                    pa.array(run.astype(np.int32)),
                ],
                names=["doc_id", "text_hash", "start", "n"],
            )

        size = 0
        for rows in _groups(batches, "anchor"):
            for part in _parts(rows, shard):
                held.append(part)
                size += sum(len(c) for c in part.column("words").to_pylist()) // 8
                if size >= shard:
                    yield close()
                    size = 0
        if held:
            yield close()

    return search


def _parts(rows: pa.Table, shard: int) -> Iterator[pa.Table]:
    """Slices of whole anchors of about ``shard`` words."""
    anchor = rows.column("anchor").to_numpy()
    bounds = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1], [True]]))
    low, most = 0, max(1, shard // (2 * WINDOW))
    while low < len(anchor):
        high = int(bounds[min(np.searchsorted(bounds, low + most), len(bounds) - 1)])
        yield rows.slice(low, high - low)
        low = high


_LEAST = -(1 << 63)


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")
    )


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """Runs of repeated windows: doc_id, text_hash, start (first word of the first window), n windows."""
    keyed = _keyed(docs)
    found = keyed.mapInArrow(_find_segments(window, gram), SEGMENTS)
    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "content", "doc_id", "start")
    placed = written(dealt.mapInArrow(_keep_repeated, PLACED), "repeated-anchors")
    wanted = placed.where("first").groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("start", "n", "anchor")).alias("segments")
    )
    words = keyed.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "segments")
    words = words.mapInArrow(_cut_words(window), WORDS)
    streamed = words.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "start")
    copies = placed.where("NOT first").select("doc_id", "text_hash", "start", "n")
    return streamed.mapInArrow(_search(window, shard), REPEATS).unionByName(copies)


RESULT = "doc_id long, n_words long, n_removed long, text string"


def _remove(window: int):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, texts = [], [], []
            for text, runs in zip(batch.column("text"), batch.column("runs")):
                words = text.as_py().encode().split()
                gone = 0
                if runs.is_valid:
                    cover = np.zeros(len(words) + 1, np.int64)
                    flat = runs.values
                    start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
                    np.add.at(cover, start, 1)
                    np.add.at(cover, np.minimum(start + n + window - 1, len(words)), -1)
                    stay = np.cumsum(cover[:-1]) == 0
                    gone = len(words) - int(stay.sum())
                    kept = [w for w, s in zip(words, stay.tolist()) if s]
                else:
                    kept = words
                counts.append(len(words))
                removed.append(gone)
                texts.append(b" ".join(kept).decode())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                names=["doc_id", "n_words", "n_removed", "text"],
            )

    return remove


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words, one space between) of every row of ``docs``.

    Null and empty texts have no words. Rows with the same id and text stand at the same place and do
    not remove each other's words; rows with the same id and other texts are ordered by word only,
    equal places being no earlier ones. Rows without id come before all others, and stay without id.
    Other columns are ignored; an empty table gives no rows.
    """
    runs = repeats(docs, window).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    joined = _keyed(docs).join(runs, ["doc_id", "text_hash"], "left")
    chosen = joined.select(F.when(F.col("doc_id") != _LEAST, F.col("doc_id")).alias("doc_id"), "text", "runs")
    return chosen.mapInArrow(_remove(window), RESULT)
