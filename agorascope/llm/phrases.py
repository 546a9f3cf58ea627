"""Collocations: phrases of two to four words that stand together more often than their parts.

Everything is counted per language. Three passes over the texts: words; pairs of frequent words;
phrases of three and four words all of whose pairs are frequent. A phrase can only be frequent if all its
parts are, so nothing frequent is left out. In each task a HAT-trie counts; its largest subtrees go
out as sorted runs, which are dealt by their first word (by the whole phrase where that word is a heavy
one) and merged. Which words and pairs are frequent is sent along as a bit filter of bounded size; it
may let others through, which the counts then drop.

A word is named by a 64-bit hash of its language and letters. That no two words have the same name is
checked on the table of all words; if two had, all is counted again with other hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agorascope.llm import arrowwords
from agorascope.llm.hattrie import HatTrie
from agorascope.llm.minhash import slices
from agorascope.llm.store import written
from agorascope.operators.skew import lookup_join

LONGEST, LEAST, COVERED, TOP = 4, 30, 80, 2000
SCALE = 2_000_000
ENTRIES = 1 << 19  # of a task's trie
HEAVY = 1024  # a word is heavy with more than this share of all words, so at most so many are
FILTER_WORDS = 1 << 22  # 64-bit words of the bit filter at most: 32 MB
STEP = 2_000_000  # bytes of text handled together
SALTS = 64

# bytes of a text as pieces and words see them: lower case, and one mark for all piece ends
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[65:91] += 32
_BYTES[[ord(c) for c in ".,;:!?\n\v\f\r"]] = 10


def word_ids(texts: pa.Array, langs: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, arrowwords.Words]:
    """(id, piece, row) of each word, in order, and the words found."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    size = int(offsets[-1] - offsets[0])
    data = _BYTES[np.frombuffer(texts.buffers()[2], np.uint8, size, int(offsets[0]))] if size else np.zeros(0, np.uint8)
    plain = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(np.ascontiguousarray(offsets - offsets[0])), pa.py_buffer(data)])
    found = arrowwords.words(plain)
    row = np.repeat(np.arange(n), np.diff(found.first))
    ends = np.cumsum(data == 10)
    piece = (ends[found.begin] if len(found.begin) else np.zeros(0, np.int64)) + row  # both only grow, so equal only within a piece
    names = langs.cast(pa.string()).fill_null("und").dictionary_encode()
    of_lang = np.array([xxhash.xxh3_64_intdigest(v, seed) for v in names.dictionary.to_pylist()], np.uint64)
    own = of_lang[names.indices.to_numpy()][row] if n else np.zeros(0, np.uint64)
    return arrowwords.mix(found.hashes ^ own), piece, row, found


def _count_words(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column("lang").cast(pa.string()).fill_null("und")
            for first, column in slices(batch.column("text"), STEP):
                ids, _, row, found = word_ids(column, langs.slice(first, len(column)), seed)
                keys, at, n = np.unique(ids, return_index=True, return_counts=True)
                yield pa.record_batch(
                    [
                        pa.array(keys.astype(">u8").view("V8").tolist(), pa.binary()), langs.take(pa.array(row[at] + first)),
                        pa.array([found.word(i) for i in at.tolist()], pa.binary()).cast(pa.string()), pa.array(n.astype(np.int64)),
                    ],
                    names=["id", "lang", "word", "n"],
                )

    return run


def word_counts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(id, lang, word, n) of all words, written, and the seed of their ids."""
    for seed in range(16):
        rows = docs.mapInArrow(_count_words(seed), "id binary, lang string, word string, n long")
        # rows of one id are in one task, so the check for equal ids needs no shuffle of its own
        words = written(rows.groupBy("id", "lang", "word").agg(F.sum("n").alias("n")), "words")
        if words.groupBy("id").count().where("count > 1").isEmpty():
            return words, seed
    raise RuntimeError("sixteen hash functions gave some words the same id")


def _marks(keys: np.ndarray) -> np.ndarray:
    one, low = np.uint64(1), np.uint64(63)
    return one << (keys & low) | one << ((keys >> np.uint64(6)) & low) | one << ((keys >> np.uint64(12)) & low)


def _path_keys(ids: np.ndarray) -> np.ndarray:
    """A hash of each row of word ids; its leading byte is that of the first id."""
    key = ids[:, 0]
    for i in range(1, ids.shape[1]):
        key = key * np.uint64(0x2545F4914F6CDD1D) + ids[:, i]
    return ids[:, 0] & np.uint64(0xFF << 56) | arrowwords.mix(key) >> np.uint64(8)


class Filter:
    """A set of hashes as bits; it may know others too, but never misses one."""

    def __init__(self, keys: DataFrame, rows: int, column: str):
        """``keys``: paths of a fixed number of words in ``column``."""
        width = min(FILTER_WORDS, 1 << max(10, (max(rows, 1) // 4).bit_length()))
        shift = 64 - (width.bit_length() - 1)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                paths = batch.column(0).to_pylist()
                if paths:
                    key = arrowwords.mix(_path_keys(np.frombuffer(b"".join(paths), ">u8").astype(np.uint64).reshape(len(paths), -1)))
                    yield pa.record_batch(
                        [pa.array((key >> np.uint64(shift)).astype(np.int64)), pa.array(_marks(key).view(np.int64))], names=["word", "bits"]
                    )

        found = keys.select(column).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
        found = found.toArrow()  # at most FILTER_WORDS rows of two numbers
        bits = np.zeros(width, np.uint64)
        bits[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        self.bits, self.shift = keys.sparkSession.sparkContext.broadcast(bits), shift

    def knows(self, paths: np.ndarray) -> np.ndarray:
        keys = arrowwords.mix(_path_keys(paths))
        marks = _marks(keys)
        return self.bits.value[(keys >> np.uint64(self.shift)).astype(np.int64)] & marks == marks


def _distinct(paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of word ids, by their leading byte, and how often each is there."""
    keys = _path_keys(paths)
    _, at, which, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    if not (paths[at][which] == paths).all():  # two paths with one hash: go by the ids themselves
        return np.unique(paths, axis=0, return_counts=True)
    return paths[at], n


def _trie_runs(seed: int, sizes: tuple[int, ...], known: Filter, unit: int, heavy, entries: int):
    """Sorted runs of the counts of phrases of ``sizes`` words, all of whose parts of ``unit`` words
    are ``known``."""

    def rows(run: list[tuple[bytes, int]]) -> Iterator[pa.RecordBatch]:
        heads = heavy.value
        for low in range(0, len(run), 1 << 16):
            paths, counts = zip(*run[low : low + (1 << 16)])
            part = [xxhash.xxh3_64_intdigest(p if p[:8] in heads else p[:8]) >> 1 for p in paths]
            yield pa.record_batch([pa.array(part, pa.int64()), pa.array(paths, pa.binary()), pa.array(counts, pa.int64())], names=["part", "path", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = HatTrie(entries)
        for batch in batches:
            for first, column in slices(batch.column("text"), STEP):
                ids, piece, _, _ = word_ids(column, batch.column("lang").slice(first, len(column)), seed)
                count = len(ids) - unit + 1
                if count <= 0:
                    continue
                units = np.stack([ids[i : i + count] for i in range(unit)], axis=1)
                good = (piece[unit - 1 :] == piece[:count]) & known.knows(units)
                for size in sizes:
                    n = len(ids) - size + 1
                    if n <= 0:
                        continue
                    start = np.flatnonzero(piece[size - 1 :] == piece[:n])
                    for i in range(size - unit + 1):
                        start = start[good[start + i]]
                    if len(start):
                        paths, counts = _distinct(np.stack([ids[start + i] for i in range(size)], axis=1))
                        trie.add(paths.astype(">u8").view(f"V{8 * size}").ravel().tolist(), counts.tolist())
                    for spilled in trie.spill():
                        yield from rows(spilled)
        for spilled in trie.spill(all_=True):
            yield from rows(spilled)

    return run


def _counted(docs: DataFrame, seed: int, sizes: tuple[int, ...], known: Filter, unit: int, heavy, least: int, entries: int) -> DataFrame:
    """(path, f) of the phrases with at least ``least`` occurrences, written."""
    runs = docs.mapInArrow(_trie_runs(seed, sizes, known, unit, heavy, entries), "part long, path binary, n long")
    merged = runs.repartition("part").groupBy("part", "path").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return written(merged.select("path", "f"), "phrases")


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, entries: int = ENTRIES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and 0x0A-0x0D and into words at space
    and tab. a, l, r count a phrase and the parts of its worst cut (the first among equals), n all words of
    the language; score is floor(2,000,000 a / (l + r)), exact. Phrases that lie inside a longer one
    with at least 80% of their occurrences are left out. Ties: higher a, then the lesser phrase by bytes.

    A null text is empty, a null lang is ``und``; ids are not used, so repeated rows count each; other
    columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    words, seed = word_counts(docs)
    totals = words.groupBy("lang").agg(F.sum("n").alias("n"))
    total = words.agg(F.sum("n")).first()[0] or 0
    frequent = words.where(F.col("n") >= least)
    context = docs.sparkSession.sparkContext
    heavy = words.where(F.col("n") > max(least, total // HEAVY)).select("id").collect()  # at most HEAVY rows
    heavy = context.broadcast({bytes(r.id) for r in heavy})
    pairs = _counted(docs, seed, (2,), Filter(frequent, frequent.count(), "id"), 1, heavy, least, entries)
    longer = _counted(docs, seed, tuple(range(3, LONGEST + 1)), Filter(pairs, pairs.count(), "path"), 2, heavy, least, entries)

    candidates = pairs.unionByName(longer).withColumnRenamed("f", "a")
    parts = frequent.select(F.col("id").alias("path"), F.col("n").alias("f")).unionByName(pairs).unionByName(longer)
    rows = candidates.count()
    n_words = (F.length("path") / 8).cast("int")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), n_words - 1)))
    cuts = cuts.select(
        "path", "a", "k", F.expr("substring(path, 1, 8 * k)").alias("head"), F.expr("substring(path, 8 * k + 1, length(path))").alias("tail")
    )
    of = lambda name, f: parts.select(F.col("path").alias(name), F.col("f").alias(f))
    cuts = lookup_join(cuts, of("head", "l"), ["head"], 3 * rows, "inner")
    cuts = lookup_join(cuts, of("tail", "r"), ["tail"], 3 * rows, "inner")
    # decimals: the products may pass 64 bits
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(19,0))) DIV CAST(CAST(l AS DECIMAL(19,0)) + r AS DECIMAL(20,0))")
    worst = cuts.withColumn("score", score).groupBy("path").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"), F.first("a").alias("a"))

    spans = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), n_words - 1),
        lambda size: F.transform(F.sequence(F.lit(0), n_words - size), lambda at: F.struct(size.alias("size"), at.alias("at"))),
    )))
    inner = longer.withColumn("s", spans).select(F.expr("substring(path, 8 * s.at + 1, 8 * s.size)").alias("path"), "f")
    cover = inner.groupBy("path").agg(F.max("f").alias("cover"))
    kept = worst.join(cover, "path", "left").where(F.coalesce(100 * _wide("cover") < COVERED * _wide("a"), F.lit(True)))
    kept = written(kept.select("path", "a", "w.l", "w.r", "w.score"), "collocations")

    spelled = kept.select("path", F.explode(F.sequence(F.lit(0), n_words - 1)).alias("at"))
    spelled = spelled.select("path", "at", F.expr("substring(path, 8 * at + 1, 8)").alias("id"))
    spelled = lookup_join(spelled, frequent.select("id", "lang", "word"), ["id"], LONGEST * rows, "inner")
    spelled = spelled.groupBy("path").agg(
        F.first("lang").alias("lang"),
        F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda w: w["word"])).alias("phrase"),
    )
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = kept.join(spelled, "path").withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)))
    some = F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))  # so the last window sees few
    ranked = ranked.withColumn("rank", some).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if totals.count() <= 100_000 else totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
