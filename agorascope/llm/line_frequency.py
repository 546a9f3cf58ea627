"""Quality rules from line frequency across the documents of a host.

Lines are normalised and hashed; a line that stands in too many distinct documents of its host is
boilerplate and is removed, and a document that loses most of its words so is rejected. Exact
copies of a text count as one document, so a text is not boilerplate because it was copied.

All of it is DataFrame functions. A digest of each document (base figures, its line hashes with
their word counts) is written once; everything else is done on digests. A frequent line stands in
a tenth of its host's documents, so a host has at most ten times as many of them as its documents
have lines on average: they fit in an array per host, and that small table is joined on (host,
salt), so that a host with a third of all documents is spread over SALTS tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agorascope.llm.sqltext import has_word, let, lines, normal_line, words
from agorascope.llm.store import written

MIN_DOCUMENTS = 20  # a removed line stands in more documents of its host than this
MAX_PERCENT = 10  # and in more than this share of them
LEAST_KEPT_PERCENT = 50  # a document that keeps fewer of its words is rejected
SALTS = 32
SYMBOLS = "#*$%&|<>"


def repeated_words(tokens: Column) -> Column:
    """Words in 3-word windows found twice or more in ``tokens``, the first included."""

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

    def covered(at: Column) -> Column:
        # windows overlap: each new one adds what lies beyond the one before
        steps = F.sequence(F.lit(1), F.size(at) - 1)
        return F.when(F.size(at) < 2, F.lit(0).cast("long")).otherwise(
            F.aggregate(steps, F.lit(3).cast("long"), lambda n, j: n + F.least(F.lit(3), at[j] - at[j - 1]))
        )

    def places(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows) - 1
        twice = F.filter(
            sorted_windows,
            lambda x, j: ((j > 0) & (sorted_windows[F.greatest(j - 1, F.lit(0))]["h"] == x["h"]))
            | ((j < last) & (sorted_windows[F.least(j + 1, last)]["h"] == x["h"])),
        )
        return F.sort_array(F.transform(twice, lambda x: x["i"]))

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        some = F.size(F.array_distinct(h)) < F.size(h)  # most texts have no repeated window
        return F.when(some, let(pairs, lambda s: let(places(s), covered))).otherwise(F.lit(0).cast("long"))

    return F.when(F.size(tokens) < 4, F.lit(0).cast("long")).otherwise(
        let(tokens, lambda w: let(hashes(w), counted))
    )


def digests(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host, text_hash, base figures, and lines: hash and words of each line with a word."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    chosen = docs.select("doc_id", F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), text.alias("text"))
    chosen = chosen.select(
        "doc_id",
        "host",
        F.xxhash64("text").alias("text_hash"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines(F.col("text")), lambda own: F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
        let(
            words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).alias("repeated"))
        ).alias("w"),
        F.transform(
            lines(F.col("text")),
            lambda line: let(normal_line(line), lambda l: F.struct(F.xxhash64(l).alias("h"), _words_in(l).alias("n"))),
        ).alias("lines"),
    )
    return chosen.select(
        "doc_id",
        "host",
        "text_hash",
        F.col("w.n").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.col("w.repeated").alias("n_repeat_words"),
        "lines",
    )


def _words_in(normal: Column) -> Column:
    return F.length(normal) - F.length(F.translate(normal, " ", "")) + 1


def frequent_lines(
    digested: DataFrame, min_documents: int = MIN_DOCUMENTS, max_percent: int = MAX_PERCENT
) -> DataFrame:
    """host, frequent (array of line hashes): one row per host that has any."""
    pairs = digested.select("host", "text_hash", F.explode(F.array_distinct("lines.h")).alias("line"))
    # two steps: first each (host, line, text) once, so a common line is spread by its texts
    counts = pairs.groupBy("host", "line").agg(F.count_distinct("text_hash").alias("n"))
    hosts = digested.groupBy("host").agg(F.count_distinct("text_hash").alias("host_n"))
    counts = counts.where(F.col("n") > min_documents).join(hosts, "host")
    return (
        counts.where(F.col("n") * 100 > F.col("host_n") * max_percent)
        .groupBy("host")
        .agg(F.collect_list("line").alias("frequent"))
    )


def with_frequent(docs: DataFrame, host: Column, frequent: DataFrame, spread: Column) -> DataFrame:
    """Adds ``frequent``, the lines of the row's host; null where it has none."""
    salts = F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("_salt")
    small = frequent.select(F.col("host").alias("_host"), "frequent", salts)
    salted = docs.withColumns(
        {"_host": F.coalesce(host.cast("string"), F.lit("")), "_salt": F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")}
    )
    return salted.join(small, ["_host", "_salt"], "left").drop("_host", "_salt")


def judged(digested: DataFrame, frequent: DataFrame, least_kept_percent: int = LEAST_KEPT_PERCENT) -> DataFrame:
    """Verdicts: base figures, base_failed, n_removed_words, kept."""
    joined = with_frequent(digested, F.col("host"), frequent, F.col("doc_id"))
    removed = F.aggregate(
        F.filter("lines", lambda l: F.array_contains("frequent", l["h"])),
        F.lit(0).cast("long"),
        lambda n, l: n + l["n"],
    )
    out = joined.withColumn("n_removed_words", F.when(F.col("frequent").isNull(), F.lit(0).cast("long")).otherwise(removed))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("n_removed_words")) < least_kept_percent * F.col("n_words")
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base.alias("base_failed"),
        (~base & ~depleted).alias("kept"),
        "n_removed_words",
    )


def verdicts(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, host column), copies of rows included.

    A null text is empty and fails the base rule; rows without a host form one host, the empty
    name; other columns are ignored; an empty table gives no rows.
    """
    digested = written(digests(docs, host), "line-digests")
    return judged(digested, written(frequent_lines(digested), "frequent-lines"))


def cleaned(docs: DataFrame, host: str = "source") -> DataFrame:
    """``docs`` without the frequent lines of their hosts and without rejected rows; same columns,
    whatever their names. Lines without a word stay."""
    digested = written(digests(docs, host).select("host", "text_hash", "lines"), "line-digests")
    frequent = written(frequent_lines(digested), "frequent-lines")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    packed = docs.select(F.struct("*").alias("row"), text.alias("own"), F.col(host).cast("string").alias("host"))
    joined = with_frequent(packed, F.col("host"), frequent, F.col("own"))

    def stays(line: Column) -> Column:
        return ~has_word(line) | ~F.array_contains("frequent", F.xxhash64(normal_line(line)))

    left = F.when(F.col("frequent").isNull(), F.col("own")).otherwise(
        F.array_join(F.filter(F.split("own", "\n", -1), stays), "\n")
    )
    # one expression, used once: a filter on columns would be pushed down and compute them again
    good = let(
        words(F.col("own")),
        lambda w: (F.size(w) >= 50)
        & (100 * F.size(words(left)) >= LEAST_KEPT_PERCENT * F.size(w))
        & (100 * repeated_words(w) <= 50 * F.size(w)),
    )
    return joined.where(good).select("row", left.alias("left")).select(
        *[F.col("left").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    )
