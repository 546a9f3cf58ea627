"""Where messages come from: the annotated CSV, Parquet, or the benchmark tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.text import word_count
from ..operators.skew import lookup_join
from ..schema import ANNOTATED_TAGS, CSV_SCHEMA, META, NO_PARENT, UNTAGGED


def untagged(tags: list[str] = ANNOTATED_TAGS) -> Column:
    """1 when none of the annotated tags is set."""
    total = F.lit(0)
    for tag in tags:
        total = total + F.col(f"`{tag}`")
    return F.when(total == 0, 1).otherwise(0)


def read_annotated_csv(spark: SparkSession, path: str, corrupt: str | None = None) -> DataFrame:
    """Read annotated threads with a fixed schema and add the `Untagged` flag.

    Texts may span lines, so one file is read by one task; pass a folder of many files.  With
    `corrupt`, a column of that name holds the source of records that do not fit the schema, else NULL.
    """
    schema, options = CSV_SCHEMA, {}
    if corrupt:
        schema = T.StructType([*CSV_SCHEMA.fields, T.StructField(corrupt, T.StringType())])
        options = {"columnNameOfCorruptRecord": corrupt}
    raw = spark.read.schema(schema).options(**options).csv(path, header=True, multiLine=True, escape='"')
    return raw.withColumnsRenamed({"Unnamed: 0": "message_id", "timestamp": "ts"}).withColumn(
        UNTAGGED, untagged()
    )


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """Read messages stored as Parquet in the layout of `read_annotated_csv`."""
    return spark.read.parquet(path)


def pack(messages: DataFrame, tags: list[str] = ANNOTATED_TAGS) -> DataFrame:
    """Metadata, `words` and one `tags` array, which is the form the operators use."""
    df = messages if UNTAGGED in messages.columns else messages.withColumn(UNTAGGED, untagged(tags))
    return df.select(
        *[c for c in META if c in df.columns],
        word_count(F.col("text")).alias("words"),
        F.array(*[F.col(f"`{t}`").cast("int") for t in [*tags, UNTAGGED]]).alias("tags"),
    )


def ingest_report(messages: DataFrame) -> DataFrame:
    """(rows, no_id, repeated_ids, no_parent, lost_parents, foreign_parents): what a corpus should not
    have, in one row.

    repeated_ids counts ids of several rows, no_parent rows with neither a parent nor -1, lost_parents
    rows whose parent is no message, foreign_parents those whose parent is in another thread only.
    """
    ids = messages.where("message_id IS NOT NULL").groupBy("message_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("tree_id").alias("low"), F.max("tree_id").alias("high")
    )
    parents = ids.select(F.col("message_id").alias("parent"), "low", "high")
    rows = messages.count()
    asked = messages.where(F.col("parent") != NO_PARENT).select("parent", "tree_id")
    linked = lookup_join(asked, parents, ["parent"], rows, "left")
    # an id in several threads is counted as repeated; its parent is foreign if in neither end's thread
    foreign = (F.col("low") != F.col("tree_id")) & (F.col("high") != F.col("tree_id"))
    links = linked.agg(
        F.count_if(F.col("low").isNull()).alias("lost_parents"), F.count_if(foreign).alias("foreign_parents")
    )
    counts = messages.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("message_id").isNull()).alias("no_id"),
        F.count_if(F.col("parent").isNull()).alias("no_parent"),
    )
    repeated = ids.agg(F.count_if(F.col("n") > 1).alias("repeated_ids"))
    parts = counts.unionByName(repeated, allowMissingColumns=True).unionByName(links, allowMissingColumns=True)
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


# --- a thread corpus derived from the benchmark tables --------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events, every 50 ids cut into two threads of varying sizes."""
    stretch, at = F.floor(F.col("event_id") / 50).cast("long"), F.col("event_id") % 50
    cut = 10 + (stretch * 7) % 41
    return (
        spark.read.parquet(f"{sf_dir}/events.parquet")
        .select("event_id", "ts", "user_id")
        .withColumns(
            {
                "pos": F.when(at >= cut, at - cut).otherwise(at),
                "tree_id": stretch * 2 + F.when(at >= cut, 1).otherwise(0),
            }
        )
    )


def benchmark_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages of binary-heap shaped threads, texts from documents.

    Words are counted once per document, before the documents are joined.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_docs = docs.count()  # answered from the file footers
    texts = docs.select(
        F.col("doc_id").alias("_doc"), "text", word_count(F.col("text")).alias("words")
    )
    seconds = F.expr(
        "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / CAST(1000000 AS DOUBLE)"
    )
    author = F.concat(
        F.lit("u"), (F.col("user_id") % 20).cast("string"),
        F.when(F.col("event_id") % 7 == 0, F.concat(F.lit("_t"), F.col("tree_id").cast("string")))
        .otherwise(""),
    )
    flags = F.expr(
        f"""transform(sequence(0L, {len(ANNOTATED_TAGS) - 1}L), i -> if(
              (event_id * 7919 + i * 104729 + (event_id % 13) * i * 31) % 97 < 5, 1, 0))"""
    )
    none = F.when(F.array_max("flags") == 0, 1).otherwise(0)
    return (
        _events(spark, sf_dir)
        .withColumn("flags", flags)
        .select(
            F.col("event_id").alias("message_id"),
            F.col("event_id").cast("string").alias("node_id"),
            "tree_id",
            F.when(F.col("pos") == 0, F.lit(-1).cast("long"))
            .otherwise(F.col("event_id") - F.col("pos") + F.floor((F.col("pos") - 1) / 2))
            .cast("long").alias("parent"),
            author.alias("author"),
            seconds.alias("ts"),
            F.concat("flags", F.array(none)).alias("tags"),
            (F.col("event_id") % n_docs).alias("_doc"),
        )
        .join(texts, "_doc")
        .drop("_doc")
    )


def benchmark_embeddings(spark: SparkSession, sf_dir: str, messages: DataFrame) -> DataFrame:
    """(message_id, embedding): one stored vector per message."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").alias("_vec"), "embedding"
    )
    n = vectors.count()
    return (
        messages.select("message_id", (F.col("message_id") % n).alias("_vec"))
        .join(vectors, "_vec")
        .drop("_vec")
    )


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as reply chains: thread = conversation, parent = previous turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    wide = 1 << 32
    place = F.when(F.col("turn").between(0, wide - 1), F.col("turn")).otherwise(
        F.raise_error(F.concat(F.lit("no message id for turn "), F.col("turn").cast("string"))).cast("long")
    )
    this = F.col("conv_id") * F.lit(wide) + place
    return turns.select(
        this.alias("message_id"),
        F.col("conv_id").alias("tree_id"),
        F.when(F.col("turn") == 0, F.lit(-1).cast("long")).otherwise(this - 1).alias("parent"),
        F.col("role").alias("author"),
        "text",
    )
