"""Size limits that steer physical choices, and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Limits:
    """Where a group of rows counts as too large for one task.

    None of these change a result; they only say when a plan splits the work further.
    Tests set them to tiny values so that the split plans run on small fixtures.
    """

    # a join key with more probe rows than this is joined apart, by broadcast
    hot_rows: int = 1_000_000
    # no more than this many keys can be hot, so what is broadcast for them is bounded
    max_hot_keys: int = 1024
    # running aggregates are cut into blocks of 2**block_bits positions
    block_bits: int = 16
    # interval look-ups resolve 2**fine_bits positions together
    fine_bits: int = 12


DEFAULT_LIMITS = Limits()

# a query's shuffle files go when it ends, not when the driver collects its garbage
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in `spark.checkpoint.dir`.

    Only a local session may run without the setting; it gets a temporary folder.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="agorascope-checkpoint-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` reliably and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_end(spark: SparkSession):
    """Queries that run here leave no shuffle files behind: what they found is written."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def stage(df: DataFrame) -> DataFrame:
    """Write `df` as a columnar table in the checkpoint folder and read it back.

    For tables that several plans read with different columns; `cut` is for loop states.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Delete a table of `stage` that no later plan reads."""
    spark = df.sparkSession
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
