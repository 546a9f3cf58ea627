"""What queries leave on disk: packed files, and no shuffle files of what is written."""

import os

from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from agorascope import queries
from agorascope.operators.context import message_contexts, written_contexts
from agorascope.settings import CLEANUP, stage, unstage
from agorascope.plans.units import message_rows, units
from test_units import fixture


def shuffles(spark):
    found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


def small_tables(spark, folder):
    docs = [(i, 'He said "so",\n' * 30 + f"{i}") for i in range(10)]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    events = spark.range(300).select(
        F.col("id").alias("event_id"), (F.col("id") % 23).alias("user_id"),
        F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT), 0)").alias("ts"),
    )
    events.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_staged_tables_leave_no_shuffle_files(spark):
    before = shuffles(spark)
    staged = stage(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert not shuffles(spark) - before
    assert {r.k: r["count"] for r in staged.collect()} == {k: 143 if k < 6 else 142 for k in range(7)}
    assert spark.conf.get(CLEANUP, "false") == "false"


def test_annotated_csv_is_packed(spark, tmp_path):
    sf = small_tables(spark, tmp_path)
    path = queries._annotated(spark, sf)
    folder = path.removeprefix("file:")
    files = [f for f in os.listdir(folder) if f.startswith("part-")]
    assert files and all(f.endswith(".csv.gz") for f in files)
    size = sum(os.path.getsize(f"{folder}/{f}") for f in files)
    assert size < 300 * 30 * 14 / 2  # less than half of the texts
    back = queries.scan_csv(spark, sf).collect()
    want = {r.message_id: r.text_md5 for r in queries.scan_messages(spark, sf).collect()}
    assert {r.message_id: r.text_md5 for r in back} == want and len(want) == 300


def folders(df):
    return {name.rpartition("/")[0].removeprefix("file://") for name in df.inputFiles()}


def test_spent_tables_are_deleted(spark):
    table = stage(spark.range(10))
    (folder,) = folders(table)
    assert os.path.isdir(folder)
    unstage(table)
    assert not os.path.exists(folder)
    design, _ = fixture(spark)
    made = []
    want = message_contexts(design.corpus, ["tree", "branch"], made)
    assert len(made) == 2 and all(os.path.isdir(f) for part in made for f in folders(part))
    got = written_contexts(design.corpus, ["tree", "branch"])
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.select(*got.columns).collect()))


def test_means_between_two_shuffles_go_with_the_stored_blocks(spark):
    design, _ = fixture(spark)
    want = sorted(map(repr, design.embedding.collect()))
    (kept,) = folders(design._between)
    assert sorted(map(repr, design.matrix("embedding").collect())) == want
    assert os.path.isdir(kept)  # read by the first matrix
    again, _ = fixture(spark)
    assert sorted(map(repr, again.matrix("embedding").collect())) == want
    assert not again._between.inputFiles() or not any(os.path.exists(f) for f in folders(again._between))
    assert sorted(map(repr, again.embedding.collect())) == want


def test_blocks_hold_no_vector_per_fit_of_contexts(spark):
    design, _ = fixture(spark)
    kinds = dict(design._stored("behaviour").dtypes)
    assert kinds["tree"] == "array<float>" and not kinds["tree_late"].startswith("map")
    rows = {r.message_id: r for r in design._stored("behaviour").collect()}
    assert len(rows) == 90
    for r in rows.values():
        for level in ("tree", "branch"):  # a whole profile, what the thread says of it, or no author
            assert (r[level] is not None) + (r[f"{level}_late"] is not None) == (r.author is not None)


def test_last_user_features_are_joined_once_for_all_fits(spark):
    design, _ = fixture(spark)
    got = design.last_user_features("combined")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("last_user") == 0
    want = design.last_user_features("combined", design.matrix("combined"))
    found = [{(r.fit, r.split, r.message_id): r.features for r in df.collect()} for df in (got, want)]
    assert found[0] == found[1] and len(found[0]) == 270


def test_units_are_written_where_the_rows_are(spark):
    design, e = fixture(spark)
    kinds = {"behaviour": ("behaviour", ""), "embedding": ("embedding", "")}
    plan = message_rows({"": design}, {"": e}, kinds)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sort [") == 2  # what an author's rows share is packed where they are dealt
    packed = units({"": design}, {"": e}, kinds)
    assert "n" in packed.table.columns and packed.table.agg({"n": "sum"}).first()[0] == 90
    seen, write = [], DataFrame.repartition
    try:
        DataFrame.repartition = lambda self, *a: seen.append(self.columns) or write(self, *a)
        units({"": design}, {"": e}, kinds)
    finally:
        DataFrame.repartition = write
    assert not [c for c in seen if "behaviour_of" in c]
