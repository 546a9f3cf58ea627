"""Joins and running aggregates that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..settings import DEFAULT_LIMITS, Limits, cut, stage


def lookup_join(
    probe: DataFrame,
    table: DataFrame,
    on: list[str],
    rows: int,
    how: str = "left",
    limits: Limits = DEFAULT_LIMITS,
    most: int | None = None,
) -> DataFrame:
    """Join `probe` to `table`, which has at most one row per key.

    A key is hot when more than `max(hot_rows, rows / max_hot_keys)` probe rows carry it, so there
    are at most `max_hot_keys` of them.  Their probe rows are dealt over salts and their table rows
    repeated for each salt, so there is one join, and one plan, with and without hot keys: the
    probe is computed once, written, and only its keys are read again to be counted.  Rows without a
    key match nothing and are dealt over salts too.  `rows` is an upper bound of the number of probe
    rows, `most` of those with one key; below the threshold no key can be hot and the check is skipped.
    """
    threshold = max(limits.hot_rows, rows // limits.max_hot_keys)
    if min(rows, rows if most is None else most) <= threshold:
        return probe.join(table, on, how)
    probe = stage(probe)
    known = F.lit(True)
    for key in on:
        known = known & F.col(key).isNotNull()
    counts = probe.where(known).groupBy(*on).agg(F.ceil(F.count("*") / threshold).alias("_salts"))
    hot = counts.where(F.col("_salts") > 1)
    keys = hot.collect()  # at most max_hot_keys rows
    hot = F.broadcast(probe.sparkSession.createDataFrame(keys, hot.schema))
    salts = F.when(~known, F.lit(-(-rows // threshold))).otherwise(F.coalesce("_salts", F.lit(1)))
    # the number of a row within a written file does not change when a task is repeated
    dealt = probe.withColumn("_row", F.monotonically_increasing_id()).join(hot, on, "left")
    dealt = dealt.withColumn("_salt", F.col("_row") % salts).drop("_row", "_salts")
    spread = table.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)).cast("long") - 1))
    ).drop("_salts")
    return dealt.join(spread, [*on, "_salt"], how).drop("_salt")


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """`df` cut into range partitions by `order`, with the partition's number as column `range`.

    The number never decreases along `order`, and the ranges hold about as many rows each however
    the values are spread, so it serves as a block of `running`.
    """
    return cut(df.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))


def running(
    df: DataFrame,
    keys: list[str],
    order: str,
    aggs: dict[str, tuple[str, str]],
    block: Column | None = None,
    following: dict[str, str] | None = None,
) -> DataFrame:
    """Add running aggregates (current row included) per `keys` in `order`.

    `aggs` maps an output name to ("sum" | "min" | "max", column).  `following` maps an output
    name to a column whose value in the next row of the group is wanted; that column must not
    decrease along `order`.

    With `block`, a coarse number that never decreases along `order`, a group is cut into one
    task per block: the aggregates run inside each block, and what earlier blocks of the same
    group add is carried over from one total per block.
    """
    following = following or {}

    def over(group: list[str], order_by: str, frame: str = "") -> str:
        return f"OVER (PARTITION BY {', '.join(group)} ORDER BY {order_by} {frame})"

    def columns(group: list[str]) -> list[str]:
        so_far = over(group, order, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
        return [f"{fn}({c}) {so_far} AS {name}" for name, (fn, c) in aggs.items()] + [
            f"lead({c}) {over(group, order)} AS {name}" for name, c in following.items()
        ]

    if block is None:
        return df.selectExpr("*", *columns(keys))

    df = df.withColumn("_block", block)
    group = [*keys, "_block"]
    local = df.selectExpr("*", *columns(group))
    totals = df.groupBy(*group).agg(
        *[F.expr(f"{fn}({c})").alias(f"_{name}") for name, (fn, c) in aggs.items()],
        *[F.min(c).alias(f"_{name}") for name, c in following.items()],
    )
    before = over(keys, "_block", "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    carried = totals.selectExpr(
        *group,
        *[f"{fn}(_{name}) {before} AS _{name}" for name, (fn, _) in aggs.items()],
        *[f"lead(_{name}) {over(keys, '_block')} AS _{name}" for name in following],
    )

    def merged(name: str, fn: str) -> str:
        if fn == "sum":
            return f"{name} + coalesce(_{name}, 0) AS {name}"
        return f"{'least' if fn == 'min' else 'greatest'}({name}, _{name}) AS {name}"

    return local.join(carried, group).selectExpr(
        *[c for c in df.columns if c != "_block"],
        *[merged(name, fn) for name, (fn, _) in aggs.items()],
        *[f"coalesce({name}, _{name}) AS {name}" for name in following],
    )
