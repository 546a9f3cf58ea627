"""Min-max scaling and ratio expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def minmax(x: Column, low: Column, high: Column) -> Column:
    """Scale `x` into [0, 1]; a constant column becomes 1 everywhere."""
    width = high - low
    return F.when(width == 0, F.lit(1.0)).otherwise((x - low) / F.nullif(width, F.lit(0.0)))


def ratio_or_zero(x: Column, y: Column) -> Column:
    return F.coalesce(x / F.nullif(y, F.lit(0.0)), F.lit(0.0))


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))


def nullable(values: Column) -> Column:
    """Mark the elements as nullable.

    `aggregate` keeps the element nullability of its start value; without this a NULL written
    by the scaler would be read back as 0.0.
    """
    return F.transform(values, lambda v: F.nullif(v.cast("double"), F.lit(float("nan"))))


def _one_after_the_other(values: Column, n: int) -> Column:
    """Each step knows the extremes of what is scaled already, and those of the values from its own on."""
    row = nullable(values)
    lows = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array_min(F.slice(row, i, F.lit(n))))
    highs = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.array_max(F.slice(row, i, F.lit(n))))

    def step(state: Column, at: Column) -> Column:
        low, high = F.least(state["low"], at["low"]), F.greatest(state["high"], at["high"])
        scaled = (at["v"] - low) / F.nullif(high - low, F.lit(0.0))
        return F.struct(
            F.concat(state["row"], F.array(scaled)).alias("row"),
            F.least(state["low"], scaled).alias("low"), F.greatest(state["high"], scaled).alias("high"),
        )

    none = F.lit(None).cast("double")
    start = F.struct(F.slice(row, 1, 0).alias("row"), none.alias("low"), none.alias("high"))
    steps = F.arrays_zip(row.alias("v"), lows.alias("low"), highs.alias("high"))
    return F.aggregate(steps, start, step, lambda state: state["row"])


def scale_row(values: Column, n: int, mode: str = "sequential") -> Column:
    """Min-max scale an array of `n` numbers against itself.

    `sequential` scales the elements from left to right, each against a row in which the
    earlier ones are already scaled.  `standard` scales all against the original row.  A row
    whose remaining values are all equal gives NULL, which later steps skip.

    Most rows need no loop.  While the row holds a zero, the minimum stays 0 and each element
    is divided by the maximum of what is scaled before it (at most 1) and the original values
    from it on.  With a maximum of 1 that divides by 1 throughout; and if no value lies
    between 0 and 1, it divides by the maximum of the values from the element on.
    """
    low, high = F.array_min(values), F.array_max(values)
    if mode == "standard":
        return F.transform(values, lambda v: (v - low) / F.nullif(high - low, F.lit(0.0)))
    if mode != "sequential":
        raise ValueError("mode must be 'sequential' or 'standard'")
    direct = F.transform(
        values,
        lambda v, i: F.when(v == 0, 0.0).otherwise(
            v / F.array_max(F.slice(values, i + 1, F.lit(n)))
        ),
    )
    with_zero = (low == 0) & ~F.exists(values, lambda v: v.isNull())
    return (
        F.when(with_zero & (high == 1), values)
        .when(with_zero & (high > 1) & ~F.exists(values, lambda v: (v > 0) & (v < 1)), direct)
        .otherwise(_one_after_the_other(values, n))
    )


def diversity(tag_sums: Column) -> Column:
    """1 - share of the most frequent tag; 0 when there is no tag at all."""
    return F.coalesce(
        1.0 - F.array_max(tag_sums) / F.nullif(array_sum(tag_sums), F.lit(0.0)), F.lit(0.0)
    )


def rounded(x: str, digits: int) -> str:
    """SQL for `round(x, digits)` of a double, with the same result.

    `round` goes through a decimal number.  That is left to large values and to those next to a tie;
    elsewhere the nearest integer of x * 10**digits, divided by an exact power, is the same double.
    """
    scaled = f"(({x}) * 1e{digits}D)"
    return f"CASE WHEN abs({x}) < 1e6D AND abs({scaled} - rint{scaled}) < 0.499D THEN rint{scaled} / 1e{digits}D ELSE round({x}, {digits}) END"
