"""Minimum and maximum over all intervals that cover a position, without pairing them.

Keys that are not too large for one task are resolved there, after one shuffle.  For larger ones:
Every interval is cut into O(log n) aligned power-of-two nodes, every position lies in O(log n)
such nodes, so an equi-join on the node replaces the interval join.  Nodes are aggregated
before the join, and the result grows as n log n however many intervals overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.threads import interval_extremes
from ..settings import DEFAULT_LIMITS, Limits

# node number = 2**(TOP - level) + (position >> level); distinct over all levels
TOP = 40


def _node(level: str, index: str) -> str:
    return f"shiftleft(1L, {TOP} - ({level})) + ({index})"


def cover(low: str, high: str) -> str:
    """Array of the nodes that together cover [low, high), as an expression."""
    left = f"shiftright({low} + shiftleft(1L, k) - 1L, k)"
    right = f"shiftright({high}, k)"
    return f"""filter(flatten(transform(
              sequence(0, length(bin({high} - {low})) - 1),
              k -> array(
                case when {left} < {right} and {left} % 2 = 1 then {_node('k', left)} end,
                case when {left} < {right} and {right} % 2 = 1
                     then {_node('k', right + ' - 1')} end))),
            n -> n is not null)"""


def nodes_above(position: str, first: str, last: str) -> str:
    """Array of the nodes that contain `position` from level `first` to level `last`."""
    return f"transform(sequence({first}, {last}), k -> {_node('k', f'shiftright({position}, k)')})"


def covering_extremes(
    intervals: DataFrame,
    points: DataFrame,
    keys: list[str],
    values: list[str],
    span: int,
    limits: Limits = DEFAULT_LIMITS,
    in_tasks: bool = True,
) -> DataFrame:
    """For each point, `lo_<v>` and `hi_<v>`: extremes of `v` over the intervals covering it.

    `intervals` has `keys`, `lo`, `hi` (lo < hi) and `values`; `points` has `keys`, `pos` and
    `size`, where positions of a key lie in [0, size) and no interval of it ends beyond `size`.
    `span` is an upper bound of all sizes.  Points covered by nothing are not returned.

    Keys of up to 2**block_bits positions are resolved inside a task each; where others occur,
    `intervals` needs `size` too to be told apart, else all are cut into nodes.  A key with more than
    2**fine_bits positions is then resolved in two steps, first once per block of positions and then
    inside the blocks, so no node is probed by more than a block's rows.
    """
    most = 1 << limits.block_bits
    if not in_tasks:
        return _by_nodes(intervals, points, keys, values, span, limits)
    if span <= most:
        return _in_tasks(intervals, points, keys, values)
    if "size" in intervals.columns:
        small, large = F.col("size") <= most, F.col("size") > most
        far = _by_nodes(intervals.where(large), points.where(large), keys, values, span, limits)
        return _in_tasks(intervals.where(small), points.where(small), keys, values).unionByName(far)
    return _by_nodes(intervals, points, keys, values, span, limits)


def _in_tasks(intervals: DataFrame, points: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The extremes of keys that fit into a task: intervals and points of a key meet there."""
    kinds = {f.name: f.dataType.simpleString() for f in [*intervals.schema.fields, *points.schema.fields]}
    spans = intervals.where("lo < hi").select(*keys, "lo", "hi", *[F.col(v).alias(f"_{v}") for v in values])
    rows = spans.unionByName(points, allowMissingColumns=True).na.drop(subset=keys)
    order = [*keys, "pos", *[c for c in points.columns if c not in (*keys, "pos")]]
    inputs = [f"_{v}" for v in values]
    schema = [f"`{c}` {kinds[c]}" for c in points.columns]
    schema += [f"`{side}__{v}` {kinds[v]}" for side in ("lo", "hi") for v in values]
    found = rows.repartition(*keys).sortWithinPartitions(*order).mapInArrow(
        interval_extremes(keys, points.columns, inputs), ", ".join(schema)
    )
    return found.withColumnsRenamed({f"{side}__{v}": f"{side}_{v}" for side in ("lo", "hi") for v in values})


def _by_nodes(
    intervals: DataFrame, points: DataFrame, keys: list[str], values: list[str], span: int, limits: Limits
) -> DataFrame:
    names = [f"lo_{v}" for v in values] + [f"hi_{v}" for v in values]
    extremes = [F.expr(f"{'min' if n.startswith('lo_') else 'max'}({n}) AS {n}") for n in names]
    pieces = intervals.where("lo < hi").selectExpr(
        *keys,
        f"explode({cover('lo', 'hi')}) AS node",
        *[f"{v} AS lo_{v}" for v in values],
        *[f"{v} AS hi_{v}" for v in values],
    )
    nodes = pieces.groupBy(*keys, "node").agg(*extremes)
    top = "length(bin(size)) - 1"

    fine = limits.fine_bits
    if span > 1 << fine:
        blocks = (
            points.where(f"size > {1 << fine}")
            .select(*keys, F.expr(f"shiftright(pos, {fine})").alias("block"), "size")
            .distinct()
        )
        above = nodes_above(
            f"shiftleft(block, {fine})", str(fine + 1), f"greatest({fine + 1}, {top})"
        )
        probes = blocks.selectExpr(*keys, "block", f"explode({above}) AS node")
        resolved = (
            probes.join(nodes, [*keys, "node"])
            .groupBy(*keys, "block")
            .agg(*extremes)
            .select(*keys, F.expr(_node(str(fine), "block")).alias("node"), *names)
        )
        coarse = F.col("node") < (1 << (TOP - fine))
        nodes = nodes.where(~coarse).unionByName(resolved).groupBy(*keys, "node").agg(*extremes)
        top = f"least({fine}, {top})"

    probes = points.selectExpr("*", f"explode({nodes_above('pos', '0', top)}) AS node")
    return (
        probes.join(nodes, [*keys, "node"])
        .groupBy(*points.columns)
        .agg(*extremes)
    )
