"""Steps over whole threads inside a task, for threads that are not too large for one.

Rows come sorted by thread, so a batch holds many threads, and vector operations work on all of them
together; only the last thread of a batch waits for the next one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .arrow import changes, ordered, unordered

# rows worked on together, at least
ROWS = 1 << 16


def whole(batches, keys: list[str]):
    """(batch, number of each row's group) with every group of `keys` complete."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < ROWS:
            continue
        joined = _joined(held)
        new = changes([joined.column(c) for c in keys])
        last = int(np.flatnonzero(new)[-1])
        if last:
            yield joined.slice(0, last), np.cumsum(new[:last]) - 1
        held, rows = [joined.slice(last)], 0
    if held:
        joined = _joined(held)
        yield joined, np.cumsum(changes([joined.column(c) for c in keys])) - 1


def _joined(held: list) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else held[0]


def _longs(batch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _known(batch, name: str) -> np.ndarray:
    return batch.column(name).is_valid().to_numpy(zero_copy_only=False)


def interval_extremes(keys: list[str], points: list[str], values: list[str]):
    """Rows with lo and hi are intervals, the others points; gives each different point that intervals
    of its group cover, with the extremes over these intervals.

    An interval is two stretches of 2**k points, which may overlap; from the longest on, stretches are
    handed down to their halves.
    """

    def run(batches):
        for batch, group in whole(batches, keys):
            is_span = _known(batch, "lo")
            at = np.flatnonzero(~is_span)
            found = batch.take(pa.array(at))
            once = changes([found.column(c) for c in points])
            at, found = at[once], found.filter(pa.array(once))
            spans, of = batch.filter(pa.array(is_span)), group[is_span]
            # places of the points in all groups, side by side
            edge = 1 + max([int(_longs(x, c).max(initial=0)) for x, c in ((found, "pos"), (spans, "hi"))])
            axis = group[at] * edge + _longs(found, "pos")
            low, high = (np.searchsorted(axis, of * edge + _longs(spans, c)) for c in ("lo", "hi"))
            some = high > low
            low, high = low[some], high[some]
            if not len(low):
                continue
            level = np.frexp((high - low).astype(float))[1] - 1
            right = high - (np.int64(1) << level)
            covered = np.bincount(low, minlength=len(at) + 1) - np.bincount(high, minlength=len(at) + 1)
            keep = np.cumsum(covered)[:-1] > 0
            out = [found.column(c).filter(pa.array(keep)) for c in points]
            for best, empty in ((np.minimum, np.iinfo(np.int64).max), (np.maximum, np.iinfo(np.int64).min)):
                for name in values:
                    column = spans.column(name)
                    v, known = ordered(column)[some], _known(spans, name)[some]
                    side = np.full(len(at), empty)
                    for k in range(int(level.max()), -1, -1):
                        here = known & (level == k)
                        for start in (low, right):
                            best.at(side, start[here], v[here])
                        if k:
                            half = 1 << (k - 1)
                            side[half:] = best(side[half:], side[:-half])
                    out.append(unordered(side[keep], side[keep] == empty, column.type))
            names = [*points, *[f"lo_{v}" for v in values], *[f"hi_{v}" for v in values]]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return run


NUMBERED = "message_id long, tree_id {}, up long, depth long, size long, pre long, thread_size long"


def number(batches):
    """Link, depth, subtree size and preorder number of the messages of whole threads; `depth` is NULL
    where the links of a message end in a cycle."""
    for batch, group in whole(batches, ["tree_id"]):
        n, ids, parent = batch.num_rows, _longs(batch, "message_id"), _longs(batch, "parent")
        order = np.argsort(ids, kind="stable")
        place = np.minimum(np.searchsorted(ids, parent, sorter=order), n - 1)
        target = order[place]
        linked = (ids[target] == parent) & (group[target] == group)
        linked &= _known(batch, "parent") & (parent != -1) & _known(batch, "tree_id")
        up = np.where(linked, target, -1)
        depth, size, reach, to = linked.astype(np.int64), np.ones(n, np.int64), 1, up.copy()
        jumps = []
        while (moving := np.flatnonzero(to >= 0)).size and reach <= 2 * n:
            there = to[moving]
            jumps.append((moving, there))
            size = size + np.bincount(there, size[moving], n).astype(np.int64)
            depth[moving] += depth[there]
            to[moving] = to[there]
            reach *= 2
        bad = to >= 0
        walk = np.lexsort((ids, up, group))
        total = np.cumsum(size[walk])
        first = np.ones(n, bool)
        first[1:] = (np.diff(group[walk]) != 0) | (np.diff(up[walk]) != 0)
        before = total - size[walk]
        pre = np.empty(n, np.int64)
        pre[walk] = before - before[np.flatnonzero(first)][np.cumsum(first) - 1]
        pre += linked
        for moving, there in jumps:
            pre[moving] += pre[there]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("message_id"), batch.column("tree_id"), pa.array(ids[target], mask=~linked),
                pa.array(depth, mask=bad), pa.array(size), pa.array(pre), pa.array(np.bincount(group)[group]),
            ],
            names=["message_id", "tree_id", "up", "depth", "size", "pre", "thread_size"],
        )


def _along(x: np.ndarray, to: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of rows over themselves and all that `to` leads to (-1: nothing), and where they have no
    value; `lost` and `to` are worked on in place."""
    known = ~np.isnan(x)
    total, count = np.where(known, x, 0.0), known.astype(np.int64)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        while (moving := np.flatnonzero(to >= 0)).size:
            there = to[moving]
            total[moving] += total[there]
            count[moving] += count[there]
            lost[moving] |= lost[there]
            to[moving] = to[there]
        return total / count, count == 0


def both_means(d: int, kept: list[str]):
    """The columns `kept` and mean_tree, mean_branch: means over the author's rows so far in the thread, and
    over a message and all it reaches by `at`, the `lo` of the next one. A message without author or vector
    has none; nor has one that reaches another without a vector, for the branch."""

    def run(batches):
        for batch, group in whole(batches, ["tree_id"]):
            n, found = batch.num_rows, []
            column = batch.column("embedding")
            rows = np.flatnonzero(_known(batch, "embedding") & _known(batch, "author"))
            x = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            part, of = batch.take(pa.array(rows)), group[rows]
            if len(rows):
                who = part.column("author").dictionary_encode().indices.to_numpy(zero_copy_only=False)
                ids = _longs(part, "message_id")
                order = np.lexsort((ids, who, of))
                new = np.ones(len(rows), bool)
                new[1:] = (np.diff(of[order]) != 0) | (np.diff(who[order]) != 0)
                # rows of one id, where it repeats, all follow the first row of the id before
                first = new.copy()
                first[1:] |= np.diff(ids[order]) != 0
                start = np.flatnonzero(first)
                before = np.concatenate([[-1], order[start[:-1]]])
                to = np.empty(len(rows), np.int64)
                to[order] = np.where(new[start], -1, before)[np.cumsum(first) - 1]
                found.append((*_along(x, to, np.zeros(len(rows), bool)), np.zeros(len(rows), bool)))
                lo, at, linked = _longs(part, "lo"), _longs(part, "at"), _known(part, "at")
                edge = 1 + max(int(lo.max()), int(at.max()))
                axis, target = of * edge + lo, of * edge + at
                by_place = np.argsort(axis)
                place = by_place[np.minimum(np.searchsorted(axis, target, sorter=by_place), len(rows) - 1)]
                lost = linked & (axis[place] != target)
                found.append((*_along(x, np.where(linked & ~lost, place, -1), lost), lost))
            out = []
            for mean, empty, lost in found or [(x, x == x, np.zeros(0, bool))] * 2:
                values = pa.array(mean.astype(np.float32).ravel(), mask=empty.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * d, pa.int32()), values)
                back = np.full(n, -1)
                back[rows[~lost]] = np.flatnonzero(~lost)
                out.append(lists.take(pa.array(back, mask=back < 0)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *out], names=[*kept, "mean_tree", "mean_branch"])

    return run


def chain_means(d: int):
    """(message_id, mean): element-wise means over a message and all it reaches by `at`, the `lo` of the
    next one in its thread. Only additions, of what is really reached; a message that reaches one
    without a row is left out."""

    def run(batches):
        for batch, group in whole(batches, ["tree_id"]):
            n, lo, at = batch.num_rows, _longs(batch, "lo"), _longs(batch, "at")
            edge = 1 + max(int(lo.max()), int(at.max()))
            low = min(int(lo.min()), int(at.min()))
            axis = group * (edge - low) + lo - low  # rows are sorted by thread and lo
            target = group * (edge - low) + at - low
            place = np.minimum(np.searchsorted(axis, target), n - 1)
            linked = _known(batch, "at")
            lost = linked & (axis[place] != target)  # the next one has no vector
            to = np.where(linked & ~lost, place, -1)
            flat = batch.column("embedding").flatten()
            mean, empty = _along(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, d), to, lost)
            values = pa.array(mean.ravel(), mask=empty.ravel())
            rows = pa.ListArray.from_arrays(pa.array(np.arange(0, n * d + 1, d), pa.int32()), values)
            found = pa.RecordBatch.from_arrays([batch.column("message_id"), rows], names=["message_id", "mean"])
            yield found.filter(pa.array(~lost))

    return run
