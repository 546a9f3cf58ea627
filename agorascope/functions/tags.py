"""Tags of messages without history inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def scale_rows(x: np.ndarray, mode: str = "sequential") -> np.ndarray:
    """`scale_row` of every row of a matrix, with NaN for NULL."""
    with np.errstate(invalid="ignore", divide="ignore"):
        if mode == "standard":
            low, high = np.fmin.reduce(x, axis=1), np.fmax.reduce(x, axis=1)
            return (x - low[:, None]) / np.where(high == low, np.nan, high - low)[:, None]
        if mode != "sequential":
            raise ValueError("mode must be 'sequential' or 'standard'")
        # extremes of the values from each one on, and of what is scaled already
        lows = np.fmin.accumulate(x[:, ::-1], axis=1)[:, ::-1]
        highs = np.fmax.accumulate(x[:, ::-1], axis=1)[:, ::-1]
        out, low, high = np.empty_like(x), np.full(len(x), np.nan), np.full(len(x), np.nan)
        for i in range(x.shape[1]):
            least, most = np.fmin(low, lows[:, i]), np.fmax(high, highs[:, i])
            out[:, i] = (x[:, i] - least) / np.where(most == least, np.nan, most - least)
            low, high = np.fmin(low, out[:, i]), np.fmax(high, out[:, i])
        return out


def _matrix(column, width: int) -> np.ndarray:
    """Arrays as rows, NaN for what is missing."""
    out = np.full((len(column), width), np.nan)
    known = column.is_valid().to_numpy(zero_copy_only=False)
    flat = column.drop_null().flatten().cast(pa.float64())
    out[known] = flat.to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def scaled_sums(n_tags: int, mode: str):
    """(fit, sums, counts) of a batch's scaled rows (fit, tags)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            scaled = scale_rows(_matrix(batch.column("tags"), n_tags), mode)
            fits, of = np.unique(batch.column("fit").to_numpy(), return_inverse=True)
            sums, counts = np.zeros((len(fits), n_tags)), np.zeros((len(fits), n_tags), np.int64)
            np.add.at(sums, of, np.nan_to_num(scaled))
            np.add.at(counts, of, ~np.isnan(scaled))
            yield pa.RecordBatch.from_arrays(
                [pa.array(fits.astype(np.int32)), pa.array(list(sums)), pa.array(list(counts))], names=["fit", "sums", "counts"]
            )

    return run


def left_out(kept: list[str], n_tags: int, means: dict[int, tuple], mode: str):
    """The columns `kept`, fit and tag_sums, for each fit of `means`: the scaled tags of the author's other
    training messages, or the mean over the authors without one that has no other.

    Rows have own_tags, fold (-1: every fit trains on the message) and `known`, a list of the author's (fit, n,
    tags); `means` are sums and counts over the authors of a fit."""

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            own = batch.column("own_tags")
            nothing = own.is_null().to_numpy(zero_copy_only=False)
            own = np.nan_to_num(_matrix(own, n_tags))
            fold = batch.column("fold")
            placed = fold.is_valid().to_numpy(zero_copy_only=False)
            fold = pc.fill_null(fold, -1).to_numpy(zero_copy_only=False)
            known = batch.column("known")
            sizes = pc.fill_null(pc.list_value_length(known), 0).to_numpy(zero_copy_only=False)
            row, entries = np.repeat(np.arange(rows), sizes), known.flatten()
            fits = entries.field("fit").to_numpy(zero_copy_only=False)
            for k, (mean_sums, mean_counts) in means.items():
                mine = np.flatnonzero(fits == k)
                theirs = entries.take(pa.array(mine))
                total, n = np.full((rows, n_tags), np.nan), np.full(rows, np.nan)
                total[row[mine]] = _matrix(theirs.field("tags"), n_tags)
                n[row[mine]] = theirs.field("n").to_numpy(zero_copy_only=False)
                trained = np.where(placed, fold != k, np.nan)
                more, alone = n > trained, n == trained
                out = np.empty((rows, n_tags))
                out[more] = scale_rows(total[more] - own[more] * trained[more, None], mode)
                # what the author adds to the mean goes with the author's only message
                added = np.full((rows, n_tags), np.nan)
                added[alone] = scale_rows(total[alone], mode)
                added, counts = added[~more], mean_counts - ~np.isnan(added[~more])
                with np.errstate(invalid="ignore", divide="ignore"):
                    out[~more] = np.where(counts == 0, np.nan, (mean_sums - np.nan_to_num(added)) / counts)
                values = pa.array(np.nan_to_num(out).ravel())
                ends = pa.array(np.arange(rows + 1) * n_tags, pa.int32(), mask=np.append(nothing & more, False))
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in kept], pa.array(np.full(rows, k, np.int32)), pa.ListArray.from_arrays(ends, values)],
                    names=[*kept, "fit", "tag_sums"],
                )

    return run
