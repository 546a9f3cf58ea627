"""Sums and means of vectors per author inside a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .arrow import changes
from .threads import ROWS, whole


def _matrix(column, d: int) -> np.ndarray:
    """Arrays of `d` numbers as doubles; a missing component is NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _lists(values: np.ndarray, mask: np.ndarray | None = None) -> pa.ListArray:
    """A matrix as arrays; NULL where `mask`."""
    n, d = values.shape
    flat = pa.array(values.ravel(), mask=None if mask is None else mask.ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), flat)


def _joined(batches, rows: int = ROWS):
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def partial_sums(d: int):
    """(author, fold, n, total): counts and sums per component of the rows (author, fold, embedding) of a
    stretch of a task, so that a frequent author has one row per stretch and fold."""

    def run(batches):
        for table in _joined(batches):
            author = table.column("author").combine_chunks()
            code = author.dictionary_encode().indices.to_numpy().astype(np.int64)
            fold = table.column("fold").to_numpy().astype(np.int64)
            order = np.lexsort((fold, code))
            code, fold = code[order], fold[order]
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(code) != 0) | (np.diff(fold) != 0)
            at = np.flatnonzero(new)
            x = _matrix(table.column("embedding").combine_chunks(), d)[order]
            known = ~np.isnan(x)
            with np.errstate(invalid="ignore", over="ignore"):
                total = np.add.reduceat(np.where(known, x, 0.0), at, axis=0)
            n = np.add.reduceat(known.astype(np.int64), at, axis=0)
            yield pa.RecordBatch.from_arrays(
                [author.take(pa.array(order[at])), pa.array(fold[at].astype(np.int32)), _lists(n), _lists(total)],
                names=["author", "fold", "n", "total"],
            )

    return run


def fit_means(d: int, n_folds: int):
    """(author, which, vectors) from rows of `partial_sums`, sorted by author and fold: the different means
    of an author over all folds but one, and for each fit the place of its mean, NULL if there is none."""

    def run(batches):
        for batch, group in whole(batches, ["author"]):
            fold = batch.column("fold").to_numpy().astype(np.int64)
            at = np.flatnonzero(changes([pa.array(group), pa.array(fold)]))
            with np.errstate(invalid="ignore", over="ignore"):
                total = np.add.reduceat(_matrix(batch.column("total"), d), at, axis=0)
            n = np.add.reduceat(_matrix(batch.column("n"), d), at, axis=0)
            group, fold = group[at], fold[at]
            starts = np.flatnonzero(changes([pa.array(group)]))
            authors, of = len(starts), np.cumsum(changes([pa.array(group)])) - 1
            has = np.zeros((authors, n_folds), bool)
            ours = (fold >= 0) & (fold < n_folds)
            has[of[ours], fold[ours]] = True
            folds = np.bincount(of, minlength=authors)
            # the mean over all folds, for fits whose fold the author is not in, comes first
            everywhere = has.all(axis=1)
            place = np.where(has, np.cumsum(has, axis=1) - has + ~everywhere[:, None], 0)
            none = has & (folds == 1)[:, None]
            owners, kinds, sums, counts = [], [], [], []

            def add(who, kind, rows_total, rows_n):
                owners.append(who)
                kinds.append(np.full(len(who), kind))
                sums.append(rows_total)
                counts.append(rows_n)

            with np.errstate(invalid="ignore", over="ignore"):
                all_total = np.add.reduceat(total, starts, axis=0)
            all_n = np.add.reduceat(n, starts, axis=0)
            some = np.flatnonzero(~everywhere)
            add(some, 0, all_total[some], all_n[some])
            several = folds > 1
            rows = np.flatnonzero(several[of])
            for k in range(n_folds):
                who = np.flatnonzero(has[:, k] & several)
                if not len(who):
                    continue
                mine = rows[has[of[rows], k]]
                first = np.flatnonzero(changes([pa.array(of[mine])]))
                keep = (fold[mine] != k)[:, None]
                with np.errstate(invalid="ignore", over="ignore"):
                    add(who, k + 1, np.add.reduceat(np.where(keep, total[mine], 0.0), first, axis=0),
                        np.add.reduceat(np.where(keep, n[mine], 0.0), first, axis=0))
            owners, kinds = np.concatenate(owners), np.concatenate(kinds)
            order = np.lexsort((kinds, owners))
            owners, sums, counts = owners[order], np.vstack(sums)[order], np.vstack(counts)[order]
            with np.errstate(invalid="ignore", divide="ignore"):
                vectors = _lists(sums / counts, counts == 0)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=authors))])
            which = pa.array(place.ravel().astype(np.int32), mask=none.ravel())
            found = pa.RecordBatch.from_arrays(
                [
                    batch.column("author").take(pa.array(at[starts])),
                    pa.ListArray.from_arrays(pa.array(np.arange(authors + 1) * n_folds, pa.int32()), which),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), vectors),
                ],
                names=["author", "which", "vectors"],
            )
            yield found.filter(pa.array(~none.all(axis=1)))

    return run
