"""Small helpers for Arrow columns inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def changes(columns: list) -> np.ndarray:
    """True where a row differs from the one before in any column; NULL equals NULL."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        here, before = c.slice(1), c.slice(0, max(n - 1, 0))
        differ = pc.or_kleene(
            pc.fill_null(pc.not_equal(here, before), False), pc.not_equal(here.is_null(), before.is_null())
        )
        new[1:] |= differ.to_numpy(zero_copy_only=False)
    return new


def ordered(column) -> np.ndarray:
    """Numbers as longs in Spark's order: NULL first, NaN last and equal to itself, one zero."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    if pa.types.is_floating(column.type):
        v = pc.fill_null(column.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False) + 0.0
        bits = np.where(np.isnan(v), np.nan, v).view(np.int64)
        out = bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))
    else:
        out = pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False)
    return np.where(missing, np.iinfo(np.int64).min, out)


def unordered(values: np.ndarray, missing: np.ndarray, kind) -> pa.Array:
    """Numbers of `ordered` as what they were; NULL where `missing`."""
    if pa.types.is_floating(kind):
        values = (values ^ ((values >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))).view(np.float64)
    return pa.array(values, mask=missing).cast(kind)
