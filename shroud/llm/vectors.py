"""Vectors as fixed binary rows, and blocks of them that meet in pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame


def matrix(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray | None]]:
    """Which rows are usable (no nulls, finite), and their components as doubles."""
    if pa.types.is_null(column.type):
        return np.zeros(len(column), bool), [None] * len(column)
    column = column.cast(pa.list_(pa.float64()))
    flat, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()       # a null component is read as NaN
    bad = np.append(0, np.cumsum(~np.isfinite(flat)))
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(at) > 0) & (bad[at[1:]] == bad[at[:-1]])
    return usable, [flat[s:e] if ok else None for ok, s, e in zip(usable, at[:-1], at[1:])]


def product(left: DataFrame, right: DataFrame, meet: Column) -> DataFrame:
    """Pairs of rows (blocks of vectors) of two written tables for which ``meet`` holds: each pair of their partitions is a task
    that reads both, so nothing is shuffled.  All pairs of a row of ``left`` in a task come one after the other."""
    return left.join(right.hint("shuffle_replicate_nl"), meet)
