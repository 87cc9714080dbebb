"""Compact rows between tasks: packed numbers, grouped runs of rows, blocks of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def packed(ascending: np.ndarray) -> bytes:
    """Ascending numbers as differences, of four bytes where these fit."""
    gaps = np.diff(ascending, prepend=np.uint64(0))
    return b"\4" + gaps.astype("<u4").tobytes() if not len(gaps) or gaps.max() < 1 << 32 else b"\x08" + gaps.astype("<u8").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, "<u4" if data[0] == 4 else "<u8", offset=1), dtype=np.uint64)


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(len(b)):
            yield tuple(c[i].as_py() for c in b.columns)


def groups(rows: Iterator[tuple], size: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Runs of rows with the same first ``size`` values."""
    key, held = None, []
    for r in rows:
        if held and r[:size] != key:
            yield key, held
            held = []
        key = r[:size]
        held.append(r)
    if held:
        yield key, held


def batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def in_batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 4 << 20, most: int = 500) -> Iterator[pa.RecordBatch]:
    """Rows as record batches of about ``size`` bytes of binary columns."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += sum(len(x) for x in r if isinstance(x, bytes))
        if total >= size or len(held) >= most:
            yield batch(held, names, types)
            held, total = [], 0
    if held:
        yield batch(held, names, types)
