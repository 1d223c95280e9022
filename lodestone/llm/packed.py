"""Packed arrays: how integers travel between tasks, and what is often done to sorted ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard


def squeeze(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers as bytes, plane by plane, compressed; rising ones as differences."""
    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes)


def loose(data: bytes | pa.Buffer, kind: type, rising: bool = False) -> np.ndarray:
    """What `squeeze` took."""
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    values = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    at = starts(values)
    return at, np.diff(np.append(at, len(values)))


def cells(table: pa.Table, name: str) -> list[pa.Buffer]:
    """A binary column's values, without copies."""
    return [x.as_buffer() for chunk in table.column(name).chunks for x in chunk]


def rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.to_pybytes() if isinstance(x, pa.Buffer) else x for x in (r[i] for r in found)], f.type) for i, f in enumerate(schema)], schema=schema)


def narrow(values: np.ndarray, most: int) -> np.ndarray:
    """Row numbers in the fewest bytes that hold all below ``most``."""
    return values.astype(np.uint16 if most <= 65_536 else np.uint32)
