"""Arrow text <-> numpy code points, one library call per batch and never one per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Rows are worked on in slices of about this many bytes, so that one huge text doesn't multiply a whole batch.
SLICE_BYTES = 1 << 21


def slices(col: pa.Array, limit: int = SLICE_BYTES):
    """(start, length) pairs that cover ``col``, each of about ``limit`` bytes or one row."""
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    at = 0
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to - at
        at = to


def unpack(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows in a row, and the n + 1 row bounds in code points. Null is as empty."""
    n = len(col)
    if col.null_count:
        col = col.fill_null("")
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(bufs[2], dtype=np.uint8)[offs[0] : offs[-1]] if bufs[2] is not None and n else np.zeros(0, np.uint8)
    lead = (raw & 0xC0) != 0x80
    count = np.concatenate([[0], np.cumsum(lead)])
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    return cps, count[offs - offs[0]]


def pack(cps: np.ndarray, bounds: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The reverse of ``unpack``; ``null`` marks the rows that come out as null."""
    data = cps.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    width = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    offs = np.concatenate([[0], np.cumsum(width)])[bounds].astype(np.int32)
    valid, nulls = None, 0
    if null is not None and null.any():
        nulls = int(null.sum())
        valid = pa.py_buffer(np.packbits(~null, bitorder="little").tobytes())
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [valid, pa.py_buffer(offs.tobytes()), pa.py_buffer(data)], nulls)


def rows_of(bounds: np.ndarray) -> np.ndarray:
    """Row number of each code point."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
