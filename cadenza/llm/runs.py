"""Sorted runs of integers in few bytes, and exact counts of them by ranges.

A run is the distinct sorted values that a task has gathered, as differences, beside columns of numbers that belong to them. Columns
are stored by byte planes and compressed, so a value of b bits in a run of n takes about b - log2(n) + 2 bits. The range of the values
is divided evenly into parts, a power of two of them, so that a value's first bits are its part; hashed values fill them evenly. A part's runs meet in one task at a
time, sorted by part there (Spark's sort spills), so a worker holds one part, whose size the caller sets by the number of parts. Where there are more
than FAN parts, values are dealt in two levels, first by FAN ranges and then, range by range, by part: a run always holds many values.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Values that a task gathers before it sends a run.
RUN_VALUES = 1 << 21
#: Parts that a task deals its values to at once.
FAN = 4096


def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative integers, all of one length, as compressed byte planes."""
    n, widths, planes = len(columns[0]), [], []
    for c in columns:
        c = np.ascontiguousarray(c, dtype=np.uint64)
        width = (int(c.max()).bit_length() + 7) // 8 if n else 0
        widths.append(width)
        planes.append(c.view(np.uint8).reshape(n, 8)[:, :width].T.tobytes())
    body = b"".join(planes)
    return struct.pack(f"<I{len(widths)}B", n, *widths) + (pa.compress(body, "zstd", asbytes=True) if body else b"")


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    """The columns of `pack`."""
    n, *widths = struct.unpack_from(f"<I{columns}B", blob)
    size = n * sum(widths)
    body = np.frombuffer(pa.decompress(blob[4 + columns :], size, "zstd", asbytes=True), np.uint8) if size else np.zeros(0, np.uint8)
    out, at = [], 0
    for width in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = body[at : at + n * width].reshape(width, n).T
        out.append(wide.reshape(-1).view(np.uint64))
        at += n * width
    return out


def parts_of(values: float) -> int:
    """The power of two of parts that hold a run's worth of so many values each, 64 at least."""
    return 1 << max(6, int(values // RUN_VALUES).bit_length())


def split(values: np.ndarray, parts: int, bits: int) -> Iterator[tuple[int, slice]]:
    """(part, its slice) of every part that a sorted array of values below 2**bits has values in."""
    own = values >> np.uint64(bits - parts.bit_length() + 1) if parts > 1 else np.zeros(len(values), np.uint64)
    at = starts_of(own)
    for p, lo, hi in zip(own[at].tolist(), at.tolist(), [*at[1:].tolist(), len(values)][: len(at)], strict=True):
        yield p, slice(lo, hi)


def steps(values: np.ndarray) -> np.ndarray:
    """The differences of a sorted array, the first from zero."""
    return np.diff(values, prepend=np.uint64(0))


def starts_of(values: np.ndarray) -> np.ndarray:
    """The start of each stretch of equal values of a sorted array."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted values with how often each occurs."""
    values = np.sort(values)
    at = starts_of(values)
    return values[at], np.diff(at, append=len(values)).astype(np.uint64)


def summed(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted values with the sums of their n."""
    order = np.argsort(values, kind="stable")
    values, n = values[order], n[order]
    at = starts_of(values)
    return values[at], np.add.reduceat(n, at) if len(at) else n


class Tally:
    """Counts of values that come in arrays; sends (part, blob) runs when enough have come."""

    def __init__(self, parts: int, bits: int, size: int = RUN_VALUES) -> None:
        self.parts, self.bits, self.size = parts, bits, size
        self.values: list[np.ndarray] = []
        self.n: list[np.ndarray] = []
        self.held = 0

    def add(self, values: np.ndarray, n: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
        """Take some values, sums of n or one each; the runs that are full."""
        values, n = counted(values) if n is None else summed(values, n)
        self.values.append(values)
        self.n.append(n)
        self.held += len(values)
        if self.held >= self.size:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes]]:
        values, n = summed(np.concatenate([*self.values, np.zeros(0, np.uint64)]), np.concatenate([*self.n, np.zeros(0, np.uint64)]))
        self.values, self.n, self.held = [], [], 0
        for p, at in split(values, self.parts, self.bits):
            yield p, pack(steps(values[at]), n[at])


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, values, counts) of each part of batches (part, blob) sorted by part; holds the distinct values of one part."""
    now, values, n = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    fresh: list[list[np.ndarray]] = [[], []]
    size = 0

    def merge() -> tuple[np.ndarray, np.ndarray]:
        out = summed(np.concatenate([values, *fresh[0]]), np.concatenate([n, *fresh[1]]))
        fresh[0].clear()
        fresh[1].clear()
        return out

    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if part != now:
                if now is not None:
                    yield (now, *merge())
                now, values, n, size = part, np.zeros(0, np.uint64), np.zeros(0, np.uint64), 0
            differences, counts = unpack(blob.as_py(), 2)
            fresh[0].append(np.cumsum(differences, dtype=np.uint64))
            fresh[1].append(counts)
            size += len(counts)
            if size > max(len(values), RUN_VALUES // 4):
                values, n = merge()
                size = 0
    if now is not None:
        yield (now, *merge())


def refined(batches: Iterator[pa.RecordBatch], parts: int, bits: int) -> Iterator[tuple[int, bytes]]:
    """Runs (part, blob) of fine parts, of batches of runs of coarse parts sorted by part."""
    tally = Tally(parts, bits)
    for batch in batches:
        for blob in batch.column(1):
            differences, n = unpack(blob.as_py(), 2)
            yield from tally.add(np.cumsum(differences, dtype=np.uint64), n)
    yield from tally.flush()


def dealt(rows, tasks: int):
    """Rows (part, ...) with every part in one task, sorted by part there."""
    return rows.repartition(tasks, "part").sortWithinPartitions("part")
