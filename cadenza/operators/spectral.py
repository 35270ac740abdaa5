"""Transforms of frames: lapped cosine transform, Fourier transform, windows, noise-shaping prediction.

Small transforms are joins with a basis table and sums; large ones run in numpy on Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cadenza.functions.signal import hann
from cadenza.operators.framing import sliding_windows

#: Fixed values of the noise-shaping filters: coefficients at most this small are dropped at the end, gain from which a filter is used, bits of a coefficient.
SMALLEST, GAIN, BITS = 0.1, 1.4, 4


def kaiser_bessel(alpha: float, size: int) -> np.ndarray:
    """Rising half (size values) of the Kaiser-Bessel derived window."""
    kernel = np.i0(math.pi * alpha * np.sqrt(1 - np.linspace(-1, 1, size + 1) ** 2))
    total = np.cumsum(kernel)
    return np.sqrt(total[:-1] / total[-1])


def cosine_basis(n: int) -> np.ndarray:
    """Rows k, columns t: 2 cos(2 pi / n (t + n0)(k + 1/2)) with n0 = (n/2 + 1) / 2."""
    t, k = np.arange(n), np.arange(n // 2)[:, None]
    return 2 * np.cos(2 * np.pi / n * (t + (n / 2 + 1) / 2) * (k + 0.5))


def lapped_by_join(samples: DataFrame, keys: list[str], n: int) -> DataFrame:
    """keys, bin, x: lapped cosine transform of long rows (pos, value) by a join with the basis (n * n / 2 rows)."""
    spark: SparkSession = samples.sparkSession
    k = spark.range(n // 2).select(F.col("id").cast("int").alias("bin"))
    basis = k.select("bin", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
    angle = 2 * math.pi / n * (F.col("pos") + (n / 2 + 1) / 2) * (F.col("bin") + 0.5)
    basis = basis.select("bin", "pos", (2 * F.cos(angle)).alias("w"))
    return samples.join(F.broadcast(basis), "pos").groupBy(*keys, "bin").agg(F.sum(F.col("value") * F.col("w")).alias("x"))


def fast_lapped(x: np.ndarray) -> np.ndarray:
    """Lapped cosine transform of rows of n samples by a complex FFT of n points."""
    n = x.shape[-1]
    t, k = np.arange(n), np.arange(n // 2)
    n0 = (n / 2 + 1) / 2
    spectrum = np.fft.fft(x * np.exp(-1j * np.pi * t / n), axis=-1)[..., : n // 2]
    return 2 * np.real(spectrum * np.exp(-2j * np.pi / n * n0 * (k + 0.5)))


def _on_arrays(rows: DataFrame, column: str, make, out: dict[str, str]) -> DataFrame:
    """Apply a numpy function to an array column, rows of equal length together; out: names and types of its results."""
    keep = [c for c in rows.columns if c != column]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != column), *(f"{k} {t}" for k, t in out.items())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(column))
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
            first = np.cumsum(n) - n
            found = []
            for size in np.unique(n[n > 0]).tolist():
                at = np.flatnonzero(n == size)
                found.append((at, make(flat[first[at][:, None] + np.arange(size)])))
            cols = [_column(len(n), [(at, np.asarray(f[j], float)) for at, f in found], t.startswith("array")) for j, t in enumerate(out.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *cols], names=[*keep, *out])

    return rows.mapInArrow(apply, schema)


def _column(rows: int, found: list[tuple[np.ndarray, np.ndarray]], nested: bool) -> pa.Array:
    """A column of so many rows from (rows' numbers, their values); rows without values are null."""
    missing = np.ones(rows, bool)
    sizes = np.zeros(rows, np.int64)
    for at, values in found:
        missing[at] = False
        sizes[at] = values.shape[1] if nested else 1
    ends = np.cumsum(sizes)
    flat = np.zeros(ends[-1] if rows else 0)
    for at, values in found:
        width = values.shape[1] if nested else 1
        flat[(ends[at] - width)[:, None] + np.arange(width)] = values.reshape(len(at), width)
    if nested:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat), mask=pa.array(missing))
    out = np.zeros(rows)
    out[~missing] = flat
    return pa.array(out, mask=missing)


def lapped(rows: DataFrame, column: str = "samples", window: int | None = None) -> DataFrame:
    """Lapped cosine transform of an array column, as `spectrum`; of each stretch of `window` samples, one after the other, where given."""

    def make(x: np.ndarray) -> list[np.ndarray]:
        return [fast_lapped(x if window is None else x.reshape(len(x), -1, window)).reshape(len(x), -1)]

    return _on_arrays(rows, column, make, {"spectrum": "array<double>"})


def short_energies(frames: DataFrame, stream: str, widths: list[int], size: int, limit: int | None = None) -> DataFrame:
    """stream, win_no (through all frames), sfb, energy of the short windows; frames: stream, frame_no, samples (arrays of `size`).

    Short blocks have sum(widths) bins. Each window takes two of them from the middle of a frame on, weighted by a Hann window and transformed.
    The first bin counts nowhere; bands that begin at or past bin `limit` are left out. Past the last frame is silence.
    """
    short = sum(widths)
    count = size // short
    after = F.lead("samples").over(Window.partitionBy(stream).orderBy("frame_no"))
    rows = frames.withColumn("after", F.coalesce(after, F.array_repeat(F.lit(0.0), size)))
    windows = sliding_windows(F.col("samples"), F.col("after"), 2 * short, short, (size - short) // 2, count)
    weighted = F.flatten(F.transform(windows, lambda w: F.transform(w, lambda x, i: x * hann(i, 2 * short))))
    found = lapped(rows.select(stream, "frame_no", weighted.alias("samples")), window=2 * short)
    sums, start = [], 0
    for width in widths:
        first = max(start, 1)
        if limit is not None and first >= limit:
            break
        sums.append((first, start + width - first))
        start += width

    def banded(w: Column) -> Column:
        return F.array(*(F.aggregate(F.slice("spectrum", w * short + (first + 1), n), F.lit(0.0), lambda s, x: s + x * x) for first, n in sums))

    rows = found.select(stream, "frame_no", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), banded)).alias("w", "e"))
    return rows.select(stream, (F.col("frame_no") * count + F.col("w")).alias("win_no"), F.posexplode("e").alias("sfb", "energy"))


def fourier(rows: DataFrame, column: str = "samples") -> DataFrame:
    """Discrete Fourier transform of an array column, as `re` and `im` (bins 0 to n/2)."""

    def make(x: np.ndarray) -> list[np.ndarray]:
        f = np.fft.rfft(x, axis=-1)
        return [f.real, f.imag]

    return _on_arrays(rows, column, make, {"re": "array<double>", "im": "array<double>"})


def overlapped(previous: Column, current: Column, block: Column, size: int, short: int) -> Column:
    """Two frames windowed for the transform of a long block; block: 0 long, 1 long to short, 3 short to long.

    The slopes of the window are sines over `size` samples, or over `short` ones in the middle of a flat stretch. Eight short
    blocks (2) have windows of their own, see `short_blocks`; here they raise.
    """
    flat = (size - short) // 2
    block = F.when(block == 2, F.raise_error(F.lit("short blocks: use short_blocks")).cast("int")).otherwise(block)

    def slope(i: Column, narrow: Column) -> Column:
        wide = F.sin(math.pi / (2 * size) * (i + 0.5))
        edge = F.when(i < flat, 0.0).when(i >= flat + short, 1.0).otherwise(F.sin(math.pi / (2 * short) * (i - flat + 0.5)))
        return F.when(narrow, edge).otherwise(wide)

    rise = F.transform(previous, lambda x, i: x * slope(i, block == 3))
    fall = F.transform(current, lambda x, i: x * slope(F.lit(size - 1) - i, block == 1))
    return F.concat(rise, fall)


def short_blocks(previous: Column, current: Column, size: int, short: int) -> Column:
    """Two frames cut into the size / short windows of short blocks, each of two blocks weighted by sine slopes, one after the other.

    The windows follow each other by `short` samples around the middle of the two frames; `lapped` with window=2 * short transforms them.
    """
    cut = sliding_windows(previous, current, 2 * short, short, (size - short) // 2, size // short)
    return F.flatten(F.transform(cut, lambda w: F.transform(w, lambda x, i: x * F.sin(math.pi / (2 * short) * (i + 0.5)))))


def prediction(x: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gain, reflection coefficients, quantized ones, residual) of a linear predictor for each row."""
    rows, n = x.shape
    lags = np.stack([(x[:, : n - k] * x[:, k:]).sum(1) for k in range(order + 1)], 1)
    error = lags[:, 0].copy()
    a = np.zeros((rows, order + 1))
    a[:, 0] = 1
    reflection = np.zeros((rows, order))
    live = error > 0
    for m in range(1, order + 1):
        acc = (a[:, :m] * lags[:, m:0:-1]).sum(1)
        k = np.where(live & (error > 0), -acc / np.where(error > 0, error, 1), 0.0)
        reflection[:, m - 1] = k
        a[:, 1 : m + 1] = a[:, 1 : m + 1] + k[:, None] * a[:, m - 1 :: -1][:, :m]
        error = error * (1 - k * k)
    gain = np.where(live, lags[:, 0] / np.where(error > 0, error, 1), 0.0)
    index, value = quantize_reflection(reflection)
    big = np.abs(value) > SMALLEST
    used = np.where(big.any(1), order - big[:, ::-1].argmax(1), 0)
    value = np.where(np.arange(order)[None] < used[:, None], value, 0.0)
    b = step_up(value)
    residual = x.copy()
    for m in range(1, order + 1):
        residual[:, m:] += b[:, m : m + 1] * x[:, : n - m]
    apply = (gain > GAIN)[:, None]
    return gain, reflection, np.where(np.arange(order)[None] < used[:, None], index, 0), np.where(apply, residual, x)


def quantize_reflection(k: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(index, value) of reflection coefficients on an arcsine scale."""
    factor = np.where(k >= 0, (2 ** (bits - 1) - 0.5) / (np.pi / 2), (2 ** (bits - 1) + 0.5) / (np.pi / 2))
    index = np.trunc(np.where(k >= 0, 0.5, -0.5) + np.arcsin(np.clip(k, -1, 1)) * factor)
    return index, np.sin(index / factor)


def step_up(k: np.ndarray) -> np.ndarray:
    """Predictor coefficients (with a leading 1) from reflection coefficients, row by row."""
    a = np.zeros((k.shape[0], k.shape[1] + 1))
    a[:, 0] = 1
    for m in range(1, k.shape[1] + 1):
        a[:, 1 : m + 1] = a[:, 1 : m + 1] + k[:, m - 1 : m] * a[:, m - 1 :: -1][:, :m]
    return a


def noise_shaping(rows: DataFrame, order: int, column: str = "spectrum", span: tuple[int, int] | None = None) -> DataFrame:
    """gain, reflection, indices, residual of the predictor along each spectrum; a gain up to GAIN leaves it as it is.

    With a span (first bin, end bin) the predictor sees and filters these bins only. Spectra of short blocks are not shaped: leave their rows out.
    """
    out = {"gain": "double", "reflection": "array<double>", "indices": "array<double>", "residual": "array<double>"}

    def make(x: np.ndarray) -> list[np.ndarray]:
        lo, hi = span or (0, x.shape[1])
        gain, reflection, index, residual = prediction(x[:, lo:hi], order)
        return [gain, reflection, index, np.concatenate([x[:, :lo], residual, x[:, hi:]], 1)]

    return _on_arrays(rows, column, make, out)


def shaping_span(starts: list[int], n_bands: int, least: int, most: int) -> tuple[int, int, int]:
    """(first bin, end bin, length in bands) of the filter; starts: of every band and the end, least and most: the rate's band limits."""
    lo, hi = max(min(least, most, n_bands), 0), max(min(n_bands, most), 0)
    return starts[lo], starts[max(lo, hi)], n_bands - least


def shaping_order(rate_index: Column, short: Column, mpeg2: Column) -> Column:
    """Predictor order by rate, block and format version."""
    return F.when(short, 7).when(mpeg2 | (rate_index <= 5), 12).otherwise(20)


def autocorrelation(bins: DataFrame, keys: list[str], order: int) -> DataFrame:
    """keys, lag, r for lags 0 to order of long rows (bin, x): each row meets itself and its `order` followers."""
    a = bins.select(*keys, "bin", "x", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("lag")).withColumn("other", F.col("bin") + F.col("lag"))
    b = bins.select(*keys, F.col("bin").alias("other"), F.col("x").alias("y"))
    return a.join(b, [*keys, "other"]).groupBy(*keys, "lag").agg(F.sum(F.col("x") * F.col("y")).alias("r"))
