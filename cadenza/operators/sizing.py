"""Bits of coded bands at many qualities, counted in numpy on Arrow batches; nothing is packed.

The steps and their order are those of payload.code_bands, section_words and delta_words, which do the same for rows that are sent.
Sums run from the first value on, as there, so that both take the same books.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cadenza.functions.signal import ROUNDING, STEP
from cadenza.operators import bands as B
from cadenza.operators import coding as C
from cadenza.operators import payload as P
from cadenza.plans.tables import BOOKS, ESCAPE, NOISE, ZERO

#: Rows that are counted together.
SLICE = 2000


class Bands:
    """The bands of some rows, one after the other, with what does not depend on the quality. lists: arrays of structs as grouped_bands gives them."""

    def __init__(self, lists: pa.Array, short: np.ndarray, last: np.ndarray) -> None:
        n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        parts = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
        number = {c: parts[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("group", "start", "width", "windows")}
        self.rows, self.n, self.short = len(n), n, short
        self.row = np.repeat(np.arange(len(n)), n)
        self.row_first = np.cumsum(n) - n
        begins = np.ones(len(self.row), bool)
        begins[1:] = (np.diff(self.row) != 0) | (np.diff(number["group"]) != 0)
        self.group = np.cumsum(begins) - 1
        self.x = parts["x"].flatten().to_numpy(zero_copy_only=False).astype(float)
        if not np.isfinite(self.x).all():
            raise ValueError("a spectrum has a value that is not finite")
        self.size = parts["x"].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.of = np.repeat(np.arange(len(self.size)), self.size)
        squares = self.x * self.x
        energy = np.bincount(self.of, squares, len(self.size))
        peak = np.maximum.reduceat(squares, self.first) if len(squares) else energy
        values = (number["width"] * number["windows"]).astype(float)
        total, counted = np.bincount(self.group, energy)[self.group], np.bincount(self.group, values)[self.group]
        last, narrow = last[self.row].astype(float), short[self.row]
        with np.errstate(all="ignore"):
            expected = total / last * number["width"]
            tonal = B.TONAL * np.power(energy / expected, 0.4)
            peaky = (1 - B.TONAL) * 0.45 * np.power(peak * number["windows"] / expected, 0.4)
            shape = 10.0 / (1 + (2 * number["start"] + number["width"]) / last)
            aim = (tonal + peaky) * np.where(narrow, 1.5, 1.0) * shape
        self.aim = np.where(total < B.SILENCE * counted, 0.0, aim)
        self.rms = np.sqrt(energy / values)
        self.level = np.rint(np.log10(np.maximum(energy / number["windows"], 1e-30)) * (0.5 * STEP))
        self.tuples = {k: self._tuples(k) for k in (2, 4)}

    def _tuples(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value, band) of every tuple of k values."""
        n = self.size // k
        of = np.repeat(np.arange(len(n)), n)
        return self.first[of] + k * (np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)), of


class Sizer:
    """bits(bands, quality): the bits of each row's sections, scale factors and codewords."""

    def __init__(self, codes: P.Codes, noise_level: int) -> None:
        own = {b: [n for _, n in sorted((i, n) for k, i, n, _ in codes if k == b)] for b in BOOKS}
        sizes = [len(own.get(b, ())) for b in range(max(BOOKS) + 1)]
        self.first = np.cumsum([0, *sizes])[:-1]
        self.length = np.array([n for b in BOOKS for n in own[b]], np.int64)
        self.top, self.tuple, self.signed = (np.array([0, *(BOOKS[b][i] for b in range(1, max(BOOKS) + 1))], np.int64) for i in range(3))
        self.delta = np.array([n for _, n in sorted((i, n) for k, i, n, _ in codes if k == 12)], np.int64)
        odd = list(range(1, ESCAPE, 2))
        self.edges, self.least = np.array([1, *(BOOKS[b][0] + 1 for b in odd)]), np.array([ZERO, *odd, ESCAPE])
        self.noise_level = noise_level

    def bits(self, bands: Bands, quality: float) -> np.ndarray:
        target = bands.aim * quality
        empty = (bands.rms < C.QUIET) | (target == 0)
        noisy = ~empty & (target < 0.1 * self.noise_level)
        with np.errstate(all="ignore"):
            sfac = np.where(empty, 0.0, np.rint(np.log10(target / bands.rms) * STEP))
        coded = ~empty & ~noisy & ~(sfac > 90)
        sf = np.where(empty, 0.0, np.where(noisy, bands.level, 100 - sfac)).astype(np.int64)
        book, spectrum = self._books(bands, np.where(coded, np.power(10.0, np.where(coded, sfac, 0.0) / STEP), 0.0))
        book = np.where(coded, book, np.where(noisy, NOISE, ZERO))
        return spectrum + self._sections(bands, book) + self._deltas(bands, book, sf)

    def _books(self, bands: Bands, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the cheapest book of each band, bits of each row's codewords); bands with a scale of 0 hold zeros."""
        n = len(bands.size)
        magnitude = np.floor(np.power(np.abs(bands.x) * scale[bands.of], 0.75) + ROUNDING).astype(np.int64)
        q = np.where(bands.x < 0, -magnitude, magnitude)
        first = self.least[np.searchsorted(self.edges, np.maximum.reduceat(magnitude, bands.first) if n else magnitude, "right")]
        second = np.where((first == ZERO) | (first == ESCAPE), first, first + 1)
        one, two = np.zeros(n), np.zeros(n)
        for k, (begin, of) in bands.tuples.items():
            used = (self.tuple[first] == k)[of]
            begin, of = begin[used], of[used]
            books = first[of]
            top, signed = self.top[books], self.signed[books] == 1
            base = np.where(signed, 2 * top + 1, top + 1)
            at = np.zeros(len(of), np.int64)
            for i in range(k):
                digit = q[begin + i]
                at = at * base + np.where(signed, digit + top, np.minimum(np.abs(digit), top))
            one += np.bincount(of, self.length[self.first[books] + at], n)
            two += np.bincount(of, self.length[self.first[second[of]] + at], n)
        signs = np.where(self.signed[first] == 1, 0, np.bincount(bands.of, magnitude > 0, n))
        large = np.flatnonzero((magnitude >= 16) & (first == ESCAPE)[bands.of])
        escapes = np.bincount(bands.of[large], 2 * np.frexp(magnitude[large].astype(float))[1] - 5, n)
        cost = np.where(first == ZERO, 0, np.minimum(one, two) + signs + escapes)
        return np.where(two < one, second, first), np.bincount(bands.row, cost, bands.rows).astype(np.int64)

    def _sections(self, bands: Bands, book: np.ndarray) -> np.ndarray:
        begins = np.ones(len(book), bool)
        begins[1:] = (np.diff(bands.group) != 0) | (np.diff(book) != 0)
        at = np.flatnonzero(begins)
        run, row = np.diff(np.append(at, len(book))), bands.row[at]
        cap, field = np.where(bands.short[row], 7, 31), np.where(bands.short[row], 3, 5)
        return np.bincount(row, C.BOOK_BITS + field * (run // cap + 1), bands.rows).astype(np.int64)

    def _deltas(self, bands: Bands, book: np.ndarray, sf: np.ndarray) -> np.ndarray:
        """A step a band of a row, for all rows together."""
        sent = np.flatnonzero(book != ZERO)
        gain = np.zeros(bands.rows, np.int64)
        gain[bands.row[sent[::-1]]] = sf[sent[::-1]]
        noise, heard, bits = gain - 90, np.zeros(bands.rows, bool), np.zeros(bands.rows, np.int64)
        for j in range(int(bands.n.max(initial=0))):
            rows = np.flatnonzero(bands.n > j)
            at = bands.row_first[rows] + j
            rows, at = rows[book[at] != ZERO], at[book[at] != ZERO]
            is_noise = book[at] == NOISE
            new = is_noise & ~heard[rows]
            want = sf[at] - np.where(is_noise, noise[rows], gain[rows])
            diff = np.where(new, want, np.clip(want, -C.CLAMP, C.CLAMP))
            bits[rows] += np.where(new, P.NOISE_BITS, self.delta[np.where(new, 0, diff + C.CLAMP)])
            noise[rows] += np.where(is_noise, diff, 0)
            gain[rows] += np.where(is_noise, 0, diff)
            heard[rows] |= is_noise
        return bits


def trial_bits(rows: DataFrame, codes: P.Codes, qualities: list[float], last: dict[bool, int], short: int, noise_level: int) -> DataFrame:
    """The rows with `bits` in place of bands: an array by quality.

    rows: block_type, bands (as grouped_bands gives them, without presets). last: values of a window of other blocks and of those of type `short`.
    """
    keep = [c for c in rows.columns if c != "bands"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema.fields), "bits array<int>"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizer = Sizer(codes, noise_level)
        for whole in batches:
            for begin in range(0, whole.num_rows, SLICE):
                batch = whole.slice(begin, SLICE)
                narrow = batch.column("block_type").to_numpy(zero_copy_only=False) == short
                bands = Bands(batch.column("bands"), narrow, np.where(narrow, last[True], last[False]))
                found = np.stack([sizer.bits(bands, q) for q in qualities], axis=1).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(qualities)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), lists], names=[*keep, "bits"])

    return rows.mapInArrow(count, schema)
