"""Dimension tables. Long ones are made from a rule or taken as a parameter; none is read from a file."""

from __future__ import annotations

import heapq
from functools import lru_cache
from itertools import product

from pyspark.sql import DataFrame, SparkSession

#: The rates by index.
RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000]
#: Widths of the bands of long and short blocks at 44.1 and 48 kHz.
LONG_44 = [
    4, 4, 4, 4, 4, 4, 4, 4, 4, 4, 8, 8, 8, 8, 8, 8, 8, 12, 12, 12, 12, 16, 16, 20, 20, 24, 24, 28, 28,
    32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 32, 96,
]
SHORT_44 = [4, 4, 4, 4, 4, 8, 8, 8, 12, 12, 12, 16, 16, 16]
#: Largest magnitude, members of a tuple, and whether signs are in the index, of codebooks 1 to 11.
BOOKS = {1: (1, 4, True), 2: (1, 4, True), 3: (2, 4, False), 4: (2, 4, False), 5: (4, 2, True), 6: (4, 2, True), 7: (7, 2, False), 8: (7, 2, False), 9: (12, 2, False), 10: (12, 2, False), 11: (16, 2, False)}
ZERO, ESCAPE, NOISE, INTENSITY_OUT, INTENSITY = 0, 11, 13, 14, 15


def band_widths(rate: int, short: bool = False, total: int | None = None) -> list[int]:
    """Band widths: the listed ones where they hold, else by rule (a twelfth of the frequency so far, in fours)."""
    if total is None and rate in (44100, 48000):
        return SHORT_44 if short else LONG_44
    total = total or (128 if short else 1024)
    out, at = [], 0
    while at < total:
        w = max(4, 4 * round(at / 48))
        w = min(w, 32 if total > 128 else 16, total - at)
        out.append(w)
        at += w
    return out


def rate_bands(spark: SparkSession) -> DataFrame:
    """rate_index, rate, listed (whether the widths are listed values or made by the rule), long, short (arrays of sfb, start, width) of all rates."""
    rows = []
    for i, rate in enumerate(RATES):
        table = []
        for short in (False, True):
            widths = band_widths(rate, short)
            table.append([(k, sum(widths[:k]), w) for k, w in enumerate(widths)])
        rows.append((i, rate, rate in (44100, 48000), *table))
    kind = "array<struct<sfb:int,start:int,width:int>>"
    return spark.createDataFrame(rows, f"rate_index int, rate int, listed boolean, long {kind}, short {kind}")


def bands(spark: SparkSession, widths: list[int]) -> DataFrame:
    """sfb, width, start, end."""
    rows, at = [], 0
    for i, w in enumerate(widths):
        rows.append((i, w, at, at + w))
        at += w
    return spark.createDataFrame(rows, "sfb int, width int, start int, end int")


def huffman_lengths(weights: list[float]) -> list[int]:
    """Code lengths of the optimal prefix code; ties go to the earlier symbol."""
    heap = [(w, i, [i]) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    lengths = [0] * len(weights)
    serial = len(weights)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        members = a[2] + b[2]
        for i in members:
            lengths[i] += 1
        heapq.heappush(heap, (a[0] + b[0], serial, members))
        serial += 1
    return lengths


def canonical(lengths: list[int]) -> list[int]:
    """The canonical codes of given lengths."""
    codes, code, last = [0] * len(lengths), 0, 0
    for n, i in sorted((n, i) for i, n in enumerate(lengths)):
        code <<= n - last
        codes[i], last = code, n
        code += 1
    return codes


def tuple_index(book: int, values: tuple[int, ...]) -> int:
    """Place of a tuple in its codebook."""
    top, _, signed = BOOKS[book]
    base = 2 * top + 1 if signed else top + 1
    out = 0
    for v in values:
        out = out * base + (v + top if signed else v)
    return out


@lru_cache(maxsize=1)
def code_table() -> list[tuple[int, int, int, int]]:
    """(book, idx, len, code) by rule: prefix codes for tuples whose chance falls with their magnitudes.

    Books that cover the same magnitudes differ in how fast it falls. Tables of a published standard can be given in place of this.
    """
    rows = []
    for book, (top, size, signed) in BOOKS.items():
        fall = (0.9 if book % 2 else 1.6) * 2.0 / (top + 1)
        span = range(-top, top + 1) if signed else range(top + 1)
        weights = [2.0 ** -(fall * sum(map(abs, t))) for t in product(span, repeat=size)]
        lengths = huffman_lengths(weights)
        rows += [(book, i, n, c) for i, (n, c) in enumerate(zip(lengths, canonical(lengths), strict=True))]
    lengths = huffman_lengths([2.0 ** -(abs(d) / 4) for d in range(-60, 61)])
    rows += [(12, i, n, c) for i, (n, c) in enumerate(zip(lengths, canonical(lengths), strict=True))]
    return rows


def codes(spark: SparkSession, table: list[tuple[int, int, int, int]] | None = None) -> DataFrame:
    return spark.createDataFrame(table or code_table(), "book int, idx int, len int, code int")


def layout(spark: SparkSession, most: int = 8) -> DataFrame:
    """channels, use_lfe, channel, kind (single, pair, lfe), tag, is_left, partner of every layout up to `most` channels."""
    rows = []
    for n in range(1, most + 1):
        for lfe in (0, 1):
            head = 0 if n == 2 else 1
            pairs = (n - head) // 2
            for ch in range(n):
                if ch < head:
                    rows.append((n, lfe, ch, "single", 0, None, None))
                elif ch < head + 2 * pairs:
                    k = ch - head
                    rows.append((n, lfe, ch, "pair", k // 2 if k % 2 == 0 else None, k % 2 == 0, ch + 1 if k % 2 == 0 else ch - 1))
                else:
                    rows.append((n, lfe, ch, "lfe" if lfe else "single", 0 if lfe else head, None, None))
    return spark.createDataFrame(rows, "channels int, use_lfe int, channel int, kind string, tag int, is_left boolean, partner int")
