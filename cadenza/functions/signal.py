"""Column functions of frame-oriented signal analysis; all run inside whole-stage code generation."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The lowest rate of each rate index, descending; lower rates have the last index.
RATE_STARTS = [92017, 75132, 55426, 46009, 37566, 27713, 23004, 18783, 13856, 11502, 9391]
FRAME, SHORT = 1024, 128
#: Fixed value: what is added before truncation when a spectrum is quantized.
ROUNDING = 0.4054
#: Quantizer steps a decade: one over log10 of the fourth root of two.
STEP = 1 / math.log10(2**0.25)


def rate_index(rate: Column) -> Column:
    """Index of a sampling rate, 0 (highest) to 11."""
    return reduce(lambda c, i: c.when(rate >= RATE_STARTS[i], i), range(1, len(RATE_STARTS)), F.when(rate >= RATE_STARTS[0], 0)).otherwise(len(RATE_STARTS))


def max_bitrate(rate: Column) -> Column:
    """Bits a second when every frame has the largest size."""
    return F.floor(F.lit(8192.0 * 8) * rate / FRAME).cast("long")


def min_bitrate() -> Column:
    return F.lit(8000).cast("long")


def reservoir_bits(bitrate: Column, rate: Column) -> Column:
    """Largest bit reservoir of a channel."""
    return (F.lit(6144) - F.floor(bitrate / rate * FRAME)).cast("long")


def allocated_bits(entropy: Column, short: Column) -> Column:
    """Bits that a perceptual entropy asks for."""
    want = F.when(short, 0.6 * entropy + 24.0 * F.sqrt(entropy)).otherwise(0.3 * entropy + 6.0 * F.sqrt(entropy))
    return F.floor(F.least(F.greatest(want, F.lit(0.0)), F.lit(6144.0)) + 0.5).cast("long")


def hann(i: Column, size: int) -> Column:
    """Hann weight of sample i, 0 at both ends of `size` samples (symmetric about their middle)."""
    return 0.5 * (1 - F.cos(2 * math.pi * (i + 0.5) / size))


def sine_window(i: Column, size: int) -> Column:
    """Rising half of the sine window: sample i of `size`."""
    return F.sin(math.pi / (2 * size) * (i + 0.5))


def quantize(x: Column, scale: Column | float = 1.0) -> Column:
    """Companded quantizer: sign(x) * trunc((|x| * scale) ** 0.75 + ROUNDING)."""
    return (F.signum(x) * F.floor(F.pow(F.abs(x) * scale, F.lit(0.75)) + ROUNDING)).cast("int")


def escape_bits(value: Column) -> Column:
    """Length of the escape word of a magnitude of 16 and more; null where it is too large to code."""
    prefix = F.floor(F.log2(F.greatest(value, F.lit(16)).cast("double") + 0.5)) - 4
    return F.when(value < 8192, (2 * prefix + 5).cast("int"))


def container_time(ts: Column) -> Column:
    """Seconds since 1904 of a timestamp."""
    return F.unix_timestamp(ts) + 2082844800
