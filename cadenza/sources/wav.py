"""PCM and WAV files as rows of samples.

Files are found and read by Spark (binaryFile), so any store works; a file is parsed in one task and must fit there.
Headerless files take their format as parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Format tags, and the last 14 bytes of the extensible sub-format.
PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
GUID_TAIL = bytes.fromhex("000000001000800000aa00389b71")
#: Chunks looked at before the wanted one.
SKIP = 10
SCHEMA = "path string, rate int, channels int, sample_no long, channel int, value double"


@dataclass(frozen=True)
class Format:
    rate: int = 44100
    channels: int = 2
    bits: int = 16
    is_float: bool = False
    big_endian: bool = False


def _chunk(data: bytes, at: int, label: bytes) -> tuple[int, int]:
    """(start, length) of the next chunk with a label; odd sizes are padded."""
    for _ in range(SKIP + 1):
        if at + 8 > len(data):
            break
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == label:
            return at + 8, size
        at += 8 + size + size % 2
    raise ValueError(f"no {label.decode().strip()} chunk")


def parse(data: bytes) -> tuple[Format, bytes]:
    """Format and sample bytes of a WAV file; a length field beyond the end means to the end."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, size = _chunk(data, 12, b"fmt ")
    tag, channels, rate = (int.from_bytes(data[at + a : at + b], "little") for a, b in ((0, 2), (2, 4), (4, 8)))
    bits = int.from_bytes(data[at + 14 : at + 16], "little")
    if tag == EXTENSIBLE and size >= 40:
        tag = int.from_bytes(data[at + 24 : at + 26], "little")
        if data[at + 26 : at + 40] != GUID_TAIL:
            raise ValueError("unsupported sub-format")
    if tag not in (PCM, FLOAT) or bits not in (8, 16, 24, 32) or (tag == FLOAT and bits != 32) or not channels:
        raise ValueError(f"unsupported format: tag {tag}, {bits} bits, {channels} channels")
    start, length = _chunk(data, at + size + size % 2, b"data")
    return Format(rate, channels, bits, tag == FLOAT), data[start : start + length]


def integers(raw: bytes, fmt: Format) -> np.ndarray:
    """Samples as signed numbers of their own width (unsigned 8-bit ones are centred), or floats."""
    order = ">" if fmt.big_endian else "<"
    width = fmt.bits // 8
    raw = raw[: len(raw) // (width * fmt.channels) * width * fmt.channels]
    if fmt.is_float:
        return np.frombuffer(raw, f"{order}f4").astype(np.float64)
    if width == 1:
        return np.frombuffer(raw, np.uint8).astype(np.int64) - 128
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int64)
        b = b[:, ::-1] if fmt.big_endian else b
        v = b[:, 0] | (b[:, 1] << 8) | (b[:, 2] << 16)
        return v - ((v >> 23) << 24)
    return np.frombuffer(raw, f"{order}i{width}").astype(np.int64)


def scaled(raw: bytes, fmt: Format) -> np.ndarray:
    """Samples in the range of 16-bit integers, as floats."""
    v = integers(raw, fmt)
    return v * (32768.0 if fmt.is_float else 2.0 ** (16 - fmt.bits))


def whole(raw: bytes, fmt: Format) -> np.ndarray:
    """Samples as 24-bit integers; 32-bit ones stay as they are. Floats have no such form."""
    if fmt.is_float:
        raise ValueError("float samples have no 24-bit form")
    v = integers(raw, fmt)
    return v << (24 - fmt.bits) if fmt.bits < 24 else v


def read(spark: SparkSession, path: str, raw: Format | None = None, remap: list[int] | None = None, as_int24: bool = False) -> DataFrame:
    """One row a sample of all files of a path; raw: the format of headerless files; remap: source position of each channel."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                fmt, data = (raw, bytes(content)) if raw else parse(bytes(content))
                values = (whole if as_int24 else scaled)(data, fmt).reshape(-1, fmt.channels)
                if remap:
                    values = values[:, remap]
                step = 1 << 16
                for lo in range(0, len(values), step):
                    part = values[lo : lo + step]
                    n = np.arange(lo, lo + len(part))
                    yield pd.DataFrame({"path": name, "rate": fmt.rate, "channels": fmt.channels, "sample_no": np.repeat(n, fmt.channels), "channel": np.tile(np.arange(fmt.channels), len(part)), "value": part.reshape(-1).astype(float)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, SCHEMA)


#: How picture files begin.
IMAGES = {"png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "gif": b"GIF8"}


def image_kind(head: bytes) -> str | None:
    """png, jpeg or gif, by the first bytes."""
    return next((k for k, v in IMAGES.items() if head.startswith(v)), None)
