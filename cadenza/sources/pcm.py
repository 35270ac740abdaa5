"""PCM and WAV files by ranges of samples: a data source whose tasks each read a stretch of a file of any size.

    pcm.register(spark)
    spark.read.format("pcm").option("path", "file:///music").load()

The driver reads the headers and nothing else. Paths are those that pyarrow opens (mounted folders, HDFS, S3, GCS), a file or a folder; for a store that only
Spark reads there is `wav.read`, which takes a file whole. Options: `samples` of a task (per channel), `first` and `count` of a range
of sample numbers, and for headerless files `rate`, `channels`, `bits`, `float`, `big_endian`. Files without samples give no rows; a cut-off last sample is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from cadenza.sources import wav

SCHEMA = "path string, rate int, channels int, sample_no long, channel int, value double"
#: Samples of a task, and of an Arrow batch, of each channel.
TASK, BATCH = 1 << 22, 1 << 15


@dataclass
class Range(InputPartition):
    path: str
    format: wav.Format
    begin: int  # byte of the first sample of the file
    first: int
    count: int


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def header(file, size: int) -> tuple[wav.Format, int, int]:
    """(format, first byte, bytes) of a WAV file's samples; reads chunk headers and the format only."""
    file.seek(0)
    head = file.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, found = 12, b""
    for _ in range(2 * wav.SKIP + 2):
        file.seek(at)
        chunk = file.read(8)
        if len(chunk) < 8:
            break
        label, length = chunk[:4], int.from_bytes(chunk[4:], "little")
        if label == b"fmt ":
            found = head + chunk + file.read(length)
        elif label == b"data" and found:
            # a whole file in small: the format as it stands, and no samples
            fmt, _ = wav.parse(found + b"\0" * (len(found) % 2) + b"data\0\0\0\0")
            return fmt, at + 8, min(length, size - at - 8)
        at += 8 + length + length % 2
    raise ValueError("no fmt or data chunk")


class PcmReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def _files(self) -> list[fs.FileInfo]:
        store, path = _opened(self.options["path"])
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        return sorted((f for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))), key=lambda f: f.path)

    def _raw(self) -> wav.Format | None:
        o = self.options
        if "bits" not in o:
            return None
        yes = lambda k: str(o.get(k, "false")).lower() == "true"
        return wav.Format(int(o.get("rate", 44100)), int(o.get("channels", 2)), int(o["bits"]), yes("float"), yes("big_endian"))

    def partitions(self) -> list[Range]:
        store, _ = _opened(self.options["path"])
        raw, out = self._raw(), []
        task, low = int(self.options.get("samples", TASK)), int(self.options.get("first", 0))
        for info in self._files():
            if raw:
                fmt, begin, length = raw, 0, info.size
            else:
                with store.open_input_file(info.path) as f:
                    fmt, begin, length = header(f, info.size)
            n = length // (fmt.bits // 8 * fmt.channels)
            high = min(n, low + int(self.options["count"])) if "count" in self.options else n
            out += [Range(info.path, fmt, begin, at, min(task, high - at)) for at in range(low, high, task)]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        store, _ = _opened(self.options["path"])
        fmt, width = part.format, part.format.bits // 8 * part.format.channels
        with store.open_input_file(part.path) as f:
            for at in range(part.first, part.first + part.count, BATCH):
                n = min(BATCH, part.first + part.count - at)
                f.seek(part.begin + at * width)
                values = wav.scaled(f.read(n * width), fmt)
                n = len(values) // fmt.channels
                rows = n * fmt.channels
                numbers = np.repeat(np.arange(at, at + n), fmt.channels), np.tile(np.arange(fmt.channels, dtype=np.int32), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.path] * rows), pa.array(np.full(rows, fmt.rate, np.int32)), pa.array(np.full(rows, fmt.channels, np.int32)), pa.array(numbers[0]), pa.array(numbers[1]), pa.array(values.astype(np.float64))],
                    names=["path", "rate", "channels", "sample_no", "channel", "value"],
                )


class PcmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PcmReader:
        return PcmReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format `pcm` known to a session."""
    spark.dataSource.register(PcmSource)
