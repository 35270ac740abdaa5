"""Streams of frames as files, each written by many tasks at once.

    placed = frame_files.placed(frames, "stream_id")
    frame_files.register(spark)
    placed.write.format("frame_files").option("path", "/shared/folder").mode("append").save()

Offsets are sums of the sizes before, in two levels, so no task sees a whole stream. A task writes its frames at their places in a hidden file, so a task that runs twice
writes the same bytes twice; when all have ended, the files get their names, and a failed job's files go. The folder must be one that
every task mounts. Frames of no bytes take no room; a stream without frames gives no file. A file of the same name is replaced.
"""

from __future__ import annotations

import os
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "name string, offset long, data binary"
#: Frames of a slot within which sizes are summed.
SLOT = 1 << 16


def placed(frames: DataFrame, stream: str, suffix: str = ".aac", header: Column | None = None, slot: int = SLOT) -> DataFrame:
    """name, offset, data of each frame; frames: stream, frame_no, data; header: bytes ahead of each frame (an expression of its columns)."""
    data = F.coalesce("data", F.lit(b"")) if header is None else F.concat(header, F.coalesce("data", F.lit(b"")))
    rows = frames.select(F.col(stream).cast("string").alias("_stream"), "frame_no", data.alias("data"), F.floor(F.col("frame_no") / slot).alias("_slot"))
    sizes = rows.groupBy("_stream", "_slot").agg(F.sum(F.octet_length("data")).alias("_bytes"))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("_stream", "_slot", F.coalesce(F.sum("_bytes").over(before("_stream").orderBy("_slot")), F.lit(0)).alias("_begin"))
    inside = rows.withColumn("_at", F.coalesce(F.sum(F.octet_length("data")).over(before("_stream", "_slot").orderBy("frame_no")), F.lit(0)))
    joined = inside.join(begins, ["_stream", "_slot"])
    return joined.select(F.concat("_stream", F.lit(suffix)).alias("name"), (F.col("_begin") + F.col("_at")).cast("long").alias("offset"), "data")


@dataclass
class Written(WriterCommitMessage):
    """Bytes that a task wrote to each file."""

    sizes: dict


class FrameWriter(DataSourceWriter):
    def __init__(self, folder: str) -> None:
        self.folder, self.job = folder.removeprefix("file://"), uuid.uuid4().hex

    def _hidden(self, name: str) -> str:
        return os.path.join(self.folder, f".{name}.{self.job}")

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.folder, exist_ok=True)
        sizes, now, out = Counter(), None, None
        for row in rows:
            if row["name"] != now:
                if out is not None:
                    os.close(out)
                if os.path.basename(row["name"]) != row["name"]:
                    raise ValueError(f"not a file name: {row['name']}")
                now, out = row["name"], os.open(self._hidden(row["name"]), os.O_CREAT | os.O_WRONLY, 0o644)
            data, at = bytes(row["data"]), row["offset"]
            sizes[now] += len(data)
            while data:
                done = os.pwrite(out, data, at)
                data, at = data[done:], at + done
        if out is not None:
            os.close(out)
        return Written(dict(sizes))

    def commit(self, messages: list) -> None:
        total: Counter = Counter()
        for m in messages:
            if m is not None:
                total.update(m.sizes)
        wrong = [n for n, size in total.items() if os.path.getsize(self._hidden(n)) != size]
        if wrong:
            self.abort(messages)
            raise OSError(f"offsets leave gaps or overlap: {wrong[:3]}")
        for name in total:
            os.replace(self._hidden(name), os.path.join(self.folder, name))

    def abort(self, messages: list) -> None:
        if os.path.isdir(self.folder):
            for name in os.listdir(self.folder):
                if name.startswith(".") and name.endswith(self.job):
                    os.remove(os.path.join(self.folder, name))


class FrameFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the format `frame_files` known to a session."""
    spark.dataSource.register(FrameFiles)
