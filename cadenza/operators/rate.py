"""Rate statistics and rate control."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the feedback: misses that are let pass, share of a miss that is made up for, limits of the quality.
SLACK, HALF, LEAST, MOST = 0.1, 0.5, 10.0, 5000.0
#: Maps that are composed in one row.
BLOCK = 32


def stream_stats(frames: DataFrame, stream: str, rate: int, frame: int = 1024) -> DataFrame:
    """Frames, bytes, largest frame, average and largest bit rate of each stream; frames: stream, frame_no, bytes.

    The largest rate is over tumbling windows of as many frames as fill a second; a window that is not full does not count, and without
    a full window the average stands in.
    """
    per = -(-rate // frame)
    whole = frames.groupBy(stream).agg(F.count("*").alias("n_frames"), F.sum("bytes").alias("total_bytes"), F.max("bytes").alias("max_frame"))
    windows = frames.groupBy(stream, F.floor(F.col("frame_no") / per).alias("w")).agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    best = windows.where(F.col("n") == per).groupBy(stream).agg(F.max(F.floor(F.col("b") * (8.0 * rate) / (per * frame))).cast("long").alias("best"))
    average = F.floor(F.col("total_bytes") * 8.0 * rate / (F.col("n_frames") * frame)).cast("long")
    return whole.join(best, stream, "left").select(stream, "n_frames", "total_bytes", "max_frame", average.alias("average_rate"), F.coalesce("best", average).alias("max_rate"))


def next_quality(quality: float, wanted: float, bits: float) -> float:
    """Quality after a frame: half of what the miss asks for, unless it is within a tenth; a step of at most what remains of it."""
    fix = wanted / bits if bits > 0 else 1.0
    fix = fix + SLACK if fix < 1 - SLACK else fix - SLACK if fix > 1 + SLACK else 1.0
    fix = (fix - 1.0) * HALF + 1.0
    return min(max(quality * fix, LEAST), MOST)


def corrected(quality: Column, wanted: float, bits: Column) -> Column:
    """next_quality of columns; bits are above zero."""
    miss = wanted / bits
    fix = F.when(miss < 1 - SLACK, miss + SLACK).when(miss > 1 + SLACK, miss - SLACK).otherwise(1.0)
    return F.least(F.greatest(quality * ((fix - 1.0) * HALF + 1.0), F.lit(LEAST)), F.lit(MOST))


def follow(maps: DataFrame, stream: str, start: int, block: int = BLOCK) -> DataFrame:
    """stream, frame_no, state before each frame, from `start` on; maps: stream, frame_no, map (array: the state after, by the state before).

    A parallel prefix: the maps of `block` frames in a row are composed to one, these are followed the same way, and each block's states
    come from the state at its begin. A stream's blocks are rows of their own, so one long stream spreads; the number of rounds is the logarithm of the
    longest stream to the base `block`. maps should be a written table: each round reads it, or what it was composed to, twice.
    """
    blocks = maps.groupBy(stream, F.floor(F.col("frame_no") / block).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("frame_no", "map"))).alias("l"))  # `block` members
    if (maps.agg(F.max("frame_no")).first()[0] or 0) < block:
        begun = blocks.withColumn("state", F.lit(start))
    else:
        whole = F.aggregate(F.slice("l", F.lit(2), F.size("l") - 1), F.get("l", F.lit(0))["map"], lambda done, m: F.transform(done, lambda s: F.get(m["map"], s)))
        upper = follow(blocks.select(stream, F.col("_block").alias("frame_no"), whole.alias("map")), stream, start, block)
        begun = blocks.join(upper.withColumnRenamed("frame_no", "_block"), [stream, "_block"])
    states = F.aggregate("l", F.array(F.col("state")), lambda seen, m: F.concat(seen, F.array(F.get(m["map"], F.element_at(seen, -1)))))
    rows = begun.select(stream, F.transform("l", lambda m: m["frame_no"]).alias("n"), states.alias("s"))
    at = F.transform("n", lambda n, i: F.struct(n.alias("frame_no"), F.get(F.col("s"), i).alias("state")))
    return rows.select(stream, F.inline_outer(at))


def control(frames: DataFrame, stream: str, wanted: float, quality: float = 100.0) -> DataFrame:
    """quality of each frame under feedback; frames: stream, frame_no, bits at quality 100 (bits are taken to scale with it).

    The feedback is sequential by definition. Each stream runs as a sorted sequence of batches with one number of state.
    """
    schema = f"{frames.select(stream).schema[0].simpleString().replace(':', ' ')}, frame_no long, bits double, quality double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, q = None, quality
        for batch in batches:
            out = []
            for key, bits in zip(batch[stream], batch["bits"], strict=True):
                if key != now:
                    now, q = key, quality
                out.append(q)
                q = next_quality(q, wanted, bits * q / 100.0)
            yield batch.assign(quality=out)

    rows = frames.select(stream, F.col("frame_no").cast("long"), F.col("bits").cast("double"))
    return rows.repartition(stream).sortWithinPartitions(stream, "frame_no").mapInPandas(run, schema)


def progress(report: dict, rate: int, frame: int = 1024, channels: int = 1) -> dict[str, float]:
    """Counters of a micro-batch's progress report (as StreamingQuery.lastProgress gives it), whose input rows are samples.

    frames, seconds of signal, frames a second of run time, and how many times faster than play time it ran.
    """
    samples = report["numInputRows"] / channels
    took = report["durationMs"].get("triggerExecution", 0) / 1000
    played = samples / rate
    return {"frames": samples // frame, "played": played, "frames_per_second": samples / frame / took if took else 0.0, "speed": played / took if took else 0.0}


def started(frames: DataFrame, stream: str, hold: int = 3) -> DataFrame:
    """The frames of each stream after the first `hold`, which only fill the delay buffers, renumbered from 0."""
    w = Window.partitionBy(stream)
    rows = frames.withColumn("_first", F.min("frame_no").over(w))
    return rows.where(F.col("frame_no") >= F.col("_first") + hold).withColumn("frame_no", F.col("frame_no") - F.col("_first") - hold).drop("_first")
