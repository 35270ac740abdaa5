"""From ordered samples to frames, channels and windows of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_samples(rows: DataFrame, stream: str, order: list[str], slot: Column, name: str = "n") -> DataFrame:
    """Number the rows of each stream from 0 in the given order.

    `slot` is a coarse prefix of the order (say the day). Rows are numbered inside (stream, slot) and moved by the counts of
    earlier slots, so a stream that holds much of the data spreads over as many tasks as it has slots.
    """
    rows = rows.withColumn("_slot", slot)
    sizes = rows.groupBy(stream, "_slot").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(stream).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(stream, "_slot", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_begin"))
    inside = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(stream, "_slot").orderBy(*order)) - 1)
    return inside.join(begins, [stream, "_slot"]).withColumn(name, F.col("_begin") + F.col("_rank")).drop("_slot", "_begin", "_rank", "_size")


def frames(samples: DataFrame, size: int) -> DataFrame:
    """Cut numbered samples (n) into frames: frame_no, pos."""
    return samples.withColumns({"frame_no": F.floor(F.col("n") / size).cast("long"), "pos": (F.col("n") % size).cast("int")}).drop("n")


def frame_arrays(framed: DataFrame, size: int, keys: list[str], value: str = "value") -> DataFrame:
    """One row a frame with its samples as an array of `size`; missing positions are zero."""
    packed = framed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce(value, F.lit(0.0)).alias("v")))).alias("_l"))  # `size` members
    found = F.transform("_l", lambda p: p["v"])
    at = F.transform("_l", lambda p: p["pos"])
    placed = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.get(found, (F.array_position(at, i) - 1).cast("int")), F.lit(0.0)))
    return packed.select(*keys, F.when(F.size("_l") == size, found).otherwise(placed).alias("samples"))


def pad(framed: DataFrame, size: int, keys: list[str], flush: int = 0) -> DataFrame:
    """Long form with every position of every frame up to the last, zeros where nothing was, then `flush` zero frames."""
    last = framed.groupBy(*keys).agg(F.max("frame_no").alias("_last"))
    grid = last.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last") + flush)).alias("frame_no"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("pos"))
    return grid.join(framed, [*keys, "frame_no", "pos"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def split_channels(rows: DataFrame, keys: list[str], values: str, channels: int, scale: float = 1.0) -> DataFrame:
    """keys, channel, sample_no, value of interleaved arrays."""
    long = rows.select(*keys, F.posexplode(F.transform(values, lambda x: x.cast("double") * scale)).alias("_pos", "value"))
    return long.select(*keys, (F.col("_pos") % channels).alias("channel"), F.floor(F.col("_pos") / channels).cast("int").alias("sample_no"), "value")


def channel_map(channels: int, centre: int = 0, low: int = 0) -> list[int] | None:
    """Source position of each output channel when centre and low-frequency channels (from 1, 0: unset) stand elsewhere."""
    if channels < 3 or not (centre or low):
        return None
    c = centre - 1 if centre else 0
    lf = low - 1 if low else channels - 1
    middle = [i for i in range(channels) if i not in (c, lf)]
    head = [c] if c < channels else []
    wanted = channels - 1 - len(head)
    body, spare = middle[:wanted], middle[wanted:]
    tail = [lf] if lf < channels else spare[:1]
    return [*head, *body, *tail]


def remap(values: Column, order: list[int]) -> Column:
    """An interleaved sample row in another channel order."""
    return F.array(*(F.get(values, F.lit(i)) for i in order))


def sliding_windows(previous: Column, current: Column, size: int = 16, hop: int = 8, offset: int = 28, count: int = 8) -> Column:
    """`count` windows of `size` samples, `hop` apart, over two frames in a row, the first at `offset`."""
    both = F.concat(previous, current)
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda w: F.slice(both, offset + 1 + w * hop, size))
