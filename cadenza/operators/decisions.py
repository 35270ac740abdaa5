"""Block types and joint-channel decisions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LONG, LONG_SHORT, ONLY_SHORT, SHORT_LONG = 0, 1, 2, 3


#: Least quality that block switching uses, first band it looks at, first band of mid/side in long and short blocks.
LEAST_QUALITY, FIRST_BAND, FIRST_LONG, FIRST_SHORT = 0.4, 2, 8, 1
#: Largest excess of mid/side, its share at quality 1, the quiet side's largest and usual share; the same of intensity.
MID_MOST, MID, SIDE_MOST, SIDE, ONE_MOST, ONE = 0.25, 0.09, 0.3, 0.1, math.sqrt(2) - 1, 0.18
#: Steps a decade of an intensity position, and the largest position that is sent.
POSITION_STEP, FARTHEST = 10 / 1.50515, 30


def transients(energy: DataFrame, stream: list[str], per_frame: int, quality: Column | float = 1.0, limit: float = 3.0, before: int = 2, after: int = 2, first_band: int = FIRST_BAND) -> DataFrame:
    """Whether a frame holds a jump of energy; energy: stream, win_no (numbered through all frames), sfb, energy.

    Neighbouring windows are compared from `before` windows ahead of the frame to `after` past it, on the bands from `first_band` on.
    The ratio of change to common energy is written as a product, so silence on both sides is no jump and any change from silence is one.
    """
    quality = F.greatest(F.lit(quality), F.lit(LEAST_QUALITY))
    w = Window.partitionBy(*stream, "sfb").orderBy("win_no")
    steps = energy.where(F.col("sfb") >= first_band).withColumn("last", F.lag("energy").over(w)).where("last is not null")
    steps = steps.groupBy(*stream, "win_no").agg(F.sum(F.abs(F.col("energy") - F.col("last"))).alias("change"), F.sum(F.least("energy", "last")).alias("common"))
    steps = steps.withColumn("jump", F.col("change") * quality > limit * F.col("common"))
    # the step into window v belongs to every frame whose span of windows, without its first, holds v
    first = F.ceil((F.col("win_no") - (per_frame + after - 1)) / per_frame)
    last = F.floor((F.col("win_no") + before - 1) / per_frame)
    spread = steps.select(*stream, "jump", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.greatest(last, F.lit(0)))).alias("frame_no"))
    frames = energy.select(*stream, F.floor(F.col("win_no") / per_frame).alias("frame_no")).distinct()
    found = spread.groupBy(*stream, "frame_no").agg(F.max("jump").alias("transient"))
    return frames.join(found, [*stream, "frame_no"], "left").withColumn("transient", F.coalesce("transient", F.lit(False)))


def by_layout(flags: DataFrame, layout: DataFrame, stream: str, channel: str = "channel") -> DataFrame:
    """stream, frame_no, channel, kind, wants_short by the channel's element; flags: stream, channel, frame_no, transient.

    Singles and both channels of a pair go by their own transients, a low-frequency channel stays with long blocks; channels
    that the layout (channel, kind) does not have are left out.
    """
    kinds = F.broadcast(layout.select(F.col("channel").alias(channel), "kind"))  # one row a channel, 64 at most
    wants = F.when(F.col("kind") == "lfe", F.lit(False)).otherwise(F.col("transient"))
    return flags.join(kinds, channel).select(stream, "frame_no", channel, "kind", wants.alias("wants_short"))


def block_types(wants: DataFrame, stream: str, forced: Column | None = None) -> DataFrame:
    """block_type from the wish for short blocks of any channel (stream, frame_no, wants_short): a window form of the state machine."""
    any_channel = wants.groupBy(stream, "frame_no").agg(F.max("wants_short").alias("d"))
    w = Window.partitionBy(stream).orderBy("frame_no")
    off = F.lit(False)
    b = F.col("d") | F.coalesce(F.lag("d").over(w), off)
    rows = any_channel.withColumn("b", b if forced is None else b | forced)
    was = F.coalesce(F.lag("b").over(w), off)
    kind = F.when(F.col("b") & was, ONLY_SHORT).when(F.col("b"), LONG_SHORT).when(was, SHORT_LONG).otherwise(LONG)
    return rows.select(stream, "frame_no", kind.alias("block_type"))


def pair_energies(banded: DataFrame, pair: list[str], side: str) -> DataFrame:
    """e_left, e_right, e_sum, e_diff of each band of a channel pair; side: 0 left, 1 right. A left without its right is left out."""
    left = banded.where(F.col(side) == 0).select(*pair, "sfb", "bin", F.col("x").alias("l"))
    right = banded.where(F.col(side) == 1).select(*pair, "sfb", "bin", F.col("x").alias("r"))
    both = left.join(right, [*pair, "sfb", "bin"])
    square = lambda c: F.sum(c * c)
    lv, rv = F.col("l"), F.col("r")
    return both.groupBy(*pair, "sfb").agg(square(lv).alias("e_left"), square(rv).alias("e_right"), square(lv + rv).alias("e_sum"), square(lv - rv).alias("e_diff"))


def mid_side(energy: DataFrame, quality: float = 1.0, first: int = FIRST_LONG) -> DataFrame:
    """ms: in_phase, out_of_phase or null; muted: the quiet side that is silenced, or null. Bands below `first` stay as they are."""
    used = F.col("sfb") >= first
    mid_limit = (1 + min(MID / quality, MID_MOST)) ** 2
    mute_limit = min(SIDE / quality, SIDE_MOST) ** 2
    s, d = F.col("e_sum") / 4, F.col("e_diff") / 4
    low, high = F.least("e_left", "e_right"), F.greatest("e_left", "e_right")
    close = used & (low * mid_limit >= F.greatest(s, d))
    both = F.col("e_left") + F.col("e_right")
    ms = F.when(close & (s * mid_limit * 2 >= both), "in_phase").when(close & (d * mid_limit * 2 >= both), "out_of_phase")
    muted = F.when(used & (low <= mute_limit * high), F.when(F.col("e_left") <= F.col("e_right"), "left").otherwise("right"))
    return energy.withColumns({"ms": ms, "muted": muted})


def intensity(energy: DataFrame, quality: float = 1.0, first: int = 8) -> DataFrame:
    """kind: in_phase, out_of_phase or null; gain, level and pan of bands that one channel can carry; muted side beyond a pan of 30."""
    limit = (1 + min(ONE / quality**2, ONE_MOST)) ** 2
    both = F.col("e_left") + F.col("e_right")
    bound = F.pow(F.sqrt("e_left") + F.sqrt("e_right"), F.lit(2)) / limit
    heard = (F.col("sfb") >= first) & (both > 0)
    kind = F.when(heard & (F.col("e_sum") >= bound), "in_phase").when(heard & (F.col("e_diff") >= bound), "out_of_phase")
    used = F.when(kind == "in_phase", F.col("e_sum")).otherwise(F.col("e_diff"))
    share = lambda c: F.when(F.col(c) > 0, F.rint(F.log10(F.col(c) / both) * POSITION_STEP))
    level = F.when(kind.isNotNull(), share("e_left"))
    pan = F.when(kind.isNotNull(), share("e_right") - share("e_left"))
    gain = F.when(kind.isNotNull() & (used > 0), F.sqrt(both / used))
    muted = F.when(pan > FARTHEST, "left").when(pan < -FARTHEST, "right")
    return energy.withColumns({"is_kind": kind, "is_gain": gain, "is_level": level, "is_pan": pan, "is_muted": muted})


def eligible_pairs(blocks: DataFrame, pair: list[str], side: str) -> DataFrame:
    """Pairs whose two channels have the same block type and grouping."""
    left = blocks.where(F.col(side) == 0).select(*pair, F.col("block_type").alias("t0"), F.col("groups").alias("g0"))
    right = blocks.where(F.col(side) == 1).select(*pair, F.col("block_type").alias("t1"), F.col("groups").alias("g1"))
    return left.join(right, pair).where("t0 = t1 and g0 = g1").select(*pair)


def pair_band_count(rows: DataFrame, pair: list[str]) -> DataFrame:
    """Both channels of a pair take the larger number of bands."""
    return rows.withColumn("n_bands", F.max("n_bands").over(Window.partitionBy(*pair)))
