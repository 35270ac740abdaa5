"""From numbered samples to frames of bytes under closed rate control.

A frame is a row that holds its own samples and those of both neighbours, so every later step works on rows alone and a long stream spreads over all
tasks. Its spectra in all four block shapes are coded at every quality of a grid; the sizes, with the frame's jumps of energy, give a map from
the state before the frame (quality, wish for short blocks, block type) to the state after. Composing the maps closes the loop over
transients, block types, masking and sizes without a pass over the stream.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators import bands as B
from cadenza.operators import decisions as D
from cadenza.operators import payload as P
from cadenza.operators import rate as Q
from cadenza.operators import sizing as Z
from cadenza.operators import spectral as X
from cadenza.plans.config import Settings, forced

#: Default quality; bytes of a stream header ahead of each frame; ratio of change to common energy that is a jump.
DEFAULT, HEADER, JUMP = 100.0, 7, 3.0
#: Windows around a frame that are compared, and how many lie before it.
AROUND, BEFORE = 12, 2


@dataclass(frozen=True)
class Shape:
    """Samples of a frame, of a short block, widths of the bands of both, and the grid of qualities."""

    size: int
    long: tuple[int, ...]
    short: tuple[int, ...]
    qualities: tuple[float, ...]

    @property
    def block(self) -> int:
        return self.size // 8

    def nearest(self, quality: Column) -> Column:
        """Place of the grid's value next to a quality; the grid is geometric."""
        step = math.log(self.qualities[1] / self.qualities[0])
        at = F.floor(F.log(quality / self.qualities[0]) / step + 0.5)
        return F.least(F.greatest(at, F.lit(0)), F.lit(len(self.qualities) - 1)).cast("int")


def grid(least: float, ratio: float, n: int) -> tuple[float, ...]:
    """A geometric grid of qualities."""
    return tuple(least * ratio**i for i in range(n))


def with_neighbours(samples: DataFrame, stream: str, size: int, after: int = 1) -> DataFrame:
    """stream, frame_no, samples, reach: the samples (n, value) of each frame between those of the one before and the `after` ones behind it, zeros outside of the stream.

    Each sample goes to all these frames, in one shuffle. The frame past the last sample comes too: it flushes the overlap. reach: place behind the last
    sample that there is.
    """
    own = F.floor(F.col("n") / size)
    spread = samples.select(stream, "n", F.coalesce("value", F.lit(0.0)).alias("v"), F.explode(F.sequence(F.greatest(own - after, F.lit(0).cast("long")), own + 1)).alias("frame_no"))
    placed = spread.select(stream, "frame_no", F.struct((F.col("n") - (F.col("frame_no") - 1) * size).cast("int").alias("pos"), "v").alias("p"))
    packed = placed.groupBy(stream, "frame_no").agg(F.sort_array(F.collect_list("p")).alias("l"))  # a few frames
    first = F.get("l", F.lit(0))["pos"]
    reach = first + F.size("l")
    zeros = lambda n: F.array_repeat(F.lit(0.0), n)
    return packed.select(stream, "frame_no", F.concat(zeros(first), F.transform("l", lambda p: p["v"]), zeros((2 + after) * size - reach)).alias("samples"), reach.alias("reach"))


def spectra(rows: DataFrame, shape: Shape) -> DataFrame:
    """long, start, short, stop: the spectra of each frame in the four block shapes, with `windows`: band energies of the windows around it, one after the other.

    rows: samples of three frames. The overlap is of the frame before with the frame; the windows lie in the frame and the one after.
    """
    size, block = shape.size, shape.block
    flat = (size - block) // 2
    wide = np.sin(np.pi / (2 * size) * (np.arange(size) + 0.5))
    slope = np.sin(np.pi / (2 * block) * (np.arange(block) + 0.5))
    narrow = np.concatenate([np.zeros(flat), slope, np.ones(size - flat - block)])
    hump = np.concatenate([slope, slope[::-1]])
    hann = 0.5 * (1 - np.cos(2 * np.pi * (np.arange(2 * block) + 0.5) / (2 * block)))
    starts = np.cumsum((0, *shape.short))

    def cut(x: np.ndarray, first: int, n: int) -> np.ndarray:
        return x[:, first + block * np.arange(n)[:, None] + np.arange(2 * block)]

    def make(x: np.ndarray) -> list[np.ndarray]:
        both = x[:, : 2 * size]
        out = [X.fast_lapped(both * np.concatenate([rise, fall[::-1]])) for rise, fall in ((wide, wide), (wide, narrow))]
        out.append(X.fast_lapped(cut(x, flat, 8) * hump).reshape(len(x), -1))
        out.append(X.fast_lapped(both * np.concatenate([narrow, wide[::-1]])))
        power = X.fast_lapped(cut(x, size + flat - BEFORE * block, AROUND) * hann) ** 2
        bands = [power[:, :, a:b].sum(axis=2) for a, b in zip(starts[D.FIRST_BAND : -1], starts[D.FIRST_BAND + 1 :], strict=True)]
        return [*out, np.stack(bands, axis=2).reshape(len(x), -1)]

    return X._on_arrays(rows, "samples", make, {c: "array<double>" for c in ("long", "start", "short", "stop", "windows")})


def jumps(windows: Column, n_bands: int, frame_no: Column) -> Column:
    """change, common of each step between the windows around a frame; the stream's first frame has none before it."""
    window = lambda j: F.slice(windows, j * n_bands + 1, n_bands)
    summed = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    step = lambda j: F.struct(summed(F.zip_with(window(j), window(j - 1), lambda a, b: F.abs(a - b))).alias("change"), summed(F.zip_with(window(j), window(j - 1), lambda a, b: F.least(a, b))).alias("common"))
    return F.transform(F.sequence(F.when(frame_no == 0, BEFORE + 1).otherwise(1), F.lit(AROUND - 1)), step)


def transients(samples: DataFrame, stream: str, size: int, widths: list[int], quality: float = 1.0, limit: float = JUMP, first_band: int = D.FIRST_BAND) -> DataFrame:
    """stream, frame_no, transient of every frame: as decisions.transients on spectral.short_energies, from rows that hold the frames around.

    samples: n, value; widths: bands of a short window. The windows of a frame begin in its middle, so its last ones reach into the second frame after it. Windows of
    frames that do not exist are compared with nothing.
    """
    short = sum(widths)
    count = size // short
    span, starts = count + 2 * BEFORE, np.cumsum([0, *widths])
    begin = size + (size - short) // 2 - BEFORE * short  # of the first window, in the row
    hann = 0.5 * (1 - np.cos(2 * np.pi * (np.arange(2 * short) + 0.5) / (2 * short)))

    def make(x: np.ndarray) -> list[np.ndarray]:
        power = X.fast_lapped(x[:, begin + short * np.arange(span)[:, None] + np.arange(2 * short)] * hann) ** 2
        energy = np.stack([power[:, :, max(a, 1) : b].sum(axis=2) for a, b in zip(starts[first_band:-1], starts[first_band + 1 :], strict=True)], axis=2)
        return [np.abs(np.diff(energy, axis=1)).sum(axis=2), np.minimum(energy[:, 1:], energy[:, :-1]).sum(axis=2)]

    rows = with_neighbours(samples, stream, size, after=2).where(F.col("reach") > size)
    rows = X._on_arrays(rows, "samples", make, {"change": "array<double>", "common": "array<double>"})
    low = F.when(F.col("frame_no") == 0, BEFORE).otherwise(0)  # steps, by the window that they begin in
    high = F.when(F.col("reach") > 2 * size, span - 1).otherwise(BEFORE + count - 1)
    jump = F.zip_with("change", "common", lambda a, b: a * max(quality, D.LEAST_QUALITY) > limit * b)
    found = F.exists(F.slice(jump, low + 1, high - low), lambda j: j)
    return rows.select(stream, F.col("frame_no").cast("long").alias("frame_no"), found.alias("transient"))


def bands_of(rows: DataFrame, shape: Shape) -> DataFrame:
    """The rows with block_type and its bands: four rows a frame, one for each shape; lens: the groups of the short one."""
    table = P.band_table(list(shape.short))
    summed = lambda w, b: F.aggregate(F.slice("short", w * shape.block + b["start"] + 1, b["width"]), F.lit(0.0), lambda s, x: s + x * x)
    lens = B.group_windows(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda w: F.transform(table, lambda b: summed(w, b))))
    rows = rows.withColumn("lens", lens)
    names = {D.LONG: "long", D.LONG_SHORT: "start", D.ONLY_SHORT: "short", D.SHORT_LONG: "stop"}
    cut = {t: P.grouped_bands(F.col(c), table, F.col("lens"), shape.block) if t == D.ONLY_SHORT else P.grouped_bands(F.col(c), P.band_table(list(shape.long))) for t, c in names.items()}
    types = F.array(*(F.struct(F.lit(t).alias("block_type"), c.alias("bands")) for t, c in cut.items()))
    return rows.withColumn("_types", types).drop(*names.values()).select("*", F.inline_outer("_types")).drop("_types")


def _coded(rows: DataFrame, shape: Shape, codes: P.Codes, noise_level: int) -> DataFrame:
    short = F.col("block_type") == D.ONLY_SHORT
    last = F.when(short, shape.block).otherwise(shape.size)
    return P.code_bands(rows, codes, last=last, short=short, quality=F.col("quality") / DEFAULT, noise_level=noise_level)


def element(rows: DataFrame, shape: Shape, codes: P.Codes) -> DataFrame:
    """The rows with the words of a single channel's element, in place of the bands."""
    short = F.col("block_type") == D.ONLY_SHORT
    mask = F.when(short, B.grouping_bits(F.col("lens"))).otherwise(0)
    info = P.window_info(F.col("block_type"), F.when(short, len(shape.short)).otherwise(len(shape.long)), mask)
    words = lambda narrow: P.single(0, P.coded_channel(F.col("bands"), codes, info, narrow))
    return rows.withColumn("element", F.when(short, words(True)).otherwise(words(False))).drop("bands")


def sizes(rows: DataFrame, shape: Shape, codes: P.Codes, keys: list[str], noise_level: int = 4) -> DataFrame:
    """keys, sizes: bytes of each frame with its header, in an array by block type and place in the grid; rows as bands_of gives them.

    Counted from lengths for the whole grid together, nothing is packed.
    """
    fields = P.size_of(P.single(0, P.channel_stream(F.lit(0), P.window_info(F.col("block_type"), F.lit(0)), P.nothing(), P.nothing(), P.shaping_words(), P.nothing()))) + 3
    coded = Z.trial_bits(rows.select(*keys, "block_type", "bands"), codes, [q / DEFAULT for q in shape.qualities], {True: shape.block, False: shape.size}, D.ONLY_SHORT, noise_level)
    counted = coded.select(*keys, "block_type", F.transform("bits", lambda b: (HEADER + F.floor((fields + b + 7) / 8)).cast("int")).alias("bytes"))
    found = counted.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("block_type", "bytes"))).alias("l"))  # the block types
    return found.select(*keys, F.flatten(F.transform("l", lambda e: e["bytes"])).alias("sizes"))


def _block_type(short: Column, was: Column, frame_no: Column, settings: Settings) -> Column:
    kind = F.when(short & was, D.ONLY_SHORT).when(short, D.LONG_SHORT).when(was, D.SHORT_LONG).otherwise(D.LONG)
    if settings.forced_block == "long":
        return F.lit(D.LONG)
    return F.when(forced(frame_no, settings), D.ONLY_SHORT).otherwise(kind)


def outcome(state: Column, steps: Column, sizes: Column, frame_no: Column, shape: Shape, settings: Settings) -> Column:
    """place in the grid, block_type, bytes, wanted (short blocks) and narrow (short blocks or a slope towards them) of a frame in a state.

    A state is three times the place in the grid, and one more if the block before was short or sloped, two more if short blocks were wanted.
    """
    place, history = F.floor(state / 3).cast("int"), state % 3
    quality = F.get(F.array(*map(F.lit, shape.qualities)), place)
    least = F.greatest(quality / DEFAULT, F.lit(D.LEAST_QUALITY))
    wanted = F.exists(steps, lambda s: s["change"] * least > JUMP * s["common"])
    force = forced(frame_no, settings)
    narrow = wanted | (history == 2) if force is None else wanted | (history == 2) | force
    kind = _block_type(narrow, history >= 1, frame_no, settings)
    found = F.get(sizes, kind * len(shape.qualities) + place)
    return F.struct(place.alias("place"), quality.alias("quality"), kind.alias("block_type"), found.alias("bytes"), wanted.alias("wanted"), narrow.alias("narrow"))


def rate_maps(rows: DataFrame, shape: Shape, settings: Settings, wanted_bits: float) -> DataFrame:
    """The rows (frame_no, steps, sizes) with `map`, the state after each frame by the state before."""

    def after(state: Column) -> Column:
        def next_of(o: Column) -> Column:
            quality = Q.corrected(o["quality"], wanted_bits, o["bytes"] * 8.0)
            return shape.nearest(quality) * 3 + F.when(o["wanted"], 2).when(o["narrow"], 1).otherwise(0)

        return P._with(outcome(state, F.col("steps"), F.col("sizes"), F.col("frame_no"), shape, settings), next_of)

    return rows.withColumn("map", F.transform(F.sequence(F.lit(0), F.lit(3 * len(shape.qualities) - 1)), after))


def encode(samples: DataFrame, stream: str, shape: Shape, settings: Settings, wanted_bits: float, codes: P.Codes, keep, payload: bool = True) -> DataFrame:
    """stream, frame_no, quality, block_type, bytes of every frame of numbered samples (n, value), and its element if asked for.

    The quality a frame is coded at follows from the sizes of all before it. keep(df, name) stores what several steps read.
    """
    keys = [stream, "frame_no"]
    rows = spectra(with_neighbours(samples, stream, shape.size).drop("reach"), shape)
    steps = jumps(F.col("windows"), len(shape.short) - D.FIRST_BAND, F.col("frame_no"))
    rows = keep(bands_of(rows.withColumn("steps", steps).drop("windows"), shape), "bands")
    counted = sizes(rows.drop("steps", "lens"), shape, codes, keys, settings.noise_level)
    seen = rows.where(F.col("block_type") == D.LONG).select(*keys, "steps")
    maps = keep(rate_maps(seen.join(counted, keys), shape, settings, wanted_bits), "maps")
    start = int(np.argmin([abs(math.log(q / min(max(settings.quality, 1), 5000))) for q in shape.qualities])) * 3
    states = Q.follow(maps.select(*keys, "map"), stream, start)
    done = maps.join(states, keys).withColumn("o", outcome(F.col("state"), F.col("steps"), F.col("sizes"), F.col("frame_no"), shape, settings))
    done = done.select(*keys, *(F.col("o")[c].alias(c) for c in ("quality", "block_type", "bytes")))
    if not payload:
        return done
    chosen = rows.drop("steps").join(done, [*keys, "block_type"])
    return element(_coded(chosen, shape, codes, settings.noise_level), shape, codes)
