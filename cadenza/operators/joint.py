"""Joint coding of a channel pair: both sides' bands rewritten from their own energies, in array expressions of one row a frame.

A band is as payload.grouped_bands gives it. Energies are those before any change. A row with a null side gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.decisions import FARTHEST, FIRST_LONG, MID, MID_MOST, ONE, ONE_MOST, POSITION_STEP, SIDE, SIDE_MOST
from cadenza.plans.tables import INTENSITY, INTENSITY_OUT, ZERO


def mid_limits(quality: Column | float) -> tuple[Column, Column]:
    """(excess up to which two sides count as one, share up to which a side is muted), for energies."""
    q = F.lit(quality)
    return F.pow(1 + F.least(MID / q, F.lit(MID_MOST)), F.lit(2)), F.pow(F.least(SIDE / q, F.lit(SIDE_MOST)), F.lit(2))


def one_limit(quality: Column | float) -> Column:
    q = F.lit(quality)
    return F.pow(1 + F.least(ONE / (q * q), F.lit(ONE_MOST)), F.lit(2))


def _summed(x: Column, y: Column | None = None, sign: int = 1) -> Column:
    squares = F.transform(x, lambda v: v * v) if y is None else F.zip_with(x, y, lambda v, w: (v + sign * w) * (v + sign * w))
    return F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)


def _pairs(left: Column, right: Column) -> Column:
    energies = lambda l, r: F.struct(l.alias("l"), r.alias("r"), _summed(l["x"]).alias("e_left"), _summed(r["x"]).alias("e_right"), _summed(l["x"], r["x"]).alias("e_sum"), _summed(l["x"], r["x"], -1).alias("e_diff"))
    return F.zip_with(left, right, energies)


def _set(band: Column, x: Column, preset: Column | None = None, base: Column | None = None) -> Column:
    none = F.lit(None).cast("int")
    return band.withField("x", x).withField("preset", none if preset is None else preset.cast("int")).withField("base", F.lit(0) if base is None else F.coalesce(base, F.lit(0)).cast("int"))


def _final(l: Column, r: Column, used: Column) -> Column:
    return F.struct(l.alias("l"), r.alias("r"), used.cast("int").alias("used"))


def intensity_pair(left: Column, right: Column, quality: Column | float = 1.0, first: Column | int = FIRST_LONG) -> Column:
    """l, r, used of each band: where one side can carry both, the left is their sum (or difference) at their common energy.

    The right then has the book of intensity, with the position as its scale factor, and the left its level as a base. Beyond the
    farthest position, or beside a silent side, the quiet side is empty and the other stays as it is.
    """

    def decided(p: Column) -> Column:
        both = p["e_left"] + p["e_right"]
        bound = F.pow(F.sqrt(p["e_left"]) + F.sqrt(p["e_right"]), F.lit(2)) / one_limit(quality)
        heard = (p["l"]["sfb"] >= first) & (both > 0)
        kind = F.when(heard & (p["e_sum"] >= bound), INTENSITY).when(heard & (p["e_diff"] >= bound), INTENSITY_OUT)
        share = lambda e: F.when(kind.isNotNull() & (e > 0), F.rint(F.log10(e / both) * POSITION_STEP))
        return p.withField("kind", kind).withField("level", share(p["e_left"])).withField("other", share(p["e_right"])).withField("both", both)

    def applied(p: Column) -> Column:
        pan = p["other"] - p["level"]
        one = p["kind"].isNotNull()
        quiet_left = one & (p["level"].isNull() | F.coalesce(pan > FARTHEST, F.lit(False)))
        quiet_right = one & ~quiet_left & (p["other"].isNull() | F.coalesce(pan < -FARTHEST, F.lit(False)))
        sent = one & ~quiet_left & ~quiet_right
        sign = F.when(p["kind"] == INTENSITY, 1.0).otherwise(-1.0)
        gain = F.sqrt(p["both"] / F.when(p["kind"] == INTENSITY, p["e_sum"]).otherwise(p["e_diff"]))
        x = F.when(sent, F.zip_with(p["l"]["x"], p["r"]["x"], lambda v, w: (v + sign * w) * gain)).otherwise(p["l"]["x"])
        left = _set(p["l"], x, F.when(quiet_left, ZERO), F.when(sent, p["level"]))
        right = _set(p["r"], p["r"]["x"], F.when(quiet_right, ZERO).when(sent, p["kind"]), F.when(sent, -pan))
        return _final(left, right, sent)

    return F.transform(F.transform(_pairs(left, right), decided), applied)


def mid_side_pair(left: Column, right: Column, quality: Column | float = 1.0, first: Column | int = FIRST_LONG) -> Column:
    """l, r, used of each band: where the sides are nearly one, the mid or the side stands on its channel and the other is empty; a side that is much quieter is muted."""
    close, mute = mid_limits(quality)

    def applied(p: Column) -> Column:
        s, d, both = p["e_sum"] / 4, p["e_diff"] / 4, p["e_left"] + p["e_right"]
        low, high = F.least(p["e_left"], p["e_right"]), F.greatest(p["e_left"], p["e_right"])
        inside = p["l"]["sfb"] >= first
        near = inside & (low * close >= F.greatest(s, d))
        kind = F.when(near & (s * close * 2 >= both), 1).when(near & (d * close * 2 >= both), 2)
        muted = F.when(inside & (low <= mute * high), F.when(p["e_left"] < p["e_right"], 1).otherwise(2))
        mixed = lambda sign: F.zip_with(p["l"]["x"], p["r"]["x"], lambda v, w: 0.5 * (v + sign * w))
        none = F.transform(p["l"]["x"], lambda v: v * 0.0)
        x = F.when(muted == 1, none).when(kind == 1, mixed(1)).when(kind == 2, none).otherwise(p["l"]["x"])
        y = F.when(muted == 2, none).when(kind == 1, none).when(kind == 2, mixed(-1)).otherwise(p["r"]["x"])
        return _final(_set(p["l"], x), _set(p["r"], y), kind.isNotNull())

    return F.transform(_pairs(left, right), applied)


def one_array(rows: DataFrame, pairs: str) -> DataFrame:
    """The rows with `bands` and `used` in place of the column `pairs` (l, r, used): the bands of both sides in one array, whose groups are numbered 2g and 2g + 1."""
    side = lambda name, n: F.transform(pairs, lambda p: p[name].withField("group", p[name]["group"] * 2 + n))
    return rows.withColumns({"bands": F.concat(side("l", 0), side("r", 1)), "used": F.transform(pairs, lambda p: p["used"])}).drop(pairs)


def side_of(bands: Column, side: int) -> Column:
    """The coded bands of one side of `one_array`."""
    return F.filter(bands, lambda b: b["group"] % 2 == side)
