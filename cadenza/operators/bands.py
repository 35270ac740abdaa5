"""Band energies, limits, offsets, masking targets and grouping of short windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Share of the mean in a masking target, and energy a value below which a group is silent.
TONAL, SILENCE = 0.2, 0.16


def band_offsets(widths: DataFrame, keys: list[str], limit: int | None = None) -> DataFrame:
    """start of each band: the sum of the widths before it; `limit` keeps the first bands only (low-frequency channels)."""
    before = Window.partitionBy(*keys).orderBy("sfb").rowsBetween(Window.unboundedPreceding, -1)
    rows = widths.withColumn("start", F.coalesce(F.sum("width").over(before), F.lit(0)).cast("int"))
    return rows if limit is None else rows.where(F.col("sfb") < limit)


def bandwidth_limit(short: list[int], long: list[int], requests: DataFrame, noise: bool = True) -> DataFrame:
    """The rows of requests (rate, bandwidth) with n_short, n_bands, bins, snapped: how many bands of each block reach the bandwidth.

    Widths are those of one rate; see bandwidth_limits.
    """
    table = lambda widths: F.array(*(F.struct(F.lit(sum(widths[:i])).alias("start"), F.lit(w).alias("width")) for i, w in enumerate(widths)))
    return bandwidth_limits(requests.withColumns({"_short": table(short), "_long": table(long)}), "_short", "_long", noise).drop("_short", "_long")


def bandwidth_limits(requests: DataFrame, short: str, long: str, noise: bool = True) -> DataFrame:
    """The rows of requests (rate, bandwidth) with n_short, n_bands, bins, snapped; `short` and `long`: each row's own bands (start, width).

    With noise substitution the bands of a short block snap the bandwidth before those of a long one are counted. Bandwidths are whole
    numbers of Hz, rounded down.
    """

    def total(bands: str) -> Column:
        last = F.element_at(bands, -1)
        return last["start"] + last["width"]

    def reached(bandwidth: Column, bands: str) -> tuple[Column, Column]:
        """(bands, values) that begin below the bandwidth."""
        most = F.floor(bandwidth * (2 * total(bands)) / F.col("rate"))
        n = F.size(F.filter(bands, lambda b: b["start"] < most))
        return n, F.coalesce(F.get(F.col(bands), n)["start"], total(bands))

    n_short, bins = reached(F.col("bandwidth"), short)
    snap = F.floor(bins * F.col("rate") / (2 * total(short))) if noise else F.col("bandwidth")
    out = requests.withColumns({"n_short": n_short, "_snap": snap})
    n_long, bins = reached(F.col("_snap"), long)
    out = out.withColumns({"n_bands": n_long, "bins": bins}).drop("_snap")
    return out.withColumn("snapped", F.floor(F.col("bins") * F.col("rate") / (2 * total(long))))


def with_bands(bins: DataFrame, bands: DataFrame, limit: int | None = None) -> DataFrame:
    """Give each bin its band (bands: sfb, start, end) by an equi-join on the bin; bins from `limit` on are left out."""
    table = bands.select("sfb", F.explode(F.sequence("start", F.col("end") - 1)).alias("bin"))
    rows = bins if limit is None else bins.where(F.col("bin") < limit)
    return rows.join(F.broadcast(table), "bin")


def energies(banded: DataFrame, keys: list[str], skip_first: bool = False) -> DataFrame:
    """energy, peak, n of each band."""
    rows = banded.where("bin > 0") if skip_first else banded
    x2 = F.col("x") * F.col("x")
    return rows.groupBy(*keys, "sfb").agg(F.sum(x2).alias("energy"), F.max(x2).alias("peak"), F.count("*").alias("n"))


def masking_targets(energy: DataFrame, keys: list[str], last: int, bands: DataFrame, windows: int = 1, short: bool = False, quality: float = 1.0) -> DataFrame:
    """target amplitude of each band, from the band's mean and peak energy against the frame's."""
    total = Window.partitionBy(*keys)
    rows = energy.join(F.broadcast(bands.select("sfb", "start", "end")), "sfb").withColumn("total", F.sum("energy").over(total))
    target = target_of(F.col("energy"), F.col("peak"), F.col("start"), F.col("end"), F.col("total"), last, windows, short, quality)
    return rows.withColumn("target", target).drop("start", "end")


def target_of(energy: Column, peak: Column, start: Column, end: Column, total: Column, last: Column | int, windows: Column | int = 1, short: Column | bool = False, quality: Column | float = 1.0, counted: Column | None = None) -> Column:
    """Target amplitude of one band of a group of windows.

    total: energy of all bands of the group; last: values of a window; counted: values of all bands of the group (all of the windows' if not given).
    The peak counts as often as the group has windows, not as often as the band has values.
    """
    width = end - start
    expected = total / last * width
    tonal = TONAL * F.pow(energy / expected, F.lit(0.4))
    peaky = (1 - TONAL) * 0.45 * F.pow(peak * windows / expected, F.lit(0.4))
    shape = 10.0 / (1 + (start + end) / last)
    target = (tonal + peaky) * F.when(F.lit(short), 1.5).otherwise(1.0) * shape * quality
    silent = total < SILENCE * (F.lit(last) * windows if counted is None else counted)
    return F.when(silent, 0.0).otherwise(target)


def largest(quantized: DataFrame, keys: list[str]) -> DataFrame:
    """Largest magnitude of each band."""
    return quantized.groupBy(*keys, "sfb").agg(F.max(F.abs("q")).cast("int").alias("max_q"))


def group_windows(windows: Column, first: int = 2, ratio: float = 3.0) -> Column:
    """Lengths of the groups of an array (window) of arrays (band energies): a new group where enough bands have spread.

    A window joins the current group unless more than three quarters of the bands from `first` on have a largest energy above `ratio`
    times the smallest one since the group began.
    """
    bands = F.size(F.get(windows, F.lit(0)))
    enough = F.floor((bands - first) * 3 / 4)
    zero = F.get(windows, F.lit(0))

    def step(state: Column, w: Column) -> Column:
        lo = F.zip_with(state["lo"], w, lambda a, b: F.least(a, b))
        hi = F.zip_with(state["hi"], w, lambda a, b: F.greatest(a, b))
        spread = F.size(F.filter(F.slice(F.arrays_zip(lo.alias("lo"), hi.alias("hi")), first + 1, F.greatest(bands - first, F.lit(0))), lambda p: p["hi"] > ratio * p["lo"]))
        cut = spread > enough
        lens = F.when(cut, F.concat(state["lens"], F.array(state["run"]))).otherwise(state["lens"])
        return F.struct(F.when(cut, w).otherwise(lo).alias("lo"), F.when(cut, w).otherwise(hi).alias("hi"), lens.alias("lens"), F.when(cut, F.lit(1)).otherwise(state["run"] + 1).alias("run"))

    start = F.struct(zero.alias("lo"), zero.alias("hi"), F.array().cast("array<int>").alias("lens"), F.lit(1).alias("run"))
    return F.aggregate(F.slice(windows, F.lit(2), F.size(windows) - 1), start, step, lambda s: F.concat(s["lens"], F.array(s["run"])))


def grouping_bits(lens: Column) -> Column:
    """The mask of a grouping of eight windows: a bit for each later window that continues its group."""
    marks = F.flatten(F.transform(lens, lambda n: F.concat(F.array(F.lit(0)), F.array_repeat(F.lit(1), (n - 1).cast("int")))))
    return F.aggregate(F.slice(marks, F.lit(2), F.size(marks) - 1), F.lit(0), lambda s, b: s * 2 + b)
