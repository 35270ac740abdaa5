"""Noise shaping as array folds: autocorrelation, Levinson's recursion, quantized reflection coefficients, and the filter in both directions.

A row is a spectrum with its own span, order and rate; everything is an array expression, so there is no shuffle and no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.operators.payload import _with
from cadenza.operators.spectral import BITS, GAIN, SMALLEST, shaping_order

#: Fixed values by rate index: the first band of a long block that is shaped, and the band where shaping ends.
FIRST_BANDS = [11, 12, 15, 16, 17, 20, 25, 26, 24, 28, 30, 31]
END_BANDS = [31, 31, 34, 40, 42, 51, 46, 46, 42, 42, 42, 39]


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def lags(x: Column, order: Column) -> Column:
    """Autocorrelation of an array at lags 0 to `order`."""
    n = F.size(x)
    shifted = lambda k: F.slice(x, k + 1, F.greatest(n - k, F.lit(0)))
    return F.transform(F.sequence(F.lit(0), order), lambda k: _total(F.zip_with(F.slice(x, F.lit(1), F.greatest(n - k, F.lit(0))), shifted(k), lambda a, b: a * b)))


def _longer(a: Column, k: Column) -> Column:
    """The predictor of one order more: each coefficient and k times its mirror image."""
    wide = F.concat(a, F.array(F.lit(0.0)))
    return F.zip_with(wide, F.reverse(wide), lambda x, y: x + k * y)


def levinson(autocorrelation: Column) -> Column:
    """gain, k (reflection coefficients) of a predictor for an autocorrelation; a silent signal has a gain of 0 and no coefficients but zeros."""
    return _with(autocorrelation, _levinson)


def _levinson(r: Column) -> Column:
    start = F.struct(F.array(F.lit(1.0)).alias("a"), F.array().cast("array<double>").alias("k"), F.get(r, F.lit(0)).alias("error"))

    def step(s: Column, m: Column) -> Column:
        products = F.zip_with(s["a"], F.reverse(F.slice(r, F.lit(2), m)), lambda a, v: a * v)
        return _with(-_total(products) / s["error"], lambda k: F.struct(_longer(s["a"], k).alias("a"), F.concat(s["k"], F.array(k)).alias("k"), (s["error"] * (1 - k * k)).alias("error")))

    orders = F.sequence(F.lit(1), F.size(r) - 1)
    none = F.struct(F.lit(0.0).alias("gain"), F.transform(orders, lambda _: F.lit(0.0)).alias("k"))
    found = F.aggregate(orders, start, step, lambda s: F.struct((F.get(r, F.lit(0)) / s["error"]).alias("gain"), s["k"].alias("k")))
    return F.when(F.get(r, F.lit(0)) > 0, found).otherwise(none)


def quantized(k: Column) -> Column:
    """index, value of reflection coefficients on an arcsine scale, without those at the end that are too small."""
    up, down = (2 ** (BITS - 1) - 0.5) / (math.pi / 2), (2 ** (BITS - 1) + 0.5) / (math.pi / 2)

    def one(x: Column) -> Column:
        index = F.when(x >= 0, (0.5 + F.asin(x) * up).cast("int")).otherwise((-0.5 + F.asin(x) * down).cast("int"))
        return F.struct(index.alias("index"), F.sin(index / F.when(index >= 0, up).otherwise(down)).alias("value"))

    kept = lambda all_: F.slice(all_, F.lit(1), F.coalesce(F.array_max(F.transform(all_, lambda c, i: F.when(F.abs(c["value"]) > SMALLEST, i + 1))), F.lit(0)))
    return _with(F.transform(k, one), kept)


def step_up(values: Column) -> Column:
    """Predictor coefficients, a leading 1 first, of reflection coefficients."""
    return F.aggregate(values, F.array(F.lit(1.0)), _longer)


def filtered(x: Column, a: Column, backward: bool = False) -> Column:
    """Each value with the weighted ones before it added (after it: backward); the weights go over the values as they were."""

    def forward(y: Column, a: Column) -> Column:
        order = F.size(a) - 1
        past = lambda i: F.reverse(F.slice(y, F.greatest(i - order, F.lit(0)) + 1, F.least(i, order)))
        weights = lambda i: F.slice(a, F.lit(2), F.least(i, order))
        return F.transform(y, lambda v, i: v + F.when((i == 0) | (order == 0), 0.0).otherwise(_total(F.zip_with(past(i), weights(i), lambda p, w: p * w))))

    found = _with(a, lambda a: _with(F.reverse(x) if backward else x, lambda y: forward(y, a)))
    return F.reverse(found) if backward else found


def span(starts: Column, n_bands: Column, rate_index: Column) -> Column:
    """first, end (bins), length (bands, as it is sent) of what is shaped; starts: of each band and the end of the last."""
    low, high = (F.get(F.array(*map(F.lit, t)), rate_index) for t in (FIRST_BANDS, END_BANDS))
    start, stop = F.least(low, high, n_bands), F.least(n_bands, high)
    return F.struct(F.get(starts, start).alias("first"), F.get(starts, F.greatest(start, stop)).alias("end"), (n_bands - low).alias("length"))


def shape(rows: DataFrame, spectrum: str, starts: Column, n_bands: Column, rate_index: Column, short: Column | bool = False, mpeg2: Column | bool = False, backward: bool = False) -> DataFrame:
    """The rows with the spectrum filtered where it pays, and order, gain, indices (null: not shaped), length.

    Short blocks are left as they are. A gain up to the threshold leaves the spectrum and sends no filter.
    """
    short, mpeg2 = F.lit(short), F.lit(mpeg2)
    order = shaping_order(rate_index, F.lit(False), mpeg2)
    rows = rows.withColumns({"_span": span(starts, n_bands, rate_index), "order": order})
    rows = rows.withColumn("_cut", F.slice(spectrum, F.col("_span")["first"] + 1, F.col("_span")["end"] - F.col("_span")["first"]))
    rows = rows.withColumn("_found", levinson(lags(F.col("_cut"), F.col("order"))))
    rows = rows.withColumn("gain", F.when(short, 0.0).otherwise(F.col("_found")["gain"]))
    rows = rows.withColumn("_coded", F.when(F.col("gain") > GAIN, quantized(F.col("_found")["k"])))
    whole = F.concat(F.slice(spectrum, F.lit(1), F.col("_span")["first"]), filtered(F.col("_cut"), step_up(F.transform("_coded", lambda c: c["value"])), backward), F.slice(spectrum, F.col("_span")["end"] + 1, F.size(spectrum)))
    rows = rows.withColumn(spectrum, F.when(F.col("_coded").isNull(), F.col(spectrum)).otherwise(whole))
    return rows.withColumns({"indices": F.transform("_coded", lambda c: c["index"]), "length": F.col("_span")["length"]}).drop("_span", "_cut", "_found", "_coded")
