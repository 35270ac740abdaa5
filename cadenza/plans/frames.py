"""Registered queries of whole frames and their SQL: grouped short blocks, joint pairs, streams of many rates.

`embeddings.embedding` (64 numbers) stands in for spectra: eight vectors in a row are the windows of a short block, two are the channels of a pair, and
sixteen the spectrum of a long block.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions.signal import rate_index
from cadenza.operators import bands as B
from cadenza.operators import coding as C
from cadenza.operators import joint as J
from cadenza.operators import payload as P
from cadenza.operators import shaping as N
from cadenza.plans import coding_sql as Y
from cadenza.plans import tables as T
from cadenza.plans.config import resolve
from cadenza.plans.queries import BINS, GAIN, WIDTHS, table

#: Bands of a short block's windows; what lies beyond them is above the bandwidth.
SHORT_WIDTHS = [4, 4, 4, 4, 8, 8, 8, 8, 12]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def blocks(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """frame_no, spectrum: `size` vectors in a row, one after the other, zeros for those that are not there."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / size).alias("frame_no"), (F.col("vec_id") % size).alias("part"), F.transform("embedding", lambda e: e.cast("double") * GAIN).alias("x"))
    packed = rows.groupBy("frame_no").agg(F.collect_list(F.struct("part", "x")).alias("l"))  # `size` members
    zeros = F.array_repeat(F.lit(0.0), BINS)
    part = lambda w: F.coalesce(F.get(F.filter("l", lambda e: e["part"] == w), F.lit(0))["x"], zeros)
    return packed.select("frame_no", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), part)).alias("spectrum"))


def _values(widths: list[int]) -> str:
    return ", ".join(f"({i}, {sum(widths[:i])}, {w})" for i, w in enumerate(widths))


def shut(rows: DataFrame, *keys: str) -> DataFrame:
    """keys, n_bits, payload of rows with an `element`."""
    closed = rows.select(*keys, (P.size_of(F.col("element")) + 3).alias("n_bits"), P.closed(F.col("element")).alias("words"))
    return closed.select(*keys, "n_bits", F.hex(P.packed(F.col("words"))).alias("payload"))


def window_groups(spectrum: Column, widths: list[int]) -> Column:
    """Lengths of the groups of eight windows of BINS values, by the energies of their bands."""
    summed = lambda w, b: F.aggregate(F.slice(spectrum, w * BINS + b["start"] + 1, b["width"]), F.lit(0.0), lambda s, x: s + x * x)
    windows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda w: F.transform(P.band_table(widths), lambda b: summed(w, b)))
    return B.group_windows(windows)


_N = len(SHORT_WIDTHS)


@query(f"""WITH RECURSIVE fr AS (SELECT DISTINCT vec_id // 8 AS key FROM embeddings), w(sfb, start, width) AS (VALUES {_values(SHORT_WIDTHS)}),
x AS (SELECT vec_id // 8 AS key, vec_id % 8 AS win, unnest(range({BINS}))::INT AS bin, unnest(embedding)::DOUBLE * {GAIN} AS x FROM embeddings),
v AS MATERIALIZED (SELECT fr.key, p.win, sfb, start, width, bins.bin, coalesce(x, 0) AS x FROM fr, range(8) p(win), w JOIN range({BINS}) bins(bin) ON bins.bin >= start AND bins.bin < start + width LEFT JOIN x ON x.key = fr.key AND x.win = p.win AND x.bin = bins.bin),
en AS (SELECT key, win, list(energy ORDER BY sfb) AS e FROM (SELECT key, win, sfb, sum(x * x) AS energy FROM v WHERE sfb >= 2 GROUP BY ALL) GROUP BY ALL),
gs AS (SELECT key, win, e AS lo, e AS hi, 0 AS grp FROM en WHERE win = 0 UNION ALL
 SELECT key, win, CASE WHEN cut THEN e ELSE lo END, CASE WHEN cut THEN e ELSE hi END, grp + cut::INT FROM (SELECT *, len(list_filter(range(1, len(e) + 1), lambda j: hi[j] > 3 * lo[j])) > {(_N - 2) * 3 // 4} AS cut FROM
  (SELECT gs.key, en.win, en.e, grp, [least(gs.lo[j], en.e[j]) FOR j IN range(1, len(en.e) + 1)] AS lo, [greatest(gs.hi[j], en.e[j]) FOR j IN range(1, len(en.e) + 1)] AS hi FROM gs JOIN en ON en.key = gs.key AND en.win = gs.win + 1))),
gr AS MATERIALIZED (SELECT key, win, grp, count(*) OVER (PARTITION BY key, grp) AS wins, win - min(win) OVER (PARTITION BY key, grp) AS place, grp = lag(grp) OVER (PARTITION BY key ORDER BY win) AS goes_on FROM gs),
mk AS (SELECT key, max(grp) + 1 AS n_groups, coalesce(sum(1 << (7 - win)::INT) FILTER (goes_on), 0) AS mask FROM gr GROUP BY key),
bx AS MATERIALIZED (SELECT key, grp * {_N} + sfb AS pos, grp, sfb, start, width, wins, place * width + bin - start AS i, x FROM v JOIN gr USING (key, win)),
kq AS (SELECT key, 0.4 + key % 4 * 0.5::DOUBLE AS quality, {BINS} AS last, true AS short FROM fr), {Y.coded()},
f AS (SELECT key, '0000000' || lpad(bin(g0 & 255), 8, '0') || '0100' || lpad(bin({_N}), 4, '0') || lpad(bin(mask::INT), 7, '0') || se || sd || '000' || sp AS d FROM bits JOIN mk USING (key)), {Y.closed("f")}
SELECT key AS frame_no, CAST(n_groups AS INT) AS n_groups, CAST(mask AS INT) AS mask, n_bits, {Y.HEX} AS payload FROM shut JOIN mk USING (key)""")
def short_frame_bytes(spark, sf_dir):
    """Frames of eight short windows in groups, at four qualities: bands over the windows of a group, sections of the short count, the grouping mask."""
    rows = blocks(spark, sf_dir, 8).withColumn("lens", window_groups(F.col("spectrum"), SHORT_WIDTHS))
    rows = rows.withColumns({"bands": P.grouped_bands(F.col("spectrum"), P.band_table(SHORT_WIDTHS), F.col("lens"), BINS), "quality": 0.4 + F.col("frame_no") % 4 * 0.5})
    rows = P.code_bands(rows.drop("spectrum"), T.code_table(), last=BINS, short=True, quality=F.col("quality"))
    rows = rows.withColumns({"n_groups": F.size("lens"), "mask": B.grouping_bits(F.col("lens")).cast("int")})
    info = P.window_info(F.lit(2), F.lit(_N), F.col("mask"))
    rows = rows.withColumn("element", P.single(0, P.coded_channel(F.col("bands"), T.code_table(), info, short=True)))
    return shut(rows, "frame_no", "n_groups", "mask")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pair_id, l, r: two vectors as the channels of a pair; in three of four pairs the right one is mixed from both, near, against or far below the left."""
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair_id"), (F.col("vec_id") % 2).alias("side"), F.transform("embedding", lambda e: e.cast("double") * GAIN).alias("x"))
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("x")))
    both = rows.groupBy("pair_id").agg(side(0).alias("l"), side(1).alias("o")).where("l is not null and o is not null")
    kind = F.col("pair_id") % 4
    own, other = (F.when(kind == 0, a).when(kind == 1, b).when(kind == 2, c).otherwise(d) for a, b, c, d in ((0.0, 0.9, -0.8, 0.0), (1.0, 0.1, 0.2, 0.02)))
    return both.select("pair_id", "l", F.zip_with("l", "o", lambda x, y: x * own + y * other).alias("r"))


_MODES = {"intensity": J.intensity_pair, "mid_side": J.mid_side_pair}


@query(f"""WITH RECURSIVE w(sfb, start, width) AS (VALUES {_values(WIDTHS)}), x AS (SELECT vec_id, unnest(range({BINS}))::INT AS bin, unnest(embedding)::DOUBLE * {GAIN} AS x FROM embeddings),
lr AS MATERIALIZED (SELECT a.vec_id // 2 AS pair_id, bin, a.x AS l, a.x * CASE a.vec_id // 2 % 4 WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN -0.8::DOUBLE ELSE 0 END + b.x * CASE a.vec_id // 2 % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.1::DOUBLE WHEN 2 THEN 0.2::DOUBLE ELSE 0.02::DOUBLE END AS r FROM x a JOIN x b USING (bin) WHERE a.vec_id % 2 = 0 AND b.vec_id = a.vec_id + 1),
en AS (SELECT pair_id, sfb, sum(l * l) AS el, sum(r * r) AS er, sum((l + r) * (l + r)) AS es, sum((l - r) * (l - r)) AS ed FROM lr JOIN w ON bin >= start AND bin < start + width GROUP BY ALL),
k1 AS (SELECT *, el + er AS e2, CASE WHEN sfb >= 8 AND el + er > 0 THEN CASE WHEN es >= pow(sqrt(el) + sqrt(er), 2) / pow(1.18::DOUBLE, 2) THEN 15 WHEN ed >= pow(sqrt(el) + sqrt(er), 2) / pow(1.18::DOUBLE, 2) THEN 14 END END AS kind FROM en),
k2 AS (SELECT *, CASE WHEN kind IS NOT NULL AND el > 0 THEN round_even(log10(el / e2) * (10 / 1.50515::DOUBLE), 0) END AS level, CASE WHEN kind IS NOT NULL AND er > 0 THEN round_even(log10(er / e2) * (10 / 1.50515::DOUBLE), 0) END AS other FROM k1),
k3 AS (SELECT *, kind IS NOT NULL AND (level IS NULL OR coalesce(other - level > 30, false)) AS ql FROM k2), k4 AS (SELECT *, kind IS NOT NULL AND NOT ql AND (other IS NULL OR coalesce(other - level < -30, false)) AS qr FROM k3),
isd AS (SELECT *, kind IS NOT NULL AND NOT ql AND NOT qr AS sent, sqrt(e2 / CASE WHEN kind = 15 THEN es ELSE ed END) AS gain, CASE WHEN kind = 15 THEN 1 ELSE -1 END AS sign FROM k4),
m1 AS (SELECT *, sfb >= 8 AND least(el, er) * pow(1.09::DOUBLE, 2) >= greatest(es / 4, ed / 4) AS near FROM en),
msd AS (SELECT *, CASE WHEN near AND es / 4 * pow(1.09::DOUBLE, 2) * 2 >= el + er THEN 1 WHEN near AND ed / 4 * pow(1.09::DOUBLE, 2) * 2 >= el + er THEN 2 END AS ms, CASE WHEN sfb >= 8 AND least(el, er) <= pow(0.1::DOUBLE, 2) * greatest(el, er) THEN CASE WHEN el < er THEN 1 ELSE 2 END END AS muted FROM m1),
v AS (SELECT pair_id, 0 AS mode, 0 AS side, sfb, bin, CASE WHEN sent THEN (l + sign * r) * gain ELSE l END AS x FROM lr JOIN w ON bin >= start AND bin < start + width JOIN isd USING (pair_id, sfb) UNION ALL
 SELECT pair_id, 0, 1, sfb, bin, r FROM lr JOIN w ON bin >= start AND bin < start + width UNION ALL
 SELECT pair_id, 1, 0, sfb, bin, CASE WHEN muted = 1 OR ms = 2 AND muted IS DISTINCT FROM 1 THEN 0 WHEN ms = 1 THEN 0.5 * (l + r) ELSE l END FROM lr JOIN w ON bin >= start AND bin < start + width JOIN msd USING (pair_id, sfb) UNION ALL
 SELECT pair_id, 1, 1, sfb, bin, CASE WHEN muted = 2 OR ms = 1 THEN 0 WHEN ms = 2 THEN 0.5 * (l - r) ELSE r END FROM lr JOIN w ON bin >= start AND bin < start + width JOIN msd USING (pair_id, sfb)),
bx AS MATERIALIZED (SELECT pair_id * 4 + mode * 2 + side AS key, sfb AS pos, 0 AS grp, sfb, start, width, 1 AS wins, bin - start AS i, x FROM v JOIN w USING (sfb)),
kq AS (SELECT DISTINCT key, 1.0::DOUBLE AS quality, {BINS} AS last, false AS short FROM bx),
pre AS (SELECT pair_id * 4 AS key, sfb AS pos, CASE WHEN ql THEN 0 END AS book, CASE WHEN sent THEN level ELSE 0 END AS base FROM isd UNION ALL SELECT pair_id * 4 + 1, sfb, CASE WHEN qr THEN 0 WHEN sent THEN kind END, CASE WHEN sent THEN level - other ELSE 0 END FROM isd), {Y.coded(presets=True)},
ch AS (SELECT key, lpad(bin(g0 & 255), 8, '0') || se || sd || '000' || sp AS d FROM bits),
fl AS (SELECT pair_id, string_agg(CASE WHEN ms IS NULL THEN '0' ELSE '1' END, '' ORDER BY sfb) AS flags FROM msd GROUP BY ALL),
f AS (SELECT l.key, '001' || '0000' || '1' || '0000' || lpad(bin({len(WIDTHS)}), 6, '0') || '0' || CASE WHEN l.key % 4 = 0 THEN '00' ELSE '01' || flags END || l.d || r.d AS d FROM ch l JOIN ch r ON r.key = l.key + 1 AND l.key % 2 = 0 JOIN fl ON pair_id = l.key // 4), {Y.closed("f")},
us AS (SELECT pair_id * 4 AS key, count(*) FILTER (sent) AS used FROM isd GROUP BY ALL UNION ALL SELECT pair_id * 4 + 2, count(ms) FROM msd GROUP BY ALL)
SELECT key // 4 AS pair_id, CASE WHEN key % 4 = 0 THEN 'intensity' ELSE 'mid_side' END AS mode, CAST(used AS INT) AS used, n_bits, {Y.HEX} AS payload FROM shut JOIN us USING (key)""")
def pair_frame_bytes(spark, sf_dir):
    """Frames of channel pairs with a common window: intensity with its books and positions, and mid/side with its mask."""
    codes, rows = T.code_table(), pairs(spark, sf_dir)
    cut = rows.select("pair_id", P.grouped_bands(F.col("l"), P.band_table(WIDTHS)).alias("l"), P.grouped_bands(F.col("r"), P.band_table(WIDTHS)).alias("r"))
    both = [cut.select("pair_id", F.lit(mode).alias("mode"), coding(F.col("l"), F.col("r")).alias("j")) for mode, coding in _MODES.items()]
    sides = J.one_array(both[0].unionByName(both[1]), "j")
    sides = P.code_bands(sides, codes, last=BINS)
    left, right = J.side_of(F.col("bands"), 0), J.side_of(F.col("bands"), 1)
    info, mask = P.window_info(F.lit(0), F.lit(len(WIDTHS))), F.when(F.col("mode") == "mid_side", F.col("used"))
    element = P.pair(0, info, mask, P.coded_channel(left, codes, None), P.coded_channel(right, codes, None))
    used = F.aggregate("used", F.lit(0), lambda s, m: s + m)
    return shut(sides.select("pair_id", "mode", used.alias("used"), element.alias("element")), "pair_id", "mode", "used")


_SETTINGS = "st AS (SELECT s_suppkey - 1 AS place, [{rates}][1 + s_suppkey % 12] AS rate, 1 + s_suppkey % 2 AS channels, 16000 + s_suppkey * 7919 % 80000 AS asked, CASE WHEN s_suppkey % 5 = 0 THEN 3000 + s_suppkey * 211 % 9000 ELSE 0 END AS want FROM supplier)".format(rates=", ".join(map(str, T.RATES)))
_TABLES = ", ".join(f"({r}, {s}, {i}, {a}, {w}, {'true' if r in (44100, 48000) else 'false'})" for r in T.RATES for s in (0, 1) for i, a, w in (lambda ws: [(i, sum(ws[:i]), w) for i, w in enumerate(ws)])(T.band_widths(r, bool(s))))


def rate_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """place, rate, channels, bitrate, bandwidth, quality of a setting for each supplier, over all rates; some ask for a bandwidth."""
    key = F.col("s_suppkey")
    rate = F.get(F.array(*map(F.lit, T.RATES)), (key % 12).cast("int"))
    want = F.when(key % 5 == 0, 3000 + key * 211 % 9000).otherwise(0)
    return table(spark, sf_dir, "supplier").select((key - 1).alias("place"), rate.alias("rate"), (1 + key % 2).alias("channels"), (16000 + key * 7919 % 80000).alias("bitrate"), want.alias("bandwidth"), F.lit(0).alias("quality"))


@query(f"""WITH RECURSIVE {_SETTINGS}, tb(rate, short, sfb, start, width, listed) AS (VALUES {_TABLES}), s1 AS (SELECT *, least(asked, rate * 64 // channels) AS bitrate FROM st),
s2 AS (SELECT *, bitrate * channels / 1280::DOUBLE AS steady, CASE WHEN want > 0 THEN want ELSE least(CAST(floor(bitrate * rate * 0.42::DOUBLE / 50000::DOUBLE) AS BIGINT), 18000) END AS bw FROM s1),
s3 AS (SELECT place, rate, least(greatest(bw, 100), rate // 2) AS bandwidth, CAST(floor(least(greatest(CASE WHEN want > 0 THEN 100 WHEN steady > 100 THEN (steady - 100) * 3 + 100 ELSE steady END, 10), 5000)) AS BIGINT) AS quality FROM s2),
h AS (SELECT place, s3.rate, bandwidth, quality, CAST(floor(sum(width) * any_value(s3.rate) / 256) AS BIGINT) AS snap FROM s3 JOIN tb ON tb.rate = s3.rate AND short = 1 AND start < bandwidth * 256 // s3.rate GROUP BY ALL),
lm AS (SELECT place, h.rate, bandwidth, quality, listed, count(*) AS n_bands, sum(width) AS bins FROM h JOIN tb ON tb.rate = h.rate AND short = 0 AND start < snap * 2048 // h.rate GROUP BY ALL),
fr AS (SELECT DISTINCT vec_id // 16 AS key FROM embeddings), n AS (SELECT count(*) AS n FROM supplier), kl AS (SELECT fr.key, lm.* FROM fr, n JOIN lm ON lm.place = fr.key % n.n),
x AS (SELECT vec_id // 16 AS key, vec_id % 16 * {BINS} + unnest(range({BINS}))::INT AS bin, unnest(embedding)::DOUBLE * {GAIN} AS x FROM embeddings),
bx AS MATERIALIZED (SELECT kl.key, sfb AS pos, 0 AS grp, sfb, start, width, 1 AS wins, r.bin - start AS i, coalesce(x, 0) AS x FROM kl JOIN tb ON tb.rate = kl.rate AND short = 0 AND sfb < n_bands JOIN range(1024) r(bin) ON r.bin >= start AND r.bin < start + width LEFT JOIN x ON x.key = kl.key AND x.bin = r.bin),
kq AS (SELECT key, quality / 100::DOUBLE AS quality, 1024 AS last, false AS short FROM kl), {Y.coded()}
SELECT key AS frame_no, rate, listed, bandwidth, quality, CAST(n_bands AS INT) AS n_bands, CAST(bins AS INT) AS bins, CAST(g0 AS INT) AS gain, CAST(len(se) AS INT) AS section_bits, CAST(len(sd) AS INT) AS sf_bits, CAST(len(sp) AS INT) AS spectrum_bits FROM bits JOIN kl USING (key)""")
def mixed_rates(spark, sf_dir):
    """Frames of streams of all rates in one table: settings, band limits and bands of each row by its own rate; widths by the rule where `listed` is false."""
    settings = resolve(rate_settings(spark, sf_dir)).join(F.broadcast(T.rate_bands(spark)), "rate")  # twelve rows
    settings = B.bandwidth_limits(settings, "short", "long").withColumn("used", F.slice("long", F.lit(1), F.col("n_bands")))
    n = table(spark, sf_dir, "supplier").count()
    frames = blocks(spark, sf_dir, 16).withColumn("place", F.col("frame_no") % n).join(settings, "place")
    rows = frames.withColumn("bands", P.grouped_bands(F.col("spectrum"), F.col("used"))).drop("spectrum")
    rows = P.code_bands(rows, T.code_table(), quality=F.col("quality") / 100.0)
    gain, codes = C.first_gain(F.col("bands")), T.code_table()
    sizes = {"section_bits": P.section_words(P.runs(F.col("bands"))), "sf_bits": P.delta_words(C.changes(F.col("bands"), gain), codes)}
    spectrum_bits = F.aggregate("bands", F.lit(0), lambda s, b: s + b["bits"])
    return rows.select("frame_no", "rate", "listed", "bandwidth", "quality", "n_bands", "bins", gain.alias("gain"), *(P.size_of(w).alias(c) for c, w in sizes.items()), spectrum_bits.alias("spectrum_bits"))


_ORDERS = " ".join(f"WHEN {r} THEN {i}" for i, r in enumerate(T.RATES))
_LISTS = [f"[{', '.join(map(str, t))}]" for t in (N.FIRST_BANDS, N.END_BANDS)]
_UP, _DOWN = (repr((2 ** (N.BITS - 1) + d) / (math.pi / 2)) for d in (-0.5, 0.5))


@query(f"""WITH RECURSIVE tb(rate, short, sfb, start, width, listed) AS (VALUES {_TABLES}), fr AS (SELECT DISTINCT vec_id // 16 AS key FROM embeddings),
nb AS (SELECT rate, count(*) AS n_bands, list(start ORDER BY sfb) || [1024] AS starts FROM tb WHERE short = 0 GROUP BY rate),
kr AS MATERIALIZED (SELECT key, nb.*, CASE nb.rate {_ORDERS} END AS ri FROM fr JOIN nb ON nb.rate = [{", ".join(map(str, T.RATES))}][1 + key % 12]),
sp AS MATERIALIZED (SELECT *, n_bands - {_LISTS[0]}[ri + 1] AS length, starts[1 + least({_LISTS[0]}[ri + 1], {_LISTS[1]}[ri + 1], n_bands)] AS first, starts[1 + greatest(least({_LISTS[0]}[ri + 1], {_LISTS[1]}[ri + 1], n_bands), least(n_bands, {_LISTS[1]}[ri + 1]))] AS stop, CASE WHEN ri <= 5 THEN 12 ELSE 20 END AS ord FROM kr),
x0 AS (SELECT vec_id // 16 AS key, vec_id % 16 * {BINS} + unnest(range({BINS}))::INT AS bin, unnest(embedding)::DOUBLE * {GAIN} AS x FROM embeddings),
x1 AS MATERIALIZED (SELECT fr.key, r.bin, coalesce(x, 0) AS x FROM fr JOIN range(1024) r(bin) ON true LEFT JOIN x0 ON x0.key = fr.key AND x0.bin = r.bin),
x AS MATERIALIZED (SELECT key, bin, x + CASE WHEN key % 3 = 0 THEN 0 ELSE 0.9::DOUBLE * lag(x, 1, 0) OVER (PARTITION BY key ORDER BY bin) END AS x FROM x1),
r AS (SELECT key, list(r ORDER BY lag) AS r FROM (SELECT sp.key, l.lag, coalesce(sum(a.x * b.x), 0) AS r FROM sp JOIN range(21) l(lag) ON l.lag <= ord LEFT JOIN x a ON a.key = sp.key AND a.bin >= first AND a.bin < stop - l.lag LEFT JOIN x b ON b.key = sp.key AND b.bin = a.bin + l.lag GROUP BY ALL) GROUP BY key),
lv AS (SELECT key, 0 AS m, [1.0::DOUBLE] AS a, []::DOUBLE[] AS k, r[1] AS error FROM r WHERE r[1] > 0 UNION ALL
 SELECT key, m + 1, [coalesce(a[i], 0) + kt * coalesce(a[m + 3 - i], 0) FOR i IN range(1, m + 3)], k || [kt], error * (1 - kt * kt) FROM (SELECT lv.*, -list_sum([a[i + 1] * r.r[m - i + 2] FOR i IN range(0, m + 1)]) / error AS kt FROM lv JOIN r USING (key) JOIN sp USING (key) WHERE m < ord)),
gn AS MATERIALIZED (SELECT lv.key, r[1] / error AS gain, k FROM lv JOIN sp USING (key) JOIN r USING (key) WHERE m = ord),
ix AS (SELECT key, list_transform(k, lambda v: CAST(trunc(CASE WHEN v >= 0 THEN 0.5 + asin(v) * {_UP} ELSE -0.5 + asin(v) * {_DOWN} END) AS INT)) AS ix FROM gn WHERE gain > 1.4),
vl AS (SELECT key, ix, list_transform(ix, lambda v: sin(v / CASE WHEN v >= 0 THEN {_UP} ELSE {_DOWN} END)) AS vl FROM ix),
ct AS MATERIALIZED (SELECT key, ix[1:n] AS ix, vl[1:n] AS vl, n FROM (SELECT *, coalesce(list_max(list_transform(range(1, len(vl) + 1), lambda i: CASE WHEN abs(vl[i]) > 0.1 THEN i ELSE 0 END)), 0) AS n FROM vl)),
su AS (SELECT key, 0 AS m, [1.0::DOUBLE] AS a FROM ct UNION ALL SELECT su.key, m + 1, [coalesce(a[i], 0) + vl[m + 1] * coalesce(a[m + 3 - i], 0) FOR i IN range(1, m + 3)] FROM su JOIN ct USING (key) WHERE m < n),
pr AS (SELECT su.key, a, n FROM su JOIN ct ON su.key = ct.key AND m = n), tp AS (SELECT key, j.j AS j, a[j.j + 1] AS a FROM pr JOIN range(1, 21) j(j) ON j.j <= n),
ad AS (SELECT c.key, c.bin, sum(tp.a * p.x) AS more FROM tp JOIN sp USING (key) JOIN x c ON c.key = tp.key AND c.bin - j >= first AND c.bin < stop JOIN x p ON p.key = tp.key AND p.bin = c.bin - j GROUP BY ALL),
y AS MATERIALIZED (SELECT key, bin, x + coalesce(more, 0) AS x FROM x LEFT JOIN ad USING (key, bin)),
bx AS MATERIALIZED (SELECT kr.key, sfb AS pos, 0 AS grp, sfb, start, width, 1 AS wins, bin - start AS i, x FROM kr JOIN tb ON tb.rate = kr.rate AND short = 0 JOIN y ON y.key = kr.key AND bin >= start AND bin < start + width),
kq AS (SELECT key, 1.0::DOUBLE AS quality, 1024 AS last, false AS short FROM kr), {Y.coded()},
f AS (SELECT key, '0000000' || lpad(bin(g0 & 255), 8, '0') || '0000' || lpad(bin(n_bands), 6, '0') || '0' || se || sd || '0' || CASE WHEN ix IS NULL THEN '0' ELSE '1' || '01' || '1' || lpad(bin(length), 6, '0') || lpad(bin(n), 5, '0') || CASE WHEN n > 0 THEN '00' || array_to_string(list_transform(ix, lambda v: lpad(bin((v + 16) & 15), 4, '0')), '') ELSE '' END END || '0' || sp AS d FROM bits JOIN sp USING (key) LEFT JOIN ct USING (key)), {Y.closed("f")}
SELECT key AS frame_no, rate, ord AS "order", round(coalesce(gain, 0), 6) + 0.0 AS gain, array_to_string(ix, ',') AS indices, CAST(length AS INT) AS length, n_bits, md5({Y.HEX}) AS payload_md5 FROM shut JOIN sp USING (key) LEFT JOIN gn USING (key) LEFT JOIN ct USING (key)""")
def noise_shaping(spark, sf_dir):
    """Frames of all rates with shaped spectra: order and span by rate, coefficients in the frame, the filtered spectrum coded; two of three spectra are smoothed before."""
    rows = blocks(spark, sf_dir, 16)
    before = F.concat(F.array(F.lit(0.0)), F.slice("spectrum", 1, 1023))
    rows = rows.withColumn("spectrum", F.zip_with("spectrum", before, lambda x, y: x + F.when(F.col("frame_no") % 3 == 0, 0.0).otherwise(y * 0.9)))
    rows = rows.withColumn("rate", F.get(F.array(*map(F.lit, T.RATES)), (F.col("frame_no") % 12).cast("int"))).join(F.broadcast(T.rate_bands(spark)), "rate")  # twelve rows
    starts = F.concat(F.transform("long", lambda b: b["start"]), F.array(F.lit(1024)))
    rows = N.shape(rows, "spectrum", starts, F.size("long"), rate_index(F.col("rate")))
    rows = P.code_bands(rows.withColumn("bands", P.grouped_bands(F.col("spectrum"), F.col("long"))).drop("spectrum"), T.code_table())
    shaping = P.shaping_words(F.col("indices"), F.col("length"))
    element = P.single(0, P.coded_channel(F.col("bands"), T.code_table(), P.window_info(F.lit(0), F.size("long")), shaping=shaping))
    rows = rows.select("frame_no", "rate", "order", (F.round("gain", 6) + 0.0).alias("gain"), F.array_join("indices", ",").alias("indices"), "length", element.alias("element"))
    return shut(rows, "frame_no", "rate", "order", "gain", "indices", "length").withColumn("payload_md5", F.md5("payload")).drop("payload")


#: Channels of a frame: one single, two pairs and a low-frequency one, which keeps its first bands only.
CHANNELS, LOW_BANDS, WRITER = 6, 3, "cadenza 1"


def _writer_bits() -> str:
    """The filler element with the writer's name at the begin of a frame: count of bytes, a byte's lead, two empty bytes, the name and a zero."""
    body = WRITER.encode() + b"\0"
    size = len(body) + 3
    lead = -(3 + 4) % 8 if size < 15 else -(3 + 4 + 8) % 8
    head = "110" + (format(size, "04b") if size < 15 else "1111" + format(size - 14, "08b"))
    return head + "0" * lead + "0" * 16 + "".join(format(b, "08b") for b in body) + "0" * (8 - lead)


@query(f"""WITH RECURSIVE w(sfb, start, width) AS (VALUES {_values(WIDTHS)}), x AS (SELECT vec_id // {CHANNELS} AS frame_no, vec_id % {CHANNELS} AS ch, unnest(range({BINS}))::INT AS bin, unnest(embedding)::DOUBLE * {GAIN} AS x FROM embeddings),
ok AS (SELECT frame_no FROM x GROUP BY frame_no HAVING count(DISTINCT ch) = {CHANNELS}),
lr AS MATERIALIZED (SELECT a.frame_no, a.ch, sfb, start, width, bin, a.x AS l, b.x AS r FROM x a JOIN x b USING (frame_no, bin) JOIN ok USING (frame_no) JOIN w ON bin >= start AND bin < start + width WHERE a.ch IN (1, 3) AND b.ch = a.ch + 1),
en AS (SELECT frame_no, ch, sfb, sum(l * l) AS el, sum(r * r) AS er, sum((l + r) * (l + r)) AS es, sum((l - r) * (l - r)) AS ed FROM lr GROUP BY ALL),
k1 AS (SELECT *, el + er AS e2, CASE WHEN sfb >= 8 AND el + er > 0 THEN CASE WHEN es >= pow(sqrt(el) + sqrt(er), 2) / pow(1.18::DOUBLE, 2) THEN 15 WHEN ed >= pow(sqrt(el) + sqrt(er), 2) / pow(1.18::DOUBLE, 2) THEN 14 END END AS kind FROM en),
k2 AS (SELECT *, CASE WHEN kind IS NOT NULL AND el > 0 THEN round_even(log10(el / e2) * (10 / 1.50515::DOUBLE), 0) END AS level, CASE WHEN kind IS NOT NULL AND er > 0 THEN round_even(log10(er / e2) * (10 / 1.50515::DOUBLE), 0) END AS other FROM k1),
k3 AS (SELECT *, kind IS NOT NULL AND (level IS NULL OR coalesce(other - level > 30, false)) AS ql FROM k2), k4 AS (SELECT *, kind IS NOT NULL AND NOT ql AND (other IS NULL OR coalesce(other - level < -30, false)) AS qr FROM k3),
isd AS MATERIALIZED (SELECT *, kind IS NOT NULL AND NOT ql AND NOT qr AS sent, sqrt(e2 / CASE WHEN kind = 15 THEN es ELSE ed END) AS gain, CASE WHEN kind = 15 THEN 1 ELSE -1 END AS sign FROM k4),
v AS (SELECT frame_no, ch, sfb, start, width, bin, x FROM x JOIN ok USING (frame_no) JOIN w ON bin >= start AND bin < start + width WHERE ch = 0 OR ch = 5 AND sfb < {LOW_BANDS} UNION ALL
 SELECT frame_no, ch, sfb, start, width, bin, CASE WHEN sent THEN (l + sign * r) * gain ELSE l END FROM lr JOIN isd USING (frame_no, ch, sfb) UNION ALL SELECT frame_no, ch + 1, sfb, start, width, bin, r FROM lr),
bx AS MATERIALIZED (SELECT frame_no * {CHANNELS} + ch AS key, sfb AS pos, 0 AS grp, sfb, start, width, 1 AS wins, bin - start AS i, x FROM v),
kq AS (SELECT DISTINCT key, 1.0::DOUBLE AS quality, {BINS} AS last, false AS short FROM bx),
pre AS (SELECT frame_no * {CHANNELS} + ch AS key, sfb AS pos, CASE WHEN ql THEN 0 END AS book, CASE WHEN sent THEN level ELSE 0 END AS base FROM isd UNION ALL SELECT frame_no * {CHANNELS} + ch + 1, sfb, CASE WHEN qr THEN 0 WHEN sent THEN kind END, CASE WHEN sent THEN level - other ELSE 0 END FROM isd), {Y.coded(presets=True)},
c0 AS (SELECT key // {CHANNELS} AS frame_no, key % {CHANNELS} AS ch, lpad(bin(g0 & 255), 8, '0') AS g, se || sd || '000' || sp AS d FROM bits),
el AS (SELECT frame_no, ch, CASE WHEN ch = 0 THEN '000' || '0000' || g || '0000' || lpad(bin({len(WIDTHS)}), 6, '0') || '0' || d WHEN ch = 5 THEN '011' || '0000' || g || '0000' || lpad(bin({LOW_BANDS}), 6, '0') || '0' || d
 WHEN ch IN (1, 3) THEN '001' || lpad(bin((ch // 2)::INT), 4, '0') || '1' || '0000' || lpad(bin({len(WIDTHS)}), 6, '0') || '0' || '00' || g || d ELSE g || d END AS d FROM c0),
f AS (SELECT frame_no AS key, CASE WHEN frame_no = 0 THEN '{_writer_bits()}' ELSE '' END || string_agg(d, '' ORDER BY ch) AS d FROM el GROUP BY frame_no), {Y.closed("f")}
SELECT key AS frame_no, n_bits, 7 + CAST(ceil((n_bits + 0.0) / 8) AS INT) AS bytes, {Y.HEX} AS payload FROM shut""")
def channels_frame_bytes(spark, sf_dir):
    """Frames of six channels by their layout: a single element, two pairs with intensity, a low-frequency element of few bands; the first frame names the writer."""
    codes = T.code_table()
    rows = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / CHANNELS).alias("frame_no"), (F.col("vec_id") % CHANNELS).alias("ch"), F.transform("embedding", lambda e: e.cast("double") * GAIN).alias("x"))
    packed = rows.groupBy("frame_no").agg(F.sort_array(F.collect_list(F.struct("ch", "x"))).alias("l")).where(F.size("l") == CHANNELS)  # six members
    cut = lambda ch, widths: P.grouped_bands(F.get("l", F.lit(ch))["x"], P.band_table(widths))
    layout = [(r["channel"], r["kind"]) for r in T.layout(spark).where(f"channels = {CHANNELS} and use_lfe = 1").orderBy("channel").collect()]  # one row a channel
    lefts = [c for c, kind in layout if kind == "pair"][::2]
    joint = packed.select("frame_no", *(cut(c, WIDTHS[:LOW_BANDS] if kind == "lfe" else WIDTHS).alias(f"b{c}") for c, kind in layout))
    joint = joint.withColumns({f"j{c}": J.intensity_pair(F.col(f"b{c}"), F.col(f"b{c + 1}")) for c in lefts})
    none = lambda b: b.withField("preset", F.lit(None).cast("int")).withField("base", F.lit(0))
    sides = {c: F.transform(f"b{c}", none) for c, kind in layout if kind != "pair"}
    for c in lefts:
        sides |= {c: F.transform(f"j{c}", lambda p: p["l"]), c + 1: F.transform(f"j{c}", lambda p: p["r"])}
    numbered = lambda c: F.transform(sides[c], lambda b: b.withField("group", F.lit(c)))
    whole = F.concat(*(numbered(c) for c, _ in layout))
    coded = P.code_bands(joint.select("frame_no", whole.alias("bands")), codes, last=BINS)
    own = lambda c: F.filter("bands", lambda b: b["group"] == c)
    info = lambda n: P.window_info(F.lit(0), F.lit(n))
    parts, pair_no = [], 0
    for c, kind in layout:
        if kind == "pair":
            if c in lefts:
                parts.append(P.pair(pair_no, info(len(WIDTHS)), None, *(P.coded_channel(own(k), codes, None) for k in (c, c + 1))))
                pair_no += 1
        else:
            parts.append(P.single(0, P.coded_channel(own(c), codes, info(LOW_BANDS if kind == "lfe" else len(WIDTHS))), low=kind == "lfe"))
    writer = F.when(F.col("frame_no") == 0, P.identification(WRITER, 0)).otherwise(P.nothing())
    done = shut(coded.select("frame_no", F.concat(writer, *parts).alias("element")), "frame_no")
    return done.select("frame_no", "n_bits", (7 + F.ceil(F.col("n_bits") / 8)).cast("int").alias("bytes"), "payload")
