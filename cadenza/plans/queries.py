"""Registered queries of the signal operators and their SQL.

The driver's tables hold no audio. `events.value` in the order of (ts, event_id) stands in for the samples of one stream a user, and
`embeddings.embedding` (64 numbers) for a frame's spectrum; vectors 2k and 2k+1 are the left and right channel of a pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import signal as S
from cadenza.operators import bands as B
from cadenza.operators import coding as C
from cadenza.operators import decisions as D
from cadenza.operators import encoder as E
from cadenza.operators import framing as R
from cadenza.operators import payload as P
from cadenza.operators import rate as Q
from cadenza.operators import spectral as X
from cadenza.plans import tables as T
from cadenza.sources import container as K

SIZE, BINS, GAIN = 16, 64, 40.0
WIDTHS = [4] * 16
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_id", "value")
    return R.number_samples(rows, "stream_id", ["ts", "event_id"], F.to_date("ts")).select("stream_id", "n", "value")


def framed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.frames(samples(spark, sf_dir), SIZE)


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, bin, x of all vectors."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("bin", "e"))
    return rows.select("vec_id", "bin", (F.col("e").cast("double") * GAIN).alias("x"))


def banded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.with_bands(spectrum(spark, sf_dir), T.bands(spark, WIDTHS))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return banded(spark, sf_dir).withColumns({"pair_id": F.floor(F.col("vec_id") / 2), "side": F.col("vec_id") % 2})


def r(c: str, n: int = 4) -> F.Column:
    return (F.round(F.col(c), n) + 0.0).alias(c)


_S = "s AS (SELECT user_id AS stream_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events)"
_F = f"{_S}, f AS (SELECT stream_id, n // {SIZE} AS frame_no, CAST(n % {SIZE} AS INT) AS pos, value FROM s)"
_X = f"x AS (SELECT vec_id, unnest(range({BINS}))::INT AS bin, unnest(embedding)::DOUBLE * {GAIN} AS x FROM embeddings), b AS (SELECT *, bin // 4 AS sfb FROM x)"
_E = f"{_X}, e AS (SELECT vec_id, sfb, sum(x * x) AS energy, max(x * x) AS peak, count(*) AS n FROM b GROUP BY ALL)"
_P = f"{_X}, e AS (SELECT l.vec_id // 2 AS pair_id, l.sfb, sum(l.x * l.x) AS e_left, sum(r.x * r.x) AS e_right, sum((l.x + r.x) ** 2) AS e_sum, sum((l.x - r.x) ** 2) AS e_diff FROM b l JOIN b r ON l.vec_id % 2 = 0 AND r.vec_id = l.vec_id + 1 AND l.bin = r.bin GROUP BY ALL)"
_RATES = "q AS (SELECT s_suppkey, 7000 + (s_suppkey * 97) % 93000 AS rate FROM supplier)"
_CASE = " ".join(f"WHEN rate >= {v} THEN {i}" for i, v in enumerate(S.RATE_STARTS))


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", (7000 + (F.col("s_suppkey") * 97) % 93000).alias("rate"))


@query(f"WITH {_RATES} SELECT s_suppkey, rate, CASE {_CASE} ELSE 11 END AS rate_index, rate * 64 AS max_rate, 8000 AS min_rate, 6144 - CAST(floor(64000 / rate * 1024) AS BIGINT) AS reservoir FROM q")
def rate_index(spark, sf_dir):
    return _rates(spark, sf_dir).select("s_suppkey", "rate", S.rate_index(F.col("rate")).alias("rate_index"), S.max_bitrate(F.col("rate")).alias("max_rate"), S.min_bitrate().alias("min_rate"), S.reservoir_bits(F.lit(64000), F.col("rate")).alias("reservoir"))


@query("SELECT p_partkey, CAST(floor(least(greatest(CASE WHEN p_size % 2 = 1 THEN 0.6 * p_retailprice + 24 * sqrt(p_retailprice) ELSE 0.3 * p_retailprice + 6 * sqrt(p_retailprice) END, 0), 6144) + 0.5) AS BIGINT) AS bits FROM part")
def bit_allocation(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.allocated_bits(F.col("p_retailprice"), F.col("p_size") % 2 == 1).alias("bits"))


@query("""WITH c AS (SELECT n.n AS channels, l.l AS use_lfe, unnest(range(n.n)) AS channel FROM range(1, 9) n(n), range(2) l(l)),
h AS (SELECT *, CASE WHEN channels = 2 THEN 0 ELSE 1 END AS head FROM c), k AS (SELECT *, channel - head AS k, (channels - head) // 2 AS pairs FROM h)
SELECT channels, use_lfe, channel, CASE WHEN channel < head THEN 'single' WHEN k < 2 * pairs THEN 'pair' WHEN use_lfe = 1 THEN 'lfe' ELSE 'single' END AS kind,
CASE WHEN channel < head THEN 0 WHEN k < 2 * pairs THEN CASE WHEN k % 2 = 0 THEN k // 2 END WHEN use_lfe = 1 THEN 0 ELSE head END AS tag,
CASE WHEN channel >= head AND k < 2 * pairs THEN k % 2 = 0 END AS is_left, CASE WHEN channel >= head AND k < 2 * pairs THEN CASE WHEN k % 2 = 0 THEN channel + 1 ELSE channel - 1 END END AS partner FROM k""")
def channel_layout(spark, sf_dir):
    return T.layout(spark)


@query(f"WITH {_F} SELECT stream_id, frame_no, round(sum(value * value), 4) + 0.0 AS energy, count(*) AS n FROM f GROUP BY ALL")
def frame_energy(spark, sf_dir):
    return framed(spark, sf_dir).groupBy("stream_id", "frame_no").agg(F.sum(F.col("value") * F.col("value")).alias("energy"), F.count("*").alias("n")).select("stream_id", "frame_no", r("energy"), "n")


@query(f"""WITH {_F}, l AS (SELECT stream_id, max(frame_no) AS last FROM f GROUP BY ALL), g AS (SELECT stream_id, unnest(range(last + 2)) AS frame_no FROM l), p AS (SELECT *, unnest(range({SIZE}))::INT AS pos FROM g)
SELECT stream_id, frame_no, pos, coalesce(value, 0) AS value FROM p LEFT JOIN f USING (stream_id, frame_no, pos)""")
def frame_pad(spark, sf_dir):
    return R.pad(framed(spark, sf_dir), SIZE, ["stream_id"], flush=1).select("stream_id", "frame_no", "pos", "value")


@query("WITH d AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT vec_id, i % 4 AS channel, i // 4 AS sample_no, v / 256 AS value FROM d")
def deinterleave(spark, sf_dir):
    return R.split_channels(table(spark, sf_dir, "embeddings"), ["vec_id"], "embedding", 4, 1 / 256)


@query("SELECT vec_id, unnest(range(64))::INT AS pos, unnest([embedding[6 * (i // 6) + [3, 1, 2, 5, 6, 4][i % 6 + 1]]::DOUBLE FOR i IN range(60)] || [embedding[i]::DOUBLE FOR i IN range(61, 65)]) AS value FROM embeddings")
def channel_remap(spark, sf_dir):
    """Ten interleaved rows of six channels a vector, each in the standard order; the four values that fill no row stay."""
    order = R.channel_map(6, 3, 4)
    rows = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda g: R.remap(F.slice("embedding", g * 6 + 1, 6), order)))
    moved = F.transform(F.concat(rows, F.slice("embedding", 61, 4)), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(moved).alias("pos", "value"))


@query(f"WITH {_F} SELECT stream_id, frame_no, round(sum((value * 0.5 * (1 - cos(2 * pi() * (pos + 0.5) / {SIZE}))) ** 2), 4) + 0.0 AS energy FROM f GROUP BY ALL")
def hann_energy(spark, sf_dir):
    v = F.col("value") * S.hann(F.col("pos"), SIZE)
    return framed(spark, sf_dir).groupBy("stream_id", "frame_no").agg(F.sum(v * v).alias("energy")).select("stream_id", "frame_no", r("energy"))


_MDCT = f"SELECT stream_id, frame_no, k.k AS bin, round(sum(value * 2 * cos(2 * pi() / {SIZE} * (pos + {(SIZE / 2 + 1) / 2}) * (k.k + 0.5))), 4) + 0.0 AS x FROM f, range({SIZE // 2}) k(k) GROUP BY ALL"


@query(f"WITH {_F} {_MDCT}")
def lapped_by_join(spark, sf_dir):
    return X.lapped_by_join(framed(spark, sf_dir), ["stream_id", "frame_no"], SIZE).select("stream_id", "frame_no", "bin", r("x"))


@query(f"WITH {_F} {_MDCT}")
def lapped_by_kernel(spark, sf_dir):
    arrays = X.lapped(R.frame_arrays(framed(spark, sf_dir), SIZE, ["stream_id", "frame_no"]))
    return arrays.select("stream_id", "frame_no", F.posexplode("spectrum").alias("bin", "x")).select("stream_id", "frame_no", "bin", r("x"))


@query(f"""WITH {_F} SELECT stream_id, frame_no, k.k AS bin, round(sum(value * cos(2 * pi() * pos * k.k / {SIZE})), 4) + 0.0 AS re, round(-sum(value * sin(2 * pi() * pos * k.k / {SIZE})), 4) + 0.0 AS im
FROM f, range({SIZE // 2 + 1}) k(k) GROUP BY ALL""")
def fourier(spark, sf_dir):
    arrays = X.fourier(R.frame_arrays(framed(spark, sf_dir), SIZE, ["stream_id", "frame_no"]))
    long = arrays.select("stream_id", "frame_no", F.posexplode(F.arrays_zip("re", "im")).alias("bin", "c"))
    return long.select("stream_id", "frame_no", "bin", F.col("c.re").alias("re"), F.col("c.im").alias("im")).select("stream_id", "frame_no", "bin", r("re"), r("im"))


@query(f"""WITH {_F}, w AS (SELECT stream_id, frame_no, pos, value * sin(pi() / {2 * SIZE} * ({SIZE - 1} - pos + 0.5)) AS v, pos + {SIZE} AS t FROM f UNION ALL
SELECT stream_id, frame_no + 1, pos, value * sin(pi() / {2 * SIZE} * (pos + 0.5)), pos FROM f), c AS (SELECT DISTINCT stream_id, frame_no FROM f),
d AS (SELECT w.* FROM w JOIN c USING (stream_id, frame_no))
SELECT stream_id, frame_no, k.k AS bin, round(sum(v * 2 * cos(2 * pi() / {2 * SIZE} * (t + {(SIZE + 1) / 2}) * (k.k + 0.5))), 4) + 0.0 AS x FROM d, range({SIZE}) k(k) GROUP BY ALL""")
def filter_bank(spark, sf_dir):
    from pyspark.sql import Window

    arrays = R.frame_arrays(framed(spark, sf_dir), SIZE, ["stream_id", "frame_no"])
    zeros = F.array_repeat(F.lit(0.0), SIZE)
    before = F.coalesce(F.lag("samples").over(Window.partitionBy("stream_id").orderBy("frame_no")), zeros)
    both = arrays.select("stream_id", "frame_no", X.overlapped(before, F.col("samples"), F.lit(0), SIZE, SIZE // 8).alias("samples"))
    return X.lapped(both).select("stream_id", "frame_no", F.posexplode("spectrum").alias("bin", "x")).select("stream_id", "frame_no", "bin", r("x"))


@query(f"""WITH {_F}, c AS (SELECT DISTINCT stream_id, frame_no FROM f), g AS (SELECT *, {SIZE} * (frame_no - 1) + 7 + 2 * w + t AS n FROM c, range(8) w(w), range(4) t(t)),
v AS (SELECT g.stream_id, g.frame_no, w, t, coalesce(value, 0) * sin(pi() / 4 * (t + 0.5)) AS v FROM g LEFT JOIN s USING (stream_id, n))
SELECT stream_id, frame_no, CAST(2 * w + k AS INT) AS bin, round(sum(v * 2 * cos(2 * pi() / 4 * (t + 1.5) * (k + 0.5))), 4) + 0.0 AS x FROM v, range(2) k(k) GROUP BY ALL""")
def short_filter_bank(spark, sf_dir):
    from pyspark.sql import Window

    arrays = R.frame_arrays(framed(spark, sf_dir), SIZE, ["stream_id", "frame_no"])
    before = F.coalesce(F.lag("samples").over(Window.partitionBy("stream_id").orderBy("frame_no")), F.array_repeat(F.lit(0.0), SIZE))
    cut = arrays.select("stream_id", "frame_no", X.short_blocks(before, F.col("samples"), SIZE, 2).alias("samples"))
    return X.lapped(cut, window=4).select("stream_id", "frame_no", F.posexplode("spectrum").alias("bin", "x")).select("stream_id", "frame_no", "bin", r("x"))


@query("WITH w AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS sfb, p_size AS width FROM part) SELECT p_brand, sfb, width, CAST(coalesce(sum(width) OVER (PARTITION BY p_brand ORDER BY sfb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start FROM w")
def band_offsets(spark, sf_dir):
    parts = R.number_samples(table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.col("p_size").alias("width")), "p_brand", ["p_partkey"], F.floor(F.col("p_partkey") / 1000), "sfb")
    return B.band_offsets(parts.select("p_brand", "sfb", "width"), ["p_brand"])


_LONG = "w(sfb, width) AS (VALUES " + ", ".join(f"({i}, {w})" for i, w in enumerate(T.LONG_44)) + "), p AS (SELECT sfb, width, coalesce(sum(width) OVER (ORDER BY sfb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w)"


_SHORT = "y(sfb, width) AS (VALUES " + ", ".join(f"({i}, {w})" for i, w in enumerate(T.SHORT_44)) + "), d AS (SELECT sfb, width, coalesce(sum(width) OVER (ORDER BY sfb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM y)"


@query(f"""WITH {_LONG}, {_SHORT}, q AS (SELECT DISTINCT 44100 AS rate, 100 + (s_suppkey * 211) % 21000 AS bandwidth FROM supplier),
h AS (SELECT rate, bandwidth, count(sfb) AS n_short, CAST(floor(coalesce(sum(width), 0) * rate / 256) AS BIGINT) AS snap FROM q LEFT JOIN d ON start < bandwidth * 256 // rate GROUP BY rate, bandwidth),
o AS (SELECT rate, bandwidth, n_short, count(sfb) AS n_bands, coalesce(sum(width), 0) AS bins FROM h LEFT JOIN p ON start < snap * 2048 // rate GROUP BY rate, bandwidth, n_short)
SELECT rate, bandwidth, CAST(n_short AS INT) AS n_short, CAST(n_bands AS INT) AS n_bands, CAST(bins AS INT) AS bins, CAST(floor(bins * rate / 2048) AS BIGINT) AS snapped FROM o""")
def bandwidth_limit(spark, sf_dir):
    wanted = table(spark, sf_dir, "supplier").select(F.lit(44100).alias("rate"), (100 + (F.col("s_suppkey") * 211) % 21000).alias("bandwidth")).distinct()
    return B.bandwidth_limit(T.SHORT_44, T.LONG_44, wanted)


@query(f"WITH {_X} SELECT vec_id, sfb, round(sum(x * x), 4) + 0.0 AS energy, round(max(x * x), 4) + 0.0 AS peak, count(*) AS n FROM b WHERE bin > 0 AND bin < 56 GROUP BY ALL")
def band_energy(spark, sf_dir):
    rows = B.with_bands(spectrum(spark, sf_dir), T.bands(spark, WIDTHS), limit=56)
    return B.energies(rows, ["vec_id"], skip_first=True).select("vec_id", "sfb", r("energy"), r("peak"), "n")


_TARGET = f"""t AS (SELECT *, sum(energy) OVER (PARTITION BY vec_id) AS total FROM e), m AS (SELECT *, CASE WHEN total < 0.16 * {BINS} THEN 0 ELSE
(0.2 * pow(energy / (total / {BINS} * 4), 0.4) + 0.8 * 0.45 * pow(peak / (total / {BINS} * 4), 0.4)) * (10.0 / (1 + (8 * sfb + 4) / {BINS})) END AS target FROM t)"""


@query(f"WITH {_E}, {_TARGET} SELECT vec_id, sfb, round(target, 4) + 0.0 AS target FROM m")
def masking_targets(spark, sf_dir):
    return _targets(spark, sf_dir).select("vec_id", "sfb", r("target"))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.masking_targets(B.energies(banded(spark, sf_dir), ["vec_id"]), ["vec_id"], BINS, T.bands(spark, WIDTHS))


_RMS = f"{_E}, {_TARGET}, h AS (SELECT *, sqrt(energy / n) AS rms FROM m), g AS (SELECT *, CASE WHEN rms < 0.4 OR target = 0 THEN NULL ELSE round_even(log10(target / rms) * {S.STEP!r}, 0) END AS sfac FROM h), z AS (SELECT *, CASE WHEN sfac IS NULL THEN 0 WHEN target < 0.4 THEN 13 WHEN sfac > 90 THEN 0 END AS book FROM g)"


@query(f"WITH {_RMS} SELECT vec_id, sfb, book, CAST(CASE WHEN sfac IS NULL THEN 0 WHEN book = 13 THEN round_even(log10(energy) * {S.STEP / 2!r}, 0) ELSE 100 - sfac END AS INT) AS sf FROM z")
def band_plan(spark, sf_dir):
    return C.band_plan(_targets(spark, sf_dir)).select("vec_id", "sfb", "book", "sf")


_Q = f"{_RMS}, k AS (SELECT b.vec_id, b.sfb, b.bin, b.x, CAST(sign(b.x) * floor(pow(abs(b.x) * pow(10, sfac / {S.STEP!r}), 0.75) + {S.ROUNDING}) AS INT) AS q FROM b JOIN z USING (vec_id, sfb) WHERE book IS NULL)"


def _quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.quantized(banded(spark, sf_dir), C.band_plan(_targets(spark, sf_dir)), ["vec_id"])


@query(f"WITH {_Q} SELECT vec_id, bin, q FROM k")
def quantize_values(spark, sf_dir):
    return _quantized(spark, sf_dir).select("vec_id", "bin", "q")


@query(f"WITH {_Q} SELECT vec_id, sfb, max(abs(q)) AS max_q FROM k GROUP BY ALL")
def max_abs_per_band(spark, sf_dir):
    return B.largest(_quantized(spark, sf_dir), ["vec_id"])


_CODES = "c(book, idx, len, code) AS (VALUES " + ", ".join(f"({b},{i},{n},{c})" for b, i, n, c in T.code_table()) + ")"


def _digits(size: int, base: int, shift: int, top: int) -> str:
    out = "0"
    for i in range(1, size + 1):
        d = f"v[{i}] + {shift}" if shift else f"least(abs(v[{i}]), {top})"
        out = f"({out}) * {base} + {d}"
    return out


_IDX = " ".join(f"WHEN {b} THEN {_digits(n, 2 * t + 1 if s else t + 1, t if s else 0, t)}" for b, (t, n, s) in T.BOOKS.items())
_BOOKS = f"""{_Q}, o AS (SELECT vec_id, sfb, max(abs(q)) AS top FROM k GROUP BY ALL),
cand AS (SELECT vec_id, sfb, unnest(CASE WHEN top < 1 THEN [0] WHEN top < 2 THEN [1, 2] WHEN top < 3 THEN [3, 4] WHEN top < 5 THEN [5, 6] WHEN top < 8 THEN [7, 8] WHEN top < 13 THEN [9, 10] ELSE [11] END) AS book FROM o),
t4 AS (SELECT vec_id, sfb, bin // 4 AS t, list(q ORDER BY bin) AS v, 4 AS size FROM k GROUP BY ALL UNION ALL SELECT vec_id, sfb, bin // 2, list(q ORDER BY bin), 2 FROM k GROUP BY ALL),
i AS (SELECT *, CASE book {_IDX} END AS idx FROM t4 JOIN cand USING (vec_id, sfb) WHERE (book BETWEEN 1 AND 4 AND size = 4) OR (book >= 5 AND size = 2)),
{_CODES}, sized AS (SELECT vec_id, sfb, book, sum(len + CASE WHEN book IN (3, 4, 7, 8, 9, 10, 11) THEN len(list_filter(v, lambda a: a <> 0)) ELSE 0 END
 + CASE WHEN book = 11 THEN coalesce(list_sum(list_transform(list_filter(v, lambda a: abs(a) >= 16), lambda a: 2 * (floor(log2(abs(a) + 0.5)) - 4) + 5)), 0) ELSE 0 END)::BIGINT AS bits FROM i JOIN c USING (book, idx) GROUP BY ALL
 UNION ALL SELECT vec_id, sfb, 0, 0 FROM cand WHERE book = 0),
best AS (SELECT vec_id, sfb, arg_min(book, (bits, book)) AS book, min(bits) AS bits FROM sized GROUP BY ALL),
allb AS (SELECT vec_id, sfb, book, bits FROM best UNION ALL SELECT vec_id, sfb, book, 0 FROM z WHERE book IS NOT NULL)"""


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id and the bands of its spectrum with books, bits, scale factors and quantized values.

    Taken apart by outer generators: the others make Spark infer a filter on the array's size, which computes the array once more.
    """
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: e.cast("double") * GAIN).alias("spectrum"))
    return P.coded_bands(rows, WIDTHS, T.code_table()).select("vec_id", "bands")


@query(f"WITH {_BOOKS} SELECT vec_id, sfb, book, bits FROM allb")
def book_choice(spark, sf_dir):
    return _coded(spark, sf_dir).select("vec_id", F.inline_outer("bands")).select("vec_id", "sfb", "book", F.col("bits").cast("long").alias("bits"))


_ISLANDS = "u AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sfb) - row_number() OVER (PARTITION BY vec_id, book ORDER BY sfb) AS island FROM allb), runs AS (SELECT vec_id, book, island, min(sfb) AS start, count(*) AS run FROM u GROUP BY ALL), sec AS (SELECT vec_id, start, book, run, 4 + 5 * (run // 31 + 1) AS bits FROM runs)"


@query(f"WITH {_BOOKS}, {_ISLANDS} SELECT vec_id, start, book, run, bits FROM sec")
def section_runs(spark, sf_dir):
    rows = _coded(spark, sf_dir).select("vec_id", F.inline_outer(P.runs(F.col("bands")))).drop("group")
    return rows.withColumn("bits", P.size_of(P.section_words(F.array(F.struct("book", "run")))).cast("long"))


_SF = "sfs AS (SELECT vec_id, sfb, CAST(CASE WHEN sfac IS NULL THEN 0 WHEN z.book = 13 THEN round_even(log10(energy) * %r, 0) ELSE 100 - sfac END AS INT) AS sf, allb.book FROM z JOIN allb USING (vec_id, sfb))" % (S.STEP / 2)
_FOLD = f"""{_SF}, gg AS (SELECT vec_id, coalesce(arg_min(sf, sfb) FILTER (book NOT IN (0, 14, 15)), 0) AS g0 FROM sfs GROUP BY ALL),
fold AS (SELECT vec_id, -1 AS sfb, g0 AS g, g0 - 90 AS nz, false AS heard, NULL::INT AS kind, NULL::INT AS diff, g0 FROM gg
 UNION ALL SELECT vec_id, sfb, CASE WHEN book NOT IN (0, 13) THEN g + d ELSE g END, CASE WHEN book = 13 THEN nz + d ELSE nz END, heard OR book = 13, CASE WHEN book = 0 THEN NULL WHEN book = 13 AND NOT heard THEN 3 WHEN book = 13 THEN 2 ELSE 0 END, CASE WHEN book <> 0 THEN d END, g0
 FROM (SELECT vec_id, s.sfb, s.book, g, nz, heard, g0, CASE WHEN s.book = 13 AND NOT heard THEN sf - nz ELSE greatest(least(sf - CASE WHEN s.book = 13 THEN nz ELSE g END, 60), -60) END AS d FROM fold JOIN sfs s USING (vec_id) WHERE s.sfb = fold.sfb + 1))"""


@query(f"WITH RECURSIVE {_BOOKS}, {_FOLD} SELECT vec_id, g0 AS global_gain, sfb, kind, diff FROM fold WHERE kind IS NOT NULL")
def sf_delta_fold(spark, sf_dir):
    rows = _sides_of(_coded(spark, sf_dir))
    return rows.select("vec_id", "global_gain", F.inline_outer("deltas")).where("kind is not null").select("vec_id", "global_gain", "sfb", "kind", "diff")


def _sides_of(coded: DataFrame) -> DataFrame:
    """global_gain, deltas and runs beside the bands."""
    rows = coded.withColumn("global_gain", C.first_gain(F.col("bands")))
    return rows.withColumns({"deltas": C.changes(F.col("bands"), F.col("global_gain")), "runs": P.runs(F.col("bands"))})


@query(f"""WITH RECURSIVE {_BOOKS}, {_ISLANDS}, {_FOLD}, sd AS (SELECT vec_id, sum(CASE WHEN kind = 3 THEN 9 ELSE len END) AS bits FROM fold LEFT JOIN c ON book = 12 AND idx = diff + 60 WHERE kind IS NOT NULL GROUP BY ALL)
SELECT vec_id, CAST(sp.bits AS BIGINT) AS spectrum_bits, CAST(se.bits AS BIGINT) AS section_bits, CAST(coalesce(sd.bits, 0) AS BIGINT) AS sf_bits, CAST(7 + (3 + 4 + 8 + 11 + 3 + 3 + sp.bits + se.bits + coalesce(sd.bits, 0) + 7) // 8 AS BIGINT) AS bytes
FROM (SELECT vec_id, sum(bits) AS bits FROM allb GROUP BY ALL) sp JOIN (SELECT vec_id, sum(bits) AS bits FROM sec GROUP BY ALL) se USING (vec_id) LEFT JOIN sd USING (vec_id)""")
def frame_sizes(spark, sf_dir):
    """Sizes of frames of one channel behind a stream header, counted without packing the spectrum."""
    codes = T.code_table()
    rows = _sides_of(_coded(spark, sf_dir)).select(
        "vec_id",
        F.aggregate("bands", F.lit(0), lambda s, b: s + b["bits"]).alias("spectrum_bits"),
        P.size_of(P.section_words(F.col("runs"))).alias("section_bits"),
        P.size_of(P.delta_words(F.col("deltas"), codes)).alias("sf_bits"),
    )
    fields = P.size_of(P.single(0, P.channel_stream(F.lit(0), P.window_info(F.lit(0), F.lit(0)), P.nothing(), P.nothing(), P.shaping_words(), P.nothing()))) + 3
    whole = 7 + F.floor((fields + F.col("spectrum_bits") + F.col("section_bits") + F.col("sf_bits") + 7) / 8)
    return rows.select("vec_id", *(F.col(c).cast("long").alias(c) for c in ("spectrum_bits", "section_bits", "sf_bits")), whole.cast("long").alias("bytes"))


_HEX = "array_to_string([substr('0123456789ABCDEF', 1 + 8 * substr(d, 4 * i + 1, 1)::INT + 4 * substr(d, 4 * i + 2, 1)::INT + 2 * substr(d, 4 * i + 3, 1)::INT + substr(d, 4 * i + 4, 1)::INT, 1) FOR i IN range(len(d) // 4)], '')"


@query(f"""WITH RECURSIVE {_BOOKS}, {_ISLANDS}, {_FOLD},
w1 AS (SELECT vec_id, string_agg(lpad(bin(code), len, '0') || CASE WHEN i.book IN (3, 4, 7, 8, 9, 10, 11) THEN array_to_string(list_transform(list_filter(v, lambda a: a <> 0), lambda a: CASE WHEN a < 0 THEN '1' ELSE '0' END), '') ELSE '' END
 || CASE WHEN i.book = 11 THEN array_to_string(list_transform(list_filter(v, lambda a: abs(a) >= 16), lambda a: repeat('1', len(bin(abs(a))) - 5) || '0' || substr(bin(abs(a)), 2)), '') ELSE '' END, '' ORDER BY i.sfb, t) AS sp
 FROM i JOIN best USING (vec_id, sfb, book) JOIN c USING (book, idx) GROUP BY vec_id),
w2 AS (SELECT vec_id, string_agg(lpad(bin(book), 4, '0') || repeat('11111', (run // 31)::INT) || lpad(bin(run % 31), 5, '0'), '' ORDER BY start) AS se FROM sec GROUP BY vec_id),
w3 AS (SELECT vec_id, string_agg(CASE WHEN kind = 3 THEN lpad(bin((diff + 256) & 511), 9, '0') ELSE lpad(bin(code), len, '0') END, '' ORDER BY sfb) AS sd FROM fold LEFT JOIN c ON book = 12 AND idx = diff + 60 WHERE kind IS NOT NULL GROUP BY vec_id),
w4 AS (SELECT vec_id, '0000000' || lpad(bin(g0 & 255), 8, '0') || '0000' || lpad(bin({len(WIDTHS)}), 6, '0') || '0' || se || coalesce(sd, '') || '000' || coalesce(sp, '') || '111' AS d FROM gg JOIN w2 USING (vec_id) LEFT JOIN w3 USING (vec_id) LEFT JOIN w1 USING (vec_id)),
w5 AS (SELECT vec_id, CAST(len(d) AS INT) AS n_bits, d || repeat('0', ((8 - len(d) % 8) % 8)::INT) AS d FROM w4) SELECT vec_id, n_bits, {_HEX} AS payload FROM w5""")
def frame_bytes(spark, sf_dir):
    """The packed frames of one channel; their sizes are those of frame_sizes without the stream header."""
    codes = T.code_table()
    rows = _sides_of(_coded(spark, sf_dir))
    info = P.window_info(F.lit(0), F.lit(len(WIDTHS)))
    stream = P.channel_stream(F.col("global_gain"), info, P.section_words(F.col("runs")), P.delta_words(F.col("deltas"), codes), P.shaping_words(), P.band_words(F.col("bands"), codes))
    rows = rows.select("vec_id", P.single(0, stream).alias("element"))
    closed = rows.select("vec_id", (P.size_of(F.col("element")) + 3).alias("n_bits"), P.closed(F.col("element")).alias("words"))
    return closed.select("vec_id", "n_bits", F.hex(P.packed(F.col("words"))).alias("payload"))


#: Short windows of a frame of SIZE samples: blocks of four samples in bands of one bin.
_WIN = f"""{_F}, fl AS (SELECT stream_id, max(frame_no) + 1 AS frames FROM f GROUP BY ALL), grid AS (SELECT stream_id, unnest(range(4 * frames)) AS win_no FROM fl),
hv AS (SELECT stream_id, (n - 6 - t) // 4 AS win_no, t, value * 0.5 * (1 - cos(2 * pi() * (t + 0.5) / 8)) AS v FROM s, range(8) t(t) WHERE n - 6 - t >= 0 AND (n - 6 - t) % 4 = 0),
sp AS (SELECT stream_id, win_no, k, sum(v * 2 * cos(2 * pi() / 8 * (t + 2.5) * (k + 0.5))) AS x FROM hv, range(1, 4) k(k) GROUP BY ALL),
v AS (SELECT stream_id, win_no, CAST(k AS INT) AS sfb, coalesce(x * x, 0) AS energy FROM (SELECT * FROM grid, range(1, 4) k(k)) g LEFT JOIN sp USING (stream_id, win_no, k))"""
_TRANS = f"""{_WIN}, st AS (SELECT *, lag(energy) OVER (PARTITION BY stream_id, sfb ORDER BY win_no) AS prev FROM v WHERE sfb >= 2), jp AS (SELECT stream_id, win_no, sum(abs(energy - prev)) > 3.0 * sum(least(energy, prev)) AS jump FROM st WHERE prev IS NOT NULL GROUP BY ALL),
fr AS (SELECT DISTINCT stream_id, win_no // 4 AS frame_no FROM v), tr AS (SELECT fr.stream_id, fr.frame_no, coalesce(bool_or(jump), false) AS transient FROM fr LEFT JOIN jp ON jp.stream_id = fr.stream_id AND jp.win_no > 4 * frame_no - 2 AND jp.win_no < 4 * frame_no + 6 GROUP BY ALL)"""


def _short_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.short_energies(R.frame_arrays(framed(spark, sf_dir), SIZE, ["stream_id", "frame_no"]), "stream_id", [1] * 4, SIZE)


@query(f"WITH {_WIN} SELECT stream_id, win_no, sfb, round(energy, 4) + 0.0 AS energy FROM v")
def window_energies(spark, sf_dir):
    return _short_energies(spark, sf_dir).where("sfb > 0").select("stream_id", "win_no", "sfb", r("energy"))


def _transients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.transients(samples(spark, sf_dir), "stream_id", SIZE, [1] * 4)


@query(f"""WITH {_TRANS} SELECT stream_id // 6 AS group_id, frame_no, stream_id % 6 AS channel, CASE stream_id % 6 WHEN 0 THEN 'single' WHEN 5 THEN 'lfe' ELSE 'pair' END AS kind, transient AND stream_id % 6 <> 5 AS wants_short FROM tr""")
def layout_dispatch(spark, sf_dir):
    """Six users stand for the channels of one stream, the sixth a low-frequency one."""
    flags = _transients(spark, sf_dir).select(F.floor(F.col("stream_id") / 6).alias("group_id"), (F.col("stream_id") % 6).alias("channel"), "frame_no", "transient")
    return D.by_layout(flags, T.layout(spark).where("channels = 6 and use_lfe = 1"), "group_id")


@query(f"WITH {_TRANS} SELECT * FROM tr")
def transient_flag(spark, sf_dir):
    return _transients(spark, sf_dir)


@query(f"""WITH {_TRANS}, o AS (SELECT *, transient OR coalesce(lag(transient) OVER w, false) OR frame_no = 2 AS b FROM tr WINDOW w AS (PARTITION BY stream_id ORDER BY frame_no)),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY stream_id ORDER BY frame_no), false) AS was FROM o) SELECT stream_id, frame_no, CASE WHEN b AND was THEN 2 WHEN b THEN 1 WHEN was THEN 3 ELSE 0 END AS block_type FROM p""")
def block_type(spark, sf_dir):
    wants = _transients(spark, sf_dir).withColumnRenamed("transient", "wants_short")
    return D.block_types(wants, "stream_id", forced=F.col("frame_no") == 2)


@query(f"WITH {_P} SELECT pair_id, sfb, round(e_left, 4) + 0.0 AS e_left, round(e_right, 4) + 0.0 AS e_right, round(e_sum, 4) + 0.0 AS e_sum, round(e_diff, 4) + 0.0 AS e_diff FROM e")
def pair_energies(spark, sf_dir):
    return D.pair_energies(paired(spark, sf_dir), ["pair_id"], "side").select("pair_id", "sfb", r("e_left"), r("e_right"), r("e_sum"), r("e_diff"))


@query(f"""WITH {_P}, l AS (SELECT *, least(e_left, e_right) AS lo, greatest(e_left, e_right) AS hi, 1.09 * 1.09 AS m, e_left + e_right AS t FROM e)
SELECT pair_id, sfb, CASE WHEN sfb < 8 THEN NULL WHEN lo * m >= greatest(e_sum, e_diff) / 4 AND e_sum / 4 * m * 2 >= t THEN 'in_phase' WHEN lo * m >= greatest(e_sum, e_diff) / 4 AND e_diff / 4 * m * 2 >= t THEN 'out_of_phase' END AS ms,
CASE WHEN sfb >= 8 AND lo <= 0.1 * 0.1 * hi THEN CASE WHEN e_left <= e_right THEN 'left' ELSE 'right' END END AS muted FROM l""")
def ms_decision(spark, sf_dir):
    return D.mid_side(D.pair_energies(paired(spark, sf_dir), ["pair_id"], "side")).select("pair_id", "sfb", "ms", "muted")


@query(f"""WITH {_P}, l AS (SELECT *, e_left + e_right AS t, pow(sqrt(e_left) + sqrt(e_right), 2) / (1.18 * 1.18) AS bound FROM e),
k AS (SELECT *, CASE WHEN sfb >= 8 AND t > 0 AND e_sum >= bound THEN 'in_phase' WHEN sfb >= 8 AND t > 0 AND e_diff >= bound THEN 'out_of_phase' END AS is_kind FROM l),
p AS (SELECT *, CASE WHEN is_kind IS NOT NULL AND e_left > 0 THEN round_even(log10(e_left / t) * (10 / 1.50515), 0) END AS is_level, CASE WHEN is_kind IS NOT NULL AND e_right > 0 THEN round_even(log10(e_right / t) * (10 / 1.50515), 0) END AS rr FROM k)
SELECT pair_id, sfb, is_kind, round(CASE WHEN is_kind IS NOT NULL THEN sqrt(t / CASE WHEN is_kind = 'in_phase' THEN e_sum ELSE e_diff END) END, 4) + 0.0 AS is_gain, is_level + 0.0 AS is_level, rr - is_level + 0.0 AS is_pan FROM p""")
def is_decision(spark, sf_dir):
    found = D.intensity(D.pair_energies(paired(spark, sf_dir), ["pair_id"], "side"))
    return found.select("pair_id", "sfb", "is_kind", r("is_gain"), (F.col("is_level") + 0.0).alias("is_level"), (F.col("is_pan") + 0.0).alias("is_pan"))


def _window_energies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, windows: energies of two bands (4 values each) in eight windows of a vector."""
    squares = F.transform("embedding", lambda x: F.pow(x.cast("double") * GAIN, F.lit(2)))
    total = lambda w, b: F.aggregate(F.slice("sq", w * 8 + b * 4 + 1, 4), F.lit(0.0), lambda s, x: s + x)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", squares.alias("sq"))
    return rows.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda w: F.array(total(w, F.lit(0)), total(w, F.lit(1)))).alias("windows"))


@query(f"""WITH RECURSIVE {_X}, w AS (SELECT vec_id, bin // 8 AS win, sum(x * x) FILTER (bin % 8 < 4) AS a, sum(x * x) FILTER (bin % 8 >= 4) AS b FROM x GROUP BY ALL),
g AS (SELECT vec_id, 0 AS win, a AS la, a AS ha, b AS lb, b AS hb, false AS cut FROM w WHERE win = 0 UNION ALL
SELECT vec_id, win, CASE WHEN c THEN a ELSE la END, CASE WHEN c THEN a ELSE ha END, CASE WHEN c THEN b ELSE lb END, CASE WHEN c THEN b ELSE hb END, c FROM (SELECT *, (ha > 3 * la)::INT + (hb > 3 * lb)::INT > 1 AS c FROM
 (SELECT g.vec_id, w.win, w.a, w.b, least(la, a) AS la, greatest(ha, a) AS ha, least(lb, b) AS lb, greatest(hb, b) AS hb FROM g JOIN w ON g.vec_id = w.vec_id AND w.win = g.win + 1)))
SELECT vec_id, CAST(count(*) FILTER (cut) + 1 AS INT) AS n_groups, CAST(coalesce(sum(1 << (7 - win)::INT) FILTER (win > 0 AND NOT cut), 0) AS INT) AS mask FROM g GROUP BY vec_id""")
def grouping_bits(spark, sf_dir):
    rows = _window_energies(spark, sf_dir).select("vec_id", B.group_windows(F.col("windows"), first=0).alias("lens"))
    return rows.select("vec_id", F.size("lens").alias("n_groups"), B.grouping_bits(F.col("lens")).cast("int").alias("mask"))


@query("SELECT o_orderkey, v AS value, CASE WHEN v < 8192 THEN CAST(2 * (floor(log2(v + 0.5)) - 4) + 5 AS INT) END AS bits FROM (SELECT o_orderkey, 16 + o_orderkey % 9000 AS v FROM orders)")
def escape_length(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (16 + F.col("o_orderkey") % 9000).alias("value"))
    return rows.select("o_orderkey", "value", S.escape_bits(F.col("value")).alias("bits"))


_ORDER_FRAMES = "f AS (SELECT o_custkey AS stream_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS frame_no, CAST(floor(o_totalprice / 100) AS BIGINT) % 4000 AS bytes FROM orders)"


def _order_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("stream_id"), "o_orderkey", (F.floor(F.col("o_totalprice") / 100) % 4000).alias("bytes"))
    return R.number_samples(rows, "stream_id", ["o_orderkey"], F.floor(F.col("o_orderkey") / 10_000), "frame_no").select("stream_id", "frame_no", "bytes")


@query(f"""WITH {_ORDER_FRAMES}, a AS (SELECT stream_id, count(*) AS n_frames, sum(bytes)::BIGINT AS total_bytes, max(bytes) AS max_frame, CAST(floor(sum(bytes) * 8.0 * 4000 / (count(*) * 1024)) AS BIGINT) AS average_rate FROM f GROUP BY ALL),
w AS (SELECT stream_id, max(r) AS best FROM (SELECT stream_id, frame_no // 4 AS w, CAST(floor(sum(bytes) * (8.0 * 4000) / 4096) AS BIGINT) AS r FROM f GROUP BY ALL HAVING count(*) = 4) GROUP BY ALL)
SELECT a.*, coalesce(best, average_rate) AS max_rate FROM a LEFT JOIN w USING (stream_id)""")
def bitrate_stats(spark, sf_dir):
    return Q.stream_stats(_order_frames(spark, sf_dir), "stream_id", 4000)


@query(f"""WITH RECURSIVE {_ORDER_FRAMES}, g AS (SELECT stream_id, frame_no, bytes * 8.0::DOUBLE AS bits, 100.0::DOUBLE AS quality FROM f WHERE frame_no = 0 UNION ALL
SELECT stream_id, frame_no, nb, least(greatest(q * ((CASE WHEN fix < 0.9 THEN fix + 0.1 WHEN fix > 1.1 THEN fix - 0.1 ELSE 1 END - 1.0) * 0.5 + 1.0), 10), 5000) FROM
 (SELECT f.stream_id, f.frame_no, f.bytes * 8.0::DOUBLE AS nb, g.quality AS q, CASE WHEN g.bits > 0 THEN 12000.0::DOUBLE / (g.bits * g.quality / 100.0) ELSE 1 END AS fix FROM g JOIN f ON f.stream_id = g.stream_id AND f.frame_no = g.frame_no + 1))
SELECT stream_id, frame_no, bits, round(quality, 4) + 0.0 AS quality FROM g""")
def rate_feedback(spark, sf_dir):
    frames = _order_frames(spark, sf_dir).withColumn("bits", F.col("bytes") * 8.0)
    return Q.control(frames, "stream_id", 12000.0).select("stream_id", "frame_no", "bits", r("quality"))


@query(f"WITH {_X}, l AS (SELECT a.vec_id, a.bin AS ab, c.bin - a.bin AS lag, a.x * c.x AS p FROM x a JOIN x c ON a.vec_id = c.vec_id AND c.bin BETWEEN a.bin AND a.bin + 7) SELECT vec_id, lag, round(sum(p), 3) + 0.0 AS r FROM l GROUP BY ALL")
def autocorrelation(spark, sf_dir):
    return X.autocorrelation(spectrum(spark, sf_dir), ["vec_id"], 7).select("vec_id", "lag", r("r", 3))


_BITS = "('1111111111110001' || '01' || right('0000' || bin(s_suppkey % 12), 4) || '0' || '010' || '0000' || right('0000000000000' || bin(200 + s_suppkey % 7000), 13) || '11111111111' || '00')"


@query(f"SELECT s_suppkey, 200 + s_suppkey % 7000 AS length, array_to_string([substr('0123456789abcdef', 1 + 8 * substr(d, 4 * i + 1, 1)::INT + 4 * substr(d, 4 * i + 2, 1)::INT + 2 * substr(d, 4 * i + 3, 1)::INT + substr(d, 4 * i + 4, 1)::INT, 1) FOR i IN range(14)], '') AS header FROM (SELECT s_suppkey, {_BITS} AS d FROM supplier)")
def stream_headers(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", (200 + F.col("s_suppkey") % 7000).alias("length"))
    return rows.select("s_suppkey", "length", F.lower(K.stream_header(F.col("s_suppkey") % 12, F.lit(2), F.col("length"))).alias("header"))


@query(f"WITH {_Q}, w AS (SELECT vec_id, bin, (abs(q) % 16) AS data FROM k) SELECT vec_id, count(*) * 4 AS n_bits, array_to_string(list(substr('0123456789ABCDEF', data + 1, 1) ORDER BY bin), '') || CASE WHEN count(*) % 2 = 1 THEN '0' ELSE '' END AS packed FROM w GROUP BY vec_id")
def bit_packing(spark, sf_dir):
    words = _quantized(spark, sf_dir).select("vec_id", "bin", (F.abs("q") % 16).alias("data"), F.lit(4).alias("len"))
    return K.pack_bits(words, ["vec_id"], "bin").select("vec_id", F.col("n_bits").cast("long").alias("n_bits"), F.hex("bytes").alias("packed"))


@query(f"WITH {_ORDER_FRAMES} SELECT stream_id, frame_no - 3 AS frame_no, bytes FROM f WHERE frame_no >= 3")
def delayed_start(spark, sf_dir):
    return Q.started(_order_frames(spark, sf_dir), "stream_id")


@query(f"""WITH {_E}, c AS (SELECT vec_id, vec_id // 2 AS pair_id, count(*) FILTER (energy > 4000) AS n FROM e GROUP BY ALL) SELECT vec_id, pair_id, max(n) OVER (PARTITION BY pair_id) AS n_bands FROM c""")
def pair_band_count(spark, sf_dir):
    loud = B.energies(banded(spark, sf_dir), ["vec_id"]).groupBy("vec_id").agg(F.count_if(F.col("energy") > 4000).alias("n_bands"))
    return D.pair_band_count(loud.withColumn("pair_id", F.floor(F.col("vec_id") / 2)), ["pair_id"]).select("vec_id", "pair_id", "n_bands")


@query(f"""WITH {_TRANS}, b AS (SELECT stream_id // 2 AS pair_id, stream_id % 2 AS side, frame_no, transient FROM tr) SELECT l.pair_id, l.frame_no FROM b l JOIN b r USING (pair_id, frame_no) WHERE l.side = 0 AND r.side = 1 AND l.transient = r.transient""")
def eligible_pairs(spark, sf_dir):
    rows = _transients(spark, sf_dir).select(F.floor(F.col("stream_id") / 2).alias("pair_id"), (F.col("stream_id") % 2).alias("side"), "frame_no", F.col("transient").cast("int").alias("block_type"), F.lit(1).alias("groups"))
    return D.eligible_pairs(rows, ["pair_id", "frame_no"], "side")
