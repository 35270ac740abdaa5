"""Registered queries of streams from samples to bytes, and their SQL: two streams of `events.value`, frames of 128 samples."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.operators import encoder as E
from cadenza.operators import framing as R
from cadenza.operators import models as M
from cadenza.operators import payload as P
from cadenza.plans import coding_sql as Y
from cadenza.plans import tables as T
from cadenza.plans.config import Settings
from cadenza.plans.frames import _values
from cadenza.plans.queries import table
from cadenza.sources.shared import written

SIZE, BLOCK, STREAMS = 128, 16, 2
LONG, SHORT = (4, 4, 4, 4, 8, 8, 8, 8, 16, 16, 16, 16, 16), (4, 4, 4, 4)
RATIO, GRID = 1.3, 16
SHAPE = E.Shape(SIZE, LONG, SHORT, E.grid(10.0, RATIO, GRID))
SETTINGS = Settings(channels=1, quality=100)
WANTED = 400.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, n, value: users of one remainder as one stream, numbered day by day."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % STREAMS).alias("stream_id"), "ts", "event_id", "value")
    return R.number_samples(rows, "stream_id", ["ts", "event_id"], F.to_date("ts")).select("stream_id", "n", "value")


def _slope(i: str, narrow: str) -> str:
    flat = (SIZE - BLOCK) // 2
    edge = f"CASE WHEN {i} < {flat} THEN 0 WHEN {i} >= {flat + BLOCK} THEN 1 ELSE sin(pi() / {2 * BLOCK} * ({i} - {flat} + 0.5)) END"
    return f"CASE WHEN {narrow} THEN {edge} ELSE sin(pi() / {2 * SIZE} * ({i} + 0.5)) END"


def _cosine(n: int) -> str:
    return f"2 * cos(2 * pi() / {n} * (t + {(n / 2 + 1) / 2}) * (k.k + 0.5))"


_FLAT, _NS, _NL = (SIZE - BLOCK) // 2, len(SHORT), len(LONG)
_LENGTH = f"length(se) + length(sd) + length(sp) + CASE WHEN short THEN {3 + 4 + 8 + 15 + 3} ELSE {3 + 4 + 8 + 11 + 3} END"
_STREAM = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT user_id % {STREAMS} AS stream_id, value, row_number() OVER (PARTITION BY user_id % {STREAMS} ORDER BY ts, event_id) - 1 AS n FROM events),
fr AS MATERIALIZED (SELECT stream_id, unnest(range(max(n) // {SIZE} + 2)) AS frame_no FROM s GROUP BY stream_id), wl(sfb, start, width) AS (VALUES {_values(list(LONG))}), ws(sfb, start, width) AS (VALUES {_values(list(SHORT))}),
vl AS (SELECT fr.stream_id, frame_no, b.b AS kind, t.t, value * CASE WHEN t.t < {SIZE} THEN {_slope("t.t", "b.b = 3")} ELSE {_slope(f"({2 * SIZE - 1} - t.t)", "b.b = 1")} END AS v
 FROM fr, (VALUES (0), (1), (3)) b(b), range({2 * SIZE}) t(t) JOIN s ON s.stream_id = fr.stream_id AND s.n = {SIZE} * (frame_no - 1) + t.t),
xl AS (SELECT stream_id, frame_no, kind, k.k AS bin, sum(v * {_cosine(2 * SIZE)}) AS x FROM vl, range({SIZE}) k(k) GROUP BY ALL),
vs AS (SELECT fr.stream_id, frame_no, w.w AS win, t.t, value * sin(pi() / {2 * BLOCK} * (t.t + 0.5)) AS v FROM fr, range(8) w(w), range({2 * BLOCK}) t(t) JOIN s ON s.stream_id = fr.stream_id AND s.n = {SIZE} * (frame_no - 1) + {_FLAT} + {BLOCK} * w.w + t.t),
xs AS (SELECT stream_id, frame_no, win, k.k AS bin, sum(v * {_cosine(2 * BLOCK)}) AS x FROM vs, range({BLOCK}) k(k) GROUP BY ALL),
vp AS (SELECT fr.stream_id, frame_no, w.w AS win, t.t, value * 0.5 * (1 - cos(2 * pi() * (t.t + 0.5) / {2 * BLOCK})) AS v FROM fr, range({E.AROUND}) w(w), range({2 * BLOCK}) t(t) JOIN s ON s.stream_id = fr.stream_id AND s.n = {SIZE} * frame_no + {_FLAT - E.BEFORE * BLOCK} + {BLOCK} * w.w + t.t),
xp AS (SELECT stream_id, frame_no, win, k.k AS bin, sum(v * {_cosine(2 * BLOCK)}) AS x FROM vp, range({BLOCK}) k(k) GROUP BY ALL),
ep AS (SELECT fr.stream_id, fr.frame_no, w.w AS win, sfb, coalesce(sum(x * x), 0) AS e FROM fr, range({E.AROUND}) w(w), ws LEFT JOIN xp ON xp.stream_id = fr.stream_id AND xp.frame_no = fr.frame_no AND xp.win = w.w AND bin >= start AND bin < start + width WHERE sfb >= 2 GROUP BY ALL),
st AS (SELECT stream_id, frame_no, win, sum(abs(e - prev)) AS change, sum(least(e, prev)) AS common FROM (SELECT *, lag(e) OVER (PARTITION BY stream_id, frame_no, sfb ORDER BY win) AS prev FROM ep) WHERE prev IS NOT NULL AND (frame_no > 0 OR win > {E.BEFORE}) GROUP BY ALL),
gq AS (SELECT qi, 10 * pow({RATIO}::DOUBLE, qi) AS quality FROM range({GRID}) g(qi)),
d AS MATERIALIZED (SELECT stream_id, frame_no, qi, bool_or(change * greatest(quality / 100, 0.4) > 3 * common) AS d FROM st, gq GROUP BY ALL),
full_s AS MATERIALIZED (SELECT fr.stream_id, fr.frame_no, w.w AS win, sfb, start, width, b.b AS bin, coalesce(x, 0) AS x FROM fr, range(8) w(w), ws JOIN range({BLOCK}) b(b) ON b.b >= start AND b.b < start + width LEFT JOIN xs ON xs.stream_id = fr.stream_id AND xs.frame_no = fr.frame_no AND xs.win = w.w AND xs.bin = b.b),
en AS (SELECT stream_id, frame_no, win, sum(x * x) FILTER (sfb = 2) AS a, sum(x * x) FILTER (sfb = 3) AS b FROM full_s GROUP BY ALL),
gs AS (SELECT stream_id, frame_no, win, a AS la, a AS ha, b AS lb, b AS hb, 0 AS grp FROM en WHERE win = 0 UNION ALL
 SELECT stream_id, frame_no, win, CASE WHEN cut THEN a ELSE la END, CASE WHEN cut THEN a ELSE ha END, CASE WHEN cut THEN b ELSE lb END, CASE WHEN cut THEN b ELSE hb END, grp + cut::INT FROM (SELECT *, (ha > 3 * la)::INT + (hb > 3 * lb)::INT > {(_NS - 2) * 3 // 4} AS cut FROM
  (SELECT en.stream_id, en.frame_no, en.win, en.a, en.b, grp, least(la, a) AS la, greatest(ha, a) AS ha, least(lb, b) AS lb, greatest(hb, b) AS hb FROM gs JOIN en ON en.stream_id = gs.stream_id AND en.frame_no = gs.frame_no AND en.win = gs.win + 1))),
gr AS MATERIALIZED (SELECT stream_id, frame_no, win, grp, count(*) OVER g AS wins, win - min(win) OVER g AS place, grp = lag(grp) OVER (PARTITION BY stream_id, frame_no ORDER BY win) AS goes_on FROM gs WINDOW g AS (PARTITION BY stream_id, frame_no, grp)),
mk AS (SELECT stream_id, frame_no, coalesce(sum(1 << (7 - win)::INT) FILTER (goes_on), 0) AS mask FROM gr GROUP BY ALL),
fx AS (SELECT fr.stream_id, fr.frame_no, b.b AS kind, sfb AS pos, 0 AS grp, sfb, start, width, 1 AS wins, r.r - start AS i, coalesce(x, 0) AS x FROM fr, (VALUES (0), (1), (3)) b(b), wl JOIN range({SIZE}) r(r) ON r.r >= start AND r.r < start + width LEFT JOIN xl ON xl.stream_id = fr.stream_id AND xl.frame_no = fr.frame_no AND xl.kind = b.b AND xl.bin = r.r
 UNION ALL SELECT stream_id, frame_no, 2, grp * {_NS} + sfb, grp, sfb, start, width, wins, place * width + bin - start, x FROM full_s JOIN gr USING (stream_id, frame_no, win)),
bx AS MATERIALIZED (SELECT ((frame_no * {STREAMS} + stream_id) * 4 + kind) * {GRID} + qi AS key, fx.* EXCLUDE (stream_id, frame_no, kind) FROM fx, gq),
kq AS (SELECT DISTINCT key, quality / 100 AS quality, CASE WHEN key // {GRID} % 4 = 2 THEN {BLOCK} ELSE {SIZE} END AS last, key // {GRID} % 4 = 2 AS short FROM bx JOIN gq ON qi = key % {GRID}), {Y.coded()},
sz AS MATERIALIZED (SELECT key, {E.HEADER} + ({_LENGTH} + 3 + 7) // 8 AS bytes FROM bits JOIN kq USING (key)),
ctl AS (SELECT stream_id, frame_no, qi, h, d, d OR h = 2 OR frame_no = 0 AS b, CASE WHEN frame_no = 0 THEN 2 WHEN (d OR h = 2) AND h >= 1 THEN 2 WHEN d OR h = 2 THEN 1 WHEN h >= 1 THEN 3 ELSE 0 END AS kind FROM d, (VALUES (0), (1), (2)) hs(h)),
tr AS MATERIALIZED (SELECT ctl.*, quality, bytes, {WANTED}::DOUBLE / (bytes * 8) AS miss FROM ctl JOIN gq USING (qi) JOIN sz ON key = ((frame_no * {STREAMS} + stream_id) * 4 + kind) * {GRID} + qi),
go AS MATERIALIZED (SELECT *, CAST(least(greatest(floor(ln(least(greatest(quality * ((CASE WHEN miss < 0.9 THEN miss + 0.1 WHEN miss > 1.1 THEN miss - 0.1 ELSE 1.0 END - 1.0) * 0.5 + 1.0), 10), 5000) / 10) / {math.log(SHAPE.qualities[1] / SHAPE.qualities[0])!r} + 0.5), 0), {GRID - 1}) AS INT) AS next_qi FROM tr),
run AS (SELECT stream_id, frame_no, {SHAPE.qualities.index(min(SHAPE.qualities, key=lambda q: abs(math.log(q / 100))))} AS qi, 0 AS h FROM fr WHERE frame_no = 0 UNION ALL
 SELECT run.stream_id, run.frame_no + 1, go.next_qi, CASE WHEN go.d THEN 2 WHEN go.b THEN 1 ELSE 0 END FROM run JOIN go USING (stream_id, frame_no, qi, h)),
chosen AS (SELECT go.*, ((frame_no * {STREAMS} + stream_id) * 4 + kind) * {GRID} + qi AS key FROM run JOIN go USING (stream_id, frame_no, qi, h))"""


def _encoded(spark: SparkSession, sf_dir: str, payload: bool) -> DataFrame:
    return E.encode(samples(spark, sf_dir), "stream_id", SHAPE, SETTINGS, WANTED, T.code_table(), written, payload)


@query(f"{_STREAM} SELECT stream_id, frame_no, round(quality, 6) + 0.0 AS quality, kind AS block_type, CAST(bytes AS INT) AS bytes FROM chosen")
def closed_rate(spark, sf_dir):
    """The rate loop closed over transients, block types, masking and sizes: each frame coded at the quality that all before it left."""
    return _encoded(spark, sf_dir, False).select("stream_id", "frame_no", (F.round("quality", 6) + 0.0).alias("quality"), "block_type", "bytes")


@query(f"""{_STREAM}, f AS (SELECT key, '0000000' || lpad(bin(g0 & 255), 8, '0') || '0' || lpad(bin(kind), 2, '0') || '0' || CASE WHEN kind = 2 THEN lpad(bin({_NS}), 4, '0') || lpad(bin(mask::INT), 7, '0') ELSE lpad(bin({_NL}), 6, '0') || '0' END || se || sd || '000' || sp AS d FROM bits JOIN chosen USING (key) JOIN mk USING (stream_id, frame_no)), {Y.closed("f")}
SELECT stream_id, frame_no, kind AS block_type, n_bits, {Y.HEX} AS payload FROM shut JOIN (SELECT key, stream_id, frame_no, kind FROM chosen) USING (key)""")
def encode(spark, sf_dir):
    """Samples to frames of bytes: overlap, block types by the loop, groups, sections, scale factors and codewords, the frame that flushes the overlap included."""
    rows = _encoded(spark, sf_dir, True)
    closed = rows.select("stream_id", "frame_no", "block_type", (P.size_of(F.col("element")) + 3).alias("n_bits"), P.closed(F.col("element")).alias("words"))
    return closed.select("stream_id", "frame_no", "block_type", "n_bits", F.hex(P.packed(F.col("words"))).alias("payload"))


_UNTIL_STEPS = _STREAM[: _STREAM.index(",\ngq AS")]


@query(f"""{_UNTIL_STEPS}, wn AS (SELECT stream_id, frame_no, win, sum(e) AS e FROM ep GROUP BY ALL),
ak AS (SELECT stream_id, frame_no, max(e) > {M.ATTACK} * avg(e) AS attack FROM wn GROUP BY ALL), ch AS (SELECT stream_id, frame_no, bool_or(change > {M.JUMP} * common) AS change FROM st GROUP BY ALL)
SELECT stream_id, frame_no, CASE WHEN stream_id = 0 THEN 'change' ELSE 'attack' END AS model, CASE WHEN stream_id = 0 THEN change ELSE attack END AS wants_short FROM ch JOIN ak USING (stream_id, frame_no)""")
def decision_models(spark, sf_dir):
    """Each stream names its model of block switching; both run in one plan."""
    rows = E.spectra(E.with_neighbours(samples(spark, sf_dir), "stream_id", SIZE).drop("reach"), SHAPE)
    n = len(SHORT) - 2
    energies = F.transform(F.sequence(F.lit(0), F.lit(E.AROUND - 1)), lambda j: F.aggregate(F.slice("windows", j * n + 1, n), F.lit(0.0), lambda s, v: s + v))
    rows = rows.select("stream_id", "frame_no", F.when(F.col("stream_id") == 0, "change").otherwise("attack").alias("model"), E.jumps(F.col("windows"), n, F.col("frame_no")).alias("steps"), energies.alias("energies"))
    return rows.select("stream_id", "frame_no", "model", M.decide(F.col("model"), F.col("steps"), F.col("energies")).alias("wants_short"))
