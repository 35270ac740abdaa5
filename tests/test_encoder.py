import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import encoder as E
from cadenza.operators import joint as J
from cadenza.operators import payload as P
from cadenza.operators import rate as Q
from cadenza.plans import tables as T
from cadenza.plans.config import Settings, resolve


@pytest.mark.parametrize("block", [2, 5, 32])
def test_follow_equals_a_loop(spark, block):
    r, states = random.Random(block), 7
    maps = {(s, t): [r.randrange(states) for _ in range(states)] for s, n in (("a", 1), ("b", 40), ("c", 130), ("d", 9)) for t in range(n)}
    want = {}
    for s in "abcd":
        now = 3
        for t in range(sum(k[0] == s for k in maps)):
            want[s, t] = now
            now = maps[s, t][now]
    rows = [(s, t, m) for (s, t), m in maps.items()]
    r.shuffle(rows)
    got = Q.follow(spark.createDataFrame(rows, "k string, frame_no long, map array<int>"), "k", 3, block).collect()
    assert {(g["k"], g["frame_no"]): g["state"] for g in got} == want and len(got) == len(want)


def test_follow_of_nothing(spark):
    assert Q.follow(spark.createDataFrame([], "k string, frame_no long, map array<int>"), "k", 0).collect() == []


def test_neighbours_and_flush(spark):
    rows = [("a", n, float(n + 1)) for n in range(10)] + [("b", 0, None)]
    got = {(g["k"], g["frame_no"]): g["samples"] for g in E.with_neighbours(spark.createDataFrame(rows, "k string, n long, value double"), "k", 4).collect()}
    assert sorted(got) == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1)]
    assert got["a", 0] == [0.0] * 4 + [1.0, 2, 3, 4, 5, 6, 7, 8] and got["a", 2] == [5.0, 6, 7, 8, 9, 10] + [0.0] * 6
    assert got["a", 3] == [9.0, 10] + [0.0] * 10 and got["b", 0] == [0.0] * 12


def test_corrected_equals_next_quality(spark):
    rows = [(q, b) for q in (10.0, 99.0, 4900.0) for b in (1.0, 300.0, 361.0, 400.0, 440.0, 3000.0)]
    for r in spark.createDataFrame(rows, "q double, b double").withColumn("n", Q.corrected(F.col("q"), 400.0, F.col("b"))).collect():
        assert r["n"] == pytest.approx(Q.next_quality(r["q"], 400.0, r["b"]))


def test_resolve_equals_settings(spark):
    r = random.Random(8)
    rows = [(r.choice(T.RATES), r.randint(1, 8), r.choice([0, 8000, 64000, 500000]), r.choice([0, 0, 50, 9000, 99000]), r.choice([0, 0, 5, 300, 9999])) for _ in range(120)]
    got = resolve(spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, rate long, channels long, bitrate long, bandwidth long, quality long")).collect()
    for g in got:
        rate, channels, bitrate, bandwidth, quality = rows[g["i"]]
        want = Settings(rate=rate, channels=channels, bitrate=bitrate, bandwidth=bandwidth, quality=quality).resolved()
        assert (g["bitrate"], g["bandwidth"], g["quality"]) == (want.bitrate, want.bandwidth, want.quality), rows[g["i"]]


def _plain_intensity(l, r):
    el, er, es, ed = (l * l).sum(), (r * r).sum(), ((l + r) ** 2).sum(), ((l - r) ** 2).sum()
    bound = (math.sqrt(el) + math.sqrt(er)) ** 2 / 1.18**2
    kind = 15 if es >= bound else 14 if ed >= bound else None
    if el + er == 0 or kind is None:
        return l, None, 0, None, 0
    step = 10 / 1.50515
    level, other = (np.rint(np.log10(e / (el + er)) * step) if e else -np.inf for e in (el, er))
    if other - level > 30:
        return l, 0, 0, None, 0
    if other - level < -30:
        return l, None, 0, 0, 0
    used = es if kind == 15 else ed
    return (l + r if kind == 15 else l - r) * math.sqrt((el + er) / used), None, int(level), kind, int(level - other)


def test_intensity_equals_plain_code(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(40):
        l, o = r.normal(size=48) * 30, r.normal(size=48) * 30
        k = i % 5
        rows.append((i, l.tolist(), (o if k == 0 else l * 0.9 if k == 1 else -l if k == 2 else l * 1e-3 if k == 3 else l * 0).tolist()))
    cut = spark.createDataFrame(rows, "i int, l array<double>, r array<double>").select("i", *(P.grouped_bands(F.col(c), P.band_table([4] * 12)).alias(c) for c in "lr"))
    kinds = set()
    for row in cut.select("i", J.intensity_pair(F.col("l"), F.col("r")).alias("j")).collect():
        left, right = np.array(rows[row["i"]][1]).reshape(12, 4), np.array(rows[row["i"]][2]).reshape(12, 4)
        for b, p in enumerate(row["j"]):
            want = _plain_intensity(left[b], right[b]) if b >= 8 else (left[b], None, 0, None, 0)
            assert p["l"]["x"] == pytest.approx(want[0].tolist()) and p["r"]["x"] == right[b].tolist()
            assert (p["l"]["preset"], p["l"]["base"], p["r"]["preset"], p["r"]["base"]) == want[1:]
            kinds.add(want[3] if want[1] is None else "left")
    assert {14, 15, 0, None} <= kinds


def test_mid_side_equals_plain_code(spark):
    r = np.random.default_rng(3)
    rows = [(i, (l := r.normal(size=48) * 30).tolist(), ((o := r.normal(size=48) * 30) if i % 4 == 0 else l + 0.1 * o if i % 4 == 1 else -l + 0.1 * o if i % 4 == 2 else o * 0.01).tolist()) for i in range(40)]
    cut = spark.createDataFrame(rows, "i int, l array<double>, r array<double>").select("i", *(P.grouped_bands(F.col(c), P.band_table([4] * 12)).alias(c) for c in "lr"))
    seen = set()
    for row in cut.select("i", J.mid_side_pair(F.col("l"), F.col("r"), 0.5).alias("j")).collect():
        left, right = np.array(rows[row["i"]][1]).reshape(12, 4), np.array(rows[row["i"]][2]).reshape(12, 4)
        for b, p in enumerate(row["j"]):
            l, o, used = left[b], right[b], 0
            el, er, s, d = (l * l).sum(), (o * o).sum(), (((l + o) / 2) ** 2).sum(), (((l - o) / 2) ** 2).sum()
            x, y, close, mute = l, o, (1 + min(0.09 / 0.5, 0.25)) ** 2, min(0.1 / 0.5, 0.3) ** 2
            if b >= 8:
                if min(el, er) * close >= max(s, d):
                    if s * close * 2 >= el + er:
                        x, y, used = (l + o) / 2, o * 0, 1
                    elif d * close * 2 >= el + er:
                        x, y, used = l * 0, (l - o) / 2, 2
                if min(el, er) <= mute * max(el, er):
                    x, y = (x * 0, y) if el < er else (x, y * 0)
                    seen.add("muted")
            seen.add(used)
            assert np.allclose(p["l"]["x"], x) and np.allclose(p["r"]["x"], y) and p["used"] == bool(used)
    assert seen == {0, 1, 2, "muted"}


def test_grouped_bands_go_over_windows(spark):
    x = [float(i) for i in range(32)]
    df = spark.createDataFrame([(x, [1, 3])], "x array<double>, g array<int>")
    got = df.select(P.grouped_bands(F.col("x"), P.band_table([2, 4]), F.col("g"), 8).alias("b")).first()["b"]
    assert [(b["group"], b["sfb"], b["windows"], b["x"]) for b in got] == [
        (0, 0, 1, [0, 1]), (0, 1, 1, [2, 3, 4, 5]), (1, 0, 3, [8, 9, 16, 17, 24, 25]), (1, 1, 3, [10, 11, 12, 13, 18, 19, 20, 21, 26, 27, 28, 29]),
    ]


def test_sizes_equal_the_elements(spark):
    shape, settings = E.Shape(128, (4, 4, 4, 4, 8, 8, 8, 8, 16, 16, 16, 16, 16), (4, 4, 4, 4), E.grid(10.0, 1.9, 10)), Settings(channels=1, quality=100)
    r = np.random.default_rng(5)
    rows = []
    for i in range(48):
        loud = 10.0 ** r.uniform(-2, 6) * 10.0 ** r.uniform(-3, 0.5, 32).repeat(4) * (r.random(128) < (1, 0.3, 0)[i % 3])
        rows.append(("a", i, *((r.normal(size=128) * loud).tolist() for _ in range(4))))
    spectra = spark.createDataFrame(rows, "k string, frame_no long, long array<double>, start array<double>, short array<double>, stop array<double>")
    cut, keys = E.bands_of(spectra, shape).cache(), ["k", "frame_no"]
    counted = E.sizes(cut.drop("lens"), shape, T.code_table(), keys)
    plan = counted._jdf.queryExecution().toString()
    assert "explode" not in plan  # a row a block type is coded, not a row a quality
    got = {g["frame_no"]: g["sizes"] for g in counted.collect()}
    tried = cut.withColumn("quality", F.explode(F.array(*map(F.lit, shape.qualities))))
    sent = E.element(E._coded(tried, shape, T.code_table(), settings.noise_level), shape, T.code_table())
    want = sent.select("frame_no", "block_type", "quality", (E.HEADER + F.floor((P.size_of(F.col("element")) + 10) / 8)).alias("b")).collect()
    assert len(got) == 48 and all(len(s) == 40 for s in got.values()) and len(want) == 48 * 40
    for w in want:
        assert got[w["frame_no"]][w["block_type"] * 10 + shape.qualities.index(w["quality"])] == w["b"]
    assert len({s for v in got.values() for s in v}) > 100


def test_sizes_of_nothing(spark):
    shape = E.Shape(128, (64, 64), (8, 8), E.grid(10.0, 2.0, 3))
    none = E.bands_of(spark.createDataFrame([], "k string, frame_no long, long array<double>, start array<double>, short array<double>, stop array<double>"), shape)
    assert E.sizes(none.drop("lens"), shape, T.code_table(), ["k", "frame_no"]).collect() == []
