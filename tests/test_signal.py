import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import signal as S
from cadenza.operators import bands as B
from cadenza.operators import coding as C
from cadenza.operators import decisions as D
from cadenza.operators import framing as R
from cadenza.operators import rate as Q
from cadenza.operators import spectral as X
from cadenza.plans import tables as T
from cadenza.plans.config import Settings


def column(spark, c, **values):
    names = list(values)
    df = spark.createDataFrame(list(zip(*values.values())), names)
    return [r[0] for r in df.select(c).collect()]


def test_rate_index(spark):
    rates = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 92017, 92016]
    assert column(spark, S.rate_index(F.col("r")), r=rates) == [*range(12), 0, 1]


def test_layouts(spark):
    rows = T.layout(spark).where("use_lfe = 1").orderBy("channels", "channel").collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r["channels"], []).append(r["kind"])
    assert kinds[1] == ["single"] and kinds[2] == ["pair"] * 2 and kinds[3] == ["single", "pair", "pair"]
    assert kinds[4] == ["single", "pair", "pair", "lfe"] and kinds[5] == ["single", *["pair"] * 4] and kinds[6] == ["single", *["pair"] * 4, "lfe"]


def test_channel_maps():
    assert R.channel_map(6, 3, 4) == [2, 0, 1, 4, 5, 3]
    assert R.channel_map(3, 3, 0) == [2, 0, 1] or R.channel_map(3, 3, 4) == [2, 0, 1]
    assert R.channel_map(2, 1, 2) is None and R.channel_map(6) is None


def test_escape_lengths(spark):
    assert column(spark, S.escape_bits(F.col("v")), v=[16, 31, 32, 63, 4096, 8191, 8192]) == [5, 5, 7, 7, 21, 21, None]


def test_section_bits(spark):
    for n in (1, 30, 31, 32, 62):
        df = spark.createDataFrame([(0, i, 5) for i in range(n)], "k int, sfb int, book int")
        assert C.sections(df, ["k"]).first()["bits"] == 4 + 5 * (n // 31 + 1)
    short = spark.createDataFrame([(0, i, 5) for i in range(14)], "k int, sfb int, book int")
    assert C.sections(short, ["k"], short=True).first()["bits"] == 4 + 3 * 3


def test_grouping_bits(spark):
    assert column(spark, B.grouping_bits(F.col("l")), l=[[8], [1] * 8, [3, 5]]) == [127, 0, 0b1101111]


def test_block_types(spark):
    wants = spark.createDataFrame([(1, i, i == 2) for i in range(6)], "s int, frame_no int, wants_short boolean")
    got = [r["block_type"] for r in D.block_types(wants, "s").orderBy("frame_no").collect()]
    assert got == [D.LONG, D.LONG, D.LONG_SHORT, D.ONLY_SHORT, D.SHORT_LONG, D.LONG]


def test_transients_of_silence(spark):
    rows = [(1, w, 2, e) for w, e in enumerate([0.0] * 8 + [1.0] * 8)] + [(2, w, 2, 0.0) for w in range(16)] + [(2, w, 1, float(w)) for w in range(16)]
    df = spark.createDataFrame(rows, "s int, win_no int, sfb int, energy double")
    got = {(r["s"], r["frame_no"]): r["transient"] for r in D.transients(df, ["s"], 8).collect()}
    assert got == {(1, 0): True, (1, 1): True, (2, 0): False, (2, 1): False}


def test_quality_and_rate():
    assert Settings(bitrate=64000, channels=2).resolved().quality == 100
    assert Settings(bitrate=128000, channels=2).resolved().quality == 400
    assert Settings(mpeg2=True).resolved().noise_level == 0
    for miss, factor in ((1.0, 1.0), (1.3, 1.1), (0.7, 0.9)):
        assert Q.next_quality(100, miss * 1000, 1000) == pytest.approx(100 * factor)
    with pytest.raises(ValueError):
        Settings(channels=65).resolved()


def test_numbers_of_samples_do_not_depend_on_slots(spark):
    rows = [(s, i * 7 % 50, i) for s in (1, 2) for i in range(50)]
    df = spark.createDataFrame(rows, "s int, t int, i int")
    a = R.number_samples(df, "s", ["t"], F.floor(F.col("t") / 10)).orderBy("s", "n").collect()
    assert [(r["s"], r["t"], r["n"]) for r in a] == [(s, t, t) for s in (1, 2) for t in range(50)]


def test_lapped_transform_reconstructs():
    r = np.random.default_rng(1)
    n, frames = 64, 6
    x = np.concatenate([np.zeros(n), r.normal(size=n * (frames - 2)), np.zeros(n)])
    w = np.sin(np.pi / (2 * n) * (np.arange(n) + 0.5))
    window = np.concatenate([w, w[::-1]])
    out = np.zeros(len(x))
    basis = X.cosine_basis(2 * n)
    for i in range(frames - 1):
        part = x[i * n : i * n + 2 * n] * window
        spectrum = X.fast_lapped(part[None])[0]
        assert np.allclose(spectrum, basis @ part)
        out[i * n : i * n + 2 * n] += window * (basis.T @ spectrum) / (2 * n)
    assert np.allclose(out[n:-n], x[n:-n])


def test_windows():
    for alpha in (4, 6):
        k = X.kaiser_bessel(alpha, 128)
        assert np.allclose(k**2 + k[::-1] ** 2, 1) and (np.diff(k) > 0).all()


def test_prediction_solves_the_normal_equations():
    r = np.random.default_rng(2)
    x = np.cumsum(r.normal(size=(3, 64)), 1)
    gain, reflection, index, residual = X.prediction(x, 4)
    a = X.step_up(reflection)
    for row, coefficients in zip(x, a, strict=True):
        lags = np.array([(row[: 64 - k] * row[k:]).sum() for k in range(5)])
        matrix = np.array([[lags[abs(i - j)] for j in range(4)] for i in range(4)])
        assert np.allclose(np.linalg.solve(matrix, -lags[1:]), coefficients[1:])
    assert (gain > X.GAIN).all() and (np.square(residual).sum(1) < np.square(x).sum(1)).all()
    assert X.prediction(np.zeros((1, 16)), 3)[0][0] == 0


def test_noise_shaping_rows(spark):
    df = spark.createDataFrame([(1, [float(i * i % 17) for i in range(32)]), (2, [0.0] * 32), (3, None)], "id int, spectrum array<double>")
    got = {r["id"]: r for r in X.noise_shaping(df, 4).collect()}
    assert len(got[1]["residual"]) == 32 and got[2]["gain"] == 0 and got[3]["residual"] is None


def test_group_windows_follow_a_plain_loop(spark):
    r = np.random.default_rng(3)
    data = [[[float(v) for v in np.exp(r.normal(size=6) * 2)] for _ in range(8)] for _ in range(40)]

    def plain(ws):
        lo, hi, lens, run = list(ws[0]), list(ws[0]), [], 1
        for w in ws[1:]:
            lo, hi = [min(a, b) for a, b in zip(lo, w)], [max(a, b) for a, b in zip(hi, w)]
            if sum(b > 3 * a for a, b in list(zip(lo, hi))[2:]) > (6 - 2) * 3 // 4:
                lens.append(run)
                lo, hi, run = list(w), list(w), 1
            else:
                run += 1
        return [*lens, run]

    got = column(spark, B.group_windows(F.col("w")), w=data)
    assert got == [plain(w) for w in data]


def test_codes_are_prefix_free():
    by_book = {}
    for book, i, n, code in T.code_table():
        by_book.setdefault(book, []).append(format(code, f"0{n}b"))
    for words in by_book.values():
        words.sort()
        assert not any(b.startswith(a) for a, b in zip(words, words[1:]))
        assert math.isclose(sum(2.0 ** -len(w) for w in words), 1)
    assert len(by_book[11]) == 289 and len(by_book[12]) == 121


def test_intensity_deltas(spark):
    rows = [(1, 0, 1, 100), (1, 1, 0, 0), (1, 2, 15, -5), (1, 3, 13, 40), (1, 4, 13, 200), (1, 5, 2, 300)]
    df = spark.createDataFrame(rows, "k int, sfb int, book int, sf int")
    got = C.scale_factor_deltas(df, ["k"]).first()
    assert got["global_gain"] == 100
    assert [tuple(d) for d in got["deltas"]] == [(0, 0, 0), (1, 2, -5), (3, 3, 30), (2, 4, 60), (0, 5, 60)]


def test_start_up_and_overlap(spark):
    frames = spark.createDataFrame([(1, i) for i in range(5)], "s int, frame_no long")
    assert sorted(r["frame_no"] for r in Q.started(frames, "s").collect()) == [0, 1]
    both = column(spark, X.overlapped(F.col("a"), F.col("b"), F.lit(0), 4, 2), a=[[1.0] * 4], b=[[1.0] * 4])[0]
    assert both == pytest.approx([math.sin(math.pi / 8 * (i + 0.5)) for i in range(4)] + [math.sin(math.pi / 8 * (3 - i + 0.5)) for i in range(4)])
    sharp = column(spark, X.overlapped(F.col("a"), F.col("b"), F.lit(1), 4, 2), a=[[1.0] * 4], b=[[1.0] * 4])[0]
    assert sharp[4:] == pytest.approx([1.0, math.sin(math.pi * 3 / 8), math.sin(math.pi / 8), 0.0])
