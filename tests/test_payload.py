import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import decisions as D
from cadenza.operators import payload as P
from cadenza.operators import rate as Q
from cadenza.operators import spectral as X
from cadenza.plans import tables as T


def bits(spark, *parts):
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(parts))).first()
    return ["".join(format(w["data"], f"0{w['len']}b") if w["len"] else "" for w in words) for words in row]


def test_window_info_and_elements(spark):
    stream = P.channel_stream(F.lit(300), P.window_info(F.lit(2), F.lit(14), F.lit(0b1101111)), P.nothing(), P.nothing(), P.shaping_words(), P.nothing())
    shared = P.channel_stream(F.lit(1), None, P.nothing(), P.nothing(), P.shaping_words(), P.nothing())
    mask = F.array(F.lit(1), F.lit(0))
    info = P.window_info(F.lit(3), F.lit(49))
    got = bits(spark, stream, P.single(2, shared), P.single(0, shared, low=True), P.pair(1, info, mask, shared, shared), P.pair(1, info, None, shared, shared), P.pair(1, None, None, stream, stream))
    own, common = "00101100" + "0100" + "1110" + "1101111" + "000", "00000001" + "000"
    assert got == [own, "000" + "0010" + common, "011" + "0000" + common, "001" + "0001" + "1" + "0110" + "110001" + "0" + "01" + "10" + common * 2, "001" + "0001" + "1" + "01101100010" + "00" + common * 2, "001" + "0001" + "0" + own * 2]


def test_sections_and_shaping(spark):
    runs = F.array(F.struct(F.lit(11).alias("book"), F.lit(31).alias("run")), F.struct(F.lit(0).alias("book"), F.lit(2).alias("run")))
    short = F.array(F.struct(F.lit(5).alias("book"), F.lit(14).alias("run")))
    indices = F.array(F.lit(-1.0), F.lit(3.0))
    got = bits(spark, P.section_words(runs), P.section_words(short, short=True), P.shaping_words(indices, F.lit(20)))
    assert got == ["1011" + "11111" + "00000" + "0000" + "00010", "0101" + "111" * 2 + "000", "1" + "01" + "1" + "010100" + "00010" + "00" + "1111" + "0011"]


def test_identification_lies_on_whole_bytes(spark):
    for before in (0, 1, 7, 8, 56):
        [got] = bits(spark, P.identification("writer 1.0", before))
        count = len("writer 1.0") + 1 + 3
        assert len(got) == 7 + 8 * count and got[:7] == "110" + format(count, "04b")
        text = got[7 + -(before + 7) % 8 + 16 :]
        assert bytes(int(text[i : i + 8], 2) for i in range(0, 80, 8)) == b"writer 1.0"
        assert (before + 7 + -(before + 7) % 8) % 8 == 0
    [long] = bits(spark, P.identification("a longer name of a writer", 0))
    assert long[:15] == "110" + "1111" + format(26 + 3 - 14, "08b")


def test_closed_frames(spark):
    got = bits(spark, P.closed(P.words((1, 2))), P.closed(P.words((1, 5))), P.closed(P.words((1, 6))))
    assert got == ["01" + "1100000" + "111" + "0000", "00001" + "111", "000001" + "111" + "0" * 7]
    row = spark.range(1).select(P.packed(P.closed(P.words((1, 6)))).alias("b"), P.bytes_of(P.words((0, 9))).alias("n")).first()
    assert bytes(row["b"]) == bytes([0b00000111, 0b10000000]) and row["n"] == 2
    with pytest.raises(Exception, match="too long"):
        spark.range(1).select(P.bytes_of(F.array_repeat(P.word(0, 8), 8192))).collect()


def test_codewords_decode_to_the_values(spark):
    """Every band's words, read back by the code table, give its values; their length is what the choice of a book counted."""
    r = np.random.default_rng(5)
    bands = [[int(v) for v in r.integers(-top, top + 1, 8)] for top in (1, 2, 4, 7, 12, 40, 8000) for _ in range(8)]
    codes = T.code_table()
    df = spark.createDataFrame([(q,) for q in bands], "q array<int>").withColumn("best", P.cheapest(F.col("q"), codes))
    words = P.band_words(F.array(F.struct(F.col("best.book").alias("book"), F.col("q").alias("q"))), codes)
    decode = {(b, n, c): i for b, i, n, c in codes}
    for row in df.select("q", "best", words.alias("w")).collect():
        text = "".join(format(w["data"], f"0{w['len']}b") for w in row["w"])
        book = row["best"]["book"]
        assert len(text) == row["best"]["bits"]
        top, size, signed = T.BOOKS[book] if book else (0, 4, False)
        base, at, out = 2 * top + 1 if signed else top + 1, 0, []
        while at < len(text):
            n = next(n for n in range(1, 40) if (book, n, int(text[at : at + n], 2)) in decode)
            idx, at, values = decode[book, n, int(text[at : at + n], 2)], at + n, []
            for _ in range(size):
                values.insert(0, idx % base - (top if signed else 0))
                idx //= base
            if not signed:
                signs = []
                for v in values:
                    signs.append(-1 if v and text[at] == "1" else 1)
                    at += bool(v)
                for i, v in enumerate(values):
                    if book == 11 and v == 16:
                        ones = text.index("0", at) - at
                        values[i] = (1 << ones + 4) + int(text[at + ones + 1 : at + 2 * ones + 5], 2)
                        at += 2 * ones + 5
                values = [v * g for v, g in zip(values, signs, strict=True)]
            out += values
        assert out == (row["q"] if book else [])


def test_low_channels_stay_long(spark):
    flags = spark.createDataFrame([(1, c, 0, True) for c in range(7)], "s int, channel int, frame_no long, transient boolean")
    got = {r["channel"]: r["wants_short"] for r in D.by_layout(flags, T.layout(spark).where("channels = 6 and use_lfe = 1"), "s").collect()}
    assert got == {0: True, 1: True, 2: True, 3: True, 4: True, 5: False}


def test_short_windows_and_spans(spark):
    df = spark.createDataFrame([(1, [1.0] * 16, [1.0] * 16), (2, None, None)], "k int, a array<double>, b array<double>")
    got = {r["k"]: r["w"] for r in df.select("k", X.short_blocks(F.col("a"), F.col("b"), 16, 2).alias("w")).collect()}
    assert np.allclose(got[1], np.tile(np.sin(np.pi / 4 * (np.arange(4) + 0.5)), 8)) and got[2] is None
    with pytest.raises(Exception, match="short blocks"):
        df.select(X.overlapped(F.col("a"), F.col("b"), F.lit(2), 16, 2)).collect()
    assert X.shaping_span([0, 4, 8, 16, 32], 4, 1, 3) == (4, 16, 3) and X.shaping_span([0, 4], 1, 5, 3) == (4, 4, -4)
    x = [float(i * i % 17) for i in range(32)]
    row = X.noise_shaping(spark.createDataFrame([(x,)], "spectrum array<double>"), 4, span=(8, 24)).first()
    assert row["residual"][:8] == x[:8] and row["residual"][24:] == x[24:]


def test_progress_counters():
    got = Q.progress({"numInputRows": 88200, "durationMs": {"triggerExecution": 500}}, 44100, channels=2)
    assert got == {"frames": 43, "played": 1.0, "frames_per_second": 44100 / 1024 / 0.5, "speed": 2.0}
