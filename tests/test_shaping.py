import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.operators import shaping as N
from cadenza.operators import spectral as X


@pytest.fixture(scope="module")
def spectra():
    r = np.random.default_rng(4)
    x = r.normal(size=(12, 64))
    x[:8] = x[:8] + 0.9 * np.roll(x[:8], 1, axis=1)
    x[3] = 0
    return x


def test_folds_equal_the_kernel(spark, spectra):
    gain, reflection, index, residual = X.prediction(spectra, 7)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(spectra)], "i int, x array<double>").withColumn("f", N.levinson(N.lags(F.col("x"), F.lit(7))))
    df = df.withColumn("c", N.quantized(F.col("f")["k"])).withColumn("y", N.filtered(F.col("x"), N.step_up(F.transform("c", lambda c: c["value"]))))
    for row in df.collect():
        i = row["i"]
        assert row["f"]["gain"] == pytest.approx(gain[i]) and row["f"]["k"] == pytest.approx(reflection[i].tolist())
        assert [c["index"] for c in row["c"]] == index[i][: len(row["c"])].tolist() and not index[i][len(row["c"]) :].any()
        if gain[i] > X.GAIN:
            assert row["y"] == pytest.approx(residual[i].tolist())
    assert (gain > X.GAIN).sum() > 3


def test_backward_is_forward_on_the_mirror_image(spark, spectra):
    a = F.array(*map(F.lit, (1.0, -0.5, 0.25, 0.1)))
    df = spark.createDataFrame([(x.tolist(),) for x in spectra[:3]], "x array<double>")
    for row in df.select("x", N.filtered(F.col("x"), a, True).alias("y"), N.filtered(F.col("x"), F.array(F.lit(1.0))).alias("same")).collect():
        x = row["x"]
        assert row["same"] == x
        assert row["y"] == pytest.approx([sum(w * x[i + j] for j, w in enumerate((1.0, -0.5, 0.25, 0.1)) if i + j < 64) for i in range(64)])


def test_spans_orders_and_short_blocks(spark, spectra):
    df = spark.createDataFrame([(i, k, spectra[0].tolist()) for i, k in enumerate((0, 5, 6, 11))], "i int, rate_index int, x array<double>")
    starts = F.sequence(F.lit(0), F.lit(64), F.lit(2))  # 32 bands of two bins
    rows = {r["i"]: r for r in N.shape(df, "x", starts, F.lit(32), F.col("rate_index")).collect()}
    assert [rows[i]["order"] for i in range(4)] == [12, 12, 20, 20]
    assert [rows[i]["length"] for i in range(4)] == [32 - N.FIRST_BANDS[k] for k in (0, 5, 6, 11)]
    for i, k in enumerate((0, 5, 6, 11)):
        lo, hi = 2 * min(N.FIRST_BANDS[k], N.END_BANDS[k], 32), 2 * min(32, N.END_BANDS[k])
        assert rows[i]["x"][:lo] == spectra[0][:lo].tolist() and rows[i]["x"][hi:] == spectra[0][hi:].tolist()
        assert (rows[i]["indices"] is None) == (rows[i]["x"] == spectra[0].tolist())
    assert any(rows[i]["indices"] is not None for i in range(4))
    short = N.shape(df, "x", starts, F.lit(32), F.col("rate_index"), short=True).collect()
    assert all(r["x"] == spectra[0].tolist() and r["indices"] is None for r in short)
    old = N.shape(df, "x", starts, F.lit(32), F.col("rate_index"), mpeg2=True).collect()
    assert all(r["order"] == 12 for r in old)
