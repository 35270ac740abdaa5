import pytest
from pyspark.sql import functions as F

from cadenza.operators import models as M

ROWS = [("change", [(9.0, 1.0)], [1.0] * 12), ("attack", [(9.0, 1.0)], [1.0] * 12), ("attack", [(0.0, 1.0)], [0.0] * 11 + [5.0]), (None, [(3.0, 1.0)], [0.0]), (None, [(3.1, 1.0)], [0.0]), ("change", [], [])]
SCHEMA = "model string, steps array<struct<change:double,common:double>>, energies array<double>"


def test_each_row_takes_its_own_model(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = [r[0] for r in df.select(M.decide(F.col("model"), F.col("steps"), F.col("energies"))).collect()]
    assert got == [True, False, True, False, True, False]


def test_names(spark, monkeypatch):
    monkeypatch.setattr(M, "MODELS", dict(M.MODELS))
    with pytest.raises(ValueError, match="there is a model"):
        M.register("change")(M.change)
    M.register("never")(lambda steps, energies, quality: F.lit(False))
    df = spark.createDataFrame([("never", [(9.0, 1.0)], [1.0]), ("nobody", [], [])], SCHEMA)
    assert [r[0] for r in df.where("model = 'never'").select(M.decide(F.col("model"), F.col("steps"), F.col("energies"))).collect()] == [False]
    with pytest.raises(Exception, match="no model nobody"):
        df.select(M.decide(F.col("model"), F.col("steps"), F.col("energies"))).collect()
