"""Tables written to the folder that all executors see, in place of lineage that would be computed again."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='cadenza-')}"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a new folder where it is unset and the session runs on one machine only (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own_folder()


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as Parquet in the shared folder, read back: it survives lost executors and is computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
