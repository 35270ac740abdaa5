"""Exact dedup by content-defined chunk recipes.

The normalised text (every run of `[\\x20\\x09-\\x0D]` one space, UTF-8) is cut where the hash of the last eight bytes
meets a condition, so equal passages give equal chunks wherever they stand. A chunk's identifier is 64 bits of its
SHA-256. Identifiers are verified over the corpus: each must stand for one (SHA-256, length) only; those that don't
are replaced by numbers of their own. Two texts are equal when their ordered identifier lists are. Only
identifiers move between tasks, never texts.

Null counts as empty; empty and all-space texts are texts like any other. Repeated rows are rows of one group; of rows
with the same smallest doc_id all are kept. A row with a null doc_id is a copy of any row of its group that has one; a group without
any keeps all its rows, with a null keep_id. Long texts are cut into chunks of at most MOST bytes. An empty table gives no rows.
Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.shared import BROADCAST_IDS, lean, materialize, small_batches, text_column

#: A chunk ends where so many bits of the rolling hash are zero (2 KiB on average), within these lengths.
BITS, LEAST, MOST = 11, 256, 65_536
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def normalise(raw: bytes) -> bytes:
    """Every run of ASCII white space as one space."""
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return b" " * (raw[:1].isspace()) + b" ".join(words) + b" " * (raw[-1:].isspace())


def cuts(text: bytes) -> list[int]:
    """The ends of the chunks of a text; the content of the eight bytes before an end decides about it."""
    n = len(text)
    if n <= LEAST:
        return [n]
    data = np.frombuffer(text, np.uint8)
    window = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    ends = np.flatnonzero((window * _FACTOR) >> np.uint64(64 - BITS) == 0) + 8
    out, at = [], 0
    for e in [*ends.tolist(), n]:
        while e - at > MOST:
            at += MOST
            out.append(at)
        if e - at >= LEAST or e == n:
            if e > at or not out:
                out.append(e)
            at = e
    return out


def recipes(documents: DataFrame) -> DataFrame:
    """doc_id, text_sha256, chunks (array of id, rest of the SHA-256, length)."""
    small_batches(documents.sparkSession)

    def cook(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas, ids, rests, sizes, bounds = [], [], [], [], [0]
            for value in text_column(batch):
                text = normalise(value.as_buffer().to_pybytes() if len(value.as_buffer()) else b"")
                shas.append(hashlib.sha256(text).hexdigest())
                at = 0
                for end in cuts(text):
                    digest = hashlib.sha256(text[at:end]).digest()
                    ids.append(int.from_bytes(digest[:8], "little", signed=True))
                    rests.append(digest[8:])
                    sizes.append(end - at)
                    at = end
                bounds.append(len(ids))
            chunks = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(rests, pa.binary()), pa.array(sizes, pa.int64())], names=["id", "rest", "size"])
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), chunks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shas, pa.string()), listed], names=["doc_id", "text_sha256", "chunks"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(cook), "doc_id long, text_sha256 string, chunks array<struct<id:long,rest:binary,size:long>>")


def verified(cooked: DataFrame) -> DataFrame:
    """doc_id, text_sha256, recipe: identifier lists in which one identifier is one chunk."""
    chunks = cooked.select(F.explode("chunks").alias("c")).select("c.*")
    least = F.min(F.struct("rest", "size"))
    clashing = chunks.groupBy("id").agg(least.alias("lo"), F.max(F.struct("rest", "size")).alias("hi")).where("lo <> hi").select("id")
    clashing = materialize(clashing, "clashes")
    plain = F.transform("chunks", lambda c: c["id"])
    if clashing.isEmpty():  # else two chunks of one identifier exist; they get numbers by their whole digests
        return cooked.select("doc_id", "text_sha256", plain.alias("recipe"))
    numbered = chunks.join(clashing, "id", "left_semi").distinct()
    numbered = numbered.withColumn("number", F.row_number().over(Window.partitionBy("id").orderBy("rest", "size")))
    rows = cooked.withColumn("row", F.monotonically_increasing_id())
    parts = rows.select("row", F.posexplode("chunks").alias("pos", "c")).select("row", "pos", "c.*").join(numbered, ["id", "rest", "size"], "left")
    fixed = parts.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("pos", "id", F.coalesce("number", F.lit(0)).alias("number")))).alias("l"))
    recipe = F.flatten(F.transform("l", lambda x: F.array(x["id"], x["number"].cast("long"))))
    return rows.join(fixed, "row").select("doc_id", "text_sha256", recipe.alias("recipe"))


def deduplicate(documents: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document."""
    rows = verified(materialize(recipes(documents), "recipes"))
    groups = rows.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # only texts that others equal are joined, as a table of its own: a group of any size is then split or not moved at all
    groups = materialize(groups.where("group_size > 1"), "groups")
    ids = groups.agg(F.sum(F.size("recipe") + 4)).first()[0] or 0
    joined = rows.join(F.broadcast(groups) if ids <= BROADCAST_IDS else groups, "recipe", "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def op5_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
