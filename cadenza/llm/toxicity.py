"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct words, word pairs and pairs with one word between them of a text in Unicode's folded case, hashed to SIZE values.
Per-coordinate rates and L1 leave few weights above zero; they are found by one task on a sample of at most SAMPLE
labelled rows with at most FEATURES features together (parameters; rows come in the order of a hash, the first is always taken) and travel to
the scoring tasks as a table of at most SIZE rows. All texts are scored whole.

Scores are calibrated: a model of all but one in FOLD of the sample scores those, a logistic curve over these scores (slope and shift, least
log-loss, a toxic text counting MISS times) is found, and the weights of the model of the whole sample take it in. With fewer than LEAST rows of a class in the fold they stay as they are.

Null and empty texts get the score of the bias alone. Without any labelled row every score is 0. A document labelled more
than once counts as toxic if one label says so; null labels are left out. Repeated rows are scored each. Rows whose hash ties are taken in the order of
doc_id. Empty tables give no rows. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import lean, rows_of, small_batches, text_column
from cadenza.llm.words import folded_slices, mix, word_hashes

SIZE = 1 << 20
#: Labelled rows that training takes at most, by the order of a hash of doc_id, and passes over them.
SAMPLE, PASSES = 12_000, 4
#: Features of the sample at most (4 bytes each), one in so many rows of it is for calibration, and rows of a class that calibration needs.
FEATURES, FOLD, LEAST = 1 << 26, 5, 10
#: False alarms that one missed toxic text is worth: where the score of 0.5 lies.
MISS = 2.0
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 0.1
_KINDS = [np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD1B54A32D192ED03)]


def features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed features, text of each) of a run of texts, as often as they occur."""
    h, n = word_hashes(data, offs, punctuation=True)
    row = np.repeat(np.arange(len(n)), n)
    shift = np.uint64(64 - int(SIZE).bit_length() + 1)
    found, rows = [mix(h * _KINDS[0]) >> shift], [row]
    for gap, kind in ((1, _KINDS[1]), (2, _KINDS[2])):
        same = row[:-gap] == row[gap:]
        found.append((mix(h[:-gap] * kind + h[gap:]) >> shift)[same])
        rows.append(row[:-gap][same])
    return np.concatenate(found).astype(np.int64), np.concatenate(rows)


class Ftrl:
    """FTRL-proximal logistic regression with binary features; coordinate 0 of `z` and `n` is the bias."""

    def __init__(self) -> None:
        self.z = np.zeros(SIZE + 1)
        self.n = np.zeros(SIZE + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        rate = (BETA + np.sqrt(n)) / ALPHA + L2
        w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / rate)
        if len(at) and at[0] == 0:
            w[0] = -z[0] / rate[0]  # the bias is not held to zero
        return w

    def learn(self, at: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[at]
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] = n + g * g


Row = tuple[int, np.ndarray]


def learned(rows: list[Row], passes: int = PASSES) -> Ftrl:
    """The model of rows (label, features with the bias first), taken in their order `passes` times."""
    model = Ftrl()
    for _ in range(passes):
        for y, at in rows:
            model.learn(at, y)
    return model


def curve(sums: np.ndarray, y: np.ndarray, miss: float = MISS) -> tuple[float, float]:
    """Slope and shift of the logistic curve over sums of weights that fits the labels best, by Newton's steps; (1, 0) with too few of a class."""
    if min(y.sum(), len(y) - y.sum()) < LEAST:
        return 1.0, 0.0
    x = np.stack([sums, np.ones(len(sums))], axis=1)
    at, weight = np.array([1.0, 0.0]), np.where(y > 0, miss, 1.0)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ at, -35, 35)))
        slope = x.T @ (weight * (p - y)) + 1e-3 * (at - [1.0, 0.0])
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
        at = at - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def fitted(rows: list[Row]) -> np.ndarray:
    """The calibrated weights of all coordinates, by rows in the order of their hash."""
    folds = [rows[i::FOLD] for i in range(FOLD)]
    part = learned([r for i, r in enumerate(rows) if i % FOLD])
    sums = np.array([part.weights(at).sum() for _, at in folds[0]])
    slope, shift = curve(sums, np.array([y for y, _ in folds[0]], float))
    w = learned(rows).weights(np.arange(SIZE + 1)) * slope
    w[0] += shift
    return w


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, features_in_all: int = FEATURES) -> np.ndarray:
    """Structured array (at, w) of the weights; labels: doc_id, toxic."""
    small_batches(documents.sparkSession)
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = rows_of(documents).join(F.broadcast(chosen), "doc_id")  # at most `sample` rows

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = []
            for lo, hi, data, offs in folded_slices(text_column(batch)):
                found, row = features(data, offs)
                key = np.unique((row << 32) | (found + 1))
                lists += np.split((key & 0xFFFFFFFF).astype(np.int32), np.searchsorted(key >> 32, np.arange(1, hi - lo)))
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([*lists, np.zeros(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), listed], names=["doc_id", "toxic", "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            values, offs = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
            for i, y in enumerate(batch.column(1).to_pylist()):
                total += int(offs[i + 1] - offs[i])
                if held and total > features_in_all:
                    break
                held.append((y, np.concatenate([[0], values[offs[i] : offs[i + 1]]])))
            if total > features_in_all:
                break
        at = np.arange(SIZE + 1)
        w = fitted(held)
        keep = np.flatnonzero((w != 0) | ((at == 0) & bool(held)))
        if not held:
            keep = keep[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keep), pa.array(w[keep])], names=["at", "w"])

    found = rows.mapInArrow(lean(featurise), "doc_id long, toxic int, features array<int>")
    ordered = found.repartition(1).sortWithinPartitions(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id", "toxic", F.hash("features"))
    table = ordered.mapInArrow(lean(fit), "at long, w double").toArrow()
    out = np.zeros(table.num_rows, [("at", "i8"), ("w", "f8")])
    out["at"], out["w"] = table.column(0).to_numpy(), table.column(1).to_numpy()
    return out


def score(documents: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, score of every document."""
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast(weights)  # at most SIZE rows of 16 bytes

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(SIZE)
        own = sent.value
        bias = own["w"][own["at"] == 0].sum() if len(own) else -np.inf
        used = own[own["at"] > 0]
        table[used["at"] - 1] = used["w"]
        some = table != 0
        for batch in batches:
            sums = np.full(batch.num_rows, bias)
            for lo, hi, data, offs in folded_slices(text_column(batch)):
                found, row = features(data, offs)
                hit = some[found]
                key = np.unique((row[hit] << 32) | found[hit])
                sums[lo:hi] += np.bincount(key >> 32, table[key & 0xFFFFFFFF], hi - lo)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(sums, -500, 500))) if len(own) else np.zeros(batch.num_rows))], names=["doc_id", "score"])

    return rows_of(documents).mapInArrow(lean(apply), "doc_id long, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out())
    scored = score(documents, train(documents, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
