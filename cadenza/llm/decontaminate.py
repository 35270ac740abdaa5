"""Benchmark decontamination: n-gram seeds join documents to items, then Smith-Waterman aligns what they point at.

Words are runs of ASCII letters, digits and non-ASCII characters, in Unicode's folded case. The n-grams of an item are its seeds, and all
of them look for passages, frequent ones too: an edited copy may have kept no other. The n-grams of the documents are joined with the seeds
by value; a bit map of the seeds, of SIEVE bits whatever the benchmark, keeps those that cannot join from being moved. Joined places become
diagonals of a document and an item, grouped by document, and come back to the texts by a key made of doc_id and text. Around
every diagonal the words of the document are aligned with the item: MATCH for equal words, MISMATCH and GAP otherwise. The score is the
best local alignment over that of the item with itself, so edited copies score by what is left of them; at least `threshold` of it, or
LONG aligned words of a longer item, make a passage. Stretches that share too few words with the item to reach either in any order,
as most that only a frequent seed points at, are not aligned. What is not found: copies that kept no SEED words of the item in a row.

Null and empty texts, in either table, meet nothing. An item of fewer than SEED words is its own seed: documents that hold its words in
a row have a passage of it; as such phrases stand in clean text too, `contaminated` leaves them out. Repeated items give a row
each; repeated documents too, with a null doc_id as well. All of a document is looked at, however long; its passages of one item are reported
as the best one, of equal ones the first. Empty tables give no rows. Columns besides doc_id, item_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import BROADCAST_IDS, lean, materialize, rows_of, small_batches, text_column
from cadenza.llm.words import folded, folded_slices, shingles, word_hashes, word_spans

SEED, THRESHOLD, LONG = 3, 0.4, 50
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words of a benchmark that is broadcast (8 bytes each); the words of a larger one are joined to the documents by item.
WORDS = 1_000_000
#: Numbers (8 bytes each) of a table of documents, items and diagonals that is broadcast; a longer one is joined by shuffle.
PLACES = 3_000_000
#: Bits of the seeds' bit map: 8 MB.
SIEVE = 26


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """(score, first word, end word) of the best local alignment of an item with a passage."""
    m = len(passage)
    steps = np.arange(m + 1) * -GAP
    above = np.zeros(m + 1, np.int64)
    start = np.arange(m + 1)
    best, first, last = 0, 0, 0
    for w in item:
        same = np.where(passage == w, MATCH, MISMATCH)
        row = np.zeros(m + 1, np.int64)
        begin = np.arange(m + 1)
        diagonal, up = above[:-1] + same, above[1:] + GAP
        row[1:] = np.maximum(np.maximum(diagonal, up), 0)
        begin[1:] = np.where(row[1:] == 0, begin[1:], np.where(diagonal >= up, start[:-1], start[1:]))
        raised = row + steps
        top = np.maximum.accumulate(raised)
        source = np.maximum.accumulate(np.where(raised == top, np.arange(m + 1), 0))
        moved = top - steps
        begin = np.where(moved > 0, begin[source], begin)
        row = np.maximum(moved, 0)
        k = int(row.argmax())
        if row[k] > best:
            best, first, last = int(row[k]), int(begin[k]), k
        above, start = row, begin
    return best, first, last


def _windows(diagonals: np.ndarray, size: int, n_words: int) -> list[tuple[int, int]]:
    """Stretches of a document that seeds of one item point at, with room for insertions, merged where they overlap."""
    room = size // 2 + 2
    out: list[list[int]] = []
    for d in np.unique(diagonals).tolist():
        lo, hi = max(0, d - room), min(n_words, d + size + room)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(w) for w in out]


def _common(item: np.ndarray, passage: np.ndarray) -> int:
    """Words that an item and a passage have in common, repeated ones as often as both have them: an alignment matches no more."""
    values, n = np.unique(item, return_counts=True)
    k = np.minimum(np.searchsorted(values, passage), len(values) - 1)
    return int(np.minimum(np.bincount(k[values[k] == passage], minlength=len(values)), n).sum())


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (a number of its own), item_id, words (hashes) of every item that has words."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo, hi, data, offs in folded_slices(text_column(batch)):
                hashes, n = word_hashes(data, offs, punctuation=True)
                some = pa.array(n > 0)
                words = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(hashes.view(np.int64)))
                out = [pa.array(np.arange(row, row + hi - lo)), batch.column(0).slice(lo, hi - lo), words]
                yield pa.RecordBatch.from_arrays([c.filter(some) for c in out], names=["item", "item_id", "words"])
                row += hi - lo

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return materialize(rows.mapInArrow(lean(cut), "item long, item_id long, words array<long>"), "items")


def seeds_of(items: DataFrame) -> DataFrame:
    """seed, size (its words), item, place of every seed."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, sizes, of, places = [np.zeros(0, np.uint64)], [], [], []
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                hashes = words.values.to_numpy().view(np.uint64)
                size = min(SEED, len(hashes))
                seeds.append(shingles(hashes, np.array([len(hashes)]), size)[0])
                n = len(seeds[-1])
                sizes += [size] * n
                of += [item] * n
                places += range(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(seeds).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(of, pa.int64()), pa.array(places, pa.int32())], names=["seed", "size", "item", "place"])

    return materialize(items.select("item", "words").mapInArrow(lean(cut), "seed long, size int, item long, place int"), "seeds")


def _sieve(seeds: DataFrame) -> np.ndarray:
    """The bit map of the seeds, gathered as at most 2**SIEVE / 64 rows."""
    slot = F.shiftrightunsigned("seed", 64 - SIEVE)
    words = seeds.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(seed, {64 - SIEVE}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (SIEVE - 6), np.int64)
    out[words.column("at").to_numpy()] = words.column("bits").to_numpy()
    return out


def _passes(values: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Positions of the values whose bit is set."""
    slot = values >> np.uint64(64 - SIEVE)
    return np.flatnonzero((sieve.view(np.uint64)[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1))


def _key() -> F.Column:
    """What a document's row is known by; rows that share one only look at each other's places in vain."""
    return F.xxhash64("doc_id", "text")


def hits(documents: DataFrame, seeds: DataFrame) -> DataFrame:
    """key, seed, at: the places of the documents' n-grams that may be seeds."""
    sizes = [r["size"] for r in seeds.select("size").distinct().collect()]  # SEED rows at most
    sent = documents.sparkSession.sparkContext.broadcast(_sieve(seeds))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy()
            for lo, _, data, offs in folded_slices(text_column(batch)):
                hashes, counts = word_hashes(data, offs, punctuation=True)
                for size in sizes:
                    values, n = shingles(hashes, counts, size)
                    at = _passes(values, sent.value)
                    first = np.concatenate([[0], np.cumsum(n)])
                    doc = np.searchsorted(first, at, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo + doc]), pa.array(values[at].view(np.int64)), pa.array((at - first[doc]).astype(np.int32))], names=["key", "seed", "at"])

    return documents.select(_key().alias("key"), "text").mapInArrow(lean(find), "key long, seed long, at int")


def _align_all(rows: DataFrame, words: dict | None, threshold: float) -> DataFrame:
    """The passages of rows (doc_id, text, met: list of item, item_id, words, diagonals); words: those of the items, where `met` has none."""
    sent = rows.sparkSession.sparkContext.broadcast(words)
    names = ["doc_id", "item_id", "score", "first_word", "end_word", "passage"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = text_column(batch), []
            for d, text, met in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                low = np.frombuffer(folded(raw.tobytes()), np.uint8)
                own, _ = word_hashes(low, np.array([0, len(low)]), punctuation=True)
                spans = None
                for m in met:
                    item_id, item = sent.value[m["item"]] if sent.value is not None else (m["item_id"], np.array(m["words"], np.int64).view(np.uint64))
                    enough = min(threshold * len(item), LONG) if len(item) >= SEED else len(item)
                    best = (0, 0, 0)
                    for x, y in _windows(np.array(m["diagonals"]), len(item), len(own)):
                        if _common(item, own[x:y]) < enough:
                            continue
                        s, f, e = align(item, own[x:y])
                        best = max(best, (s, -(x + f), x + e))
                    if best[0] >= MATCH * enough:
                        f, e = -best[1], best[2]
                        spans = spans or word_spans(raw, np.array([0, len(raw)]), punctuation=True)[1:]  # folding keeps the number of words
                        passage = raw[spans[0][f] : spans[1][e - 1]].tobytes().decode("utf-8", "replace")
                        out.append((d, item_id, best[0] / (MATCH * len(item)), f, e, passage))
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)

    return rows.mapInArrow(lean(find), "doc_id long, item_id long, score double, first_word long, end_word long, passage string")


def passages(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word, passage of every document and item that align."""
    small_batches(documents.sparkSession)
    documents, items = rows_of(documents), items_of(benchmark)
    seeds = seeds_of(items)
    few = seeds.count() <= BROADCAST_IDS // 2
    joined = hits(documents, seeds).join(F.broadcast(seeds) if few else seeds, "seed")
    met = joined.groupBy("key", "item").agg(F.collect_set(F.col("at") - F.col("place")).alias("diagonals"))
    met = materialize(met, "met")
    size = met.agg(F.count("*"), F.coalesce(F.sum(F.size("diagonals")), F.lit(0))).first()
    few = 4 * size[0] + size[1] <= PLACES
    if (items.agg(F.sum(F.size("words"))).first()[0] or 0) <= WORDS:
        words = {r["item"]: (r["item_id"], np.array(r["words"], np.int64).view(np.uint64)) for r in items.toLocalIterator()}
        found = met.groupBy("key").agg(F.collect_list(F.struct("item", "diagonals")).alias("met"))
    else:
        words = None
        found = met.join(items, "item").select("key", F.array(F.struct("item", "item_id", "words", "diagonals")).alias("met"))
    rows = documents.withColumn("key", _key()).join(F.broadcast(found) if few else found, "key")
    return _align_all(rows.select("doc_id", "text", "met"), words, threshold)


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id of the documents that hold a passage of the benchmark, of SEED words at least."""
    found = passages(documents, benchmark, threshold).where(F.col("end_word") - F.col("first_word") >= SEED)
    return materialize(found.select("doc_id"), "contaminated").distinct()


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that align, with score and place; clean documents have no row."""
    found = passages(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", "score", "first_word", "end_word")
