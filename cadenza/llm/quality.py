"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The symbols are bytes of UTF-8, with digits taken as one; the n-grams of ORDER bytes and their counts grow with the trusted text. Counts
are gathered per task and summed; continuation counts, counts of counts, context sums and interpolation are grouped counts and joins
on n-grams and contexts, dealt out by key, so no task and no worker holds the model.

Per-document perplexity comes from count joins. A document's n-grams are counted where its text is read. The HEAD most frequent
n-grams of the trusted text, a table of that bounded size, are joined there by broadcast, which keeps the hot keys out of any
shuffle. All others go on as rows (document, n-gram, count): each distinct one is looked up once, order by order, in the sharded model,
and its probability is joined back to the rows, by broadcast again for the HEAD that most documents have. Nothing is dropped: `perplexity` is exact for any HEAD, zero included.

The score is the perplexity per symbol over the whole text, shrunk towards the trusted mean by PRIOR symbols so that
texts of a few words are not judged by chance. One in HELD trusted documents is kept out of the model; the thresholds come from those. A
document is rejected above their HIGH quantile for its language times SLACK; a language without any takes the quantile of all
of them. A repeated word is as likely to the model as the word itself, so repetition has a measure of its own: the share
of a text's word pairs that it holds for the first time in a stretch of WINDOW pairs, so that long texts are judged like short ones, PAIRS new
ones added to both counts. Below the LOW quantile of the
trusted documents over SLACK the document is rejected. Words are separated by white space; repetition without any is not seen.

Null and empty texts have the trusted mean and are kept. Texts are read whole, however long. Without any trusted text every document is kept
with a null perplexity; with too few to keep one out, the thresholds come from those in the model. Ties with a threshold are kept.
Repeated rows are scored each, rows with a null doc_id too; a null language is a language of its own. An empty table gives no rows.
Columns besides doc_id, text and lang are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.runs import counted, summed
from cadenza.llm.shared import discard, lean, materialize, rows_of, small_batches, text_column, text_slices, with_ids
from cadenza.llm.words import ROW, mix, word_hashes

CLASSES, ORDER, BITS = 256, 5, 8
#: N-grams that are joined by broadcast (16 bytes each), and n-grams that a task gathers before it sends their counts.
HEAD, GATHERED = 1 << 18, 1 << 21
#: Bytes of text that are looked up together; a batch's texts, 1000 at most, fit their numbers into the bits beside an n-gram.
SLICE = 1 << 18
PRIOR, LOW, HIGH, SLACK, HELD = 80, 0.0005, 0.995, 1.06, 5
PAIRS, WINDOW = 20, 200
#: The symbol of each byte; 0 stands for the start of a text.
CLASS = np.array([ord("0") if chr(b) in "0123456789" else max(b, 1) for b in range(256)], np.int64)


def gram_codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of the ORDER-gram that ends at each byte, bounds of each text's codes)."""
    n = len(offs) - 1
    padded = np.zeros(len(data) + (ORDER - 1) * n, np.int64)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1) * (ORDER - 1), np.diff(offs))
    padded[at] = CLASS[data]
    codes = padded.copy()
    for j in range(1, ORDER):
        codes[j:] |= padded[:-j] << (BITS * j)
    return codes[at], offs


def gram_counts(trusted: DataFrame) -> DataFrame:
    """gram, n: how often each ORDER-gram stands in the trusted texts, all of them."""
    small_batches(trusted.sparkSession)

    def sent(values: list[np.ndarray], n: list[np.ndarray]) -> pa.RecordBatch:
        grams, times = summed(np.concatenate([*values, np.zeros(0, np.uint64)]), np.concatenate([*n, np.zeros(0, np.uint64)]))
        return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(times.view(np.int64))], names=["gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, n, held = [], [], 0
        for batch in batches:
            for _, _, data, offs in text_slices(text_column(batch)):
                grams, times = counted(gram_codes(data, offs)[0].view(np.uint64))
                values.append(grams)
                n.append(times)
                held += len(grams)
                if held >= GATHERED:
                    yield sent(values, n)
                    values, n, held = [], [], 0
        yield sent(values, n)

    return rows_of(trusted).mapInArrow(lean(count), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _estimate(counts: DataFrame, lower: DataFrame | None) -> DataFrame:
    """One order: gram, p, context, gamma. counts: gram, n, below; lower: gram, p of the order below (None: uniform)."""
    ofs = counts.where("n <= 4").groupBy("n").agg(F.count("*").alias("k")).collect()  # four numbers at most
    n = {r["n"]: r["k"] for r in ofs}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    d = [0.0, *(min(max(i - (i + 1) * y * b / a, 0.1), i - 0.05) if a else 0.5 for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))]
    discount = F.when(F.col("n") == 1, d[1]).when(F.col("n") == 2, d[2]).otherwise(d[3])
    rows = counts.withColumns({"context": F.shiftright("gram", BITS), "d": discount})
    sums = rows.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"))
    rows = rows.join(sums, "context").withColumns({"own": (F.col("n") - F.col("d")) / F.col("total"), "gamma": F.col("mass") / F.col("total")})
    if lower is None:
        return rows.select("gram", (F.col("own") + F.col("gamma") / CLASSES).alias("p"), "context", "gamma", "n")
    rows = rows.join(lower.select(F.col("gram").alias("below"), F.col("p").alias("p_below")), "below")
    return rows.select("gram", (F.col("own") + F.col("gamma") * F.col("p_below")).alias("p"), "context", "gamma", "n")


def model(counts: DataFrame) -> dict[int, DataFrame]:
    """gram, p, context, gamma, n by order: the interpolated probabilities of all observed n-grams of orders 1 to ORDER."""
    tables, own = {ORDER: counts}, counts
    for k in range(ORDER - 1, 0, -1):  # how many different symbols stand before each shorter n-gram
        own = own.groupBy(F.col("gram").bitwiseAND((1 << (BITS * k)) - 1).alias("gram")).agg(F.count("*").alias("n"))
        tables[k] = own = materialize(own, f"continuations-{k}")
    out: dict[int, DataFrame] = {}
    for k in range(1, ORDER + 1):
        rows = tables[k].withColumn("below", F.col("gram").bitwiseAND((1 << (BITS * (k - 1))) - 1))
        out[k] = materialize(_estimate(rows, out.get(k - 1)), f"order-{k}")
    return out


def bits_of(grams: DataFrame, orders: dict[int, DataFrame]) -> DataFrame:
    """gram, bits (-log2 p) of distinct ORDER-grams, observed or not, by joins with the model order by order; other columns stay.

    Tables of one or two symbols have at most CLASSES**2 rows and are broadcast; longer ones are sharded by n-gram and by context.
    """
    given = grams.columns
    small = lambda table, symbols: F.broadcast(table) if symbols <= 2 else table
    for k in range(ORDER, 0, -1):
        grams = grams.withColumn(f"g{k}", F.col("gram").bitwiseAND((1 << (BITS * k)) - 1)).withColumn(f"c{k}", F.shiftright(f"g{k}", BITS))
        grams = grams.join(small(orders[k].select(F.col("gram").alias(f"g{k}"), F.col("p").alias(f"p{k}")), k), f"g{k}", "left")
        grams = grams.join(small(orders[k].groupBy(F.col("context").alias(f"c{k}")).agg(F.max("gamma").alias(f"w{k}")), k - 1), f"c{k}", "left")
    p = F.lit(1.0 / CLASSES)
    for k in range(1, ORDER + 1):
        p = F.coalesce(f"p{k}", F.coalesce(f"w{k}", F.lit(1.0)) * p)
    return grams.select(*given, (-F.log2(F.greatest(p, F.lit(1e-12)))).alias("bits"))


def _slot(grams: np.ndarray, size: int) -> np.ndarray:
    return ((grams.view(np.uint64) * ROW) >> np.uint64(64 - size)).view(np.int64)


def _slots(grams: np.ndarray, bits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of 2**size slots that hold n-grams and their bits by hash; n-grams whose slot is taken are left to the join."""
    keys, values = np.full(1 << size, -1, np.int64), np.zeros(1 << size)
    at = _slot(grams, size)
    keys[at], values[at] = grams, bits
    return keys, values


def fresh(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The share of each text's word pairs that are new in their stretch of WINDOW pairs of it, with PAIRS new ones added."""
    hashes, n = word_hashes(data, offs)
    row = np.repeat(np.arange(len(n)), n)
    same = row[1:] == row[:-1]
    of = row[1:][same]
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    stretch = (of << 32) | (place[1:][same] - 1) // WINDOW
    pairs = mix(hashes[:-1] * ROW + hashes[1:])[same] ^ mix(stretch.astype(np.uint64) + ROW)
    new = of[np.unique(pairs, return_index=True)[1]]
    return (np.bincount(new, minlength=len(n)) + PAIRS) / (np.bincount(of, minlength=len(n)) + PAIRS)


def gather(documents: DataFrame, head: pa.Table, *more: str) -> DataFrame:
    """row, doc_id, `more`, n_symbols, bits (of the n-grams in `head`), fresh, tail (array of gram, n: the others) of every document."""
    small_batches(documents.sparkSession)
    sent = documents.sparkSession.sparkContext.broadcast((head.column("gram").to_numpy(), head.column("bits").to_numpy()))  # at most HEAD rows
    rest = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in documents.select(*more).schema.fields)
    names = ["row", "doc_id", *more, "n_symbols", "bits", "fresh", "tail"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        size = max(4, len(sent.value[0]).bit_length() + 2)
        keys, values = _slots(*sent.value, size)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            column = text_column(batch)
            for lo, hi, data, offs in text_slices(column, SLICE):
                codes, bounds = gram_codes(data, offs)
                at = _slot(codes, size)
                found = values[at]
                missed = np.flatnonzero(keys[at] != codes)
                found[missed] = 0.0
                total = np.concatenate([[0.0], np.cumsum(found)])
                of = np.searchsorted(bounds, missed, "right") - 1
                key, times = np.unique((of << (BITS * ORDER)) | codes[missed], return_counts=True)  # a slice has few texts
                tail = pa.StructArray.from_arrays([pa.array(key & ((1 << (BITS * ORDER)) - 1)), pa.array(times)], names=["gram", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(key >> (BITS * ORDER), np.arange(hi - lo + 1)).astype(np.int32)), tail)
                part = [c.slice(lo, hi - lo) for c in (batch.column(0), *batch.columns[2:])]
                numbers = [pa.array(np.diff(bounds)), pa.array(np.diff(total[bounds])), pa.array(fresh(data, offs))]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + hi - lo)), *part, *numbers, lists], names=names)
                row += hi - lo

    return rows_of(documents, *more).mapInArrow(lean(score), f"row long, doc_id long, {rest}n_symbols long, bits double, fresh double, tail array<struct<gram:long,n:long>>")


def perplexity(documents: DataFrame, orders: dict[int, DataFrame], *more: str, head: int = HEAD) -> DataFrame:
    """doc_id, `more`, n_symbols, bits (all of a text's symbols together), fresh of every document."""
    top = orders[ORDER].orderBy(F.desc("n"), "gram").limit(head).select("gram", (-F.log2(F.greatest("p", F.lit(1e-12)))).alias("bits"))
    rows = materialize(gather(documents, top.toArrow(), *more), "documents-scored", compression="zstd")
    tails = rows.where(F.size("tail") > 0).select("row", F.explode("tail").alias("t")).select("row", "t.gram", "t.n")
    looked = materialize(bits_of(tails.groupBy("gram").agg(F.count("*").alias("texts")), orders), "bits")
    # those that most texts have are joined by broadcast, the others by shuffle: hot keys don't move
    often = looked.orderBy(F.desc("texts"), "gram").limit(head).drop("texts")
    found = tails.join(F.broadcast(often), "gram")
    if looked.limit(head + 1).count() > head:
        often = materialize(often, "often")
        found = tails.join(F.broadcast(often), "gram").unionByName(tails.join(F.broadcast(often), "gram", "left_anti").join(looked.drop("texts").join(F.broadcast(often), "gram", "left_anti"), "gram"))
    more_bits = found.groupBy("row").agg(F.sum(F.col("n") * F.col("bits")).alias("tail_bits"))
    scored = rows.drop("tail").join(more_bits, "row", "left")
    out = materialize(scored.select("doc_id", *more, "n_symbols", (F.col("bits") + F.coalesce("tail_bits", F.lit(0.0))).alias("bits"), "fresh"), "perplexity")
    discard(rows, looked)
    return out


def classify(documents: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, slack: float = SLACK, prior: int = PRIOR, held: int = HELD) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity, high, fresh, kept of every document; labels: doc_id, quality (1: trusted)."""
    trusted = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = trusted.withColumn("out", F.pmod(F.xxhash64("doc_id"), F.lit(held)) == 0)
    counts = materialize(gram_counts(with_ids(rows_of(documents), trusted.where("not out").select("doc_id"))), "grams")
    if counts.isEmpty():  # too few trusted documents to keep any out
        trusted = trusted.withColumn("out", F.lit(True))
        counts = materialize(gram_counts(with_ids(rows_of(documents), trusted.select("doc_id"))), "grams")
    rows = documents.withColumn("lang", F.col("lang").cast("string"))
    if counts.isEmpty():
        return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.lit(0).cast("long").alias("n_symbols"), *(F.lit(None).cast("double").alias(c) for c in ("perplexity", "high", "fresh")), F.lit(True).alias("kept"))
    orders = model(counts)
    scored = perplexity(rows, orders, "lang")
    discard(counts, *orders.values())
    known = materialize(scored.join(trusted, "doc_id"), "trusted")  # as many rows as there are trusted documents
    if known.where("out and n_symbols > 0").isEmpty():
        known = known.withColumn("out", F.lit(True))
    whole = known.where("out").agg(F.sum("bits"), F.sum("n_symbols")).first()
    mean = (whole[0] or 0.0) / max(whole[1] or 0, 1)
    value = F.pow(F.lit(2.0), (F.col("bits") + prior * mean) / (F.col("n_symbols") + prior))
    scored, known = scored.withColumn("perplexity", value), known.withColumn("perplexity", value)
    limit = F.percentile_approx("perplexity", F.lit(high), F.lit(100_000)).alias("most")
    least = F.percentile_approx("fresh", F.lit(low), F.lit(100_000)).alias("least")
    by_lang = known.where("out").groupBy("lang").agg(limit).join(known.groupBy("lang").agg(least), "lang", "full")
    overall, new = known.where("out").agg(limit).first()[0], known.agg(least).first()[0]
    few = F.broadcast(by_lang) if by_lang.count() <= 10_000 else by_lang
    joined = scored.join(few.withColumnRenamed("lang", "lang_"), F.col("lang").eqNullSafe(F.col("lang_")), "left")
    hi = F.coalesce("most", F.lit(overall).cast("double")) * slack
    kept = F.coalesce(F.col("perplexity") <= hi, F.lit(True)) & F.coalesce(F.col("fresh") >= F.coalesce("least", F.lit(new).cast("double")) / slack, F.lit(True))
    return joined.select("doc_id", "lang", "n_symbols", "perplexity", hi.alias("high"), "fresh", kept.alias("kept"))


def op3_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their perplexity and their language's threshold."""
    found = classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.where("kept").drop("fresh")
