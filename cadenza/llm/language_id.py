"""Language identification by interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

A text's symbols are its letters and marks in lower case, as Python's str.lower gives them, with everything between two of them as one boundary; a
boundary ends the text and stands ORDER - 1 times before it. Code points below DIRECT are symbols of their own, the others share the rest of
the 2**BITS symbols by hash, so that an n-gram of ORDER symbols is an exact 60-bit number.

Counts of all n-grams of all texts that are learned from are gathered per task and summed by Spark; continuation counts, discounts (modified
Kneser-Ney, by order and language) and context weights are grouped sums and joins on n-grams and contexts. An order's table has
a row for each n-gram that any language has, with the interpolated probability of every language. What the scoring tasks get is bounded: of each
order's table and context weights the most frequent rows, NUMBERS probabilities at most. Tables are sorted by a bijective hash of the n-gram, with the
first place of each stretch of hashes beside them. N-grams of texts that a cut table may hold beyond its rows are left open by these tasks: the different ones
are joined with the whole tables of the cut orders, and each text gets their sum, in whole numbers so that its order does not matter.
So NUMBERS decides where an n-gram is looked up and not what it counts.

The language of a text is that of the lowest cross-entropy in bits per symbol; ties go to the smaller name. The score is the probability of that language
when the cross-entropies, shrunk by PRIOR symbols, are weighed by the factor that fits the calibration texts best: one in CALIBRATION of the
texts to learn from, which no model has seen. `rejected` says that the text's cross-entropy is above the QUANTILE of its language's calibration texts times SLACK:
probably none of the learned languages.

Null and empty texts and those without a letter (Unicode category L) are `und` with a score of 0, as are all texts if there is none to learn from. Texts without a
language, with a null doc_id or a null text teach nothing. Texts are scored whole, however long. Repeated rows are scored each, rows with a null doc_id too.
An empty table gives no rows. Columns besides doc_id, text and, where it is learned from, the language are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.runs import counted, summed
from cadenza.llm.shared import discard, lean, materialize, rows_of, small_batches, text_column, text_slices
from cadenza.llm.words import mix

ORDER, BITS, DIRECT = 5, 12, 3584
#: Probabilities that one table of the scoring tasks holds at most (4 bytes each, 8 more for each row's hash).
NUMBERS = 1 << 21
#: N-grams that a task gathers before it sends their counts, and bytes of text that are looked up together.
GATHERED, SLICE = 1 << 21, 1 << 18
CALIBRATION, PRIOR, QUANTILE, SLACK = 10, 20, 0.995, 1.05
#: Factors of the cross-entropies that are tried for the score.
FACTORS = [2.0 ** (i / 2) for i in range(-4, 17)]
#: Parts of a bit in sums over open n-grams.
PARTS = 1 << 30
#: Orders (number, n-grams, contexts) whose tables are cut in the scoring tasks, the highest first.
Rare = list[tuple[int, DataFrame, DataFrame]]
UNKNOWN = "und"


@functools.cache
def symbol_table() -> tuple[np.ndarray, np.ndarray]:
    """(symbol of each code point, 0 for what is no letter or mark; whether it is a letter)."""
    kinds = np.array([ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)], np.uint8)
    letters = kinds == ord("L")
    own = np.arange(0x110000, dtype=np.uint64)
    shared = DIRECT + (mix(own) % np.uint64((1 << BITS) - DIRECT)).astype(np.int64)
    return np.where(letters | (kinds == ord("M")), np.where(own < DIRECT, own.astype(np.int64), shared), 0), letters


def gram_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the ORDER-gram that ends at each symbol, the text of each, whether each text has a letter)."""
    table, letters = symbol_table()
    lowered = [t.lower() + " " for t in texts]
    of = np.repeat(np.arange(len(texts)), [len(t) for t in lowered])
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), "<u4")
    some = np.bincount(of[letters[points]], minlength=len(texts)) > 0
    symbols = table[points]
    before = np.zeros(len(symbols), bool)
    before[1:] = (symbols[:-1] != 0) & (of[1:] == of[:-1])
    kept = (symbols != 0) | before
    symbols, of = symbols[kept], of[kept]
    padded = np.zeros(len(symbols) + (ORDER - 1) * len(texts), np.int64)
    at = np.arange(len(symbols)) + (of + 1) * (ORDER - 1)
    padded[at] = symbols
    codes = padded.copy()
    for j in range(1, ORDER):
        codes[j:] |= padded[:-j] << (BITS * j)
    return codes[at], of, some


def _slices(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    for lo, hi, *_ in text_slices(column, SLICE):
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()


def gram_counts(rows: DataFrame, names: list[str]) -> DataFrame:
    """gram, n0, n1, ...: how often each ORDER-gram stands in the texts of each language; rows: text, lang (one of names)."""
    small_batches(rows.sparkSession)
    index = {name: i for i, name in enumerate(names)}

    def sent(held: list[list]) -> Iterator[pa.RecordBatch]:
        for i, (values, n) in enumerate(held):
            if values:
                grams, times = summed(np.concatenate(values), np.concatenate(n))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), i, np.int32)), pa.array(grams.view(np.int64)), pa.array(times.view(np.int64))], names=["of", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [[[], []] for _ in names], 0
        for batch in batches:
            langs = np.array([index[x] for x in batch.column(1).to_pylist()], np.int64)
            for lo, hi, texts in _slices(text_column(batch)):
                codes, of, _ = gram_codes(texts)
                own = langs[lo:hi][of]
                for i in np.unique(own):
                    grams, times = counted(codes[own == i].view(np.uint64))
                    held[i][0].append(grams)
                    held[i][1].append(times)
                    size += len(grams)
                if size >= GATHERED:
                    yield from sent(held)
                    held, size = [[[], []] for _ in names], 0
        yield from sent(held)

    found = rows.select("text", "lang").mapInArrow(lean(count), "of int, gram long, n long")
    return found.groupBy("gram").agg(*(F.sum(F.when(F.col("of") == i, F.col("n")).otherwise(0)).alias(f"n{i}") for i in range(len(names))))


def _discounts(counts: DataFrame, width: int) -> list[list[float]]:
    """The discounts of n-grams seen once, twice and more often, by language."""
    ofs = counts.agg(*(F.count(F.when(F.col(f"n{i}") == k, 1)).alias(f"c{i}_{k}") for i in range(width) for k in (1, 2, 3, 4))).first()
    out = []
    for i in range(width):
        n1, n2, n3, n4 = (ofs[f"c{i}_{k}"] for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
        out.append([min(max(k - (k + 1) * y * b / a, 0.1), k - 0.05) if a else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))])
    return out


def _estimate(counts: DataFrame, lower: DataFrame | None, width: int) -> tuple[DataFrame, DataFrame]:
    """One order: (gram, n, p0, p1, ...), (context, n, g0, g1, ...). counts: gram, below, n0, ...; lower: the order below (None: uniform)."""
    every = range(width)
    taken = [F.when(F.col(f"n{i}") == 0, 0.0).when(F.col(f"n{i}") == 1, d[0]).when(F.col(f"n{i}") == 2, d[1]).otherwise(d[2]) for i, d in enumerate(_discounts(counts, width))]
    rows = counts.withColumns({"context": F.shiftright("gram", BITS)} | {f"d{i}": taken[i] for i in every})
    sums = rows.groupBy("context").agg(*(F.sum(f"n{i}").alias(f"t{i}") for i in every), *(F.sum(f"d{i}").alias(f"m{i}") for i in every))
    weights = [F.when(F.col(f"t{i}") > 0, F.col(f"m{i}") / F.col(f"t{i}")).otherwise(1.0) for i in every]
    contexts = sums.select("context", sum(F.col(f"t{i}") for i in every).alias("n"), *(weights[i].alias(f"g{i}") for i in every))
    rows = rows.join(sums, "context")
    if lower is not None:
        rows = rows.join(lower.select(F.col("gram").alias("below"), *(F.col(f"p{i}").alias(f"l{i}") for i in every)), "below")
    below = [F.lit(1.0 / (1 << BITS)) if lower is None else F.col(f"l{i}") for i in every]
    own = [F.when(F.col(f"t{i}") > 0, (F.col(f"n{i}") - F.col(f"d{i}")) / F.col(f"t{i}")).otherwise(0.0) for i in every]
    grams = rows.select("gram", sum(F.col(f"n{i}") for i in every).alias("n"), *((own[i] + weights[i] * below[i]).alias(f"p{i}") for i in every))
    return grams, contexts


def models(counts: DataFrame, width: int) -> list[tuple[DataFrame, DataFrame]]:
    """The n-grams and contexts of orders 1 to ORDER with the interpolated probabilities of every language; counts as gram_counts gives them."""
    tables = [counts]
    for k in range(ORDER - 1, 0, -1):  # how many different symbols stand before each shorter n-gram
        shorter = tables[-1].groupBy(F.col("gram").bitwiseAND((1 << (BITS * k)) - 1).alias("gram"))
        tables.append(materialize(shorter.agg(*(F.count(F.when(F.col(f"n{i}") > 0, 1)).alias(f"n{i}") for i in range(width))), f"continuations-{k}"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for k, table in enumerate(reversed(tables), 1):
        rows = table.withColumn("below", F.col("gram").bitwiseAND((1 << (BITS * (k - 1))) - 1))
        grams, contexts = _estimate(rows, out[-1][0] if out else None, width)
        out.append((materialize(grams, f"order-{k}"), contexts))
    return out


class HashArray:
    """Rows of numbers by 64-bit keys, sorted by hash; find(keys) gives the place of each key, or -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, whole: bool = True) -> None:
        self.whole = whole  # whether there is nothing to find beyond these rows
        hashes = mix(keys.astype(np.uint64))
        order = np.argsort(hashes)
        self.hashes, self.values = np.append(hashes[order], np.uint64(2**64 - 1)), values[order]
        self.shift = np.uint64(64 - max(1, len(keys).bit_length()))
        self.first = np.searchsorted(self.hashes[:-1] >> self.shift, np.arange(1 << int(np.uint64(64) - self.shift), dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        if len(self.values) == 0:
            return np.full(len(keys), -1)
        hashes = mix(keys.astype(np.uint64))
        at = self.first[hashes >> self.shift]
        short = np.flatnonzero(self.hashes[at] < hashes)
        while len(short):
            at[short] += 1
            short = short[self.hashes[at[short]] < hashes[short]]
        return np.where((self.hashes[at] == hashes) & (at < len(self.values)), at, -1)


class Scorer:
    """bits(codes): -log2 of each ORDER-gram's probability in every language, and which of them are open, as a cut table may hold what was not found."""

    def __init__(self, grams: list[HashArray], contexts: list[HashArray], width: int) -> None:
        self.grams, self.contexts, self.width = grams, contexts, width

    @property
    def settled(self) -> int:
        """The highest order up to which no table is cut."""
        return next((k for k in range(ORDER) if not (self.grams[k].whole and self.contexts[k].whole)), ORDER)

    def bits(self, codes: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
        unsure = np.zeros(len(codes), bool)
        if order == 0:
            return np.full((len(codes), self.width), float(BITS), np.float32), unsure
        grams, contexts = self.grams[order - 1], self.contexts[order - 1]
        own = codes & ((1 << (BITS * order)) - 1)
        at = grams.find(own)
        missed = np.flatnonzero(at < 0)
        out = grams.values[at] if len(missed) < len(at) else np.zeros((len(at), self.width), np.float32)
        if len(missed):
            rest, below = self.bits(codes[missed], order - 1)
            known = contexts.find(own[missed] >> BITS)
            some = known >= 0
            if some.any():
                rest[some] += contexts.values[known[some]]
            out[missed] = rest
            unsure[missed] = below | (not grams.whole) | (~some & (not contexts.whole))
        return out, unsure


def _bits(name: str, width: int) -> list[Column]:
    return [(-F.log2(F.greatest(f"{name}{i}", F.lit(1e-30)))).cast("float") for i in range(width)]


def scorer(orders: list[tuple[DataFrame, DataFrame]], width: int, numbers: int = NUMBERS) -> Scorer:
    """The most frequent rows of every table, as many as hold `numbers` probabilities, as sorted hash arrays."""
    most = max(1, numbers // width)

    def fetch(table: DataFrame, key: str, name: str) -> HashArray:
        top = table.orderBy(F.desc("n"), key).limit(most + 1)
        got = top.select(key, *(b.alias(f"b{i}") for i, b in enumerate(_bits(name, width)))).toArrow()
        kept = got.slice(0, most)
        return HashArray(kept.column(0).to_numpy(), np.stack([kept.column(1 + i).to_numpy() for i in range(width)], axis=1), len(got) <= most)

    return Scorer([fetch(g, "gram", "p") for g, _ in orders], [fetch(c, "context", "g") for _, c in orders], width)


def _counts_by_row(codes: np.ndarray, of: np.ndarray, rows: int) -> tuple[pa.Array, pa.Array]:
    """(the different codes of each row, how often each stands there), as lists."""
    order = np.lexsort((codes, of))
    codes, of = codes[order], of[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    bounds = pa.array(np.searchsorted(of[at], np.arange(rows + 1)).astype(np.int32))
    return tuple(pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int64))) for x in (codes[at], np.diff(np.append(at, len(codes)))))


def entropies(rows: DataFrame, sent, *more: str, rare: Rare = ()) -> DataFrame:
    """doc_id, `more`, n_symbols, h (bits per symbol in every language, null without a letter) of every row of (doc_id, text, `more`).

    rare: the cut orders. Without them an open n-gram counts as one that was never seen; with them, the result is stored.
    """
    small_batches(rows.sparkSession)
    exact = bool(rare)
    more = (*more, "_row") if exact else more
    rows = rows.withColumn("_row", F.monotonically_increasing_id()) if exact else rows
    names = ["doc_id", *more, "n_symbols", "h", *(("grams", "times") if exact else ())]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.select(*more).schema.fields)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Scorer = sent.value
        for batch in batches:
            for lo, hi, texts in _slices(text_column(batch)):
                codes, of, some = gram_codes(texts)
                n = np.bincount(of, minlength=hi - lo)
                bits, unsure = model.bits(codes)
                rest = [c.slice(lo, hi - lo) for c in batch.columns[2:]]
                left = []
                if exact:
                    unsure &= some[of]
                    bits[unsure] = 0
                    left = _counts_by_row(codes[unsure], of[unsure], hi - lo)
                h = np.stack([np.bincount(of, bits[:, i], hi - lo) for i in range(model.width)], axis=1) / np.maximum(n, 1)[:, None]
                lists = pa.FixedSizeListArray.from_arrays(pa.array(h.ravel()), model.width).cast(pa.list_(pa.float64()))
                lists = pa.compute.if_else(pa.array(some), lists, pa.scalar(None, lists.type))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *rest, pa.array(n), lists, *left], names=names)

    schema = f"doc_id long, {kinds}n_symbols long, h array<double>" + (", grams array<long>, times array<long>" if exact else "")
    found = rows.select("doc_id", "text", *more).mapInArrow(lean(score), schema)
    return _with_open(materialize(found, "partial"), sent, rare) if exact else found


def _with_open(partial: DataFrame, sent, rare: Rare) -> DataFrame:
    """The rows with the bits of their open n-grams (grams, times) added to h, stored."""
    asked = partial.select("_row", F.explode(F.arrays_zip("grams", "times")).alias("a")).select("_row", F.col("a.grams").alias("gram"), F.col("a.times").alias("times"))
    values = materialize(open_bits(asked.select("gram").distinct(), sent, rare), "open")
    width = len([c for c in rare[0][1].columns if c.startswith("p")])
    parts = [F.sum(F.col("times") * F.round(F.get("bits", F.lit(i)) * PARTS).cast("long")) / PARTS for i in range(width)]
    sums = asked.join(values, "gram").groupBy("_row").agg(F.array(*parts).alias("_sum"))
    each = F.greatest("n_symbols", F.lit(1))
    h = F.when(F.col("_sum").isNull(), F.col("h")).otherwise(F.zip_with("h", "_sum", lambda a, b: a + b / each))
    stored = materialize(partial.drop("grams", "times").join(sums, "_row", "left").withColumn("h", h).drop("_row", "_sum"), "entropies")
    discard(partial, values)
    return stored


def open_bits(grams: DataFrame, sent, rare: Rare) -> DataFrame:
    """gram, bits (in every language) of ORDER-grams, by joins with the whole tables of the cut orders and by the model below them."""
    width = len([c for c in rare[0][1].columns if c.startswith("p")])
    settled = ORDER - len(rare)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    rows = grams.withColumns({"above": F.array_repeat(F.lit(0.0), width), "bits": F.lit(None).cast("array<double>")})
    for k, table, contexts in rare:
        own = F.col("gram").bitwiseAND((1 << (BITS * k)) - 1)
        rows = rows.withColumns({"_own": own, "_context": F.shiftright(own, BITS)})
        rows = rows.join(table.select(F.col("gram").alias("_own"), F.array(*_bits("p", width)).cast("array<double>").alias("_p")), "_own", "left")
        rows = rows.join(contexts.select(F.col("context").alias("_context"), F.array(*_bits("g", width)).cast("array<double>").alias("_g")), "_context", "left")
        rows = rows.select("gram", F.when(F.col("_g").isNull(), F.col("above")).otherwise(plus("above", "_g")).alias("above"), F.coalesce("bits", plus("above", "_p")).alias("bits"))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Scorer = sent.value
        for batch in batches:
            found, _ = model.bits(batch.column(0).to_numpy(), settled)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(found.astype(float).ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["gram", "above", "bits", "low"])

    all_of = rows.mapInArrow(lean(below), "gram long, above array<double>, bits array<double>, low array<double>")
    return all_of.select("gram", F.coalesce("bits", plus("above", "low")).alias("bits"))


def _weight() -> Column:
    return F.col("n_symbols") / (F.col("n_symbols") + PRIOR)


def calibrate(scored: DataFrame, names: list[str]) -> tuple[float, list[float]]:
    """(the factor of the scores, the largest cross-entropy of each language that is not rejected); scored: n_symbols, h, lang."""
    known = scored.where("h is not null").withColumn("own", F.element_at("h", F.array_position(F.array(*map(F.lit, names)), F.col("lang")).cast("int")))
    loss = lambda factor: F.sum(F.log(F.aggregate("h", F.lit(0.0), lambda s, x: s + F.exp(F.least(F.lit(700.0), factor * _weight() * (F.col("own") - x))))))
    losses = known.agg(*(loss(f) for f in FACTORS)).first()
    if losses[0] is None:
        return 1.0, [math.inf] * len(names)
    limits = dict(known.groupBy("lang").agg(F.percentile_approx(F.col("own") * _weight(), F.lit(QUANTILE), F.lit(100_000)) * SLACK).collect())  # a row a language
    return FACTORS[int(np.argmin(losses))], [limits.get(name, math.inf) for name in names]


def identify(documents: DataFrame, learned: DataFrame, lang: str = "lang") -> DataFrame:
    """doc_id, lang_pred, score, cross_entropy (bits per symbol), rejected of every document; learned: doc_id, text and the column `lang`."""
    rows = rows_of(learned, F.col(lang).cast("string").alias("lang")).where("doc_id is not null and lang is not null and text is not null")
    names = sorted(r[0] for r in rows.select("lang").distinct().collect())  # a name a language
    if not names:
        none = F.lit(None).cast("double")
        return rows_of(documents).select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("cross_entropy"), F.lit(False).alias("rejected"))
    out_of = F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) == 0
    counts = materialize(gram_counts(rows.where(~out_of), names), "grams")
    if counts.isEmpty():  # too few texts to keep any out
        counts, out_of = materialize(gram_counts(rows, names), "grams"), F.lit(True)
    orders = models(counts, len(names))
    spark = documents.sparkSession
    model = scorer(orders, len(names))  # NUMBERS probabilities a table at most
    sent, settled = spark.sparkContext.broadcast(model), model.settled
    rare = [(k, orders[k - 1][0], materialize(orders[k - 1][1], f"contexts-{k}")) for k in range(ORDER, settled, -1)]
    discard(counts, *(g for g, _ in orders[:settled]))
    factor, limits = calibrate(materialize(entropies(rows.where(out_of), sent, "lang", rare=rare), "calibration"), names)
    scored = entropies(rows_of(documents), sent, rare=rare)
    discard(*(t for _, *tables in rare for t in tables))
    scored = scored.withColumn("cross_entropy", F.array_min("h"))
    best = F.array_position("h", F.col("cross_entropy")).cast("int")
    total = F.aggregate("h", F.lit(0.0), lambda s, x: s + F.exp(factor * _weight() * (F.col("cross_entropy") - x)))
    limit, some = F.element_at(F.array(*map(F.lit, limits)), best), F.col("h").isNotNull()
    return scored.select(
        "doc_id",
        F.when(some, F.element_at(F.array(*map(F.lit, names)), best)).otherwise(UNKNOWN).alias("lang_pred"),
        F.when(some, 1.0 / total).otherwise(0.0).alias("score"),
        "cross_entropy",
        F.when(some, F.col("cross_entropy") * _weight() > limit).otherwise(False).alias("rejected"),
    )


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def op11_language_id(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(documents, documents.where(~held_out()))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
