"""Quantization decisions, codebook choice, sections, scale-factor deltas and sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.functions.signal import STEP, escape_bits, quantize
from cadenza.plans.tables import BOOKS, ESCAPE, INTENSITY, INTENSITY_OUT, NOISE, ZERO

#: Rms below which a band is empty, largest change of a scale factor, bits of a codebook number.
QUIET, CLAMP, BOOK_BITS = 0.4, 60, 4


def band_plan(targets: DataFrame, noise_level: int = 4) -> DataFrame:
    """book (zero, noise or null: to be coded), sfac, scale, sf of each band; targets: energy, n, target."""
    rms, sfac = step_of(F.col("energy"), F.col("n"), F.col("target"))
    rows = targets.withColumns({"rms": rms, "sfac": sfac})
    book, scale, sf = decision_of(F.col("energy"), F.col("rms"), F.col("target"), F.col("sfac"), noise_level)
    return rows.withColumns({"book": book, "scale": scale, "sf": sf})


def step_of(energy: Column, n: Column, target: Column) -> tuple[Column, Column]:
    """(rms, sfac) of a band; sfac is null where nothing is left of it."""
    rms = F.sqrt(energy / n)
    return rms, F.when((rms >= QUIET) & (target != 0) & (rms > 0), F.rint(F.log10(target / rms) * STEP))


def decision_of(energy: Column, rms: Column, target: Column, sfac: Column, noise_level: int = 4) -> tuple[Column, Column, Column]:
    """(book, scale, sf) of a band: book is zero, noise or, where it is to be coded, null."""
    empty = (rms < QUIET) | (target == 0)
    noisy = ~empty & (target < 0.1 * noise_level)
    level = F.rint(F.log10(F.greatest(energy, F.lit(1e-30))) * (0.5 * STEP))
    book = F.when(empty, ZERO).when(noisy, NOISE).when(sfac > 90, ZERO)  # beyond, its scale factor would fall below the least one
    sf = F.when(empty, 0).when(noisy, level).otherwise(100 - sfac)
    return book, F.when(book.isNull(), F.pow(F.lit(10.0), sfac / STEP)), sf.cast("int")


def quantized(bins: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Bins (x) of the bands to be coded, with q."""
    rows = bins.join(plan.where("book is null").select(*keys, "sfb", "scale"), [*keys, "sfb"])
    return rows.withColumn("q", quantize(F.col("x"), F.col("scale")))


def candidate_books(max_q: Column) -> Column:
    """The books that can hold a band with this largest magnitude."""
    pair = lambda b: F.array(F.lit(b), F.lit(b + 1))
    return F.when(max_q < 1, F.array(F.lit(ZERO))).when(max_q < 2, pair(1)).when(max_q < 3, pair(3)).when(max_q < 5, pair(5)).when(max_q < 8, pair(7)).when(max_q < 13, pair(9)).otherwise(F.array(F.lit(ESCAPE)))


def tuple_rows(q: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, sfb, tuple_no, v (array) of consecutive bins."""
    rows = q.withColumn("tuple_no", F.floor(F.col("bin") / size))
    packed = rows.groupBy(*keys, "sfb", "tuple_no").agg(F.array_sort(F.collect_list(F.struct("bin", "q"))).alias("v"))  # `size` members
    return packed.withColumn("v", F.transform("v", lambda s: s["q"]))


def _index(book: Column, v: Column) -> Column:
    """Place of a tuple in a book: digits of the book's base, shifted where signs are in the index."""
    out = F.when(book == 1, tuple_place(v, 1))
    for b in list(BOOKS)[1:]:
        out = out.when(book == b, tuple_place(v, b))
    return out


def tuple_place(v: Column, book: int) -> Column:
    """Place of a tuple in one book."""
    top, size, signed = BOOKS[book]
    base = 2 * top + 1 if signed else top + 1
    at = F.lit(0)
    for i in range(size):
        digit = F.get(v, F.lit(i))
        at = at * base + (digit + top if signed else F.least(F.abs(digit), F.lit(top)))
    return at


def coded_sizes(q: DataFrame, keys: list[str], codes: DataFrame) -> DataFrame:
    """keys, sfb, book, bits of every candidate book of every band; codes: book, idx, len (a dimension table)."""
    top = q.groupBy(*keys, "sfb").agg(F.max(F.abs("q")).alias("max_q"))
    books = top.select(*keys, "sfb", F.explode(candidate_books(F.col("max_q"))).alias("book"))
    quads = tuple_rows(q, keys, 4).join(books.where("book between 1 and 4"), [*keys, "sfb"])
    pairs = tuple_rows(q, keys, 2).join(books.where("book between 5 and 11"), [*keys, "sfb"])
    rows = quads.unionByName(pairs).withColumn("idx", _index(F.col("book"), F.col("v")).cast("int"))
    rows = rows.join(F.broadcast(codes.select("book", "idx", "len")), ["book", "idx"])
    unsigned = [b for b, (_, _, signed) in BOOKS.items() if not signed]
    signs = F.when(F.col("book").isin(*unsigned), F.size(F.filter("v", lambda x: x != 0))).otherwise(0)
    escapes = F.when(F.col("book") == ESCAPE, F.aggregate(F.filter("v", lambda x: F.abs(x) >= 16), F.lit(0), lambda s, x: s + escape_bits(F.abs(x)))).otherwise(0)
    sized = rows.groupBy(*keys, "sfb", "book").agg(F.sum(F.col("len") + signs + escapes).alias("bits"))
    return sized.unionByName(books.where(F.col("book") == ZERO).withColumn("bits", F.lit(0).cast("long")))


def cheapest_books(sizes: DataFrame, keys: list[str]) -> DataFrame:
    """The book with the fewest bits of each band; the lower one of two that tie."""
    best = sizes.groupBy(*keys, "sfb").agg(F.min(F.struct("bits", "book")).alias("b"))
    return best.select(*keys, "sfb", F.col("b.book").alias("book"), F.col("b.bits").alias("bits"))


def sections(books: DataFrame, keys: list[str], short: bool = False) -> DataFrame:
    """keys, start, book, run, bits of the runs of bands with one book (islands by a difference of row numbers)."""
    cap, count_bits = (7, 3) if short else (31, 5)
    by = Window.partitionBy(*keys).orderBy("sfb")
    island = F.row_number().over(by) - F.row_number().over(Window.partitionBy(*keys, "book").orderBy("sfb"))
    runs = books.withColumn("island", island).groupBy(*keys, "book", "island").agg(F.min("sfb").alias("start"), F.count("*").alias("run"))
    return runs.select(*keys, "start", "book", "run", (BOOK_BITS + count_bits * (F.floor(F.col("run") / cap) + 1)).cast("long").alias("bits"))


def scale_factor_deltas(bands: DataFrame, keys: list[str]) -> DataFrame:
    """keys, global_gain, deltas (array of kind, sfb, diff): three predictors, each fed back its own clamped change.

    kind: 0 normal, 1 intensity, 2 noise, 3 the first noise value, which is sent whole. global_gain is the first scale factor of a
    band that is neither zero nor intensity. The fold is per frame, over its few dozen bands.
    """
    packed = bands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sfb", "book", "sf"))).alias("l"))
    packed = packed.withColumn("global_gain", first_gain(F.col("l")))
    return packed.select(*keys, "global_gain", changes(F.col("l"), F.col("global_gain")).alias("deltas"))


def first_gain(bands: Column) -> Column:
    """The first scale factor of a band that is neither zero nor intensity; 0 without one."""
    coded = F.filter(bands, lambda b: (b["book"] != ZERO) & ~b["book"].isin(INTENSITY, INTENSITY_OUT))
    return F.coalesce(F.get(coded, F.lit(0))["sf"], F.lit(0))


def changes(bands: Column, gain: Column) -> Column:
    """kind, sfb, diff of the scale factors of an array of bands (sfb, book, sf), see scale_factor_deltas."""

    def step(s: Column, b: Column) -> Column:
        is_int, is_noise = b["book"].isin(INTENSITY, INTENSITY_OUT), b["book"] == NOISE
        first = is_noise & ~s["heard"]
        want = b["sf"] - F.when(is_int, s["i"]).when(is_noise, s["n"]).otherwise(s["g"])
        diff = F.when(first, want).otherwise(F.least(F.greatest(want, F.lit(-CLAMP)), F.lit(CLAMP)))
        kind = F.when(is_int, 1).when(first, 3).when(is_noise, 2).otherwise(0)
        put = F.struct(kind.alias("kind"), b["sfb"].alias("sfb"), diff.alias("diff"))
        skip = b["book"] == ZERO
        add = lambda c, on: c + F.when(on & ~skip, diff).otherwise(0)
        return F.struct(add(s["g"], ~is_int & ~is_noise).alias("g"), add(s["i"], is_int).alias("i"), add(s["n"], is_noise).alias("n"), (s["heard"] | is_noise).alias("heard"), F.when(skip, s["out"]).otherwise(F.concat(s["out"], F.array(put))).alias("out"))

    start = F.struct(gain.alias("g"), F.lit(0).alias("i"), (gain - 90).alias("n"), F.lit(False).alias("heard"), F.expr("cast(array() as array<struct<kind:int,sfb:int,diff:int>>)").alias("out"))
    return F.aggregate(bands, start, step, lambda s: s["out"])


def delta_bits(deltas: DataFrame, keys: list[str], codes: DataFrame) -> DataFrame:
    """keys, bits of the scale-factor words: nine for a first noise value, else the length of the change in book 12."""
    rows = deltas.select(*keys, F.explode("deltas").alias("d")).select(*keys, "d.*")
    book = codes.where("book = 12").select((F.col("idx") - CLAMP).alias("diff"), "len")
    return rows.join(F.broadcast(book), "diff", "left").groupBy(*keys).agg(F.sum(F.when(F.col("kind") == 3, 9).otherwise(F.col("len"))).alias("bits"))
