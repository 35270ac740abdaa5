"""The bits of a frame: a row a frame (or channel), from the spectrum to packed bytes, in array expressions without a shuffle.

A word is a struct (data, len); parts of a frame are arrays of words, and a frame is their concatenation. `size_of` counts a frame
before anything is packed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.signal import quantize
from cadenza.operators import bands as B
from cadenza.operators import coding as C
from cadenza.plans.tables import BOOKS, ESCAPE, ZERO

#: Element numbers of a raw frame, the filler's, and the end.
SINGLE, PAIR, LOW, FILL, END = 0, 1, 3, 6, 7
#: Bits of a channel's gain, of a first noise value, of a noise-shaping coefficient; largest frame in bytes, headers included.
GAIN_BITS, NOISE_BITS, SHAPING_BITS, LARGEST = 8, 9, 4, 8191
WORD = "struct<data:bigint,len:int>"
Codes = list[tuple[int, int, int, int]]


def word(data: Column | int, n: Column | int) -> Column:
    """One word: data, which has at most n bits."""
    return F.struct(F.lit(data).cast("bigint").alias("data"), F.lit(n).cast("int").alias("len"))


def words(*fields: tuple[Column | int, Column | int]) -> Column:
    return F.array(*(word(d, n) for d, n in fields))


def nothing() -> Column:
    return F.array().cast(f"array<{WORD}>")


def size_of(parts: Column) -> Column:
    """Bits of an array of words."""
    return F.aggregate(parts, F.lit(0), lambda s, w: s + w["len"])


# --- a spectrum's bands -------------------------------------------------------------------------------------------------------


def band_table(widths: list[int]) -> Column:
    """sfb, start, width of the bands as an array."""
    starts = [sum(widths[:i]) for i in range(len(widths))]
    return F.array(*(F.struct(F.lit(i).alias("sfb"), F.lit(s).alias("start"), F.lit(w).alias("width")) for i, (s, w) in enumerate(zip(starts, widths, strict=True))))


def grouped_bands(spectrum: Column, table: Column, groups: Column | None = None, window: int = 0) -> Column:
    """group, sfb, start, width, windows, x of every band of every group: the values of its windows, one after the other.

    table: array (sfb, start, width); groups: lengths of the groups of short windows of `window` values (None: one long window). The array of a row
    may be the row's own, so rows of many rates go together.
    """
    groups = F.array(F.lit(1)) if groups is None else groups
    numbered = F.transform(groups, lambda n, i: F.struct(i.alias("group"), n.cast("int").alias("windows"), F.aggregate(F.slice(groups, F.lit(1), i), F.lit(0), lambda s, m: s + m.cast("int")).alias("first")))

    def cut(g: Column, b: Column) -> Column:
        places = F.sequence(g["first"], g["first"] + g["windows"] - 1)
        x = F.flatten(F.transform(places, lambda w: F.slice(spectrum, w * window + b["start"] + 1, b["width"])))
        return F.struct(g["group"].alias("group"), *(b[c].alias(c) for c in ("sfb", "start", "width")), g["windows"].alias("windows"), x.alias("x"))

    return F.flatten(F.transform(numbered, lambda g: F.transform(table, lambda b: cut(g, b))))


def code_bands(rows: DataFrame, codes: Codes, column: str = "bands", last: Column | int = 1024, short: Column | bool = False, quality: Column | float = 1.0, noise_level: int = 4) -> DataFrame:
    """The rows with group, sfb, windows, energy, peak, target, sf, q (empty unless coded), book and bits of every band of `column`.

    column: bands as grouped_bands gives them; where they have `preset` and `base`, a preset book is final and a base is added to the scale factor.
    last: values of a window. The cheaper one of a magnitude's two codebooks is taken, the lower one of two that tie.
    """
    given = set(rows.schema[column].dataType.elementType.names)

    def summed(b: Column) -> Column:
        squares = F.transform(b["x"], lambda v: v * v)
        out = b.withField("energy", F.aggregate(squares, F.lit(0.0), lambda s, v: s + v)).withField("peak", F.array_max(squares))
        return out if "preset" in given else out.withField("preset", F.lit(None).cast("int")).withField("base", F.lit(0))

    def of_groups(value) -> Column:
        return F.transform(F.sequence(F.lit(0), F.array_max(F.transform(column, lambda b: b["group"]))), lambda g: F.aggregate(column, F.lit(0.0), lambda s, b: s + F.when(b["group"] == g, value(b)).otherwise(0.0)))

    def aimed(b: Column) -> Column:
        total, counted = F.get("_totals", b["group"]), F.get("_counts", b["group"])
        return b.withField("target", B.target_of(b["energy"], b["peak"], b["start"], b["start"] + b["width"], total, last, b["windows"], short, quality, counted))

    def planned(b: Column) -> Column:
        rms, sfac = C.step_of(b["energy"], b["width"] * b["windows"], b["target"])
        return b.withField("rms", rms).withField("sfac", sfac)

    def decided(b: Column) -> Column:
        book, scale, sf = C.decision_of(b["energy"] / b["windows"], b["rms"], b["target"], b["sfac"], noise_level)
        return b.withField("book", F.coalesce(b["preset"], book)).withField("scale", scale).withField("sf", b["base"] + F.when(b["preset"].isNull(), sf).otherwise(0))

    def quantized(b: Column) -> Column:
        return b.withField("q", F.when(b["book"].isNull(), F.transform(b["x"], lambda v: quantize(v, b["scale"]))).otherwise(F.array().cast("array<int>")))

    def sized(b: Column) -> Column:
        return b.withField("best", F.when(b["book"].isNull(), cheapest(b["q"], codes)).otherwise(F.struct(F.lit(0).alias("bits"), b["book"].alias("book"))))

    rows = rows.withColumn(column, F.transform(column, summed))
    rows = rows.withColumns({"_totals": of_groups(lambda b: b["energy"]), "_counts": of_groups(lambda b: (b["width"] * b["windows"]).cast("double"))})
    for step in (aimed, planned, decided, quantized, sized):
        rows = rows.withColumn(column, F.transform(column, step))
    final = lambda b: F.struct(*(b[c].alias(c) for c in ("group", "sfb", "windows", "energy", "peak", "target", "sf", "q")), b["best"]["book"].alias("book"), b["best"]["bits"].alias("bits"))
    return rows.withColumn(column, F.transform(column, final)).drop("_totals", "_counts")


def coded_bands(rows: DataFrame, widths: list[int], codes: Codes, column: str = "spectrum", quality: float = 1.0, noise_level: int = 4) -> DataFrame:
    """The rows with `bands` of a long block's spectrum, as code_bands gives them."""
    cut = rows.withColumn("bands", grouped_bands(F.col(column), band_table(widths)))
    return code_bands(cut, codes, last=sum(widths), quality=quality, noise_level=noise_level)


class _Table:
    """The codebooks as arrays: those of a book by its number, codes and lengths by first place of the book and place in it."""

    def __init__(self, codes: Codes) -> None:
        books = range(max(BOOKS) + 1)
        own = {b: sorted((i, n, c) for k, i, n, c in codes if k == b) for b in BOOKS}
        firsts = np.cumsum([0] + [len(own.get(b, ())) for b in books])[:-1]
        self.first = F.lit(firsts.astype(np.int32))
        self.size = F.lit(np.array([BOOKS[b][1] if b else 1 for b in books], np.int32))
        self.top = F.lit(np.array([BOOKS[b][0] if b else 0 for b in books], np.int32))
        self.signed = F.lit(np.array([int(BOOKS[b][2]) if b else 0 for b in books], np.int32))
        self.length = F.lit(np.array([n for b in BOOKS for _, n, _ in own[b]], np.int32))
        self.code = F.lit(np.array([c for b in BOOKS for _, _, c in own[b]], np.int64))

    def place(self, t: Column, book: Column) -> Column:
        """Place of a tuple in the arrays."""
        top, signed = F.get(self.top, book), F.get(self.signed, book)
        base = top * (signed + 1) + 1
        at = F.aggregate(t, F.lit(0), lambda s, x: s * base + F.when(signed == 1, x + top).otherwise(F.least(F.abs(x), top)))
        return F.get(self.first, book) + at

    def tuples(self, q: Column, book: Column) -> Column:
        size = F.get(self.size, book)
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(q) / size).cast("int") - 1), lambda i: F.slice(q, i * size + 1, size))


def _escapes(t: Column) -> Column:
    """The words of a pair's magnitudes of 16 and more: a run of ones that tells the length, a zero, and the rest of the number."""

    def one(x: Column) -> Column:
        ones = F.length(F.bin(F.abs(x).cast("bigint"))) - 5
        base = F.pow(F.lit(2.0), ones + 4).cast("bigint")
        prefix = (F.pow(F.lit(2.0), ones).cast("bigint") - 1) * 2
        return word(prefix * base + F.abs(x) - base, 2 * ones + 5)

    return F.transform(F.filter(t, lambda x: F.abs(x) >= 16), one)


def _cost(q: Column, book: Column, table: _Table) -> Column:
    bits = F.aggregate(table.tuples(q, book), F.lit(0), lambda s, t: s + F.get(table.length, table.place(t, book)))
    signs = F.when(F.get(table.signed, book) == 1, 0).otherwise(F.size(F.filter(q, lambda x: x != 0)))
    escapes = F.when(book == ESCAPE, F.aggregate(F.filter(q, lambda x: F.abs(x) >= 16), F.lit(0), lambda s, x: s + 2 * F.length(F.bin(F.abs(x).cast("bigint"))) - 5)).otherwise(0)
    return F.struct((bits + signs + escapes).alias("bits"), book.alias("book"))


def _with(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def cheapest(q: Column, codes: Codes) -> Column:
    """(bits, book) of the cheapest book that holds a band's values."""
    table = _Table(codes)

    def sized(first: Column) -> Column:
        zero = F.struct(F.lit(0).alias("bits"), F.lit(ZERO).alias("book"))
        return F.when(first == ZERO, zero).when(first == ESCAPE, _cost(q, first, table)).otherwise(F.array_min(F.array(_cost(q, first, table), _cost(q, first + 1, table))))

    def first_book(top: Column) -> Column:
        out = F.when(top < 1, ZERO)
        for book in range(1, ESCAPE, 2):
            out = out.when(top <= BOOKS[book][0], book)
        return out.otherwise(ESCAPE)

    return _with(F.array_max(F.transform(q, lambda x: F.abs(x))), lambda top: _with(first_book(top), sized))


def band_words(bands: Column, codes: Codes) -> Column:
    """The codewords of all bands (book, q): code and signs of each tuple, then its escapes."""
    table = _Table(codes)

    def put(t: Column, book: Column) -> Column:
        at = table.place(t, book)
        sent = F.when(F.get(table.signed, book) == 1, F.array().cast("array<int>")).otherwise(F.filter(t, lambda x: x != 0))
        signs = F.aggregate(sent, F.lit(0), lambda s, x: s * 2 + F.when(x < 0, 1).otherwise(0))
        data = F.get(table.code, at) * F.pow(F.lit(2.0), F.size(sent)).cast("bigint") + signs
        out = F.array(word(data, F.get(table.length, at) + F.size(sent)))
        return F.when(book == ESCAPE, F.concat(out, _escapes(t))).otherwise(out)

    def one(b: Column) -> Column:
        return F.when(b["book"].between(1, ESCAPE), F.flatten(F.transform(table.tuples(b["q"], b["book"]), lambda t: put(t, b["book"])))).otherwise(nothing())

    return F.flatten(F.transform(bands, one))


def runs(bands: Column) -> Column:
    """start, book, run, group of each stretch of bands of a group with one book."""
    start = F.expr("cast(array() as array<struct<start:int,book:int,run:int,group:int>>)")

    def step(s: Column, b: Column) -> Column:
        last = F.get(s, F.size(s) - 1)
        longer = F.concat(F.slice(s, F.lit(1), F.size(s) - 1), F.array(last.withField("run", last["run"] + 1)))
        new = F.struct(b["sfb"].cast("int").alias("start"), b["book"].cast("int").alias("book"), F.lit(1).alias("run"), b["group"].cast("int").alias("group"))
        return F.when(F.size(s) == 0, F.array(new)).when((last["book"] == b["book"]) & (last["group"] == b["group"]), longer).otherwise(F.concat(s, F.array(new)))

    return F.aggregate(bands, start, step)


def coded_channel(bands: Column, codes: Codes, info: Column | None, short: bool = False, shaping: Column | None = None) -> Column:
    """The words of one channel's coded bands."""
    gain = C.first_gain(bands)
    return channel_stream(gain, info, section_words(runs(bands), short), delta_words(C.changes(bands, gain), codes), shaping_words() if shaping is None else shaping, band_words(bands, codes))


def section_words(sections: Column, short: bool = False) -> Column:
    """Books and lengths of the runs; a length of the largest count and more takes several words."""
    cap, bits = (7, 3) if short else (31, 5)
    return F.flatten(F.transform(sections, lambda s: F.concat(words((s["book"], 4)), F.array_repeat(word(cap, bits), F.floor(s["run"] / cap).cast("int")), words((s["run"] % cap, bits)))))


def delta_words(deltas: Column, codes: Codes) -> Column:
    """The words of scale-factor changes (kind, diff): a first noise value is sent whole, others by their code."""
    own = sorted((i, n, c) for b, i, n, c in codes if b == 12)
    code, length = F.lit(np.array([c for _, _, c in own], np.int64)), F.lit(np.array([n for _, n, _ in own], np.int32))

    def put(d: Column) -> Column:
        at = d["diff"] + C.CLAMP
        return F.when(d["kind"] == 3, word(F.pmod(d["diff"] + 256, F.lit(1 << NOISE_BITS)), NOISE_BITS)).otherwise(word(F.get(code, at), F.get(length, at)))

    return F.transform(deltas, put)


# --- elements -----------------------------------------------------------------------------------------------------------------


def window_info(block: Column, n_bands: Column, grouping: Column | int = 0, shape: int = 0) -> Column:
    """Block type, window shape, number of bands; the grouping of short windows, or the absence of prediction."""
    head = words((0, 1), (block, 2), (shape, 1))
    return F.concat(head, F.when(block == 2, words((n_bands, 4), (grouping, 7))).otherwise(words((n_bands, 6), (0, 1))))


def shaping_words(indices: Column | None = None, length: Column | int = 0) -> Column:
    """Whether a long block has a noise-shaping filter, and its length in bands, order and coefficients; short blocks have none."""
    if indices is None:
        return words((0, 1))
    order = F.size(indices)
    coefficients = F.transform(indices, lambda i: word(F.pmod(i.cast("int"), F.lit(1 << SHAPING_BITS)), SHAPING_BITS))
    one = F.concat(words((1, 1), (1, 2), (SHAPING_BITS - 3, 1), (length, 6), (order, 5)), F.when(order > 0, F.concat(words((0, 1), (0, 1)), coefficients)).otherwise(nothing()))
    return F.when(indices.isNull(), words((0, 1))).otherwise(one)


def channel_stream(gain: Column, info: Column | None, sections: Column, deltas: Column, shaping: Column, spectrum: Column) -> Column:
    """One channel: gain, window info unless its pair shares one, sections, scale factors, flags for pulses (never), shaping and gain control (never), spectrum."""
    return F.concat(words((F.pmod(gain, F.lit(1 << GAIN_BITS)), GAIN_BITS)), nothing() if info is None else info, sections, deltas, words((0, 1)), shaping, words((0, 1)), spectrum)


def single(tag: Column | int, stream: Column, low: bool = False) -> Column:
    """The element of one channel, or of a low-frequency one."""
    return F.concat(words((LOW if low else SINGLE, 3), (tag, 4)), stream)


def pair(tag: Column | int, info: Column | None, mask: Column | None, left: Column, right: Column) -> Column:
    """The element of two channels; with `info` they share a window, and `mask` (0 or 1 a band of each group, or null) says where mid and side are sent."""
    if info is None:
        return F.concat(words((PAIR, 3), (tag, 4), (0, 1)), left, right)
    none = words((0, 2))
    sides = none if mask is None else F.when(mask.isNull(), none).otherwise(F.concat(words((1, 2)), F.transform(mask, lambda m: word(m, 1))))
    return F.concat(words((PAIR, 3), (tag, 4), (1, 1)), info, sides, left, right)


def identification(text: str, before: int) -> Column:
    """The filler element that names the writer, sent once a stream; before: bits of the frame ahead of it, which decide where its bytes lie."""
    body = text.encode("latin-1") + b"\0"
    count = len(body) + 3
    lead = -(before + 7) % 8
    size = [(count, 4)] if count < 15 else [(15, 4), (count - 14, 8)]
    return words((FILL, 3), *size, (0, lead), (0, 8), (0, 8), *((b, 8) for b in body), (0, 8 - lead))


def closed(elements: Column) -> Column:
    """A frame's elements with a filler where they are shorter than a byte, the end, and zeros up to a whole byte."""
    n = size_of(elements)
    filled = F.concat(elements, F.when(n < 5, words((FILL, 3), (0, 4))).otherwise(nothing()), words((END, 3)))
    return F.concat(filled, words((0, F.pmod(-size_of(filled), F.lit(8)))))


def bytes_of(parts: Column) -> Column:
    """Bytes of a frame; one above the largest size raises."""
    n = F.floor((size_of(parts) + 7) / 8).cast("int")
    return F.when(n > LARGEST, F.raise_error(F.lit("frame too long")).cast("int")).otherwise(n)


def packed(parts: Column) -> Column:
    """The words one after the other, zeros up to a whole byte."""
    digits = F.array_join(F.transform(parts, lambda w: F.when(w["len"] > 0, F.lpad(F.bin(w["data"]), w["len"], "0")).otherwise("")), "")
    return _with(digits, lambda d: octets(F.concat(d, F.repeat(F.lit("0"), F.pmod(-F.length(d), F.lit(8))))))


def octets(digits: Column) -> Column:
    """Bytes of a string of binary digits whose length is a multiple of eight."""

    def cut(d: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.floor(F.length(d) / 8).cast("int") - 1, F.lit(0)))
        pairs = F.transform(places, lambda i: F.lpad(F.conv(F.substr(d, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
        return F.when(F.length(d) > 0, F.unhex(F.array_join(pairs, ""))).otherwise(F.lit(b""))

    return _with(digits, cut)
