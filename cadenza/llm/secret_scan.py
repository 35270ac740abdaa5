"""Secret scan with a battery of randomness tests, in DataFrame functions only.

Base spans come from three patterns (assignments, access keys, long hex). Positions are code points, found by splitting the
text at a pattern and adding up the lengths of pieces and matches.

The method adds tokens that look random. A candidate is a run of at least LEAST encoding characters outside
base spans; its encoding is the smallest that fits (decimal, hex, base 32, base 64). Three statistics test it against
structured text as the null hypothesis:

* the chi-squared distance of its symbols from a uniform alphabet, which for text grows with the length (noncentrality SHAPE a symbol),
* the runs of character classes (lower, upper, digit, mark; low and high digits in a decimal), of which text has few (TURNS a step),
* the serial correlation of its symbol values, which text has (CARRY).

Each gives a normal score in favour of randomness; Stouffer's sum gives one p-value per candidate. Longer candidates carry more
weight: p-values are divided by their length over the mean length, and Benjamini-Hochberg at level ALPHA over all
candidates of all texts sets the limit, from a histogram of at most BINS steps of log p.

Positions and overlaps come from running sums and maxima in doubling steps, so a text of n matches costs n log n whatever its length.

Null and empty texts have no spans; the hash of no spans is that of the empty string. Repeated rows are scanned each, a null doc_id
too. An empty table gives no rows. Ties: spans of one start stand in the order of their kinds. Columns besides doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.shared import materialize, rows_of

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
KINDS = ["assign", "access", "hex", "random"]
LEAST = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{{LEAST},}}"
ALPHA, BINS, STEP = 0.01, 4000, 0.01
SHAPE = {"decimal": 0.6, "hex": 1.2, "base32": 1.6, "base64": 3.2}
TURNS, CARRY = 0.25, 0.35
_ALPHABETS = {"decimal": "0123456789", "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"}


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def scanned(values: Column, op, least: Column) -> Column:
    """The array whose i-th element combines the first i + 1 values; op is associative with identity `least`.

    Each step combines elements twice as far apart; steps beyond the array's length change nothing and are skipped.
    """
    def doubled(a: Column, step: Column) -> Column:
        before = F.concat(F.array_repeat(least, step), F.slice(a, F.lit(1), F.size(a) - step))
        return F.when(F.size(a) > step, F.zip_with(before, a, op)).otherwise(a)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(31))), values, doubled)


def clear_of(found: Column, base: Column) -> Column:
    """The spans of `found` (which don't overlap each other) that overlap none of `base`.

    In the order of starts of base spans and ends of found ones, a span is clear when no base span before it ends after its start.
    """
    at = lambda s, key, end, of: F.struct(s[key].alias("at"), F.lit(of).alias("of"), s["start"].alias("start"), end.alias("end"))
    found_at = F.transform(found, lambda s: at(s, "end", F.lit(0), 0))
    base_at = F.transform(base, lambda s: at(s, "start", s["end"], 1))

    def kept(events: Column) -> Column:
        reach = scanned(F.transform(events, lambda e: e["end"]), lambda a, b: F.greatest(a, b), F.lit(0))
        clear = F.filter(F.zip_with(events, reach, lambda e, r: F.struct(e["of"].alias("of"), (r <= e["start"]).alias("ok"))), lambda e: e["of"] == 0)
        return F.filter(F.zip_with(found, clear, lambda s, c: F.struct(s.alias("s"), c["ok"].alias("ok"))), lambda x: x["ok"])

    left = F.transform(_let(F.array_sort(F.concat(found_at, base_at)), kept), lambda x: x["s"])
    return F.when((F.size(found) > 0) & (F.size(base) > 0), left).otherwise(found)


def _found(text: str, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, token, part>> of the leftmost non-overlapping matches of a pattern; part: a group of it."""
    col, pat = F.col(text), F.lit(pattern)
    zipped = F.arrays_zip(
        F.regexp_extract_all(col, pat, F.lit(0)).alias("token"),
        F.regexp_extract_all(col, pat, F.lit(group)).alias("part"),
        F.transform(F.split(col, pattern, -1), lambda p: F.length(p)).alias("gap"),
    )
    empty = F.expr("cast(array() as array<struct<start:int,end:int,token:string,part:string>>)")
    matches = F.filter(zipped, lambda m: m["token"].isNotNull())  # the last gap, after the last match, has no token

    def placed(found: Column) -> Column:
        ends = scanned(F.transform(found, lambda m: m["gap"] + F.length(m["token"])), lambda a, b: a + b, F.lit(0))
        return F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m["token"])).alias("start"), e.alias("end"), m["token"].alias("token"), m["part"].alias("part")))

    return F.when(col.rlike(pattern), _let(matches, placed)).otherwise(empty)


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def base_spans(documents: DataFrame) -> DataFrame:
    """doc_id, text, base (array of start, kind, end), n_assign, n_access, n_hex."""
    rows = rows_of(documents).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.select("doc_id", "text", _found("text", ASSIGN, 2).alias("a"), _found("text", ACCESS).alias("k"), _found("text", HEX).alias("h"))
    rows = rows.withColumns({"a": F.filter("a", lambda m: F.length(m["part"]) >= 8), "k": F.filter("k", lambda m: F.length(m["token"]) >= 16)})
    base = F.concat(*(_spans(F.col(c), i) for i, c in enumerate("akh")))
    return rows.select("doc_id", "text", F.array_sort(base).alias("base"), *(F.size(c).cast("long").alias(n) for c, n in (("a", "n_assign"), ("k", "n_access"), ("h", "n_hex"))))


def _phi(z: Column) -> Column:
    """The normal distribution function, by its logistic approximation."""
    return 1 / (1 + F.exp(-(1.5976 * z + 0.07056 * z * z * z)))


def _with(row: Column, names: list[str], **more: Column) -> Column:
    """The struct with further fields; kept a step of its own, each is computed once a token."""
    return F.struct(*(row[n].alias(n) for n in names), *(c.alias(n) for n, c in more.items()))


def _score(token: Column) -> Column:
    """The p-value of a candidate against structured text."""
    return _let(_steps(token), lambda t: _phi(-F.least(F.greatest((t["z_chi"] + t["z_runs"] + t["z_serial"]) / 3**0.5, F.lit(-8.0)), F.lit(8.0))))


def _steps(token: Column) -> Column:
    """struct with encoding, z_chi, z_runs and z_serial of a candidate."""
    whole = F.when(token.rlike("^[0-9]+$"), F.lit("decimal")).when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit("hex")).when(token.rlike("^[A-Z2-7]+$"), F.lit("base32")).otherwise(F.lit("base64"))

    def by(key: Column, values: dict) -> Column:
        return reduce(lambda c, k: c.when(key == k, F.lit(values[k])), list(values)[1:], F.when(key == list(values)[0], F.lit(values[list(values)[0]])))

    def texts(t: Column) -> Column:
        folded = F.when(t["encoding"] == "hex", F.lower(t["token"])).otherwise(t["token"])
        classes = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace(t["token"], "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "+/-_", "mmmm")
        kinds = F.split(F.when(t["encoding"] == "decimal", F.translate(t["token"], "0123456789", "lllllhhhhh")).otherwise(classes), "", -1)
        return _with(t, ["token", "encoding"], alphabet=by(t["encoding"], _ALPHABETS), shape=by(t["encoding"], SHAPE), folded=folded, chars=F.split(folded, "", -1), kinds=kinds)

    def numbers(t: Column) -> Column:
        n = F.length(t["folded"]).cast("double")
        squares = F.aggregate(F.array_distinct(t["chars"]), F.lit(0.0), lambda s, c: s + F.pow(F.length(t["folded"]) - F.length(F.replace(t["folded"], c, F.lit(""))), F.lit(2)))
        values = F.transform(t["chars"], lambda c: F.instr(t["alphabet"], c).cast("double"))
        steps = F.zip_with(F.slice(t["kinds"], 1, F.size(t["kinds"]) - 1), F.slice(t["kinds"], 2, F.size(t["kinds"]) - 1), lambda x, y: x != y)
        return _with(t, ["encoding", "shape"], n=n, size=F.length(t["alphabet"]).cast("double"), squares=squares, values=values, turns=F.size(F.filter(steps, lambda x: x)))

    def centred(t: Column) -> Column:
        mean = F.aggregate(t["values"], F.lit(0.0), lambda s, v: s + v) / t["n"]
        moved = _let(mean, lambda m: F.transform(t["values"], lambda v: v - m))
        return _with(t, ["encoding", "shape", "n", "size", "squares", "turns"], moved=moved)

    def scores(t: Column) -> Column:
        n, freedom = t["n"], t["size"] - 1
        chi = t["size"] / n * t["squares"] - n
        z_chi = (freedom + n * t["shape"] - chi) / F.sqrt(2 * (freedom + 2 * n * t["shape"]))
        z_runs = (t["turns"] - (n - 1) * TURNS) / F.sqrt((n - 1) * (TURNS * (1 - TURNS)))
        power = F.aggregate(t["moved"], F.lit(0.0), lambda s, v: s + v * v)
        after = F.zip_with(F.slice(t["moved"], 1, F.size(t["moved"]) - 1), F.slice(t["moved"], 2, F.size(t["moved"]) - 1), lambda a, b: a * b)
        serial = F.when(power > 0, F.aggregate(after, F.lit(0.0), lambda s, v: s + v) / power).otherwise(F.lit(1.0))
        return _with(t, ["encoding"], z_chi=z_chi, z_runs=z_runs, z_serial=(CARRY - F.abs(serial)) * F.sqrt(n))

    return _let(_let(_let(_let(F.struct(token.alias("token"), whole.alias("encoding")), texts), numbers), centred), scores)


def candidates(scanned: DataFrame) -> DataFrame:
    """The rows of base_spans with `tokens` (start, end, p, n) in place of the text."""
    scanned = scanned.withColumn("found", _found("text", CANDIDATE))
    # tokens are scored as rows of an array; texts without any skip the battery
    scored = F.transform("found", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), _score(m["token"]).alias("p"), F.length(m["token"]).alias("n")))
    return scanned.withColumn("found", clear_of(F.col("found"), F.col("base"))).withColumn("tokens", scored).drop("text", "found")


def limit(scored: DataFrame, alpha: float = ALPHA) -> tuple[float, float]:
    """(limit of the weighted p-values, mean length) by Benjamini-Hochberg over all candidates."""
    tokens = scored.select(F.explode("tokens").alias("t")).select("t.*")
    total, mean = tokens.agg(F.count("*"), F.avg("n")).first()
    if not total:
        return -1.0, 1.0
    weighted = F.least(F.col("p") * mean / F.col("n"), F.lit(1.0))
    bins = tokens.groupBy(F.least(F.floor(-F.log10(F.greatest(weighted, F.lit(1e-300))) / STEP), F.lit(BINS)).alias("bin")).agg(F.count("*").alias("k"))
    best, seen = -1.0, 0
    for r in sorted(bins.collect(), key=lambda r: -r["bin"]):  # at most BINS + 1 rows
        seen += r["k"]
        edge = 10 ** (-r["bin"] * STEP)
        if edge * total <= alpha * seen:
            best = edge
    return best, mean


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(documents: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans, n_candidates, least_p, limit_p of every document.

    least_p: the smallest weighted p-value of a document's candidates (null without any); limit_p: up to which a candidate is taken as random,
    over all documents, negative if none is.
    """
    scored = materialize(candidates(base_spans(documents)), "candidates")
    most, mean = limit(scored, alpha)
    weighted = lambda t: F.least(t["p"] * mean / t["n"], F.lit(1.0))
    kept = F.filter("tokens", lambda t: weighted(t) <= most)
    out = scored.withColumn("random", F.transform(kept, lambda t: F.struct(t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end"))))
    spans = F.array_sort(F.concat("base", "random"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.size("random").cast("long").alias("n_random"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(spans).alias("spans"), F.size("tokens").cast("long").alias("n_candidates"), F.array_min(F.transform("tokens", weighted)).alias("least_p"), F.lit(most).alias("limit_p"))


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
