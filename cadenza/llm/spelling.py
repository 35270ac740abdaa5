"""Spelling variant grouping by wildcard groups, without pairs of words.

Words are maximal runs of letters (A-Z and U+00C0 to U+00FF), counted over all documents; a fixed share of a document's runs, chosen by a
checksum, has one letter deleted first. Of the distinct words those with LENGTH code points and LEAST occurrences are kept, sorted by
falling count and then by code points, and numbered in this order, so that of two words the one with the smaller number is the better form.

Two words that differ by one replaced code point share one group (position, prefix, suffix), and no other. A group keeps its size and its two
smallest numbers: a member's near words in it are size - 1, the best of them is the first, or for the first itself the second. A group has a word for
each letter at most. Words that differ by an indel meet where a word's distinct deletions, one for each stretch of equal letters, join the vocabulary:
each finds one word at most, and the word that is found counts the deletions and keeps the smallest number. Sums and minima
by word put all of it together.

Keys of words up to LONG code points are the strings themselves. Longer words take keys of a fixed size, 128 bits of polynomial hashes of
prefix and suffix with length and position, so that a word of a million letters gives a million small rows.

A word's form is its best near word if that has RATIO times its count. Roots are found by doubling: each step replaces a word's goal by its goal's goal, and
as counts grow by RATIO from form to form, steps are few.

Null and empty texts have no words. A null doc_id has an empty text in the checksum. Repeated rows count each. Texts are read whole, however long. Of near
words with equal counts the smaller in code-point order is the form. Tables without words give no rows. Columns besides doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.shared import discard, lean, materialize, rows_of, small_batches, text_column
from cadenza.llm.words import mix

LENGTH, LEAST, RATIO, DAMAGED = 7, 2, 10, 31
#: Code points of a key that is a string; longer ones are hashes.
LONG = 64
#: Distinct words that a task gathers before it sends their counts, and rows of a batch of hashed keys.
GATHERED, ROWS = 200_000, 100_000
_BASES = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F]


def word_counts(documents: DataFrame, length: int = LENGTH, damaged: int = DAMAGED) -> DataFrame:
    """word, n of every distinct word with at least `length` code points; damaged: one in so many runs loses a letter."""
    small_batches(documents.sparkSession)
    find = re.compile(f"[a-zÀ-ÿ]{{{length},}}").findall

    def sent(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), text_column(batch), strict=True):
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for run, n in Counter(find(text.as_buffer().to_pybytes().lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % damaged == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < length:
                            continue
                    counts[run] += n
                if len(counts) >= GATHERED:
                    yield sent(counts)
                    counts.clear()
        yield sent(counts)

    return rows_of(documents).mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _values(points: np.ndarray, salt: int) -> np.ndarray:
    return mix(points.astype(np.uint64) * np.uint64(_BASES[salt]) + np.uint64(salt + 1))


def hashed_keys(word: str) -> tuple[str, list[np.ndarray], list[np.ndarray], np.ndarray]:
    """(key of the word, keys of its positions' groups, keys of its deletions, places of the deletions), keys as pairs of 64-bit numbers."""
    points = np.frombuffer(word.encode("utf-32-le"), "<u4")
    size = len(points)
    whole, groups, deletions = [], [], []
    for salt, base in enumerate(_BASES):
        powers = np.full(size + 1, base, np.uint64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_values(points, salt) * powers[:-1], dtype=np.uint64)])
        before, after = sums[:-1], sums[-1] - sums[1:]
        whole.append(sums[-1])
        groups.append(mix(before) * np.uint64(base) + mix(after))
        deletions.append(before + after * np.uint64(pow(base, -1, 1 << 64)))
    first = np.flatnonzero(np.concatenate([[True], points[1:] != points[:-1]]))
    return f"{size}#{whole[0]:016x}{whole[1]:016x}", groups, [d[first] for d in deletions], first


def _long_keys(words: DataFrame, long: int) -> DataFrame:
    """kind (w: the word, r: replacement, d: deletion), key, id of words above `long` code points; strings only where a deletion has `long`."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(word)
                own, groups, deletions, first = hashed_keys(word)
                rows = [("w", iter([own])), ("r", (f"{size}:{i}#{a:016x}{b:016x}" for i, (a, b) in enumerate(zip(*groups, strict=True))))]
                short = (word[:i] + word[i + 1 :] for i in first.tolist())
                rows.append(("d", short if size - 1 <= long else (f"{size - 1}#{a:016x}{b:016x}" for a, b in zip(*deletions, strict=True))))
                for kind, found in rows:
                    while part := [k for _, k in zip(range(ROWS), found)]:
                        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(part)), pa.array(part), pa.array(np.full(len(part), number))], names=["kind", "key", "id"])

    return words.select("id", "word").mapInArrow(lean(keys), "kind string, key string, id long")


def near_words(words: DataFrame, long: int = LONG) -> DataFrame:
    """id, n_near (words that differ by one insertion, deletion or replacement), best (the smallest id of them) of words that have any; words: id, word."""
    size = F.length("word")
    hashed = materialize(_long_keys(words.where(size > long), long), "long-keys")
    of = lambda kind: hashed.where(F.col("kind") == kind).select("key", "id")
    plain = words.where(size <= long)
    without = lambda i, mark: F.concat(F.substring("word", F.lit(1), i - 1), F.lit(mark), F.substring("word", i + 1, size))
    groups = plain.select(F.explode(F.transform(F.sequence(F.lit(1), size), lambda i: without(i, "*"))).alias("key"), "id").unionByName(of("r"))
    own = Window.partitionBy("key")
    placed = groups.select("id", F.count("*").over(own).alias("n"), F.min("id").over(own).alias("first"), F.lead("id").over(own.orderBy("id")).alias("next"))
    replaced = placed.where("n > 1").select("id", (F.col("n") - 1).alias("n"), F.when(F.col("id") == F.col("first"), F.col("next")).otherwise(F.col("first")).alias("best"))
    letter = lambda i: F.substring("word", i, F.lit(1))
    starts = F.filter(F.sequence(F.lit(1), size), lambda i: (i == 1) | (letter(i) != letter(i - 1)))
    deletions = plain.select(F.explode(F.transform(starts, lambda i: without(i, ""))).alias("key"), "id").unionByName(of("d"))
    found = deletions.join(plain.select(F.col("word").alias("key"), F.col("id").alias("of")).unionByName(of("w").withColumnRenamed("id", "of")), "key")
    found = materialize(found.select("id", "of"), "deletions")  # one row for each deletion that is a word
    shorter = found.groupBy(F.col("of").alias("id")).agg(F.count("*").alias("n"), F.min("id").alias("best"))
    longer = found.groupBy("id").agg(F.count("*").alias("n"), F.min("of").alias("best"))
    return replaced.unionByName(shorter).unionByName(longer).groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots_of(forms: DataFrame) -> DataFrame:
    """id, root of every row of forms (id, form), where forms make no circle: form after form to the last."""
    goals = materialize(forms.select("id", F.col("form").alias("root")), "roots")
    while True:
        on = goals.select(F.col("id").alias("root"), F.col("root").alias("next"))
        stepped = materialize(goals.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        discard(goals)
        goals = stepped
        if goals.where("moved").isEmpty():
            return goals.select("id", "root")


def group_variants(documents: DataFrame, length: int = LENGTH, least: int = LEAST, ratio: int = RATIO, damaged: int = DAMAGED, long: int = LONG) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the documents with `length` code points and `least` occurrences."""
    counted = word_counts(documents, length, damaged).where(F.col("n") >= least)
    words = materialize(counted.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()), "words")
    near = materialize(near_words(words, long), "near")
    best = words.select(F.col("id").alias("best"), F.col("word").alias("best_word"), F.col("n").alias("best_n"))
    rows = materialize(words.join(near, "id", "left").join(best, "best", "left").withColumn("is_form", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))), "variants")
    roots = roots_of(rows.where("is_form").select("id", F.col("best").alias("form")))
    ends = words.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    rows = rows.join(roots.join(ends, "root").drop("root"), "id", "left")
    given = lambda c: F.when(F.col("is_form"), F.col(c))
    return rows.select("word", given("best_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), given("best_n").alias("form_n"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The checksum is linear: each byte's part depends on its value and its distance from the end, and on nothing else.
SQL = r"""
WITH RECURSIVE steps(b, v, k) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS MATERIALIZED (SELECT b, v FROM steps WHERE k = 8),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
messages AS MATERIALIZED (SELECT row_number() OVER () AS id, doc_id, run, n, hex(encode(concat(doc_id, ':', run))) AS h FROM runs),
parts(k, b, v) AS (
  SELECT 0, b, v FROM crc
  UNION ALL SELECT k + 1, p.b, xor(p.v >> 8, c.v) FROM parts p JOIN crc c ON c.b = p.v & 255 WHERE k < (SELECT max(length(h)) // 2 FROM messages)),
zeros(k, v) AS (
  SELECT 0, 4294967295::BIGINT
  UNION ALL SELECT k + 1, xor(z.v >> 8, c.v) FROM zeros z JOIN crc c ON c.b = z.v & 255 WHERE k < (SELECT max(length(h)) // 2 FROM messages)),
bytes AS (SELECT id, length(h) // 2 - i AS k, ('0x' || substr(h, 2 * i - 1, 2))::BIGINT AS b FROM (SELECT id, h, unnest(range(1, length(h) // 2 + 1)) AS i FROM messages)),
sums AS (SELECT id, bit_xor(v) AS v FROM bytes JOIN parts USING (k, b) GROUP BY id),
checked AS (SELECT run, n, xor(xor(s.v, z.v), 4294967295) AS h, length(run) AS size FROM messages JOIN sums s USING (id) JOIN zeros z ON z.k = length(messages.h) // 2),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % size) || substr(run, h % size + 2) ELSE run END AS word, n FROM checked)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
letters AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS key FROM letters),
deleted AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS key FROM letters),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM gaps a JOIN gaps b ON a.key = b.key AND a.word <> b.word
  UNION ALL SELECT d.word, d.n, w.word, w.n FROM deleted d JOIN words w ON w.word = d.key
  UNION ALL SELECT w.word, w.n, d.word, d.n FROM deleted d JOIN words w ON w.word = d.key),
ranked AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
best AS MATERIALIZED (SELECT word, near, near_n, n_near, near_n >= 10 * n AS is_form FROM ranked WHERE place = 1),
chain(word, root) AS (
  SELECT word, near FROM best WHERE is_form
  UNION ALL SELECT c.word, b.near FROM chain c JOIN best b ON b.word = c.root AND b.is_form),
last AS (SELECT word, root FROM chain c WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.word = c.root AND b.is_form))
SELECT w.word, CASE WHEN b.is_form THEN b.near END AS form, coalesce(l.root, w.word) AS root, w.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.is_form THEN b.near_n END AS form_n
FROM words w LEFT JOIN best b USING (word) LEFT JOIN last l USING (word)
"""
