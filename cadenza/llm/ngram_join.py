"""Near-duplicate join on word n-grams with filters under several global orders of the n-grams.

A text's set is its distinct k-word shingles (64-bit hashes); two texts link when the Jaccard similarity of
their sets reaches num/den. Two sets that similar share a member of their prefixes (the first n - ceil(t n) + 1
members) under every order of the shingles. The steps:

1. Texts with equal sets form one class; only the class representative (smallest doc_id) goes on.
2. Frequent shingles are counted over all documents, in packed runs (`runs`): an order that puts them last keeps shared
   passages out of the prefixes. The list only shapes the order, never the result; it holds at most HOT rows.
3. Prefix members under the first order that more than one class has are found the same way; only their rows are joined on the
   shingle. A pair is looked at when sizes and the positions of the shared shingle allow the similarity.
4. Before the exact check a pair must also share a prefix member under the second and the third order, and the members in a
   fixed share of the hash range may differ by no more than whole sets of that similarity may.
5. `components` first checks every group's members against one leader and merges what links; then all remaining
   pairs of a group whose members are still in different components. No pair that could change a component is left out.

Null texts and texts without words have an empty set: size 0, linked with nothing. Texts of fewer than k words have
one shingle for the whole sequence. Repeated rows belong to the same class; a doc_id names one node. A row with a null
doc_id takes the component of its class, null if all of that class are null, and is never a component's name.
Texts are taken whole whatever their length, one set at a time. Ties: of equal sets the smallest doc_id stands for the class, of equally
early members of a group the one with the smallest doc_id leads. An empty table gives no rows. Columns besides doc_id and text are
ignored, whatever their names. Hash values stand for shingles; equal sets are recognised by a 128-bit digest of the sorted values.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.components import components as connect
from cadenza.llm.runs import FAN, Tally, dealt, parts_of, refined, tallied
from cadenza.llm.shared import BROADCAST_IDS, discard, lean, materialize, rows_of, small_batches, text_column, text_slices, trim, with_ids
from cadenza.llm.words import mix, shingles, word_hashes

#: Rows of the list of frequent shingles (8 bytes each), and documents from which a shingle is frequent.
HOT, FREQUENT = 1_000_000, 12
#: Bytes of text for each shingle, at least: sizes the counting parts and the bits by which shingles are told apart there.
SHINGLE_BYTES = 4
#: Share of the hash range whose members are compared before whole sets are.
SHARE = 0.2
_ORDERS = [np.uint64(x) for x in (0x8CB92BA72F3D8DD7, 0xC6A4A7935BD1E995, 0x2545F4914F6CDD1D)]


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every row."""
    for lo, _, data, offs in text_slices(column):
        values, n = shingles(*word_hashes(data, offs), k)
        ends = np.cumsum(n)
        for i, (e, m) in enumerate(zip(ends.tolist(), n.tolist(), strict=True)):
            yield lo + i, np.unique(values[e - m : e])


def _parts(values: float) -> tuple[int, int]:
    """(parts, bits) in which so many values are counted: a run's worth a part, and few false meetings in the bits."""
    return parts_of(values), min(60, max(32, int(values).bit_length() + 8))


def _recurring(rows: DataFrame, values_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], size: tuple[int, int], least: int, fan: int = FAN) -> DataFrame:
    """value, n of the values below 2**bits that at least `least` rows have."""
    parts, bits = size
    coarse = min(parts, fan)

    def sent(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int32()), pa.array([b for _, b in found], pa.binary())], names=["part", "run"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(coarse, bits)
        for batch in batches:
            for values in values_of(batch):
                for found in tally.add(values):
                    yield sent([found])
        yield sent(list(tally.flush()))

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in refined(batches, parts, bits):
            yield sent([found])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, values, n in tallied(batches):
            keep = n >= least
            yield pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(n[keep].view(np.int64))], names=["value", "n"])

    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts // 16)
    runs = rows.mapInArrow(lean(deal), "part int, run binary")
    if parts > coarse:
        runs = dealt(runs, max(tasks, coarse)).mapInArrow(lean(refine), "part int, run binary")
    return dealt(runs, tasks).mapInArrow(lean(count), "value long, n long")


def frequent_shingles(documents: DataFrame, k: int) -> tuple[np.ndarray, int]:
    """(sorted brief values of shingles that at least FREQUENT documents have, the HOT most frequent ones; their bits).

    Two shingles that share these bits only share a place in the order.
    """
    rows = rows_of(documents)
    size = _parts((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / SHINGLE_BYTES)

    def values_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        held, n = [], 0
        for _, s in _sets(text_column(batch), k):
            held.append(s)
            n += len(s)
            if n > 1 << 17:
                yield _brief(np.concatenate(held), size[1])
                held, n = [], 0
        if held:
            yield _brief(np.concatenate(held), size[1])

    top = _recurring(rows, values_of, size, FREQUENT).orderBy(F.desc("n"), "value").limit(HOT).select("value").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64)), size[1]


def _brief(values: np.ndarray, bits: int) -> np.ndarray:
    """Some bits of each shingle, by which frequent ones are listed."""
    return mix(values ^ _ORDERS[0]) >> np.uint64(64 - bits)


Hot = tuple[np.ndarray, int]


def _order(values: np.ndarray, hot: Hot, which: int) -> np.ndarray:
    """The members of a set in a global order: frequent ones last, else by a hash."""
    rank = mix(values ^ _ORDERS[which]) >> np.uint64(1)
    listed, bits = hot
    if len(listed):
        own = _brief(values, bits)
        at = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
        rank |= (listed[at] == own).astype(np.uint64) << np.uint64(63)
    return np.argsort(rank, kind="stable")


def _prefix(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def signatures(documents: DataFrame, k: int, num: int, den: int, hot: Hot) -> DataFrame:
    """doc_id, n_shingles, digest of the set, prefix (in order) under the first order."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, prefixes = [], [], []
            for _, s in _sets(text_column(batch), k):
                n.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                prefixes.append(s[_order(s, hot, 0)[: _prefix(len(s), num, den)]].view(np.int64))
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), listed], names=["doc_id", "n_shingles", "digest", "prefix"])
            trim()

    return rows_of(documents).mapInArrow(lean(sign), "doc_id long, n_shingles long, digest binary, prefix array<long>")


def _build(rows: DataFrame, k: int, columns: dict[str, tuple[str, Callable[[np.ndarray], np.ndarray]]]) -> DataFrame:
    """The rows with their text replaced by the set's size n_set and array columns made from the set."""
    first = [f for f in rows.schema.fields if f.name != "text"]
    names = [f.name for f in first]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, lists = [], {c: [] for c in columns}
            for _, s in _sets(text_column(batch), k):
                size.append(len(s))
                for c, (_, make) in columns.items():
                    lists[c].append(make(s))
            out = [*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(size, pa.int64())]
            for c, (kind, _) in columns.items():
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists[c]])]).astype(np.int32)
                values = np.concatenate([*lists[c], np.zeros(0, np.int32 if kind == "int" else np.int64)])
                out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values)))
            yield pa.RecordBatch.from_arrays(out, names=[*names, "n_set", *columns])
            trim()

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in first) + ", n_set long" + "".join(f", {c} array<{kind}>" for c, (kind, _) in columns.items())
    return rows.mapInArrow(lean(build), schema)


def _feasible(n_a: str, pos_a: str, n_b: str, pos_b: str, num: int, den: int) -> F.Column:
    """Whether sizes, and positions of the first shared prefix member, allow the similarity."""
    a, b = F.col(n_a), F.col(n_b)
    sizes = (den * F.least(a, b)) >= (num * F.greatest(a, b))
    shared = F.least(a - F.col(pos_a), b - F.col(pos_b))
    return sizes & ((num + den) * shared >= num * (a + b))


def _sides(table: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (a, b) with the columns of a table by doc_id, once for each side (suffix _a and _b)."""

    def side(x: str) -> DataFrame:
        return table.select(F.col("doc_id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in table.columns if c != "doc_id"))

    return pairs.join(side("b"), "b").join(side("a"), "a")


def plausible(pairs: DataFrame, documents: DataFrame, k: int, num: int, den: int, hot: Hot) -> DataFrame:
    """The pairs (a, b), written, that pass the filters of the second and third order and of the share of the hash range."""
    below = np.uint64(int(SHARE * 2**64))
    columns = {
        "second": ("int", lambda s: s[_order(s, hot, 1)[: _prefix(len(s), num, den)]].astype(np.uint32).view(np.int32)),
        "third": ("int", lambda s: s[_order(s, hot, 2)[: _prefix(len(s), num, den)]].astype(np.uint32).view(np.int32)),
        "part": ("bigint", lambda s: s[mix(s ^ _ORDERS[1]) < below].view(np.int64)),
    }
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    parts = materialize(_build(with_ids(rows_of(documents), ids), k, columns), "parts")
    both = _sides(parts, pairs)
    both = both.where(F.arrays_overlap("second_a", "second_b") & F.arrays_overlap("third_a", "third_b"))
    apart = F.size("part_a") + F.size("part_b") - 2 * F.size(F.array_intersect("part_a", "part_b"))
    out = materialize(both.where((num + den) * apart <= (den - num) * (F.col("n_set_a") + F.col("n_set_b"))).select("a", "b").distinct(), "plausible")
    discard(parts)
    return out


def verify(pairs: DataFrame, documents: DataFrame, k: int, num: int, den: int, hot: Hot) -> DataFrame:
    """The pairs (a, b) that link: filtered, then counted exactly on whole sets.

    For the count each side's sets are built where its texts are read and move once, to the pairs of their `a`.
    """
    left = plausible(pairs, documents, k, num, den, hot)
    rows = rows_of(documents)
    few = left.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS

    def joined(ids: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(ids) if few else ids, "doc_id")

    whole = {"members": ("bigint", lambda s: s.view(np.int64))}
    own = _build(joined(left.select(F.col("a").alias("doc_id")).distinct()).withColumnRenamed("doc_id", "a"), k, whole)
    others = _build(joined(left.select(F.col("b").alias("doc_id"), "a")).withColumnRenamed("doc_id", "b"), k, whole)
    both = others.select("a", "b", F.col("members").alias("members_b")).join(own, "a")
    common = both.select("a", "b", (F.size("members") + F.size("members_b")).alias("total"), F.size(F.array_intersect("members", "members_b")).alias("common"))
    return common.where(den * F.col("common") >= num * (F.col("total") - F.col("common"))).select("a", "b").distinct()


class _Candidates:
    """Classes of equal sets and the prefix members that more than one class has."""

    def __init__(self, documents: DataFrame, k: int, num: int, den: int) -> None:
        small_batches(documents.sparkSession)
        self.documents, self.k, self.num, self.den = documents, k, num, den
        self.hot = frequent_shingles(documents, k)
        self.signed = materialize(signatures(documents, k, num, den, self.hot), "signatures")
        # classes of one text need no row; the others are joined as a table of their own, whose skewed keys can be split
        classes = self.signed.where("n_shingles > 0").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("node"), F.count("*").alias("texts"))
        self.classes = materialize(classes.where("texts > 1").drop("texts"), "classes")
        named = self.signed.select("doc_id", "n_shingles", "digest").join(self.classes, ["digest", "n_shingles"])
        again = materialize(named.where("doc_id <> node").select("doc_id", "digest").distinct(), "again")
        few = again.limit(BROADCAST_IDS // 2).count() < BROADCAST_IDS // 2
        first = self.signed.where("n_shingles > 0").join(F.broadcast(again) if few else again, ["doc_id", "digest"], "left_anti")
        if self._repeated():
            first = first.dropDuplicates(["doc_id", "digest"])
        first = first.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "prefix")
        members = first.select("node", "n", F.posexplode("prefix").alias("pos", "token"))
        tokens = self._shared_tokens(first)
        few = tokens.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
        members = materialize(members.join(F.broadcast(tokens) if few else tokens, "token", "left_semi"), "members")
        leaders = members.groupBy("token").agg(F.count("*").alias("rows"), F.min(F.struct("pos", "node", "n")).alias("leader"))
        leaders = materialize(leaders.where("rows > 1").drop("rows"), "leaders")
        discard(tokens, again)
        self.shared = members.join(leaders, "token")

    def _shared_tokens(self, first: DataFrame) -> DataFrame:
        """token: the prefix members that more than one class has."""
        total = first.agg(F.sum(F.size("prefix"))).first()[0] or 0
        parts, _ = _parts(total)

        def values_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            yield batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)

        return materialize(_recurring(first.select("prefix"), values_of, (parts, 64), 2).select(F.col("value").alias("token")), "tokens")

    def _repeated(self) -> bool:
        return not self.signed.groupBy("doc_id").count().where("count > 1").isEmpty()

    def check(self, pairs: DataFrame) -> DataFrame:
        return materialize(verify(pairs, self.documents, self.k, self.num, self.den, self.hot), "links")

    def against_leaders(self) -> DataFrame:
        """Pairs of each group's leader, the member with the earliest position, with its other members."""
        rows = self.shared.select("node", "n", "pos", F.col("leader.node").alias("a"), F.col("leader.n").alias("n_a"), F.col("leader.pos").alias("pos_a"))
        pairs = rows.where("node <> a").where(_feasible("n_a", "pos_a", "n", "pos", self.num, self.den))
        return materialize(pairs.select("a", F.col("node").alias("b")).distinct(), "pairs")

    def remaining(self, labels: DataFrame | None, done: DataFrame | None) -> DataFrame:
        """Pairs of members of a group; with labels, only those whose labels differ, without the pairs done."""
        rows = self.shared.drop("leader")
        if labels is not None:
            rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
            mixed = materialize(rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("token"), "mixed-tokens")
            rows = materialize(rows.join(mixed, "token"), "mixed")
        else:
            rows = rows.withColumn("label", F.col("node"))
        a = rows.select("token", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("pos").alias("pos_a"), F.col("label").alias("label_a"))
        b = rows.select("token", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("pos").alias("pos_b"), F.col("label").alias("label_b"))
        pairs = a.join(b, "token").where("a < b and label_a <> label_b").where(_feasible("n_a", "pos_a", "n_b", "pos_b", self.num, self.den)).select("a", "b").distinct()
        if done is not None:
            pairs = pairs.join(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
        return materialize(pairs, "pairs")

    def membership(self) -> DataFrame:
        """doc_id, n_shingles, node (the representative of its class)."""
        few = self.classes.limit(BROADCAST_IDS // 2).count() < BROADCAST_IDS // 2
        named = self.signed.select("doc_id", "n_shingles", "digest").join(F.broadcast(self.classes) if few else self.classes, ["digest", "n_shingles"], "left")
        return named.select("doc_id", "n_shingles", F.coalesce("node", "doc_id").alias("node"))


def similar_pairs(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(links a < b between class representatives, membership doc_id, n_shingles, node): every link, none pruned."""
    found = _Candidates(documents, k, num, den)
    links = found.check(found.remaining(None, None))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), found.membership()


def near_duplicates(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every document."""
    found = _Candidates(documents, k, num, den)
    pairs = found.against_leaders()
    links = found.check(pairs)
    labels = connect(links)
    more = found.check(found.remaining(labels, pairs))
    labels = connect(links.unionByName(more))
    named = found.membership().join(labels, "node", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "node").alias("component_id"))


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, num=90, den=100)


#: Fixed to the query's parameters: three words, 0.9.
SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
u AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM t),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM u),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.c = l.x)
SELECT u.doc_id, len(g) AS n_shingles, min(c) AS component_id FROM u JOIN r USING (doc_id) GROUP BY u.doc_id, g
"""
