"""Best-fit packing by bin completion.

Every document is its token ids and one end id; longer ones are cut into pieces of `capacity`. The packing
problem depends only on how many pieces there are of each length, so the lengths are counted in Spark (at most
`capacity` rows, whatever the corpus) and solved on the driver as a histogram: a branch-and-bound search over
fillings of a sequence around its largest piece, with runs of equal sequences taken at once. The plan, patterns
with multiplicities, is as small as the histogram. Pieces then find their place by their rank among the pieces of
their length: ranks come from counts per (length, salt), so no task holds one length whole.

The search has a budget of NODES steps, whatever the histogram; without one (`nodes=None`) it ends only with a proof that no plan has fewer
sequences; `pack` takes that argument too, and its rows say whether there is a proof. Where it meets the lower bound, as best fit alone does on large histograms, the plan is optimal anyway. No budget ever drops a piece:
the best plan so far stands.

Null or empty texts are one piece of one id (the end id). Texts are cut whole, however long. Repeated rows are packed each; pieces of
one length are alike, ties in their ranks change nothing but which of them lies where. Empty tables give no rows. Columns besides
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.shared import lean, materialize, small_batches, text_column, text_slices
from cadenza.llm.token_counts import RUN, encoder, vocabulary_path

CAPACITY = 2048
END_ID = 0
#: Steps of the search (looks at fillings, and eight lengths of a node's bound each), after which the best solution so far stands.
NODES = 60_000
#: Fillings that are found before the fullest of them is tried.
LOT = 64
#: Pieces of one length and salt, on average, in the largest possible class.
SALT_ROWS = 50_000

Pattern = tuple[int, tuple[tuple[int, int], ...]]  # (how many sequences, ((length, pieces of it in each), ...))


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over a histogram; equal sequences are handled together."""
    room: list[int] = []
    groups: dict[int, list[list]] = {}

    def put(left: int, items: tuple, n: int) -> None:
        if left not in groups:
            insort(room, left)
            groups[left] = []
        groups[left].append([items, n])

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        todo = counts[length]
        while todo:
            k = bisect_left(room, length)
            if k == len(room):
                each = capacity // length
                if todo >= each:
                    put(capacity - each * length, ((length, each),), todo // each)
                    todo %= each
                else:
                    put(capacity - todo * length, ((length, todo),), 1)
                    todo = 0
                continue
            left = room[k]
            items, n = groups[left].pop()
            each = min(left // length, todo)
            take = min(n, todo // each)
            if n > take:
                groups[left].append([items, n - take])
            if not groups[left]:
                del groups[left]
                room.pop(k)
            put(left - each * length, (*items, (length, each)), take)
            todo -= each * take
    return [(n, items) for left in room for items, n in groups[left]]


def fillings(lengths: list[int], counts: dict[int, int], room: int, steps: Iterator[int]) -> Iterator[tuple[tuple[int, int], ...]]:
    """Undominated ways to fill `room`, found one by one, the fullest of every LOT first: no further piece fits, and none packs inside an earlier one.

    lengths: sorted negative lengths. steps: the budget, one step a look; it ends early once the budget is spent.
    """
    kept: list[tuple[int, ...]] = []
    lot: list[tuple[int, ...]] = []

    def children(start: int, left: int, chosen: tuple[int, ...]) -> Iterator[int]:
        for j in range(bisect_left(lengths, -left, lo=start), len(lengths)):
            if chosen.count(-lengths[j]) < counts[-lengths[j]]:
                yield j
                if -lengths[j] == left:
                    return  # a piece of exactly this length dominates all smaller ones in its place

    def chosen_ones() -> Iterator[tuple[tuple[int, int], ...]]:
        for f in sorted(lot, key=lambda f: (-sum(f), len(f))):
            if not any(_packs_into(f, g) for g in kept):
                kept.append(f)
                yield tuple((x, f.count(x)) for x in sorted(set(f), reverse=True))
        lot.clear()

    frames: list[list] = [[children(0, room, ()), room, (), True]]
    while frames and next(steps, None) is not None:
        frame = frames[-1]
        j = next(frame[0], None)
        if j is None:
            frames.pop()
            _, left, chosen, leaf = frame
            if leaf and next((-x > left for x in reversed(lengths) if chosen.count(-x) < counts[-x]), True):
                lot.append(chosen)
                if len(lot) == LOT:
                    yield from chosen_ones()
            continue
        frame[3] = False
        x = -lengths[j]
        left, chosen = frame[1] - x, (*frame[2], x)
        frames.append([children(j, left, chosen), left, chosen, True])
    yield from chosen_ones()


def _packs_into(small: tuple[int, ...], big: tuple[int, ...]) -> bool:
    """Whether the pieces of `small` can be packed into those of `big` as boxes (then `big` dominates)."""
    if len(small) > 6 or sum(small) > sum(big):
        return False
    left = list(big)

    def place(k: int) -> bool:
        if k == len(small):
            return True
        tried = set()
        for j, x in enumerate(left):
            if x >= small[k] and x not in tried:
                tried.add(x)
                left[j] -= small[k]
                if place(k + 1):
                    return True
                left[j] += small[k]
        return False

    return place(0)


def solve(counts: dict[int, int], capacity: int = CAPACITY, nodes: int | None = NODES) -> tuple[list[Pattern], bool]:
    """(plan, whether it is proved to have the fewest sequences) by bin completion on a histogram of lengths; nodes None: no budget."""
    counts = {int(k): int(v) for k, v in counts.items() if v > 0}
    best = best_fit(counts, capacity)
    most = sum(n for n, _ in best)
    least = _bound(counts, capacity)
    budget = iter(count()) if nodes is None else iter(range(nodes))
    spent = False

    rest = dict(counts)  # what is left at the node that is looked at; a node's own pieces go in and come out of it

    def branches() -> Iterator[tuple[int, dict[int, int]]]:
        """The ways to place the largest piece, each with how many sequences alike; `rest` is the node's own whenever it goes on."""
        largest = max(rest)
        rest[largest] -= 1
        ways = fillings(sorted(-x for x in rest if rest[x] > 0), rest, capacity - largest, budget)
        rest[largest] += 1
        while True:
            rest[largest] -= 1
            filling = next(ways, None)
            rest[largest] += 1
            if filling is None:
                return
            pattern = dict(filling)
            pattern[largest] = pattern.get(largest, 0) + 1
            # as many alike as there can be, then fewer: those that remain take other fillings
            for times in range(min(rest[x] // k for x, k in pattern.items()), 0, -1):
                yield times, pattern

    def move(times: int, pattern: dict[int, int]) -> None:
        for x, k in pattern.items():
            left = rest.get(x, 0) - times * k
            if left:
                rest[x] = left
            else:
                del rest[x]

    stack = [(0, {}, 0, branches())] if rest and most > least else []  # (sequences alike, their pattern, sequences so far, what is to try)
    while stack and most > least and not spent:
        times, pattern, used, todo = stack[-1]
        step = next(todo, None)
        if next(islice(budget, len(rest) // 8, None), None) is None:
            spent = True
        if step is None:
            stack.pop()
            move(-times, pattern)
            continue
        total = used + step[0]
        move(*step)
        if total + _bound(rest, capacity) >= most:  # the waste so far rules out anything better
            move(-step[0], step[1])
            continue
        finish = best_fit(rest, capacity)
        if (whole := total + sum(n for n, _ in finish)) < most:
            chosen = [*((t, p) for t, p, *_ in stack if t), step]
            best, most = [*((t, tuple(sorted(p.items(), reverse=True))) for t, p in chosen), *finish], whole
        if rest:
            stack.append((*step, total, branches()))
        else:
            move(-step[0], step[1])
    return best, most == least or not spent


def _bound(counts: dict[int, int], capacity: int) -> int:
    """At least so many sequences: by the sum, and by pieces of over half a sequence with what cannot join them."""
    if not counts:
        return 0
    total = sum(k * v for k, v in counts.items())
    least = -(-total // capacity)
    half = capacity // 2
    for cut in {0, *list(sorted(x for x in counts if x <= half))[:32]}:
        big = sum(v for k, v in counts.items() if k > capacity - cut)
        mid = [(k, v) for k, v in counts.items() if capacity - cut >= k > half]
        low = sum(k * v for k, v in counts.items() if half >= k >= max(cut, 1))
        n_mid = sum(v for _, v in mid)
        space = sum((capacity - k) * v for k, v in mid)
        least = max(least, big + n_mid + max(0, -(-(low - space) // capacity)))
    return least


def plan_slots(plan: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Sorted arrays that map (length, rank among its pieces) to a sequence and an offset."""
    keys, first, each, base, start, size = [], [], [], [], [], []
    seen: dict[int, int] = {}
    sequence = 0
    for times, items in plan:
        at = 0
        for length, k in items:
            rank = seen.get(length, 0)
            keys.append((length << 44) | rank)
            first.append(rank)
            each.append(k)
            base.append(sequence)
            start.append(at)
            size.append(length)
            seen[length] = rank + k * times
            at += length * k
        sequence += times
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    columns = {"key": keys, "first": first, "each": each, "base": base, "start": start, "size": size}
    return {n: np.array(v, np.int64)[order] for n, v in columns.items()}


def cut_pieces(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token pieces of every document."""
    small_batches(documents.sparkSession)
    path = path or vocabulary_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shortcut = encoder(path)
        for batch in batches:
            docs = batch.column(0)
            for lo, hi, data, offs in text_slices(text_column(batch), RUN):
                ids, n = shortcut.encode(data, offs)
                bounds = np.concatenate([[0], np.cumsum(n)])
                ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
                bounds += np.arange(len(bounds))
                raw = memoryview(ids.tobytes())
                pieces = -(-np.diff(bounds) // capacity)
                row = np.repeat(np.arange(hi - lo), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(np.diff(bounds)[row] - start, capacity)
                begin = 4 * (bounds[row] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([docs.slice(lo, hi - lo).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY, nodes: int | None = NODES) -> DataFrame:
    """Add sequence_id, offset and proved to pieces (a table that gives the same rows each time it is read).

    proved: whether no plan has fewer sequences, the same for all rows. nodes: the budget of the search; with None it ends with the proof.
    """
    counted = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    plan, proved = solve(counted, capacity, nodes)
    slots = plan_slots(plan, capacity)
    salts = max(64, max(counted.values(), default=0) // SALT_ROWS)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    ranked = ranked.join(begins, ["length", "salt"]).withColumn("rank", F.col("begin") + F.col("rank")).drop("salt", "begin")
    columns = [c for c in pieces.columns]
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + ", sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = np.asarray(batch.column(len(columns)))
            rank = np.asarray(batch.column(len(columns) + 1))
            k = np.searchsorted(slots["key"], (length << 44) | rank, "right") - 1
            within = rank - slots["first"][k]
            each = slots["each"][k]
            sequence = slots["base"][k] + within // each
            offset = slots["start"][k] + within % each * slots["size"][k]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return ranked.select(*columns, F.col("length").alias("length_"), F.col("rank").cast("long")).mapInArrow(lean(place), schema).withColumn("proved", F.lit(proved))


def pack(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY, nodes: int | None = NODES) -> DataFrame:
    """One row per piece of every document with its sequence and place there, and whether the plan is proved to be the shortest; nodes as in place_pieces."""
    return place_pieces(materialize(cut_pieces(documents, path, capacity), "pieces"), capacity, nodes)


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
