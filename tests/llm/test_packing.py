import random
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cadenza.llm import packing as p
from cadenza.llm.token_counts import vocabulary_path

SCHEMA = "doc_id long, text string, piece string, offset string"


def least(lengths, capacity):
    """The optimum by exhaustive search over small instances."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms)}.values():
            if rooms[j] >= lengths[k]:
                place(k + 1, [*rooms[:j], rooms[j] - lengths[k], *rooms[j + 1 :]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_small_instances_are_optimal(lengths):
    plan, proved = p.solve(Counter(lengths), 20, nodes=None)
    assert proved
    packed = Counter()
    for n, items in plan:
        assert sum(x * k for x, k in items) <= 20
        for x, k in items:
            packed[x] += n * k
    assert packed == Counter(lengths) and sum(n for n, _ in plan) == least(lengths, 20)


def test_bin_completion_beats_best_fit_on_triplets():
    r = random.Random(1)
    c = Counter()
    for _ in range(20):
        a = r.randint(26, 48)
        b = r.randint(26, 74 - a)
        c.update([a, b, 100 - a - b])
    assert sum(n for n, _ in p.solve(c, 100, nodes=200_000)[0]) == 20 < sum(n for n, _ in p.best_fit(c, 100))


def test_pieces_and_places(spark):
    r = random.Random(3)
    texts = [None, "", "word", *(" ".join(r.choice(["alpha", "beta", "gam!", "x"]) for _ in range(r.choice([5, 60, 60, 3000, 9000]))) for _ in range(60))]
    rows = [(i, t, "", "") for i, t in enumerate(texts)]
    got = p.pack(spark.createDataFrame([*rows, rows[3]], SCHEMA)).collect()
    tokens = Tokenizer.from_file(vocabulary_path())
    by_doc = {}
    for x in got:
        by_doc.setdefault(x["doc_id"], []).append(x)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 0]
        want = [(k, 2048 * k, len(ids[2048 * k : 2048 * k + 2048]), zlib.crc32(np.array(ids[2048 * k : 2048 * k + 2048], "<u4").tobytes())) for k in range(-(-len(ids) // 2048))]
        assert sorted((x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in by_doc[i]) == sorted(want * (2 if i == 3 else 1))
    used = {}
    for x in got:
        used.setdefault(x["sequence_id"], []).append((x["offset"], x["length"]))
    for spans in used.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 2048
    assert len(used) <= -(-sum(x["length"] for x in got) // 2048) + 1


def test_many_pieces_of_one_length(spark, monkeypatch):
    monkeypatch.setattr(p, "SALT_ROWS", 3)
    got = p.pack(spark.createDataFrame([(i, "same text here", "", "") for i in range(700)], SCHEMA), capacity=16).collect()
    assert len({(x["sequence_id"], x["offset"]) for x in got}) == 700
    assert len({x["sequence_id"] for x in got}) == -(-700 // (16 // got[0]["length"]))


def test_empty_table(spark):
    assert p.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_callers_can_ask_for_a_proof(spark):
    from cadenza.llm import packing

    rows = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate([6, 6, 5, 5, 5, 4, 4, 3, 2])], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.place_pieces(rows, 10, nodes=None).collect()
    assert len({r["sequence_id"] for r in got}) == 4 and all(r["proved"] for r in got)
    assert len(packing.place_pieces(rows, 10, nodes=0).collect()) == 9
