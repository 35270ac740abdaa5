import random

import numpy as np

from cadenza.llm import decontaminate as d
from cadenza.llm.words import folded

DOCS = "doc_id long, text string, item_id string, score string"
ITEMS = "item_id long, text string, doc_id string"


def brute_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (d.MATCH if x == y else d.MISMATCH), h[i - 1, j] + d.GAP, h[i, j - 1] + d.GAP)
    return int(h.max())


def test_alignment_equals_brute_force():
    r = random.Random(1)
    for _ in range(300):
        a = np.array([r.randrange(4) for _ in range(r.randint(1, 12))], np.uint64)
        b = np.array([r.randrange(4) for _ in range(r.randint(0, 15))], np.uint64)
        score, first, end = d.align(a, b)
        assert score == brute_align(a, b)
        if score:
            assert brute_align(a, b[first:end]) == score


def words(r, n):
    return ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_copies_edited_copies_and_clean_documents(spark):
    r = random.Random(2)
    items = [words(r, 40) for _ in range(5)]
    rows, want = [], set()
    for i in range(60):
        text = words(r, r.randint(0, 100))
        k = i % 6
        if k < 5:
            own = list(items[k])
            for _ in range([0, 3, 6, 8, 4][k]):
                own[r.randrange(40)] = words(r, 1)[0]
            if k == 4:
                del own[10:14]
                own[20:20] = words(r, 3)
            at = r.randint(0, len(text))
            text[at:at] = own
            want.add((i, k))
        rows.append((i, r.choice([" ", "\n", ", "]).join(text).title() if i % 2 else " ".join(text), "", ""))
    rows += [(100, None, "", ""), (101, "", "", ""), (102, " ".join(items[0] * 3 + items[1]), "", "")]
    want |= {(102, 0), (102, 1)}
    bench = [(k, " ".join(w), "") for k, w in enumerate(items)] + [(9, None, ""), (10, "", ""), (11, "two words", "")]
    got = d.passages(spark.createDataFrame(rows, DOCS), spark.createDataFrame(bench, ITEMS)).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want
    full = next(x for x in got if x["doc_id"] == 0)
    assert full["score"] == 1.0 and full["end_word"] - full["first_word"] == 40 and full["passage"].split() == items[0]


def test_joined_words_give_the_same(spark, monkeypatch):
    r = random.Random(3)
    items = [words(r, 20) for _ in range(6)]
    docs = spark.createDataFrame([(i, " ".join(words(r, 10) + items[i % 6]), "", "") for i in range(12)], DOCS)
    bench = spark.createDataFrame([(k, " ".join(w), "") for k, w in enumerate(items)], ITEMS)
    one = {(x["doc_id"], x["item_id"], x["score"]) for x in d.passages(docs, bench).collect()}
    monkeypatch.setattr(d, "WORDS", 30)
    monkeypatch.setattr(d, "BROADCAST_IDS", 1)
    monkeypatch.setattr(d, "PLACES", 1)
    assert {(x["doc_id"], x["item_id"], x["score"]) for x in d.passages(docs, bench).collect()} == one and len(one) == 12


def test_short_items_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Two, words", "", ""), (2, "two words more", "", "")], DOCS)
    got = d.passages(docs, spark.createDataFrame([(7, "two words", "")], ITEMS)).collect()
    assert sorted((x["doc_id"], x["item_id"], x["score"], x["first_word"]) for x in got) == [(1, 7, 1.0, 0), (2, 7, 1.0, 0)]
    assert d.contaminated(docs, spark.createDataFrame([(7, "two words", "")], ITEMS)).collect() == []
    assert d.passages(docs, spark.createDataFrame([], ITEMS)).collect() == []
    assert d.passages(spark.createDataFrame([], DOCS), spark.createDataFrame([(7, "two words", "")], ITEMS)).collect() == []


def test_edited_copies_whose_seeds_are_absent_or_frequent(spark):
    r = random.Random(4)
    items = [words(r, 40) for _ in range(2)]
    edited = [[words(r, 1)[0] if j % 5 == 2 else w for j, w in enumerate(item)] for item in items]
    rows = [(0, " ".join(edited[0])), (1, " ".join(words(r, 20) + edited[1] + words(r, 20)))]
    rows += [(10 + i, " ".join(words(r, 5) + items[1][3:7] + items[1][8:12] + words(r, 5))) for i in range(30)]  # its seeds are frequent
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS)
    got = d.passages(docs, spark.createDataFrame([(k, " ".join(w), "") for k, w in enumerate(items)], ITEMS)).collect()
    assert {(x["doc_id"], x["item_id"], x["score"]) for x in got} == {(0, 0, 0.7), (1, 1, 0.7)}


def test_common_words_bound_the_alignment():
    r = random.Random(5)
    for _ in range(300):
        a = np.array([r.randrange(6) for _ in range(r.randint(1, 12))], np.uint64)
        b = np.array([r.randrange(6) for _ in range(r.randint(1, 15))], np.uint64)
        assert d.align(a, b)[0] <= d.MATCH * d._common(a, b)


def test_case_is_folded_beyond_ascii(spark):
    item = "Él número señaló después Größe daß être Œuvre ΣΊΣΥΦΟΣ Жизнь número años"
    rows = [(0, item.upper()), (1, "antes: " + item.lower() + " luego"), (2, item.title()), (3, "ÉL NÚMERO")]
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS)
    got = {x["doc_id"]: x for x in d.passages(docs, spark.createDataFrame([(7, item, "")], ITEMS)).collect()}
    assert {i: x["score"] for i, x in got.items()} == {0: 1.0, 1: 1.0, 2: 1.0}
    assert got[0]["passage"] == item.upper() and got[1]["passage"] == item.lower()


def test_folding_keeps_word_bounds():
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        assert all(x == c or x.isalnum() or ord(x) > 127 for x in folded(c.encode()).decode())


def test_passages_equal_alignment_of_everything(spark):
    """Every pair of document and item by plain alignment of the whole texts: what seeds find is all that scores enough and kept a seed."""
    r = random.Random(6)
    items = [words(r, r.randint(8, 40)) for _ in range(8)]
    rows = []
    for i in range(80):
        own = list(items[r.randrange(8)])
        for _ in range(r.randint(0, len(own))):
            own[r.randrange(len(own))] = r.choice(words(r, 1) + own)
        if r.random() < 0.3:
            own[5:5] = words(r, r.randint(1, 4))
        text = words(r, 15) + own + words(r, 15)
        rows.append((i, " ".join(text if r.random() < 0.8 else text[:20])))
    want, reached = {}, 0
    for i, t in rows:
        own = t.split()
        for k, item in enumerate(items):
            score = brute_align(item, own) / (d.MATCH * len(item))
            if score >= d.THRESHOLD:
                reached += 1
                if any(item[a : a + d.SEED] == own[b : b + d.SEED] for a in range(len(item)) for b in range(len(own))):
                    want[i, k] = score
    docs = spark.createDataFrame([(i, t, "", "") for i, t in rows], DOCS)
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in d.passages(docs, spark.createDataFrame([(k, " ".join(w), "") for k, w in enumerate(items)], ITEMS)).collect()}
    assert got == want and len(want) >= 0.9 * reached


def test_a_long_verbatim_passage_of_a_longer_item(spark):
    r = random.Random(7)
    item = words(r, 300)
    rows = [(1, " ".join(words(r, 30) + item[100:160] + words(r, 30)), "", ""), (2, " ".join(words(r, 30) + item[100:140]), "", ""), (None, " ".join(item), "", ""), (3, " ".join(words(r, 60_000) + item[:200]), "", "")]
    got = {x["doc_id"]: x for x in d.passages(spark.createDataFrame(rows, DOCS), spark.createDataFrame([(5, " ".join(item), ""), (5, " ".join(item), "")], ITEMS)).collect()}
    assert set(got) == {1, None, 3} and got[1]["score"] == 0.2 and got[3]["first_word"] == 60_000
