import hashlib
import random
import re
from collections import defaultdict

from cadenza.llm import exact_dedup as e

SCHEMA = "doc_id long, text string, keep_id string, chunks string"


def brute(rows):
    norm = {}
    groups = defaultdict(list)
    for i, t in rows:
        norm[i] = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        groups[norm[i]].append(i)
    return sorted((i, min(groups[norm[i]]), len(groups[norm[i]]), i == min(groups[norm[i]]), hashlib.sha256(norm[i].encode()).hexdigest()) for i, _ in rows)


def corpus():
    r = random.Random(4)
    texts = [None, "", " ", "\n\t ", "a b", " a b", "a  b", "a b ", "a\x0bb", "a b", "é" * 3000, "x" * 200_000, "x" * 200_001]
    for _ in range(20):
        t = " ".join(r.choice(["alpha", "beta", "gamma", "délta"]) for _ in range(r.randint(1, 4000)))
        texts += [t, t.replace(" ", "\n", 5), t + "!", t[:-1]]
    return list(enumerate(texts, 3))


def test_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "k", "c") for i, t in rows], SCHEMA)
    assert sorted(tuple(r) for r in e.deduplicate(df).collect()) == brute(rows)


def test_clashing_identifiers_are_told_apart(spark, monkeypatch):
    cooked = spark.createDataFrame(
        [(1, "s", [(5, b"a", 1), (6, b"x", 1)]), (2, "s", [(5, b"b", 1), (6, b"x", 1)]), (3, "s", [(5, b"a", 1), (6, b"x", 1)])],
        "doc_id long, text_sha256 string, chunks array<struct<id:long,rest:binary,size:long>>",
    )
    got = {r["doc_id"]: tuple(r["recipe"]) for r in e.verified(cooked).collect()}
    assert got[1] == got[3] != got[2]


def test_chunks_follow_content_and_have_bounds():
    r = random.Random(1)
    body = bytes(r.randrange(256) for _ in range(300_000))
    a, b = e.cuts(body), e.cuts(b"12345" + body)
    assert a[-1] == len(body) and all(x < y for x, y in zip(a, a[1:]))
    assert len(set(a) & {x - 5 for x in b}) > 0.9 * len(a)
    assert max(y - x for x, y in zip([0, *e.cuts(b"z" * 500_000)], e.cuts(b"z" * 500_000))) <= e.MOST
    assert e.cuts(b"") == [0]


def test_empty_table_and_repeated_rows(spark):
    assert e.deduplicate(spark.createDataFrame([], SCHEMA)).collect() == []
    got = e.deduplicate(spark.createDataFrame([(2, "q", "", ""), (2, "q", "", ""), (4, "q", "", "")], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got) == [(2, 2, 3, True), (2, 2, 3, True), (4, 2, 3, False)]


def test_null_ids_empty_table_and_a_large_group(spark):
    rows = [(None, "a b", 0), (3, "a  b", 0), (2, "a b", 0), (None, "z", 0), (None, "z", 0), *((100 + i, "same text", 0) for i in range(300))]
    got = e.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, kept int")).collect()
    assert sorted(((r["doc_id"] or 0, r["keep_id"], r["group_size"], r["kept"]) for r in got if r["keep_id"] == 2), key=str) == [(0, 2, 3, False), (2, 2, 3, True), (3, 2, 3, False)]
    assert [(r["kept"], r["group_size"]) for r in got if r["keep_id"] is None] == [(True, 2)] * 2
    assert sum(r["kept"] for r in got if r["keep_id"] == 100) == 1 and len(got) == len(rows) and all(r["kept"] is not None for r in got)
    assert e.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []
