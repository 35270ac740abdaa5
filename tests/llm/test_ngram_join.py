import random
import re
import string

import pytest

from cadenza.llm.ngram_join import near_duplicates, similar_pairs

SCHEMA = "doc_id long, text string, lang string, token long"


def sets_of(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(rows, k, num, den):
    sets = {i: sets_of(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = set()
    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if den * common >= num * (len(sets[i]) + len(sets[j]) - common):
                    links.add((i, j))
                    a, b = sorted((find(i), find(j)))
                    parent[b] = a
    return {(i, len(sets[i]), find(i)) for i in ids}, links, sets


def corpus(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice(string.ascii_lowercase) for _ in range(4)) for _ in range(300)]
    passage = [r.choice(vocab) for _ in range(30)]
    texts = [None, "", " \t\n", "One", "one", "one two", "One Two ", "a b c", "ÉA éa", "éA Éa"]
    base = [r.choice(vocab) for _ in range(60)]
    for _ in range(60):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = r.choice(vocab)
        texts.append(" ".join(w))
    for _ in range(40):
        w = [r.choice(vocab) for _ in range(r.randint(3, 40))]
        texts.append(" ".join(w + passage))
        for _ in range(r.randint(0, 3)):
            v = list(w + passage)
            for _ in range(r.randint(0, 3)):
                v[r.randrange(len(v))] = r.choice(vocab)
            texts.append("\n".join(v).upper() if r.random() < 0.3 else "  ".join(v))
    texts.append("lorem " * 5000)
    r.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("seed,k,num,den", [(1, 3, 90, 100), (2, 5, 80, 100)])
def test_components_equal_brute_force(spark, seed, k, num, den):
    rows = corpus(seed)
    want, _, _ = brute(rows, k, num, den)
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], SCHEMA)
    got = {tuple(r) for r in near_duplicates(df, k, num, den).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == want


def test_pairs_equal_brute_force(spark):
    rows = corpus(3)
    _, links, sets = brute(rows, 3, 90, 100)
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in rows], SCHEMA)
    pairs, members = similar_pairs(df, 3, 90, 100)
    node = {r["doc_id"]: r["node"] for r in members.collect()}
    want = {tuple(sorted((node[i], node[j]))) for i, j in links if node[i] != node[j]}
    assert {tuple(r) for r in pairs.collect()} == want
    for i, n in node.items():
        assert sets[i] == sets[n]


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == []
    twice = spark.createDataFrame([(7, "a b c d e f", "x", 0), (7, "a b c d e f", "x", 0), (5, "A b c d e f", "x", 0)], SCHEMA)
    assert sorted(tuple(r) for r in near_duplicates(twice).collect()) == [(5, 2, 5), (7, 2, 5), (7, 2, 5)]


def test_counting_in_two_levels_counts_the_same(spark):
    from collections import Counter

    import numpy as np

    from cadenza.llm import ngram_join, runs

    r = np.random.default_rng(4)
    rows = [(i, r.integers(0, 1 << 40, 30).tolist() + (r.integers(0, 50, 20) << 34).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, v array<long>").repartition(5)
    own = lambda batch: (np.unique(np.array(v, np.uint64)) for v in batch.column(0).to_pylist())
    want = {v: n for v, n in Counter(v for _, vs in rows for v in set(vs)).items() if n >= 2}
    assert len(want) == 50
    for parts, fan in ((64, 4096), (64, 8), (1024, 4), (1, 1)):
        got = ngram_join._recurring(df.select("v"), own, (parts, 40), 2, fan).collect()
        assert {g["value"]: g["n"] for g in got} == want and len(got) == 50
    assert [runs.parts_of(x) for x in (0, runs.RUN_VALUES * 64, runs.RUN_VALUES * 1e6)] == [64, 128, 1 << 20]


def test_rows_without_a_doc_id(spark):
    from cadenza.llm import ngram_join

    rows = [(None, "a b c d e"), (5, "a b c d e"), (None, "x y z w v"), (None, "x y z w v"), (7, None), (None, None)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == sorted([(5, 3, 5), (None, 3, 5), (None, 3, None), (None, 3, None), (7, 0, 7), (None, 0, None)], key=str)
