import math
import random
from collections import Counter, defaultdict

import pytest

from cadenza.llm import quality as q

SCHEMA = "doc_id long, text string, lang string, kept string"


def grams(text, k):
    symbols = [0] * (k - 1) + [int(q.CLASS[b]) for b in text.encode()]
    return [tuple(symbols[i : i + k]) for i in range(len(symbols) - k + 1)]


def brute_model(texts):
    """Interpolated modified Kneser-Ney straight from its definition."""
    counts = {q.ORDER: Counter(g for t in texts for g in grams(t, q.ORDER))}
    for k in range(q.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    tables = {}
    for k, c in counts.items():
        n = Counter(v for v in c.values() if v <= 4)
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
        d = [0.0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.1), i - 0.05) if n[i] else 0.5 for i in (1, 2, 3)]
        total, mass = defaultdict(float), defaultdict(float)
        for g, v in c.items():
            total[g[:-1]] += v
            mass[g[:-1]] += d[min(v, 3)]
        tables[k] = (c, d, total, mass)

    def p(g):
        if not g:
            return 1 / q.CLASSES
        c, d, total, mass = tables[len(g)]
        h = g[:-1]
        if h not in total:
            return p(g[1:])
        return max(c[g] - d[min(c[g], 3)], 0) / total[h] + mass[h] / total[h] * p(g[1:])

    return p


def prose(r, n):
    return " ".join(r.choice(["the", "river", "was", "cold", "and", "grey", "été", "stones"]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    good = [(i, prose(r, r.randint(3, 80)), "en") for i in range(60)]
    return [*good, (100, "### $$$ " * 50, "en"), (101, "GREY!! COLD!! " * 20, "fr"), (102, None, "en"), (103, "", None), (104, prose(r, 40), None), (105, "the river", "xx")]


def test_probabilities_equal_brute_force(spark, rows):
    good = [t for _, t, _ in rows[:60]]
    df = spark.createDataFrame([(i, t, l, "") for i, t, l in rows], SCHEMA)
    model = q.model(q.gram_counts(df.where("doc_id < 60")))
    p = brute_model(good)
    for k, table in model.items():
        for r in table.collect():
            g = tuple((r["gram"] >> (q.BITS * (k - 1 - j))) & 255 for j in range(k))
            assert math.isclose(r["p"], p(g), rel_tol=1e-9)
    for head in (0, 7, q.HEAD):  # the joins alone, both, and as little of the joins as there can be
        found = {r["doc_id"]: (r["n_symbols"], r["bits"], r["lang"]) for r in q.perplexity(df, model, "lang", head=head).collect()}
        for i, t, lang in rows:
            bits = -sum(math.log2(max(p(g), 1e-12)) for g in grams(t or "", q.ORDER))
            assert found[i][0] == len((t or "").encode()) and found[i][2] == lang
            assert math.isclose(found[i][1], bits, rel_tol=1e-9, abs_tol=1e-9)


def test_probabilities_add_up(spark, rows):
    p = brute_model([t for _, t, _ in rows[:60]])
    for h in ((), (1,), grams("the", 2)[1], grams("the r", 3)[3], grams("the r", 4)[3], (9, 9, 9)):
        assert math.isclose(sum(p((*h, w)) for w in range(q.CLASSES)), 1, rel_tol=1e-9)


def test_decisions(spark, rows):
    df = spark.createDataFrame([(i, t, l, "") for i, t, l in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(100, 0), (None, 1), (101, None)], "doc_id long, quality int")
    got = {r["doc_id"]: r["kept"] for r in q.classify(df, labels).collect()}
    assert not got[100] and not got[101]
    assert got[102] and got[103] and got[104] and sum(got[i] for i in range(60)) >= 58


def test_without_trusted_text_and_empty_table(spark, rows):
    df = spark.createDataFrame([(i, t, l, "") for i, t, l in rows], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r["kept"] and r["perplexity"] is None for r in q.classify(df, none).collect())
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")  # one trusted document: none can be kept out
    assert {r["doc_id"]: r["kept"] for r in q.classify(df, labels).collect()}[1]
    assert q.classify(spark.createDataFrame([], SCHEMA), labels).collect() == []


def test_repetition_is_rejected_whatever_the_word(spark):
    r = random.Random(7)
    vocabulary = ["".join(r.choice(["ri", "ver", "sto", "ne", "co", "ld", "gre", "y", "wa", "s"]) for _ in range(r.randint(1, 5))) for _ in range(400)]
    good = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(30, 120))), "en", "") for i in range(120)]
    bad = [(1000 + i, " ".join([w] * 200), "en", "") for i, w in enumerate(vocabulary[:100])]
    bad += [(2000, " ".join(" ".join(vocabulary[:7]) for _ in range(60)), "xx", "")]
    got = {x["doc_id"]: x["kept"] for x in q.classify(spark.createDataFrame(good + bad, SCHEMA), spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")).collect()}
    assert not any(got[i] for i, *_ in bad) and sum(got[i] for i in range(120)) >= 116


def test_very_long_text_repeated_rows_and_null_ids(spark, rows):
    r = random.Random(9)
    more = [(None, "the river was cold", "en"), (7, prose(r, 5), "en"), (200, prose(r, 200_000), "en"), (201, "#~" * 600_000, "en")]
    df = spark.createDataFrame([(i, t, l, "x") for i, t, l in [*rows, *more]], SCHEMA)
    got = q.classify(df, spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, quality int")).collect()
    assert len(got) == len(rows) + len(more) and sum(x["doc_id"] == 7 for x in got) == 2 and sum(x["doc_id"] is None for x in got) == 1
    assert {x["doc_id"]: x["kept"] for x in got}[201] is False
