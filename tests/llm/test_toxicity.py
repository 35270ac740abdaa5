import random

import numpy as np

from cadenza.llm import toxicity as t

SCHEMA = "doc_id long, text string, toxic string, score string"


def corpus(n, seed=1):
    r = random.Random(seed)
    words = ["plain", "river", "stone", "idea", "market", "letter", "garden", "window"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(words) + r.choice(["", "s", "ly"]) for _ in range(r.randint(5, 60))]
        bad = i % 5 == 0
        if bad:
            w[r.randrange(len(w))] = r.choice(["awful,", "HORRID", "vile."])
        rows.append((i, " ".join(w), "t", "s"))
        labels.append((i, int(bad)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(1500)
    docs = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([x for x in labels if x[0] < 1200], "doc_id long, toxic int")
    weights = t.train(docs, known)
    assert 0 < (weights["at"] > 0).sum() < 200
    got = {r["doc_id"]: r["score"] for r in t.score(docs, weights).collect()}
    right = [(got[i] >= 0.5) == bool(y) for i, y in labels if i >= 1200]
    assert np.mean(right) > 0.98


def test_missing_texts_labels_and_tables(spark):
    rows, labels = corpus(100)
    docs = spark.createDataFrame([*rows, (900, None, "", ""), (901, "", "", ""), (901, "", "", "")], SCHEMA)
    weights = t.train(docs, spark.createDataFrame([*labels, (3, None), (None, 1), (5, 1), (5, 0)], "doc_id long, toxic int"))
    got = t.score(docs, weights).collect()
    assert len(got) == 103 and len({r["score"] for r in got if r["doc_id"] >= 900}) == 1
    none = t.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert len(none) == 0 and {r["score"] for r in t.score(docs, none).collect()} == {0.0}
    assert t.score(spark.createDataFrame([], SCHEMA), weights).collect() == []


def test_training_does_not_depend_on_row_order(spark):
    rows, labels = corpus(300)
    a = t.train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    b = t.train(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), spark.createDataFrame(labels[::-1], "doc_id long, toxic int"))
    assert np.array_equal(a, b)


def test_features_of_a_text():
    data = np.frombuffer(b"A b, c!A b", np.uint8)
    found, row = t.features(data, np.array([0, 7, 10]))
    assert np.bincount(row).tolist() == [3 + 2 + 1, 2 + 1]
    assert len(set(found[row == 1]) & set(found[row == 0])) == 3


def test_case_is_folded_beyond_ascii(spark):
    rows, labels = corpus(300)
    rows = [(i, x.replace("awful", "écœurant").replace("HORRID", "hässlich"), a, b) for i, x, a, b in rows]
    weights = t.train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int"))
    new = [(1, "plain river écœurant hässlich stone"), (2, "plain river ÉCŒURANT HÄSSLICH stone")]
    got = {r["doc_id"]: r["score"] for r in t.score(spark.createDataFrame([(i, x, "", "") for i, x in new], SCHEMA), weights).collect()}
    assert got[1] == got[2] > 0.5


def test_weights_equal_plain_loops():
    """FTRL-proximal by dictionaries, one coordinate at a time."""
    r = random.Random(5)
    rows = [(r.randrange(2), np.array([0, *sorted(r.sample(range(1, 40), r.randint(1, 12)))])) for _ in range(200)]
    z, n = {}, {}

    def weight(i):
        if i and abs(z.get(i, 0.0)) <= t.L1:
            return 0.0
        signed = (1 if z.get(i, 0.0) > 0 else -1) * t.L1 if i else 0.0
        return (signed - z.get(i, 0.0)) / ((t.BETA + n.get(i, 0.0) ** 0.5) / t.ALPHA + t.L2)

    for _ in range(t.PASSES):
        for y, at in rows:
            w = {i: weight(i) for i in at.tolist()}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in w:
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / t.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    got = t.learned(rows).weights(np.arange(40))
    assert np.allclose(got, [weight(i) for i in range(40)]) and (got != 0).sum() > 3 and (got == 0).sum() > 3


def test_curve_undoes_a_slope_and_a_shift():
    r = np.random.default_rng(1)
    true = r.normal(size=20_000) * 3
    y = (r.random(20_000) < 1 / (1 + np.exp(-true))).astype(float)
    slope, shift = t.curve((true + 2) / 4, y, miss=1.0)
    assert abs(slope - 4) < 0.2 and abs(shift + 2) < 0.1
    assert t.curve(true[:5], y[:5]) == (1.0, 0.0)


def test_features_are_bounded(spark):
    rows, labels = corpus(300)
    docs, known = spark.createDataFrame([*rows, (5000, "horrid word " * 20_000, "", "")], SCHEMA), spark.createDataFrame([*labels, (5000, 1)], "doc_id long, toxic int")
    few = t.train(docs, known, features_in_all=2_000)
    assert 0 < len(few) and len(t.train(docs, known, features_in_all=1)) > 0
    assert not np.array_equal(few, t.train(docs, known))


def test_held_out_recall(spark):
    d = "/root/testdata/sf0.1"
    got = t.op7_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").toPandas()
    bad, good = got[got.toxic == 1], got[got.toxic == 0]
    assert len(bad) > 90 and bad.predicted.mean() >= 0.9 and good.predicted.mean() <= 0.01
