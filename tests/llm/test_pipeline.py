import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cadenza.llm.token_counts import vocabulary_path

WORDS = ["river", "stone", "light", "window", "garden", "morning", "letter", "winter", "silver", "bridge", "market", "paper", "yellow", "forest", "summer", "island"]


def prose(r, n):
    return "".join(r.choice(WORDS) + r.choice(["", "", "s", "ly", "ed"]) + r.choice([" ", " ", " ", "\n", "\n ", "  "]) for _ in range(n)).strip().capitalize() + "."


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(8)
    top = tmp_path_factory.mktemp("sf")
    docs = {i: prose(r, r.randint(60, 200)) for i in range(60)}
    docs[60] = "###$$$ " * 200
    docs[61] = "\n ".join(docs[3].split())
    docs[62] = docs[4] + " silver bridges"
    item = prose(r, 40)
    docs[63] = prose(r, 50) + " " + item + " " + prose(r, 30)
    words = item.split()
    words[5], words[17], words[30] = "silvered", "papers", "islandly"
    docs[64] = prose(r, 50) + " " + " ".join(words)
    docs[65] = None
    docs[66] = prose(r, 3000)
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "q") for i, t in docs.items()]
    spark.createDataFrame([*rows, rows[7]], "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(60, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_stages_drop_what_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, gone = docs.columns, []
    before = {r["doc_id"] for r in docs.collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf_dir)
        assert sorted(out.columns) == sorted(columns)
        out.write.parquet(f"{sf_dir}/stage{i}")
        docs = spark.read.parquet(f"{sf_dir}/stage{i}")
        rows = [r["doc_id"] for r in docs.collect()]
        gone.append(before - set(rows))
        before = set(rows)
    assert gone == [{60}, {61}, {62}, {63, 64}]
    assert len(rows) == len(set(rows))
    packed = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    tokens = Tokenizer.from_file(vocabulary_path())
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for d, t in texts.items():
        pieces = sorted((p for p in packed if p["doc_id"] == d), key=lambda p: p["piece"])
        assert sum(p["length"] for p in pieces) == len(tokens.encode(t, add_special_tokens=False).ids) + 1
    assert all(p["length"] == 2048 for p in packed if p["doc_id"] == 66 and p["piece"] == 0)


def test_rows_that_share_a_doc_id_have_fates_of_their_own(spark, sf_dir):
    once, same = "a text that stands once, and only here", "same text here, twice in all"
    rows = [(1, same, "a"), (7, once, "b"), (7, same, "c"), (8, "another text of some words", "d"), (None, same, "e"), (None, "a text without a number, of its own", "f"), (8, "another text of some words", "g"), (9, None, "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"lang": F.lit("en"), "n_chars": F.length("text").cast("long")})
    out = corpus_pipeline.drop_copies(spark, docs, sf_dir)
    assert out.columns == docs.columns
    kept = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert kept == sorted([(1, same), (7, once), (8, "another text of some words"), (None, "a text without a number, of its own"), (9, None)], key=str)
    near = {r["source"] for r in corpus_pipeline.drop_near_copies(spark, docs, sf_dir).collect()}
    assert {"b", "f", "h"} <= near and len(near & {"a", "c", "e"}) == 1 and len(near & {"d", "g"}) == 1
    assert {r["source"] for r in corpus_pipeline.drop_leaks(spark, docs, sf_dir).collect()} == set("abcdefgh")


def test_labels_meet_their_rows_when_doc_ids_repeat(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert not corpus_pipeline.named(docs)  # one row stands twice
    left = {r["doc_id"] for r in corpus_pipeline.keep_good(spark, docs, sf_dir).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {60}


def test_empty_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).collect() == []
    assert corpus_pipeline.pack(spark, docs, sf_dir).collect() == []


def test_run_equals_the_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    rows = got.collect()
    assert {r["doc_id"] for r in rows} == set(range(67)) - {60, 61, 62, 63, 64}
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        at = np.cumsum([0] + [n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == at[:-1].tolist() and at[-1] <= 2048
