import random

import pytest
from tokenizers import Tokenizer

from cadenza.llm import token_counts as t

SCHEMA = "doc_id long, text string, n_tokens string, n_bytes string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(t.vocabulary_path())


def texts():
    r = random.Random(1)
    odd = [
        None, "", " ", "a<|endoftext|>b C", "x <|ENDOFTEXT|> <|", "İstanbul ΣΑΣ ΌΔΟΣ x́ ﬁ", "it's I'LL don't'S ''s we've'", "ñ\x85b\xa0c\x1cd", "½²ª ºµß ÿÀÞ×÷", "漢字 kana かな 😀", "é e ́ é", "tab\tx\x0bq\x0cz", "soft\xadhy",
        "!!,, ..a1b22", "\x7f a \x00b", "É,É. été.", "<|startoftext|>", "A" * 5000, "12345 67", " wide ", "ſecret ßẞ", "a,b.c, d. e", "﻿bom", "naïve, CAFÉ. Über,",
    ]
    return odd + [" ".join("".join(r.choice("abcdefghiéüñ,.'!0AÉ") for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 200))) for _ in range(40)]


def test_counts_equal_the_library(spark, library):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in t.count_tokens(spark.createDataFrame([(i, x, "", "") for i, x in rows], SCHEMA), limit=100).collect()}
    assert len(got) == len(rows)
    for i, x in rows:
        want = len(library.encode(x or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (want, len((x or "").encode()), want > 100), repr(x)


def test_proof_holds(library):
    s = t.encoder(t.vocabulary_path())
    some = random.Random(2).sample(sorted(s.whole), 500)
    assert all(library.encode(w, add_special_tokens=False).ids == [int.from_bytes(s.whole[w], "little")] for w in some)
    assert len(s.whole) > 20_000


def test_a_full_cache_changes_nothing(library, monkeypatch):
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(t, "CACHE", 10)
    s = t.Shortcut(t.vocabulary_path())
    column = pa.array([x or "" for x in texts()])
    ids = [i for _, _, d, o in t.text_slices(column, 300) for i in s.encode(d, o)[0].tolist()]
    assert ids == [i for x in column.to_pylist() for i in library.encode(x, add_special_tokens=False).ids]
    assert np.array(ids).max() < 49_408


def test_empty_table(spark):
    assert t.count_tokens(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("together", [7, 1 << 15])
def test_plain_pieces_are_merged_together(library, monkeypatch, together):
    import pyarrow as pa

    def alone(piece):
        raise AssertionError(f"{piece} was merged alone")

    monkeypatch.setattr(t, "TOGETHER", together, raising=False)
    s = t.Shortcut(t.vocabulary_path())
    monkeypatch.setattr(s, "_learn", alone)
    r = random.Random(4)
    letters = [chr(b) for b in [*range(0x21, 0x7F), *range(0xA1, 0x100)] if b not in (0x27, 0xAD)]
    words = ["".join(r.choice(letters if r.random() < 0.2 else "thinaeroéÉß") for _ in range(r.randint(1, 30))) for _ in range(2000)]
    column = pa.array([" ".join(words[k : k + 50]).replace("<|", "<") for k in range(0, 2000, 50)] + ["", "aaaaaaaaaaaa ininininin " + "x" * 64])
    for _, _, d, o in t.text_slices(column, 4000):
        ids, n = s.encode(d, o)
        raw = d.tobytes()
        want = [library.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(o[:-1], o[1:], strict=True)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
