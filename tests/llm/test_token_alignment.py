import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cadenza.llm import token_alignment as t

SCHEMA = "doc_id long, text string, n_a string, links string"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public.path(t.A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public.path(t.B))


def texts():
    r = random.Random(1)
    odd = [
        None, "", " ", "  ", "\n", "a", " a", "a ", "  a  b ", "a\n b \nc", "a   b  c  d", "x  y 　z", "it's I'LL don't'S ''s", "<|endoftext|> a<|endoftext|>b", "<s> </s> <unk> <0x41>",
        "a▁b ▁", "漢字 kana かな 😀 é", "ñ\x85b\xa0c\x1cd \x1f e", "​ a​ b", "A" * 3000, "a" * 90 + " " + "b" * 90, "12345 67 8,9", "tab\tx \ty\t z", "\u0000 b", "naïve, CAFÉ.  Über,   x", "İ ﬁ ſ", "#### $$$ !!!",
    ]
    made = [" ".join("".join(r.choice("abcdeéü,.'!0A\n ") for _ in range(r.randint(1, 9))) for _ in range(r.randint(1, 150))) for _ in range(60)]
    return odd + made + made[:5]


def whole(libraries, text):
    """(A, B, bytes of A's tokens, bytes of B's tokens) of one text, encoded whole."""
    a, b = libraries
    byte = {c: x for c, x in t._byte_letters().items()}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", b.id_to_piece(i)) else b.id_to_piece(i).replace("▁", " ").encode()
    return ids_a, ids_b, [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a], [piece(i) for i in ids_b]


def plain(libraries, rows):
    out, links = [], []
    for text in rows:
        ids_a, ids_b, x, y = whole(libraries, text) if text else ([], [], [], [])
        if not text or b"".join(x) != (" " + text).encode() or b"".join(y) != (" " + text).encode():
            out.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        ends_a, ends_b = np.cumsum([len(z) for z in x]).tolist(), np.cumsum([len(z) for z in y]).tolist()
        groups, i, j = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
            i, j = k, m
        own = [(p, q) for p, f in zip(ids_a, ends_a, strict=True) for q, g in zip(ids_b, ends_b, strict=True) if f == g]
        out.append((len(ids_a), len(ids_b), len(groups), len(own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(own)
    counts = Counter(pair for own in links for pair in own)
    highest = defaultdict(int)
    for (_, q), n in counts.items():
        highest[q] = max(highest[q], n)
    return [(*o, sum(counts[pair] == highest[pair[1]] for pair in own), sum(counts[pair] for pair in own)) for o, own in zip(out, links, strict=True)]


def got(df):
    rows = df.orderBy("doc_id").collect()
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")) for r in rows]


def test_equals_whole_texts(spark, libraries, monkeypatch):
    rows = texts()
    want = plain(libraries, rows)
    assert sum(w[0] == 0 for w in want) >= 3 and sum(w[5] < w[3] for w in want) > 10
    documents = spark.createDataFrame([(i, x, "", "") for i, x in enumerate(rows)], SCHEMA)
    assert got(t.cross_align(documents)) == want


def test_small_shards_and_look_ups(spark, libraries, monkeypatch):
    rows = texts()[:60]
    documents = spark.createDataFrame([(i, x, "", "") for i, x in enumerate(rows)], SCHEMA).repartition(7)
    aligned = t.materialize(t.align(documents, public.path(t.A), public.path(t.B)), "aligned")
    counts = t.link_counts(aligned)
    folder = t.shard_folder(spark)
    found = t.write_shards(counts, folder, shard=50)
    want = {r["link"]: r["n"] for r in counts.groupBy("link").agg(F.sum("n").alias("n")).collect()}
    shards = sorted({(r["name"], r["first"], r["last"]) for r in found.to_pylist()}, key=lambda s: s[1])
    assert len(shards) > 4 and all(x[2] < y[1] for x, y in zip(shards, shards[1:]))
    store, path = t._store(folder)
    halves = [np.split(np.fromfile(f"{path}/{s[0]}", np.int64), 2) for s in shards]
    assert dict(zip(np.concatenate([h[0] for h in halves]).tolist(), np.concatenate([h[1] for h in halves]).tolist(), strict=True)) == want
    highest = np.zeros(32_000, np.int64)
    for link, n in want.items():
        highest[link >> 32] = max(highest[link >> 32], n)
    assert got(t.look_up(aligned, folder, shards, highest)) == plain(libraries, rows)


def test_cut_only_where_both_encoders_cut(libraries):
    slow = re.compile(r"(?<=\S)(?= \S)")
    for text in texts():
        if text:
            chunks = t._CHUNK.findall(" " + text)
            assert chunks == slow.split(" " + text), repr(text)
            if "▁" not in text:
                parts = [whole(libraries, c[1:]) if c[1:] else (libraries[0].encode(c, add_special_tokens=False).ids, []) for c in chunks]
                ids_a, ids_b, *_ = whole(libraries, text)
                assert [i for p in parts for i in p[0]] == ids_a and [i for p in parts for i in p[1]] == ids_b, repr(text)


def test_a_full_cache_changes_nothing(libraries, monkeypatch):
    own = t.Aligner(public.path(t.A), public.path(t.B))
    rows = [x or "" for x in texts()]
    want = [x[:4] for x in own.align(rows)]
    monkeypatch.setattr(t, "CACHE", 5)
    monkeypatch.setattr(t, "KEPT", 4)
    small = t.Aligner(public.path(t.A), public.path(t.B))
    assert [x[:4] for text in rows for x in small.align([text])] == want


def test_nothing(spark):
    assert got(t.cross_align(spark.createDataFrame([], SCHEMA))) == []
    assert got(t.cross_align(spark.createDataFrame([(None, None, "", ""), (1, "", "", "")], SCHEMA))) == [(0, 0, 0, 0, "", 0, 0)] * 2
