import random
import re
import zlib
from collections import Counter

from cadenza.llm import spelling as t

SCHEMA = "doc_id long, text string, word string, n string, id string, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, x, "", "", "", "") for i, x in rows], SCHEMA)


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    """Every pair of words, one by one."""
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if is_near(w, x)] for w in words}
    best = {w: min(xs, key=lambda x: (-words[x], x)) for w, xs in near.items() if xs}
    form = {w: b for w, b in best.items() if words[b] >= 10 * words[w]}
    out = {}
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), words[form[w]] if w in form else None)
    return out


def got(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


def corpus():
    r = random.Random(4)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(6, 11))) for _ in range(30)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(120):
            w = r.choices(base, [40 ** (1 - j / 30) for j in range(30)])[0]
            if r.random() < 0.2:
                at, c = r.randrange(len(w)), r.choice("abÉÀÿ×")
                w = r.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
            words.append(w.upper() if r.random() < 0.05 else w)
        rows.append((i, r.choice([" ", ", ", "·"]).join(words)))
    chain = " ".join(["aaaaaaa"] * 2 + ["aaaaaab"] * 20 + ["aaaaabb"] * 200 + ["aaaabbb"] * 2000 + ["aaaaaac"] * 20)
    return [*rows, (100, chain), (101, chain), (101, chain), (None, "nullnull nullnull nullnul"), (102, None), (103, ""), (104, "1234 é"), (105, "LONGLONG" * 3)]


def test_equals_all_pairs(spark):
    rows = corpus()
    want = plain(rows)
    assert len(want) > 200 and sum(w[0] is not None for w in want.values()) > 20 and any(w[0] != w[1] and w[0] for w in want.values())
    assert got(t.group_variants(table(spark, rows))) == want


def test_hashed_keys_give_the_same(spark):
    rows = corpus()
    assert got(t.group_variants(table(spark, rows), long=8)) == plain(rows)
    assert got(t.group_variants(table(spark, rows), long=0)) == plain(rows)


def test_very_long_words(spark):
    long = "abcdefghij" * 20_000
    rows = [(2, f"{long} {long} {long}x {long}x {long[:-1]} {long[:-1]}"), (3, " ".join([long[:500] + "z" + long[501:]] * 20))]
    found = got(t.group_variants(table(spark, rows)))
    edges = {w: v[3] for w, v in found.items() if v[2] >= 2}
    assert edges[long] == 3 and edges[long + "x"] == 1 and edges[long[:-1]] == 1
    assert found[long][0] == long[:500] + "z" + long[501:]


def test_many_members_of_one_group(spark):
    """A common word with a variant for every letter at every place."""
    word = "abcdefghijkl"
    variants = [word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in "mnopqrstuvwxyzàé"]
    rows = [(i, " ".join([word] * 50 + variants)) for i in range(4)]
    assert got(t.group_variants(table(spark, rows))) == plain(rows)


def test_nothing(spark):
    assert got(t.group_variants(table(spark, []))) == {}
    assert got(t.group_variants(table(spark, [(1, None), (2, "abc"), (3, "abcdefgh")]))) == {}
