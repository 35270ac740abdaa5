import base64
import gzip
import hashlib
import random
from pathlib import Path

from cadenza.llm import warc

SCHEMA = "page_id long, url string, html string, run string, offset int"


def brute(rows):
    first = {}
    for i, _, t in rows:
        t = (t or "").encode()
        first[t] = min(first.get(t, i), i)
    out = []
    for i, _, t in rows:
        t = (t or "").encode()
        again = i > first[t]
        out.append((i, len(t), base64.b32encode(hashlib.sha1(t).digest()).decode(), "revisit" if again else "response", first[t] if again else None))
    return sorted(out)


def corpus():
    r = random.Random(2)
    texts = [None, "", "\r\n", "\r\n\r\n", "a\r\n", "a\r\n\r\n", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "é" * 70_000, "x\ny", "\r\n\r\n\r\n", "a", "a", "\r", "\n"]
    urls = [None, "", "no scheme", "http://A.example.com/x?y#z", "https://b.a.example.org", "http://x/\r\nEvil: 1", "http://example.com?q=/a"]
    rows = [(i, r.choice(urls), t) for i, t in enumerate(texts * 3)]
    r.shuffle(rows)
    return rows


def test_round_trip_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN", 5)
    monkeypatch.setattr(warc, "RANGE", 12)
    rows = corpus()
    df = spark.createDataFrame([(*r, "q", 1) for r in rows], SCHEMA)
    index = warc.capture_index(df).orderBy("range_id", "position").collect()
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in index)
    assert got == brute(rows)
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in index]
    assert keys == sorted(keys) and len({r["range_id"] for r in index}) > 1


def test_files_are_warc(spark, tmp_path):
    df = spark.createDataFrame([(1, "http://a.b/c", "hi", "", 1), (2, None, "hi", "", 1)], SCHEMA)
    warc.write_archives(df, f"file://{tmp_path}/w")
    text = b"".join(gzip.decompress(p.read_bytes()) for p in Path(tmp_path, "w").glob("part-*"))
    assert text.count(b"WARC/1.1\r\n") == 2 and text.endswith(b"\r\n\r\n") and b"WARC-Refers-To: <urn:page:1>" in text


def test_payloads_below_the_limit_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "hi", "", 1), (2, "u", "hi", "", 1), (None, "u", "hi", "", 1)], SCHEMA)
    assert {r["record_type"] for r in warc.capture_index(df, least=3).collect()} == {"response"}
    assert sorted((r["page_id"] or 0, r["record_type"]) for r in warc.capture_index(df).collect()) == [(0, "response"), (1, "response"), (2, "revisit")]


def test_loser_tree():
    r = random.Random(1)
    for k in range(9):
        runs = [sorted(r.randrange(30) for _ in range(r.randrange(8))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for run in runs for x in run)


def test_empty_table(spark):
    assert warc.capture_index(spark.createDataFrame([], SCHEMA)).collect() == []


def test_offsets_are_places_in_the_files(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://a.b/{i % 3}", f"text {i % 5} é\r\n\r\n", "", 1) for i in range(40)], SCHEMA)
    for r in warc.capture_index(df, folder=f"file://{tmp_path}/w").collect():
        record = gzip.decompress(Path(tmp_path, "w", r["archive"]).read_bytes())[r["offset"] : r["offset"] + r["length"]]
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"<urn:page:{r['page_id']}>".encode() in record


def test_any_page_id_in_any_zone(spark):
    ids = [0, 1, 3, 86_399, 86_400, 300_000_000_000, 2**62, 2**63 - 1, -5, -(2**63)]
    df = spark.createDataFrame([(i, "http://a.b/c", f"{i}", "", 1) for i in ids], SCHEMA)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rows = warc.capture_index(df).orderBy("range_id", "position").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r["page_id"] for r in rows] == sorted(ids)
    by_id = {r["page_id"]: r["captured"] for r in rows}
    assert by_id[3] == "2024-01-01T00:00:03Z" and by_id[86_400] == "2024-01-02T00:00:00Z" and by_id[2**62] == "9999-12-31T23:59:59Z"
    assert [r["captured"] for r in rows] == sorted(r["captured"] for r in rows)


def test_equal_digest_needs_equal_payload(spark):
    rows = spark.createDataFrame([(1, b"a", 3), (2, b"b", 3), (3, b"a", 3), (3, b"a", 3), (None, b"a", 3)], "page_id long, sha256 binary, size long")
    assert [(r["page_id"], r["first"]) for r in warc.revisits(rows).collect()] == [(3, 1)]


def test_more_runs_than_are_merged_at_once(tmp_path, monkeypatch):
    import pyarrow as pa

    r = random.Random(6)
    entry = lambda: {f.name: None for f in warc.ENTRY} | {"url_key": f"k{r.randrange(9)}", "captured": f"t{r.randrange(9)}", "page_id": r.randrange(10**6)}
    runs = warc.RunFiles(str(tmp_path), warc._schema())
    rows = []
    for k in range(150):
        own = sorted((entry() for _ in range(r.randrange(1, 6))), key=warc._order)
        rows += own
        runs.add(pa.RecordBatch.from_pylist(own, warc._schema()), str(k))
    now, most = set(), [0]
    read = warc.RunFiles.read

    def counted(self, path):
        now.add(path)
        most[0] = max(most[0], len(now))
        yield from read(self, path)
        now.discard(path)

    monkeypatch.setattr(warc.RunFiles, "read", counted)
    got = list(runs.merged(fan=4))
    assert [warc._order(e) for e in got] == sorted(map(warc._order, rows)) and len(got) == len(rows)
    assert most[0] <= 4 and len(list(tmp_path.iterdir())) <= 4
