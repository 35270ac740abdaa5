"""WARC archives and their capture index by an external merge.

Writing: every page becomes a response record, or a revisit of the record with the smallest page_id among those of equal
payload (equal SHA-256 and size). Only digests and ids are grouped; payloads stay where they are read unless the list of revisits is long.
Records are lines of Spark's text writer whose line separator is the blank line that ends a WARC record,
so any store that Spark writes to works and lost tasks are redone by its commit protocol. Each file is one gzip stream, which Spark
does not split, so that a file's segments come in order; a record's offset and length in the index are places in the inflated stream.

Reading: the same separator feeds segments in order to a parser that follows Content-Length, one record at a time.
Every task sorts its index entries in runs of RUN rows. Runs are dealt to ranges of (url key, timestamp, page_id); in
each range they are laid out as sorted files of the task, and a loser tree merges them batch by batch, holding one batch of each.
The ranges read in turn are the globally ordered capture histories.

Null payloads are empty. A null or empty url gives an empty url key. Pages have no capture time of their own: it is FIRST plus
page_id seconds in UTC whatever the session's zone, no earlier than FIRST and no later than the year 9999; entries of one time are in
the order of page_id. A null page_id gives a response record and comes first. Repeated rows are written each; rows of the smallest page_id
of a payload are all responses. Payloads of any length are held one record at a time. Empty tables give no rows. Columns besides page_id,
url and html are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from datetime import date
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm.shared import BROADCAST_IDS, lean, materialize, shared_dir, small_batches

END = "\r\n\r\n"
FIRST = "2024-01-01"
#: Seconds from FIRST to the end of the year 9999, the last that a WARC date can name.
LAST = (date.max - date.fromisoformat(FIRST)).days * 86_400 + 86_399
#: Entries of a sorted run, of a range of the index, of a batch of a run while it is merged, and records of an archive file.
RUN, RANGE, BATCH, FILE = 50_000, 100_000, 2_000, 20_000
#: Runs that are merged at once, each an open file.
FAN = 256
ENTRY = T.StructType(
    [
        T.StructField("url_key", T.StringType()),
        T.StructField("captured", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("archive", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("run", T.StringType()),
    ]
)


def base32_of_hex(h: F.Column) -> F.Column:
    """The bare upper-case base32 of 20 bytes given in hex: five bytes are eight digits of base 32."""
    parts = [F.lpad(F.conv(F.substring(h, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def captured(page_id: F.Column) -> F.Column:
    """The capture time in UTC, by calendar arithmetic that no session zone enters."""
    at = F.least(F.greatest(F.coalesce(page_id, F.lit(0).cast("long")), F.lit(0).cast("long")), F.lit(LAST))
    day = F.date_add(F.lit(FIRST).cast("date"), F.floor(at / 86400).cast("int")).cast("string")
    part = lambda unit, n: F.lpad(F.pmod(F.floor(at / unit), F.lit(n)).cast("string"), 2, "0")
    return F.concat(day, F.lit("T"), part(3600, 24), F.lit(":"), part(60, 60), F.lit(":"), part(1, 60), F.lit("Z"))


def revisits(rows: DataFrame, least: int = 0) -> DataFrame:
    """page_id, sha256, first: the pages whose payload the page `first` has too; rows: page_id, sha256, size."""
    known = materialize(rows.where(F.col("page_id").isNotNull() & (F.col("size") >= least)).select("page_id", "sha256", "size"), "payloads")
    first = known.groupBy("sha256", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").drop("last")
    first = materialize(first, "payload-groups")
    few = first.limit(BROADCAST_IDS // 8 + 1).count() <= BROADCAST_IDS // 8
    again = known.join(F.broadcast(first) if few else first, ["sha256", "size"]).where("page_id > first")
    return materialize(again.select("page_id", "sha256", "first").distinct(), "revisits")


def records(pages: DataFrame, least: int = 0) -> DataFrame:
    """One column `value`: the WARC record of each page without its closing blank line."""
    text = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"), text.alias("payload"))
    digest = F.unhex(F.sha2(F.encode("payload", "utf-8"), 256))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha256": digest})
    again = revisits(rows, least)
    few = again.limit(BROADCAST_IDS // 4 + 1).count() <= BROADCAST_IDS // 4
    rows = rows.join(F.broadcast(again) if few else again, ["page_id", "sha256"], "left").withColumn("sha1", F.sha1(F.encode("payload", "utf-8")))
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    header = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name("page_id")),
        F.concat(F.lit("WARC-Date: "), captured(F.col("page_id"))),
        F.when(F.col("url") != "", F.concat(F.lit("WARC-Target-URI: "), F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name("first"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    )
    return rows.select(F.concat(header, F.lit(END), block).alias("value"))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Write the WARC files of all pages to a folder, at most FILE records each."""
    records(pages, least).write.options(lineSep=END, compression="gzip", maxRecordsPerFile=FILE).text(path)


def url_key(url: str) -> str:
    """The sort-friendly form of a url: host labels reversed, then the rest."""
    _, sep, rest = url.partition("://")
    if not sep:
        return url
    n = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    return ",".join(reversed(rest[:n].lower().split("."))) + ")" + rest[n:]


class RecordParser:
    """Cuts a stream of segments, each ended by a blank line, into records; holds one record at a time."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.at = 0
        self.need = 0
        self.header: dict[str, str] = {}

    def feed(self, segment: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
        """(offset, length, header fields, block) of every record that the segment completes."""
        self.held += segment
        self.held += b"\r\n\r\n"
        while True:
            if not self.need:
                end = self.held.find(b"\r\n\r\n")
                if end < 0:
                    return
                lines = self.held[:end].decode("utf-8").split("\r\n")
                if not lines[0].startswith("WARC/"):
                    raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
                self.header = dict(line.split(": ", 1) for line in lines[1:])
                self.start = end + 4
                self.need = self.start + int(self.header["Content-Length"]) + 4
            if len(self.held) < self.need:
                return
            yield self.at, self.need, self.header, bytes(self.held[self.start : self.need - 4])
            del self.held[: self.need]
            self.at += self.need
            self.need = 0


def _entry(archive: str, offset: int, length: int, header: dict[str, str], block: bytes) -> dict:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2].split(b"\r\n")[0])
    digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = header["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record at {archive}:{offset}")
    number = lambda s: int(n) if (n := s[len("<urn:page:") : -1]) else None
    url = header.get("WARC-Target-URI", "")
    return {
        "url_key": url_key(url), "captured": header["WARC-Date"], "page_id": number(header["WARC-Record-ID"]), "record_type": kind,
        "refers_to": number(header["WARC-Refers-To"]) if kind == "revisit" else None, "payload_bytes": size, "payload_digest": digest,
        "url": url, "archive": archive, "offset": offset, "length": length,
    }


def _order(e: dict) -> tuple:
    return e["url_key"], e["captured"], -1 if e["page_id"] is None else e["page_id"]


def _schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(ENTRY)


def read_runs(spark, path: str) -> DataFrame:
    """Index entries of all archives of a folder, as locally sorted runs."""
    small_batches(spark)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, run, parser, archive = _schema(), [], RecordParser(), None

        def flush() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            out = pa.RecordBatch.from_pylist([e | {"run": name} for e in sorted(run, key=_order)], schema)
            run.clear()
            return out

        for batch in batches:
            for segment, name in zip(batch.column(0), batch.column(1), strict=True):
                if archive != (name := name.as_py()):
                    archive, parser = name, RecordParser()
                for found in parser.feed(segment.as_buffer().to_pybytes() if segment.as_buffer() else b""):
                    run.append(_entry(archive, *found))
                    if len(run) >= RUN:
                        yield flush()
        if run:
            yield flush()

    lines = spark.read.text(path, lineSep=END).select(F.coalesce("value", F.lit("")).alias("value"), F.element_at(F.split("_metadata.file_path", "/"), -1).alias("archive"))
    return lines.mapInArrow(lean(parse), ENTRY)


class LoserTree:
    """k-way merge: inner nodes hold the losers of their matches, so each output replays one path of log k matches."""

    def __init__(self, runs: list, key) -> None:
        self.runs, self.key, self.k = [iter(r) for r in runs], key, len(runs)
        self.head = [None] * self.k
        self.rank: list[tuple | None] = [None] * self.k
        for i in range(self.k):
            self._next(i)
        self.loser = [-1] * max(self.k, 1)
        self.winner = self._play(1) if self.k > 1 else 0

    def _next(self, i: int) -> None:
        self.head[i] = next(self.runs[i], None)
        self.rank[i] = None if self.head[i] is None else (self.key(self.head[i]), i)

    def _beats(self, a: int, b: int) -> bool:
        return self.rank[b] is None or (self.rank[a] is not None and self.rank[a] < self.rank[b])

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, self.loser[node] = (a, b) if self._beats(a, b) else (b, a)
        return win

    def __iter__(self) -> Iterator:
        while self.k and self.rank[self.winner] is not None:
            i = self.winner
            yield self.head[i]
            self._next(i)
            node = (i + self.k) // 2
            while node:
                if self._beats(self.loser[node], i):
                    i, self.loser[node] = self.loser[node], i
                node //= 2
            self.winner = i


class RunFiles:
    """Sorted runs as files of the task's own folder, written one after the other and read back a batch at a time."""

    def __init__(self, folder: str, schema: pa.Schema) -> None:
        self.folder, self.schema, self.paths, self.now, self.out = folder, schema, [], None, None

    def add(self, batch: pa.RecordBatch, run: str) -> None:
        """The next rows of a run; all rows of a run come one after the other."""
        if run != self.now:
            self.close()
            self.now = run
            self.paths.append(os.path.join(self.folder, str(len(self.paths))))
            self.out = pa.ipc.new_stream(self.paths[-1], self.schema)
        for lo in range(0, batch.num_rows, BATCH):
            self.out.write_batch(batch.slice(lo, BATCH))

    def close(self) -> None:
        if self.out is not None:
            self.out.close()

    def read(self, path: str) -> Iterator[dict]:
        with pa.OSFile(path) as f:
            for batch in pa.ipc.open_stream(f):
                yield from batch.to_pylist()

    def merged(self, fan: int = FAN) -> Iterator[dict]:
        """All rows in order. While there are more than `fan` runs, the first `fan` are merged to a run of their own, which takes the last place; no more are open at once."""
        self.close()
        while len(self.paths) > fan:
            few, self.paths = self.paths[:fan], self.paths[fan:]
            self.paths.append(f"{few[0]}+")
            with pa.ipc.new_stream(self.paths[-1], self.schema) as out:
                rows = iter(LoserTree([self.read(p) for p in few], _order))
                while part := list(islice(rows, BATCH)):
                    out.write_batch(pa.RecordBatch.from_pylist(part, self.schema))
            for p in few:
                os.remove(p)
        yield from LoserTree([self.read(p) for p in self.paths], _order)


def merge_runs(entries: DataFrame) -> DataFrame:
    """The entries in global order: range_id, then position in the range."""
    n = entries.count()
    fields = [f.name for f in ENTRY if f.name != "run"]
    dealt = entries.repartitionByRange(max(1, -(-n // RANGE)), "url_key", "captured", "page_id")
    dealt = dealt.sortWithinPartitions("run", "url_key", "captured", F.col("page_id").asc_nulls_first())  # the shuffle brings a run's blocks in any order
    schema = T.StructType([f for f in ENTRY if f.name != "run"] + [T.StructField("range_id", T.IntegerType()), T.StructField("position", T.LongType())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        with tempfile.TemporaryDirectory() as folder:
            runs = RunFiles(folder, _schema())
            for batch in batches:
                names = batch.column(len(fields)).to_pylist()
                cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if hi > lo:
                        runs.add(batch.slice(lo, hi - lo).cast(runs.schema), names[lo])
            part, out, at = TaskContext.get().partitionId(), [], 0
            for e in runs.merged():
                out.append({k: e[k] for k in fields} | {"range_id": part, "position": at})
                at += 1
                if len(out) == BATCH:
                    yield pa.RecordBatch.from_pylist(out, to_arrow_schema(schema))
                    out = []
            yield pa.RecordBatch.from_pylist(out, to_arrow_schema(schema))

    return dealt.mapInArrow(lean(merge), schema)


def capture_index(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """Write the archives of all pages, read them back, and return their merged index."""
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, least)
    return merge_runs(materialize(read_runs(spark, folder), "runs"))


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """One row a page; the digest columns come out of the merged index of the archives that were read back."""
    index = capture_index(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, t, sha1(t) AS h, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, strlen(t) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, 1 + 10 * CAST(i // 8 AS INT), 10) AS BIGINT) >> CAST(35 - 5 * (i % 8) AS INT)) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first THEN first END AS refers_to
FROM h
"""
