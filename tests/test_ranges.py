import os
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.sources import frame_files, pcm, wav
from cadenza.streaming.progress import watch
from cadenza.streaming.state import flushed_frames


def wav_bytes(data, tag, channels, bits, length=None, extra=b""):
    fmt = struct.pack("<HHIIHH", tag, channels, 8000, 8000 * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVE" + extra + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data) if length is None else length) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


@pytest.mark.parametrize(("tag", "bits"), [(1, 8), (1, 16), (1, 24), (1, 32), (3, 32)])
def test_ranges_equal_whole_files(spark, tmp_path, tag, bits):
    pcm.register(spark)
    r = np.random.default_rng(bits)
    raw = r.normal(size=1001 * 2).astype("<f4").tobytes() if tag == 3 else r.integers(0, 256, 1001 * 2 * bits // 8).astype(np.uint8).tobytes()
    (tmp_path / "a.wav").write_bytes(wav_bytes(raw + b"\x01", tag, 2, bits, extra=b"LIST" + struct.pack("<I", 3) + b"abc\0"))
    (tmp_path / "empty.wav").write_bytes(wav_bytes(b"", tag, 2, bits))
    (tmp_path / "_skipped").write_bytes(b"x")
    got = spark.read.format("pcm").option("path", f"file://{tmp_path}").option("samples", 64).load()
    assert got.rdd.getNumPartitions() == 16
    rows = got.orderBy("sample_no", "channel").collect()
    fmt, data = wav.parse((tmp_path / "a.wav").read_bytes())
    assert [r["value"] for r in rows] == wav.scaled(data, fmt).tolist() and len(rows) == 2002
    assert [(r["sample_no"], r["channel"]) for r in rows[:3]] == [(0, 0), (0, 1), (1, 0)] and {r["rate"] for r in rows} == {8000}


def test_a_file_beyond_two_gigabytes(spark, tmp_path):
    pcm.register(spark)
    n = 600_000_000  # samples of two channels of 16 bits; a sparse file
    with open(tmp_path / "big.wav", "wb") as f:
        f.write(wav_bytes(b"", 1, 2, 16, length=2**32 - 1))
        begin = f.tell()
        f.truncate(begin + 4 * n)
        f.seek(begin + 4 * (n - 3))
        f.write(struct.pack("<6h", 1, 2, 3, 4, 5, 6))
    assert os.stat(tmp_path / "big.wav").st_size > 2**31
    whole = pcm.PcmReader({"path": f"{tmp_path}/big.wav"}).partitions()
    assert len(whole) == -(-n // pcm.TASK) and sum(p.count for p in whole) == n and all(a.first + a.count == b.first for a, b in zip(whole, whole[1:]))
    got = spark.read.format("pcm").options(path=f"{tmp_path}/big.wav", first=n - 5, count=100, samples=2).load().orderBy("sample_no", "channel").collect()
    assert [r["value"] for r in got] == [0, 0, 0, 0, 1, 2, 3, 4, 5, 6] and got[-1]["sample_no"] == n - 1


def test_headerless_files_and_faults(spark, tmp_path):
    pcm.register(spark)
    (tmp_path / "x.raw").write_bytes(struct.pack(">5h", 1, -2, 3, -4, 5))
    got = spark.read.format("pcm").options(path=f"{tmp_path}/x.raw", bits=16, channels=2, big_endian="true").load().orderBy("sample_no", "channel").collect()
    assert [r["value"] for r in got] == [1, -2, 3, -4]
    with pytest.raises(Exception, match="not a WAV file"):
        spark.read.format("pcm").option("path", f"{tmp_path}/x.raw").load().collect()


def test_files_equal_the_frames_one_after_the_other(spark, tmp_path):
    frame_files.register(spark)
    r = random.Random(3)
    frames = [(s, t, r.randbytes(r.randrange(0, 40))) for s in (1, 2, 30) for t in range(200)] + [(4, 0, b""), (5, 7, None), (5, 9, b"end")]
    r.shuffle(frames)
    df = spark.createDataFrame(frames, "stream_id long, frame_no long, data binary")
    header = F.to_binary(F.lpad(F.hex(F.coalesce(F.octet_length("data"), F.lit(0))), 4, "0"), F.lit("hex"))
    for name, head in (("plain", None), ("headed", header)):
        placed = frame_files.placed(df, "stream_id", header=head, slot=16).repartition(9)
        placed.write.format("frame_files").option("path", f"{tmp_path}/{name}").mode("append").save()
        for s in (1, 2, 4, 5, 30):
            own = [d or b"" for k, _, d in sorted(frames, key=lambda f: f[1]) if k == s]
            want = b"".join((b"" if head is None else len(d).to_bytes(2, "big")) + d for d in own)
            assert (tmp_path / name / f"{s}.aac").read_bytes() == want
        assert len(os.listdir(tmp_path / name)) == 5


def test_a_task_that_runs_twice_or_fails_leaves_nothing(spark, tmp_path):
    writer = frame_files.FrameWriter(f"file://{tmp_path}/w")
    rows = [{"name": "a", "offset": 3, "data": b"def"}, {"name": "a", "offset": 0, "data": b"abc"}]
    writer.write(iter(rows[:1]))
    writer.write(iter(rows))
    writer.commit([writer.write(iter(rows[:1])), writer.write(iter(rows[1:])), None])
    assert (tmp_path / "w" / "a").read_bytes() == b"abcdef" and os.listdir(tmp_path / "w") == ["a"]
    broken = frame_files.FrameWriter(f"{tmp_path}/w")
    done = broken.write(iter([{"name": "b", "offset": 5, "data": b"x"}]))
    with pytest.raises(OSError, match="gaps"):
        broken.commit([done])
    assert os.listdir(tmp_path / "w") == ["a"]
    frame_files.register(spark)
    bad = spark.createDataFrame([("../b", 0, b"x")], frame_files.SCHEMA)
    with pytest.raises(Exception, match="not a file name"):
        bad.write.format("frame_files").option("path", f"{tmp_path}/w").mode("append").save()
    assert os.listdir(tmp_path / "w") == ["a"]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_streams_flush_and_progress_is_told(rocks, tmp_path):
    schema = "stream_id long, n long, ts timestamp, value double"
    at = lambda s: f"2024-01-01 00:{s // 60:02d}:{s % 60:02d}"
    # stream 1 ends in the first batch, stream 2 goes on with a late row and a wild number, stream 3 moves the watermark
    batches = [
        [(1, n, at(n), float(n + 1)) for n in range(6)] + [(2, n, at(n), 1.0) for n in range(3)],
        [(2, 3, at(10), 2.0), (2, 1, at(11), 9.0), (2, 10**12, at(12), 7.0), (3, 0, at(600), None)],
        [(3, 1, at(601), 5.0)],
        [(3, 2, at(602), 5.0)],
    ]
    for i, rows in enumerate(batches):
        df = rocks.createDataFrame(rows, "stream_id long, n long, t string, value double").select("stream_id", "n", F.col("t").cast("timestamp").alias("ts"), "value")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    os.makedirs(tmp_path / "in")
    for i in range(len(batches)):
        [part] = [f for f in os.listdir(tmp_path / f"in{i}") if f.startswith("part")]
        os.link(tmp_path / f"in{i}" / part, tmp_path / "in" / f"{i}.parquet")
        os.utime(tmp_path / "in" / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    listener = watch(rocks, rate=8, frame=4)
    stream = rocks.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = flushed_frames(stream, 4, silence=30_000, late="1 second").writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    rocks.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    got = {(r["stream_id"], r["frame_no"]): (r["samples"], r["flushed"]) for r in rocks.sql("SELECT * FROM flushed").collect()}
    zero = [0.0] * 4
    wild = 10**12 // 4
    assert got == {
        (1, 0): ([1, 2, 3, 4], False), (1, 1): ([5, 6, 0, 0], True), (1, 2): (zero, True),
        (2, 0): ([1, 1, 1, 2], False), (2, wild): ([7, 0, 0, 0], True), (2, wild + 1): (zero, True),
    }
    rows = listener.table(rocks).collect()
    rocks.streams.removeListener(listener)
    told = [r for r in rows if r["query"] == str(q.id)]
    assert told[0]["event"] == "started" and sum(r["samples"] for r in told) == 15
    assert sum(r["frames"] for r in told) == sum(n // 4 for n in (9, 4, 1, 1)) and all(r["played"] == r["samples"] / 8 for r in told)
