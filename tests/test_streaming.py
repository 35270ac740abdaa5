import random

from pyspark.sql import functions as F

from cadenza.streaming.frames import frame_stream, window_energy


def run(spark, tmp_path, batches, schema, build, name, mode="append"):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = build(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    return spark.sql(f"SELECT * FROM {name}").collect()


def test_stream_frames_equal_batch_frames(spark, tmp_path):
    r = random.Random(1)
    values = {s: [r.choice([0.0, 1.0, 5.0]) for _ in range(37)] for s in (1, 2)}
    rows = [(s, n, v) for s, vs in values.items() for n, v in enumerate(vs)]
    rows.sort(key=lambda x: x[1])
    batches = [rows[i : i + 11] for i in range(0, len(rows), 11)]
    got = run(spark, tmp_path, batches, "stream_id long, n long, value double", lambda s: frame_stream(s, 8), "frames_out")
    found = {(x["stream_id"], x["frame_no"]): (x["energy"], x["jump"]) for x in got}
    for s, vs in values.items():
        energies = [sum(v * v for v in vs[i * 8 : i * 8 + 8]) for i in range(4)]
        for i, e in enumerate(energies):
            jump = i > 0 and abs(e - energies[i - 1]) > 3 * min(e, energies[i - 1])
            assert found[s, i] == (e, jump)
    assert len(found) == 8


def test_window_energy_equals_batch(spark, tmp_path):
    rows = [(1, f"2024-01-01 00:{m:02d}:00", float(m)) for m in range(0, 59, 7)]
    df = spark.createDataFrame(rows, "user_id long, t string, value double").select("user_id", F.col("t").cast("timestamp").alias("ts"), "value")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = window_energy(stream).writeStream.format("memory").queryName("energy_out").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {(x["start"], x["energy"], x["n"]) for x in spark.sql("SELECT * FROM energy_out").collect()}
    assert got == {(x["start"], x["energy"], x["n"]) for x in window_energy(df).collect()}


def test_a_wild_number_costs_one_frame(spark, tmp_path):
    rows = [(1, 0, 1.0), (1, 1, 2.0), (1, 10**12 + 1, 3.0), (1, 10**12 + 4, 4.0)]
    got = run(spark, tmp_path, [rows[:1], rows[1:]], "stream_id long, n long, value double", lambda s: frame_stream(s, 4), "wild_out")
    assert {(x["frame_no"], x["energy"]) for x in got} == {(0, 5.0), (10**12 // 4, 9.0)}
