"""Line numbers of split files, and the event-time stream against the batch fold."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from lorespark.operators import lifecycle
from lorespark.sources import jsonl
from lorespark.streaming.lifecycle import stream_states_in_order


def test_a_large_file_is_read_in_parts(spark, tmp_path):
    rng = random.Random(1)
    lines = [rng.choice(["", '{"user": "%d", "n": %d}\r' % (i, i), '{"user": "あ%s", "n": %d}' % ("x" * rng.randrange(200), i)]) for i in range(5000)]
    (tmp_path / "big.jsonl").write_text("\n".join(lines), encoding="utf-8", newline="")
    (tmp_path / "small.jsonl").write_text('\n{"user": "s", "n": 2}\n', encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        assert jsonl._lines(spark, str(tmp_path)).rdd.getNumPartitions() > 1
        got = jsonl.read_jsonl(spark, str(tmp_path), "user string, n int").collect()
        big = sorted((r.ord, r.n) for r in got if r.file.endswith("big.jsonl"))
        assert big == [(i + 1, i) for i, x in enumerate(lines) if x]
        assert [(r.ord, r.n) for r in got if r.file.endswith("small.jsonl")] == [(2, 2)]
        at = next(i for i in range(4321, 5000) if lines[i])
        lines[at] = "{broken"
        (tmp_path / "big.jsonl").write_text("\n".join(lines), encoding="utf-8", newline="")
        with pytest.raises(Exception, match=f"invalid JSON on line {at + 1} of .*big.jsonl"):
            jsonl.read_jsonl(spark, str(tmp_path), "user string, n int").collect()
        kept = jsonl.read_jsonl(spark, str(tmp_path), "user string, n int", strict=False)
        assert kept.where(F.col("file").endswith("big.jsonl")).count() == len(big) - 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def stream(spark, path, name, **kw):
    rows = spark.readStream.schema("user_id long, ts timestamp, event_id long, event_type string").option("maxFilesPerTrigger", 1).parquet(path)
    found = stream_states_in_order(rows, "user_id", "event_type", lifecycle.QUEUE_MOVES, "pending", "ts", "event_id", **kw)
    q = found.writeStream.format("memory").queryName(name).outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_shuffled_micro_batches_equal_the_batch_fold(spark, tmp_path):
    rng = random.Random(4)
    start = datetime.datetime(2024, 1, 1)
    rows = [(rng.randrange(6), start + datetime.timedelta(seconds=rng.randrange(3000)), i, rng.choice(["promote", "verify", "revoke", "noise"])) for i in range(900)]
    rng.shuffle(rows)
    end = [(99, start + datetime.timedelta(days=2), 10_000, "promote")]
    schema = "user_id long, ts timestamp, event_id long, event_type string"
    for k, part in enumerate([rows[:300], rows[300:600], rows[600:], end, [(99, start + datetime.timedelta(days=3), 10_001, "noise")]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    found = stream(spark, str(tmp_path / "in"), "in_order", late="2 hours")
    last = found.groupBy("user_id").agg(F.max_by(F.struct("status", "n_changes"), F.struct("until", "n_changes")).alias("r")).select("user_id", "r.*")
    batch = lifecycle.fold_states(spark.createDataFrame(rows, schema).withColumn("o", F.struct("ts", "event_id")), "user_id", "event_type", lifecycle.QUEUE_MOVES, "pending", "o")
    want = {r.user_id: (r.status, r.n_changes) for r in batch.collect()}
    got = {r.user_id: (r.status, r.n_changes) for r in last.where("user_id < 99").collect()}
    assert got == want and max(n for _, n in want.values()) > 20


def test_idle_keys_are_forgotten(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    at = lambda h: start + datetime.timedelta(hours=h)
    schema = "user_id long, ts timestamp, event_id long, event_type string"
    for part in ([(1, at(0), 0, "promote")], [(2, at(5), 1, "promote")], [(2, at(6), 2, "noise")], [(1, at(7), 3, "verify")], [(2, at(20), 4, "noise")], [(2, at(21), 5, "noise")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = stream(spark, str(tmp_path / "in"), "idle", late="1 minute", idle=3600).where("user_id = 1").orderBy("until").collect()
    assert [(r.status, r.n_changes) for r in rows] == [("promoted", 1), ("pending", 0)]
