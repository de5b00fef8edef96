"""Streams restarted from their checkpoints, and the shortfall of lanes."""

from datetime import datetime, timedelta

from siftline.operators import quota
from siftline.streaming.ledger import attempt_windows, stream_state
from siftline.streaming.once import first_of_each, write_once

START = datetime(2024, 1, 1)


def test_each_event_once_over_two_runs(spark, tmp_path):
    shape = "id int, at timestamp, word string"
    event = lambda i, word, hours=0: (i, START + timedelta(hours=i + hours), word)
    runs = [[event(i, "first") for i in range(8)] + [event(3, "first")], [event(i, "again", 1) for i in range(4, 12)], [], [event(100, "far"), event(101, "far")], [event(1, "too late"), event(101, "again")]]
    for rows in runs:
        spark.createDataFrame(rows, shape).repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(shape).parquet(f"{tmp_path}/in")
        write_once(first_of_each(stream, keys=["id"], at="at", within="2 days"), f"{tmp_path}/out", f"{tmp_path}/state")
    got = sorted((r.id, r.word) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(i, "first") for i in range(8)] + [(i, "again") for i in range(8, 12)] + [(100, "far"), (101, "far")]


def test_ledger_goes_on_after_a_restart(spark, tmp_path):
    shape, out = "event_id long, entity string, outcome string, score double", []
    runs = [[(1, "a", "stands", 3.0), (2, "b", "eliminated", 0.0)], [(4, "a", "read", 0.0), (3, "a", "eliminated", 5.0), (5, "b", "stands", 2.0)]]
    for rows in runs:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        states = stream_state(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"))
        keep = lambda batch, number: out.extend(map(tuple, batch.collect()))
        states.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out[:2]) == [("a", "stands", 3.0, 1), ("b", "eliminated", 0.0, 1)] and sorted(out[2:]) == [("a", "eliminated", 5.0, 3), ("b", "eliminated", 2.0, 2)]


def test_windows_of_attempts(spark, tmp_path):
    shape = "created_at timestamp, provider string, outcome string, cost double"
    rows = [(START + timedelta(hours=h), p, o, c) for h, p, o, c in [(0, "x", "verified", 0.1), (5, "x", "failed", 0.2), (7, "x", "verified", 0.4), (1, "y", "failed", None), (40, "x", "failed", 1.0)]]
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/in")
    out = []
    counted = attempt_windows(spark.readStream.schema(shape).parquet(f"{tmp_path}/in"))
    counted.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).trigger(availableNow=True).start().awaitTermination()
    assert sorted((p, (s - START).total_seconds() // 3600, a, v, c) for s, p, a, v, c in out) == [("x", 0, 2, 1, 0.3), ("x", 6, 1, 1, 0.4), ("x", 36, 1, 0, 1.0), ("y", 0, 1, 0, None)]


def test_shortfall_partitions_what_surfaced(spark):
    rows = [("narrow", f"e{i}", i, "size" if i % 3 else "kind", "eliminated", 0.0) for i in range(9)] + [("narrow", "e9", 20, "size", "stands", 50.0), ("narrow", "e1", 30, "kind", "eliminated", 9.0)]
    rows += [("near", "a", 1, "size", "stands", 90.0), ("near", "a", 2, "size", "stands", 80.0), ("near", "b", 3, "kind", "stands", 0.0), ("near", "c", 4, "kind", "eliminated", 120.0), ("both", "d", 1, "size", "stands", 89.0)]
    rows += [("both", f"g{i}", i, None, "eliminated", None) for i in range(5)] + [("none", "e", 1, "size", "stands", 10.0), (None, "f", 1, "size", "eliminated", 0.0)]
    got = {r.lane: r for r in quota.shortfall(spark.createDataFrame(rows, "lane string, entity string, event_id int, rung string, outcome string, score double"), least_score=100).collect()}
    assert all(r.surfaced == r.stood + r.eliminated for r in got.values()) and set(got) == {"narrow", "near", "both", "none", None}
    one = got["narrow"]
    assert (one.surfaced, one.stood, one.eliminated_at, one.findings, one.scored, one.below, one.best_below) == (10, 1, ["size: 6", "kind: 3"], ["funnel"], 2, 2, 50.0) and "gate" in one.lever
    assert (got["near"].findings, got["near"].best_below, got["near"].scored) == (["search"], 80.0, 2) and got["both"].findings == ["funnel", "bar"] and got["both"].eliminated_at == [": 5"]
    assert got["none"].stage == "search" and got[None].stood == 0 and got[None].findings == ["search"]
