import json
import os
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from palimpsest.operators import logs
from palimpsest.streaming import presence as streams


def drain(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
    finally:
        q.stop()


def source(spark, tmp_path, name, schema, *batches):
    d = tmp_path / name
    d.mkdir()
    for i, batch in enumerate(batches):
        (d / f"{i}.json").write_text("\n".join(json.dumps(r) for r in batch))
        os.utime(d / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # files are taken in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(d))


def test_touches_agree_with_the_batch_form(spark, tmp_path):
    touches = [{"device_id": "a", "ts_ms": t} for t in (0, 10_000, 29_999, 30_000, 59_999, 61_000)] + [{"device_id": "b", "ts_ms": 5}]
    drain(streams.touch_stream(source(spark, tmp_path, "t", "device_id string, ts_ms long", touches[:3], touches[3:])), "touches")
    batch = logs.throttle(spark.createDataFrame([(t["device_id"], t["ts_ms"]) for t in touches], "device_id string, ts_ms long"), "device_id", "ts_ms")
    assert rows(spark.table("touches")) == rows(batch) == [("a", 0), ("a", 30_000), ("a", 61_000), ("b", 5)]


PRESENCE = "vault string, device string, name string, file string, state string, updated_ms long, seq long"


def settle(stream, name, want, *columns):
    """Runs the stream until its rows are ``want``; timers keep such a query from ever being done by itself."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("update").trigger(processingTime="300 milliseconds").start()
    try:
        for _ in range(120):
            if q.exception() or rows(spark_of(stream).table(name), *columns) == want:
                break
            time.sleep(0.5)
        assert q.exception() is None
        return rows(spark_of(stream).table(name), *columns)
    finally:
        q.stop()


def spark_of(frame):
    return frame.sparkSession


def test_presence_frames(spark, tmp_path):
    row = lambda d, s, t, f=None: {"vault": "v", "device": d, "name": d, "file": f, "state": s, "updated_ms": t, "seq": t}
    stream = source(spark, tmp_path, "p", PRESENCE, [row("a", "active", 1, "x"), row("a", "idle", 2), row("b", "active", 1)], [row("b", "offline", 3)])
    want = [("a", "idle", 2), ("b", "active", 1), ("b", "offline", 3)]
    assert settle(streams.presence_stream(stream, 3_600_000), "presence", want, "device", "state", "updated_ms") == want


def test_presence_expires(spark, tmp_path):
    first = {"vault": "v", "device": "a", "name": "a", "file": "x", "state": "active", "updated_ms": 1, "seq": 1}
    stream = streams.presence_stream(source(spark, tmp_path, "e", PRESENCE, [first]), 1_000)
    want = [("active",), ("offline",)]
    assert settle(stream, "expiry", want, "state") == want


def test_bursts(spark, tmp_path):
    at = lambda s: {"path": "a", "ts": f"2024-01-01 00:00:{s:02d}"}
    stream = source(spark, tmp_path, "d", "path string, ts timestamp_ntz", [at(0), at(2), at(10)], [{"path": "z", "ts": "2024-01-01 01:00:00"}], [{"path": "z", "ts": "2024-01-01 02:00:00"}])
    drain(streams.debounce_stream(stream, "path", "ts"), "bursts")
    assert rows(spark.table("bursts").where("path = 'a'"), "events") == [(1,), (2,)]


def test_frames_of_others(spark):
    text = lambda **f: (json.dumps(f),)
    messages = spark.createDataFrame([text(t="presence", device="me"), text(t="presence", device="you"), text(t="ping"), text(t="root", root="r")], "value string")
    assert rows(streams.frames(messages, "me"), "t", "device") == [("presence", "you"), ("root", None)]
    sizes = spark.createDataFrame([(bytearray(b""),), (bytearray(b"x"),)], "update binary")
    assert streams.sized(sizes).count() == 1
    moved = spark.createDataFrame([("v", "r", 1)], "vault string, root_hash string, seq long")
    assert json.loads(streams.root_changes(moved).first()[0]) == {"t": "root", "vault": "v", "root": "r"}


def test_batch_presence_edges(spark):
    events = spark.createDataFrame([("v", "a", "a", None, "active", 10, 1), ("v", "b", "b", None, "active", 11, 2), ("v", "c", "c", None, "offline", 90_000, 3)], "vault string, device string, name string, file string, state string, updated_ms long, seq long")
    live = logs.presence(events, 90_010)
    assert rows(live, "device") == [("b",)]
    assert rows(logs.active_peers(live, "x")) == [("v", 1)]
    assert logs.suppress_echoes(events, "a").count() == 2


def test_repeated_lines(spark):
    lines = spark.createDataFrame([("s", i, x) for i, x in enumerate(["a", "a", "b", "a", None, None])], "s string, i int, x string")
    assert rows(logs.collapse_runs(lines, "s", ["i"], "x"), "run", "x", "repeats") == [(0, "a", 1), (1, "b", 0), (2, "a", 0), (3, None, 1)]


def test_frames_too_large_or_empty(spark):
    size = F.length("n")
    updates = spark.createDataFrame([("",), ("x",)], "n string").select(F.col("n").cast("binary").alias("update"), size.alias("n"))
    good, large = logs.accepted(updates)
    assert (good.count(), large.count()) == (1, 0)


def test_runs_and_totals_do_not_depend_on_the_cells(spark):
    import random

    from palimpsest.operators import ranges

    rng = random.Random(3)
    data = [("s" if rng.random() < 0.8 else None, i, rng.choice(["a", "b", None])) for i in range(500)]
    lines = spark.createDataFrame(data, "s string, i long, x string")
    whole = rows(logs.collapse_runs(lines, "s", ["i"], "x", 1))
    assert whole == rows(logs.collapse_runs(lines, "s", ["i"], "x", 40)) and sum(r[3] + 1 for r in whole) == 500
    totals = {}
    want = []
    for s, i, _ in data:
        want.append((i, totals.get(s, 0)))
        totals[s] = totals.get(s, 0) + i
    for cells in (1, 7, 64):
        assert sorted(rows(ranges.running_total(lines, "s", "i", F.col("i"), "before", cells), "i", "before")) == want


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_a_vault_of_all_is_fanned_out_by_all_tasks(spark, monkeypatch, most):
    monkeypatch.setattr(streams, "MOST_TOLD", most)
    sent = [("v" if i % 20 else None, f"d{i % 7}", i) for i in range(4000)]
    who = [("v", f"d{i}") for i in range(30)] + [("v", None), (None, "d1"), ("w", "d2")]
    messages = spark.createDataFrame(sent, "vault string, device string, value long").coalesce(1)
    told = streams.fan_out(messages, spark.createDataFrame(who, "vault string, subscriber string"))
    assert sorted(map(tuple, told.select("value", F.coalesce("subscriber", F.lit("-"))).collect())) == sorted((n, s or "-") for v, d, n in sent for w, s in who if v and v == w and d != s)
    if not most:
        return  # small shuffles are read together
    loads = [r["n"] for r in told.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(loads) > 1 and max(loads) < 2 * sum(loads) / len(loads)


def test_what_is_fanned_out_takes_few_bytes_in_files(spark, tmp_path):
    messages = spark.range(600).select(F.lit("v").alias("vault"), F.col("id").alias("device"), F.col("id").alias("value"))
    subscribers = spark.range(5000).select(F.lit("v").alias("vault"), (F.col("id") * 7919).alias("subscriber"))
    streams.fan_out(messages, subscribers).select("value", "subscriber").write.parquet(str(tmp_path / "told"))
    told = spark.read.parquet(str(tmp_path / "told"))
    n = 600 * 5000 - 1  # of the devices, only 0 follows
    assert (told.count(), told.distinct().count()) == (n, n)
    assert sum(f.stat().st_size for f in (tmp_path / "told").glob("*.parquet")) < n // 2


def test_logs_and_frames_are_streamed(spark, tmp_path):
    batches = [[{"vault": "v", "device": "a", "value": "1"}, {"vault": "w", "device": "a", "value": "2"}], [{"vault": "v", "device": "b", "value": "3"}]]
    sent, subscribers = [], spark.createDataFrame([("v", "a"), ("v", "b"), ("w", "c")], "vault string, subscriber string")
    stream = source(spark, tmp_path, "f", "vault string, device string, value string", *batches)
    q = streams.fan_out_stream(stream, lambda: subscribers, lambda frame, n: sent.extend((n, *r) for r in rows(frame, "subscriber", "value"))).trigger(availableNow=True).start()
    assert q.awaitTermination(90) and sorted(sent) == [(0, "b", "1"), (0, "c", "2"), (1, "a", "3")]
    texts = source(spark, tmp_path, "u", "note_key string, n int", [{"note_key": "a", "n": 3}, {"note_key": "b", "n": 0}], [{"note_key": "c", "n": (4 << 20) + 1}])
    updates = texts.selectExpr("note_key", "CAST(repeat('x', n) AS BINARY) AS update")
    q = streams.log_stream(updates, str(tmp_path / "log")).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    assert rows(spark.read.parquet(str(tmp_path / "log/updates")), "note_key") == [("a",)]
    assert rows(spark.read.parquet(str(tmp_path / "log/refused")), "note_key") == [("c",)]
