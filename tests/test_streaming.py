import glob
import json
import os
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapewright import session
from tapewright.schema import EVENT_LOG
from tapewright.sources import log as logs
from tapewright.streaming import live
from tapewright.streaming.live import start_live
from tapewright.streaming.replies import match_replies_stream
from tapewright.streaming.snapshots import start_snapshots

T0 = datetime(2024, 1, 1)


def entry(seq, topic, body):
    return ("trader-A:stream", seq, T0 + timedelta(seconds=seq), topic, body if body is None or isinstance(body, str) else json.dumps(body))


def order(seq, type_, coid="O1", **fields):
    return entry(seq, "events.order.V", {"type": type_, "client_order_id": coid, "strategy_id": "Cls-FOO", **fields})


def append(spark, path, rows):
    spark.createDataFrame(rows, EVENT_LOG).coalesce(1).write.mode("append").parquet(path)


def run(spark, path, registry):
    log = logs.stream_log(spark, f"{path}/log", max_files=1)
    query = start_live(log, lambda: registry["now"], f"{path}/out", available_now=True)
    assert query.awaitTermination(180)
    return {r.seq: r for r in spark.read.parquet(f"{path}/out/events").collect()}


def test_live_pipeline_over_restarts(spark, tmp_path):
    path = str(tmp_path)
    registry = {"now": spark.createDataFrame([("FOO", "sandbox")], "strategy_id string, mode string")}
    append(spark, f"{path}/log", [
        order(1, "OrderInitialized", quantity="100", time_in_force="IOC", order_side="BUY"),
        order(3, "OrderFilled", last_qty="40", last_px="1.0"),
        entry(4, "data.quotes.V.X", {"type": "QuoteTick"}),
        entry(5, "events.position.V", {"type": "PositionChanged", "strategy_id": "Cls-FOO"}),
        entry(6, "events.position.V", {"type": "PositionOpened", "strategy_id": "Cls-FOO"}),
        entry(7, "events.system.E", {"type": "ComponentStateChanged", "state": "READY"}),
        entry(8, "events.system.E", {"type": "ComponentStateChanged", "state": "RUNNING"}),
        entry(9, "ops.report.positions", {"strategy_id": "FOO"}),
        entry(10, "events.account.V", "garbage"),
    ])
    got = run(spark, path, registry)
    assert {s: r.channel for s, r in got.items()} == {6: "sandbox", 8: "logging", 9: "logging", 10: "logging"}
    # The query starts again where it stopped; state and position come from its checkpoint, the registry is read anew.
    registry["now"] = spark.createDataFrame([("FOO", "live")], "strategy_id string, mode string")
    append(spark, f"{path}/log", [
        order(12, "OrderFilled", last_qty="60", last_px="2.0"),
        order(2, "OrderFilled", last_qty="1000", last_px="9"),
        order(13, "OrderInitialized", "O2", quantity="5"),
    ])
    append(spark, f"{path}/log", [order(14, "OrderFilled", last_qty="1", last_px="1"), order(15, "OrderCanceled", "O2"), order(16, "OrderFilled", None, last_qty="1")])
    got = run(spark, path, registry)
    assert sorted(got) == [6, 8, 9, 10, 12, 14, 15, 16]
    done = got[12]
    assert (done.channel, done.vwap, done.fill_count, done.known_tif, done.known_side) == ("live", 1.6, 2, "IOC", "BUY")
    # After completion the order is forgotten: the next fill has an unknown total and is forwarded.
    assert got[14].qty_total is None and float(got[14].qty_filled) == 1
    assert float(got[15].remainder) == 5
    late = spark.read.parquet(f"{path}/out/late").collect()
    assert [r.seq for r in late] == [2]


def test_replies_stream(spark, tmp_path):
    path, schema = str(tmp_path), "topic string, strategy_id string, seq long, ts timestamp"

    def put(name, rows):
        rows = [("f", sid, seq, T0 + timedelta(seconds=s)) for sid, seq, s in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/{name}")

    def step():
        asked, came = (spark.readStream.schema(schema).parquet(f"{path}/{n}") for n in ("asked", "came"))
        writer = match_replies_stream(asked, came).writeStream.format("parquet").outputMode("append")
        query = writer.option("checkpointLocation", f"{path}/cp").option("path", f"{path}/out").trigger(availableNow=True).start()
        assert query.awaitTermination(180)

    put("asked", [("A", 1, 0), ("A", 2, 10), ("B", 3, 0), ("C", 4, 0)])
    put("came", [("A", 11, 60), ("A", 12, 70), ("B", 13, 121), ("D", 14, 5)])
    step()
    # Nothing is missing for sure until the watermark has passed.
    put("asked", [("Z", 9, 100_000)])
    put("came", [("Z", 99, 200_000)])
    step()
    got = {r.seq: r.reply_seq for r in spark.read.parquet(f"{path}/out").where(F.col("seq") < 9).collect()}
    assert got == {1: 11, 2: 11, 3: None, 4: None}


def test_snapshots(spark, tmp_path):
    path, schema = str(tmp_path), "position_id string, seq long, ts timestamp, type string"

    def tick(rows):
        spark.createDataFrame([(p, i, T0, t) for p, i, t in rows], schema).coalesce(1).write.mode("append").parquet(f"{path}/log")
        query = start_snapshots(spark.readStream.schema(schema).parquet(f"{path}/log"), f"{path}/out", available_now=True)
        assert query.awaitTermination(120)

    tick([("A", 1, "PositionOpened"), ("B", 2, "PositionOpened")])
    tick([("A", 3, "PositionClosed"), ("C", 4, "PositionOpened")])
    got = spark.read.parquet(f"{path}/out/snapshots").collect()
    assert {(r.tick, r.position_id) for r in got} == {(0, "A"), (0, "B"), (1, "B"), (1, "C")}
    assert start_snapshots(None, path, enabled=False) is None


def test_steps_of_a_batch_are_compact_and_go_with_it(spark, tmp_path, monkeypatch):
    """The steps hold columns as compressed files, not as the plain rows of a checkpoint; none stays behind the batch."""
    kept = []
    monkeypatch.setattr(live, "stored", lambda df, folder: kept.append(folder) or session.stored(df, folder))
    monkeypatch.setattr(type(spark.range(1)), "checkpoint", lambda *_: pytest.fail("plain rows are written"))
    append(spark, f"{tmp_path}/log", [order(1, "OrderInitialized", quantity="2"), order(2, "OrderFilled", last_qty="2", last_px="5")])
    registry = spark.createDataFrame([("S1", "live")], "strategy_id string, mode string")
    stream = spark.readStream.schema(EVENT_LOG).parquet(f"{tmp_path}/log")
    live.start_live(stream, lambda: registry, f"{tmp_path}/out", available_now=True).awaitTermination()
    assert [r.client_order_id for r in spark.read.parquet(f"{tmp_path}/out/events").collect()] == ["O1"]
    assert len(kept) >= 4 and not any(os.path.exists(f) for f in kept)


def busy_log(spark, path):
    """Two files: 30 orders with fills, some of them done early, cancelled, late or repeated, and entries of no order."""
    first, second, seq = [], [], 100
    for i in range(30):
        coid = f"O{i}"
        first += [order(seq, "OrderInitialized", coid, quantity="10", order_side="BUY"), order(seq + 1, "OrderFilled", coid, last_qty="4", last_px=f"{i}.5")]
        first += [order(seq + 2, "OrderFilled", coid, last_qty="6", last_px="2")] if i % 3 == 0 else []
        first += [order(seq + 2, "OrderCanceled", coid)] if i % 3 == 1 else []
        second += [order(seq + 5, "OrderFilled", coid, last_qty="6", last_px="3")]
        second += [order(seq - 90, "OrderFilled", coid, last_qty="1", last_px="1")] if i % 4 == 0 else []
        second += [order(seq + 5, "OrderFilled", coid, last_qty="6", last_px="3")] if i % 5 == 0 else []
        first += [entry(seq + 7, "events.position.V", {"type": "PositionOpened", "strategy_id": f"Cls-S{i % 3}"}), entry(seq + 8, "ops.report.fills", None)]
        seq += 10
    append(spark, f"{path}/log", first)
    append(spark, f"{path}/log", second)
    return len(first)


def plain_rows(df, *without):
    return sorted(str(r) for r in df.drop("channel", *without).collect())


def test_slices_of_a_batch_leave_what_the_whole_batch_does(spark, tmp_path, monkeypatch):
    """A batch cut by order gives the same events, late rows and states; its steps never hold more than a slice."""
    rows = busy_log(spark, tmp_path)
    registry = spark.createDataFrame([("FOO", "live"), ("S1", "live")], "strategy_id string, mode string")
    steps, sizes = [], []

    def watched(df, folder):
        if "/steps/" in folder:
            if folder.endswith("/0"):
                steps.append(sorted(os.listdir(os.path.dirname(folder))) if os.path.exists(os.path.dirname(folder)) else [])
            sizes.append((kept := session.stored(df, folder)).count())
            return kept
        return session.stored(df, folder)

    monkeypatch.setattr(live, "stored", watched)
    for name, most in (("whole", 1_000_000), ("cut", 50)):
        steps.clear(), sizes.clear()
        log = logs.stream_log(spark, f"{tmp_path}/log", max_files=1)
        live.start_live(log, lambda: registry, f"{tmp_path}/{name}", available_now=True, slice_rows=most).awaitTermination()
        if name == "whole":
            assert len(steps) == 2 and max(sizes) > 60
    assert len(steps) == -(-rows // 50) + 1 and not any(steps) and max(sizes) < rows / 2
    whole, cut = ([spark.read.parquet(f"{tmp_path}/{n}/{x}") for x in ("events", "late", "states/delta")] for n in ("whole", "cut"))
    assert [plain_rows(df, "s_at") for df in cut] == [plain_rows(df, "s_at") for df in whole]
    assert whole[0].count() > 60 and whole[1].count() >= 8 and whole[2].count() == 60
    assert [r.channel for r in cut[0].orderBy("seq", "topic").collect()] == [r.channel for r in whole[0].orderBy("seq", "topic").collect()]
    assert not os.listdir(f"{tmp_path}/cut/work")


def test_shuffles_of_a_batch_go_with_its_steps(spark, tmp_path):
    """Shuffle files do not pile up until the driver's memory is cleaned."""
    busy_log(spark, tmp_path)
    registry = spark.createDataFrame([("FOO", "live")], "strategy_id string, mode string")
    folders = [f.getPath() for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def shuffles():
        return {f for folder in folders for f in glob.glob(f"{folder}/*/shuffle_*.data")}

    before = shuffles()
    start_live(logs.stream_log(spark, f"{tmp_path}/log", max_files=1), lambda: registry, f"{tmp_path}/out", available_now=True).awaitTermination()
    for _ in range(20):
        if not (left := shuffles() - before):
            break
        time.sleep(0.5)
    assert not left
