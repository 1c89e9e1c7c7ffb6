import random
from datetime import datetime, timedelta

from pyspark.sql.types import StructType

from tapewright.streaming.history import History, start_history

T0 = datetime(2024, 1, 1)
SCHEMA = StructType().add("position_id", "string").add("seq", "long").add("ts", "timestamp").add("type", "string").add("quantity", "long")
TYPES = ["PositionOpened", "PositionChanged", "PositionClosed"]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def plain(rows, ticks):
    """At every tick the newest entry of each position, an entry taking effect no earlier than those before it."""
    out = set()
    for tick in range(ticks):
        now = T0 + timedelta(minutes=30 * tick)
        newest, reached = {}, {}
        for pid, seq, ts, type_, quantity in sorted(rows, key=lambda r: r[1]):
            reached[pid] = max(reached.get(pid, ts), ts)
            if reached[pid] <= now:
                newest[pid] = (type_, quantity)
        out |= {(now, pid, q) for pid, (t, q) in newest.items() if t != "PositionClosed"}
    return out


def shown(history, ticks, last=None):
    end = T0 + timedelta(minutes=30 * (ticks - 1))
    rows = history.snapshots(str(T0), str(end), last).collect()
    got = {(r.snapshot_ts, r.position_id, r.quantity) for r in rows}
    assert len(got) == len(rows)
    return got


def test_any_cut_of_a_log_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows, at = [], 0
    for seq in range(150):
        at += rng.randrange(600)
        # Times go back a little now and then; entry numbers decide.
        rows.append((rng.choice("ABCD"), seq, T0 + timedelta(seconds=max(at - rng.randrange(2000), 0)), rng.choice(TYPES), seq))
    cuts = [0, 10, 11, 90, 150]
    history = History(spark, str(tmp_path), SCHEMA, hot_rows=25)
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        history.step(frame(spark, rows[a:b]), i)
        if i == 2:  # a batch that runs again changes nothing
            history.step(frame(spark, rows[a:b]), i)
    assert shown(history, 30) == plain(rows, 30)
    assert shown(history, 30, 2) == plain(rows[:90], 30)
    # Long after the last event the open positions are still shown at any tick that is asked for.
    far = str(T0 + timedelta(days=30))
    assert {r.position_id for r in history.snapshots(far, far).collect()} == {p for t, p, q in plain(rows, 60) if t == T0 + timedelta(minutes=30 * 59)}


def test_late_rows_closed_positions_and_nulls(spark, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    history = History(spark, str(tmp_path), SCHEMA)
    history.step(frame(spark, []), 0)
    assert shown(history, 3) == set()
    history.step(frame(spark, [("A", 1, at(0), "PositionOpened", 1), ("A", 5, at(40), "PositionClosed", 0), ("B", 2, at(1), None, 2)]), 1)
    # Older than the closing, without a time, a position or a number; a repeated row.
    bad = [("A", 3, at(30), "PositionChanged", 9), ("C", 6, None, "PositionOpened", 9), (None, 7, at(2), "PositionOpened", 9)]
    history.step(frame(spark, [*bad, ("D", None, at(2), "PositionOpened", 9), ("B", 2, at(1), None, 2)]), 2)
    assert spark.read.parquet(f"{tmp_path}/late/batch_id=2").count() == 5
    assert shown(history, 4) == {(at(0), "A", 1), (at(30), "A", 1), (at(30), "B", 2), (at(60), "B", 2), (at(90), "B", 2)}
    # A year later the closed position has left the state, the open one has not.
    history.step(frame(spark, [("E", 9, at(365 * 1440), "PositionOpened", 3)]), 3)
    assert {r.position_id for r in history._open(3).collect()} == {"B", "E"}
    assert {r.position_id for r in history._open(2).collect()} == {"A", "B"}


def test_as_a_stream_over_a_restart(spark, tmp_path):
    def step(rows):
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
        query, history = start_history(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/log"), f"{tmp_path}/out", available_now=True)
        assert query.awaitTermination(120)
        return history

    step([("A", 1, T0, "PositionOpened", 1), ("B", 2, T0, "PositionOpened", 2)])
    history = step([("A", 3, T0 + timedelta(minutes=31), "PositionClosed", 0)])
    assert shown(history, 3) == {(T0, "A", 1), (T0, "B", 2), *((T0 + timedelta(minutes=m), "B", 2) for m in (30, 60)), (T0 + timedelta(minutes=30), "A", 1)}
