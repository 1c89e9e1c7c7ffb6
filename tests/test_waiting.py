import random
from datetime import datetime, timedelta

from tapewright.operators.commands import match_replies
from tapewright.streaming.waiting import Waiting, start_replies

T0 = datetime(2024, 1, 1)
SCHEMA = "topic string, strategy_id string, seq long, ts timestamp"


def rows_of(seed, n=240):
    rng = random.Random(seed)
    rows = [(rng.choice("fg"), rng.choice(["A", "A", "B", None]), i, T0 + timedelta(seconds=rng.randrange(3000)), rng.random() < 0.4) for i in range(n)]
    return rows + [("f", "A", n, None, False), ("f", "A", n + 1, None, True)]


def frame(spark, rows):
    return spark.createDataFrame(rows, f"{SCHEMA}, is_reply boolean").repartition(2)


def plain(rows, seconds):
    """First reply of each request in time, by looking at all of them."""
    out = {}
    for topic, sid, seq, ts, reply in rows:
        if reply:
            continue
        fits = [(t, s) for tp, si, s, t, r in rows if r and (tp, si) == (topic, sid) and ts and t and ts <= t <= ts + timedelta(seconds=seconds)]
        out[seq] = min(fits)[1] if fits else None
    return out


def test_any_cut_gives_the_batch_result(spark, tmp_path, seed=1):
    rows = rows_of(seed)
    # Rows arrive by time, some up to the lateness behind, and are cut anywhere.
    rng = random.Random(seed)
    rows.sort(key=lambda r: ((r[3] or T0) + timedelta(seconds=rng.randrange(60))))
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), 3)), len(rows)]
    waiting = Waiting(spark, str(tmp_path), SCHEMA, seconds=120, lateness=60)
    batches = [frame(spark, rows[a:b]) for a, b in zip(cuts, cuts[1:])]
    for i, batch in enumerate(batches):
        waiting.step(batch, i)
        if i == 2:  # a batch that runs again changes nothing
            waiting.step(batch, i)
    got = waiting.so_far(len(batches) - 1).collect()
    assert {r.seq: r.reply_seq for r in got} == plain(rows, 120) and len(got) == len(plain(rows, 120))
    assert all(r.answered == (r.reply_seq is not None) for r in got)
    every = frame(spark, rows)
    whole = match_replies(every.where("not is_reply").drop("is_reply"), every.where("is_reply and ts is not null").drop("is_reply"), 120)
    assert {r.seq: r.reply_seq for r in whole.collect()} == plain(rows, 120)
    assert not [r for i in range(len(batches)) for r in spark.read.parquet(f"{tmp_path}/late/batch_id={i}").collect()]


def test_what_is_kept_is_bounded_by_time(spark, tmp_path):
    waiting = Waiting(spark, str(tmp_path), SCHEMA, seconds=120, lateness=60)
    at = lambda s: T0 + timedelta(seconds=s)
    waiting.step(frame(spark, [("f", "A", i, at(i), i % 2 == 0) for i in range(200)]), 0)
    waiting.step(frame(spark, [("f", "A", 1000, at(5000), False), ("f", "A", 1001, at(5001), True)]), 1)
    waiting.step(frame(spark, [("f", "A", 1002, at(100), True), ("f", "A", 1003, at(100), False)]), 2)
    pending = waiting._pending(2).collect()
    assert {r.seq for r in pending} == {1000, 1001}
    assert {r.seq for r in spark.read.parquet(f"{tmp_path}/late/batch_id=2").collect()} == {1002, 1003}
    got = {r.seq: (r.reply_seq, r.settled) for r in waiting.so_far(2).collect()}
    # The last reply of the first batch answers what stood before it; its last request waits in vain.
    assert got[1] == (2, True) and got[199] == (None, True) and got[1000] == (1001, False)
    assert not (tmp_path / "pending" / "batch_id=0").exists()


def test_a_hot_strategy_and_empty_batches(spark, tmp_path):
    rows = [("f", "A", i, T0 + timedelta(seconds=i // 3), i % 5 == 0) for i in range(300)]
    waiting = Waiting(spark, str(tmp_path), SCHEMA, seconds=120, lateness=60, hot_rows=50)
    waiting.step(frame(spark, []), 0)
    waiting.step(frame(spark, rows), 1)
    waiting.step(frame(spark, []), 2)
    assert {r.seq: r.reply_seq for r in waiting.so_far(2).collect()} == plain(rows, 120)


def test_as_a_stream_over_a_restart(spark, tmp_path):
    def put(name, rows):
        rows = [("f", sid, seq, T0 + timedelta(seconds=s)) for sid, seq, s in rows]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def step():
        asked, came = (spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/{n}") for n in ("asked", "came"))
        query, waiting = start_replies(asked, came, f"{tmp_path}/out", lateness=0, available_now=True)
        assert query.awaitTermination(180)
        return waiting

    put("asked", [("A", 1, 0), ("A", 2, 10), ("B", 3, 0), ("C", 4, 0)])
    put("came", [("A", 11, 60), ("B", 13, 121), ("D", 14, 5)])
    step()
    put("asked", [("C", 5, 125)])
    put("came", [("C", 15, 130)])
    got = {r.seq: r.reply_seq for r in step().so_far().collect()}
    assert got == {1: 11, 2: 11, 3: None, 4: None, 5: 15}
