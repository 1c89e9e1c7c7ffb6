"""The block-wise scans against plain Python folds, with every key treated as hot and with none."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tapewright.operators import skew
from tapewright.operators.asof import asof_join
from tapewright.operators.skew import Track, mark_blocks, running, top_per_key


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    return [("hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}", i, rng.choice([None, 1, 2, 3])) for i in range(400)]


def fold(rows, exclusive=False, reverse=False):
    state, out = {}, {}
    for key, seq, v in sorted(rows, key=lambda r: -r[1] if reverse else r[1]):
        s = state.setdefault(key, {"s": 0, "n": 0, "f": None, "l": None, "m": None})
        if exclusive:
            out[seq] = tuple(s.values())
        if v is not None:
            s["s"] += v
            s["n"] += 1
            s["f"] = v if s["f"] is None else s["f"]
            s["l"] = v
            s["m"] = v if s["m"] is None else max(s["m"], v)
        if not exclusive:
            out[seq] = tuple(s.values())
    return out


@pytest.mark.parametrize("hot_rows", [5, 60, 10**9])
@pytest.mark.parametrize("block", [None, "seq div 7"])
@pytest.mark.parametrize("exclusive", [False, True])
@pytest.mark.parametrize("reverse", [False, True])
def test_running_equals_fold(spark, rows, hot_rows, block, exclusive, reverse):
    df = spark.createDataFrame(rows, "k string, seq long, v int")
    v = F.col("v")
    got = running(
        df,
        ["k"],
        ["seq"],
        {n: Track(k, v) for n, k in [("s", "sum"), ("n", "count"), ("f", "first"), ("l", "last"), ("m", "max")]},
        block=None if block is None else F.expr(block),
        exclusive=exclusive,
        reverse=reverse,
        hot_rows=hot_rows,
    ).collect()
    assert {r.seq: (r.s, r.n, r.f, r.l, r.m) for r in got} == fold(rows, exclusive, reverse)


@pytest.mark.parametrize("hot_rows", [3, 10**9])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_equals_search(spark, hot_rows, direction):
    rng = random.Random(5)
    t0 = datetime(2024, 1, 1)
    values = [(f"i{rng.randrange(3)}", t0 + timedelta(hours=rng.randrange(200)), i, float(i)) for i in range(150)]
    probes = [(f"i{rng.randrange(4)}", t0 + timedelta(hours=rng.randrange(200)), i) for i in range(80)]
    got = asof_join(
        spark.createDataFrame(probes, "i string, ts timestamp_ntz, pid long"),
        spark.createDataFrame(values, "i string, ts timestamp_ntz, seq long, v double"),
        ["i"],
        direction=direction,
        take=["v", "seq"],
        hot_rows=hot_rows,
    ).collect()
    want = {}
    for i, t, pid in probes:
        if direction == "backward":
            fits = [(ts, s, v) for k, ts, s, v in values if k == i and ts <= t]
            want[pid] = max(fits)[2] if fits else None
        else:
            fits = [(ts, s, v) for k, ts, s, v in values if k == i and ts >= t]
            want[pid] = min(fits)[2] if fits else None
    assert {r.pid: r.v for r in got} == want


def test_null_key_is_hot_like_any(spark):
    df = spark.range(3000).select(F.lit(None).cast("string").alias("k"), F.col("id").alias("seq"))
    got = running(df, ["k"], ["seq"], {"n": Track("count", F.lit(1))}, block=F.expr("seq div 100"), hot_rows=10)
    assert got.where("n <> seq + 1").count() == 0 and got.count() == 3000
    blocks = mark_blocks(df, ["k"], ["seq"], 10, F.expr("seq div 100")).groupBy("k", "_block").count()
    assert blocks.agg(F.max("count")).first()[0] == 100


def test_blocks_of_one_day_have_equal_depth(spark):
    """All rows of one key on one day, most of them within one hour: eight blocks, the largest at most twice the mean."""
    seconds = F.when(F.col("id") % 10 == 0, F.col("id") % 86400).otherwise(36000 + F.col("id") % 3600)
    day = F.lit("2024-01-01").cast("timestamp")
    df = spark.range(80_000).select(F.lit("one").alias("k"), F.timestamp_seconds(F.unix_seconds(day) + seconds).alias("ts"), F.col("id").alias("seq"))
    df = df.unionByName(spark.range(50).select(F.lit("few").alias("k"), day.alias("ts"), F.col("id").alias("seq")))
    marked = mark_blocks(df, ["k"], ["ts", "seq"], 10_000)
    sizes = [r["count"] for r in marked.where("k = 'one'").groupBy("_block").count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 80_000 / 8 and min(sizes) > 0
    assert marked.where("k = 'few' and _block is not null").isEmpty()
    ends = marked.where("k = 'one'").groupBy("_block").agg(F.min(F.struct("ts", "seq")).alias("a"), F.max(F.struct("ts", "seq")).alias("b"))
    line = sorted((r._block, r.a, r.b) for r in ends.collect())
    assert all(x[2] < y[1] for x, y in zip(line, line[1:]))


def test_top_per_key(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id").repartition(6)
    got = top_per_key(df, ["k"], [F.desc("id")], 4, rank="r", salts=3).collect()
    assert {(r.k, r.id, r.r) for r in got} == {(i % 3, i, (499 - i) // 3 + 1) for i in range(488, 500)}
    assert {r.id for r in top_per_key(df, [], [F.desc("id")], 4).collect()} == {496, 497, 498, 499}


def test_without_hot_keys_rows_are_dealt_once(spark, monkeypatch):
    rows = [(i % 7 if i % 7 else None, i, i) for i in range(140)]
    df = spark.createDataFrame(rows, "k int, t int, v int")
    for buckets in (1 << 16, 1):  # one bucket holds all keys: these are then counted themselves
        monkeypatch.setattr(skew, "BUCKETS", buckets)
        assert skew.has_hot(df, ["k"], 19) and not skew.has_hot(df, ["k"], 20)
    tracks = {"s": skew.Track("sum", F.col("v"))}
    cool, hot = (skew.running(df, ["k"], ["t"], tracks, hot_rows=n) for n in (20, 19))
    plan = cool._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    assert sorted(map(tuple, cool.collect()), key=str) == sorted(map(tuple, hot.collect()), key=str)
