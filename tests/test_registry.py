from itertools import product

from pyspark.sql import functions as F

from tapewright.operators import registry as reg
from tapewright.sources import log as logs

ANNOUNCE = "seq long, strategy_id string, mode string, trader_id string, engine_version string, protocol_version string"


def announces(spark, *rows):
    return spark.createDataFrame([(i, *(list(r) + [None] * 5)[:5]) for i, r in enumerate(rows)], ANNOUNCE)


def as_dict(df):
    return {r.strategy_id: r.mode for r in df.collect()}


def test_latest_announce_wins(spark):
    df = announces(spark, ("FOO-001", "sandbox"), ("BAR-001", "live"), ("FOO-001", "live"), (None, "live"), ("FOO-001", None))
    assert as_dict(reg.latest_registry(df)) == {"FOO-001": "live", "BAR-001": "live"}


def test_incremental_read(spark):
    df = announces(spark, ("FOO-001", "sandbox"), ("BAR-001", "live", "T", "1", "1"), (None, "live"))
    rows, cursor = logs.read_announces(df, 0)
    assert [tuple(r) for r in rows.collect()] == [(1, "BAR-001", "live", "1", "1")] and cursor.first()[0] == 2
    rows, cursor = logs.read_announces(df, 2)
    assert rows.count() == 0 and cursor.first()[0] == 2
    rows, _ = logs.read_announces(df)
    assert rows.first().engine_version == ""


def test_traders_and_keys(spark):
    df = announces(spark, ("OLD-001", "live"), ("NEW-001", "live", "B"), ("N2", "live", "A"), ("N3", "live", "A"))
    assert {r.trader_id for r in logs.trader_ids(df).collect()} == {"A", "B"}
    assert [r.stream_key for r in logs.external_streams(df).collect()] == ["trader-A:stream", "trader-B:stream"]


def test_fallback(spark):
    log = spark.createDataFrame([("ops:control:FOO-001",), ("ops:control:GHOST-001",), ("ops:control:a:b",), ("trader-A:stream",)], "stream_key string")
    registry = spark.createDataFrame([("FOO-001", "live")], "strategy_id string, mode string")
    assert as_dict(reg.with_fallback(registry, log)) == {"FOO-001": "live", "GHOST-001": "sandbox", "a:b": "sandbox"}


def test_fanout(spark):
    df = announces(spark, ("FOO",), ("BAR",), ("FOO",), (None,))
    assert [r.strategy_id for r in reg.fanout_targets(df).collect()] == ["FOO", "BAR"]
    assert [r.strategy_id for r in reg.fanout_targets(df, limit=2).collect()] == ["FOO"]


def test_drift(spark):
    """Every pair of versions once per strategy, unless both are ours."""
    seen = [(f"S{n}", "live", None, engine, protocol) for n, (engine, protocol) in enumerate(product(("e1", "e2", None), ("p1", "p2", None)))]
    got = reg.drift_warnings(announces(spark, *seen * 3), "p1", "e1").collect()
    assert sorted(r.strategy_id for r in got) == sorted(s for s, _, _, e, p in seen if (e, p) != ("e1", "p1"))


HANDLES = ["".join(p) for n in (1, 2, 3) for p in product(("u", "v-", "w"), repeat=n)]


def test_routing_follows_the_rule(spark):
    """Ids and handles made of a few parts: the longest handle that ends an id behind a hyphen, or is the id."""
    modes = {h: ("live", "sandbox", "paper")[n % 3] for n, h in enumerate(HANDLES)}
    table = spark.createDataFrame(list(modes.items()), "strategy_id string, mode string")
    ids = sorted({f"{a}-{b}" for a in HANDLES[::3] for b in HANDLES[::5]} | set(HANDLES)) + ["", None, "zz"]
    rows = [(t, i) for i in ids for t in ("events.order.X", "ops.report.positions")]
    got = reg.route(spark.createDataFrame(rows, "topic string, strategy_id string"), table).collect()
    assert len(got) == len(rows)
    for r in got:
        fits = [h for h in modes if r.strategy_id and (r.strategy_id == h or r.strategy_id.endswith("-" + h))]
        best = max(fits, key=len) if fits else r.strategy_id or None
        assert r.handle == best
        scoped = r.topic.startswith("events.") and r.strategy_id
        assert r.channel == ("logging" if not scoped else "live" if modes.get(best) == "live" else "sandbox")


def test_channel_targets(spark):
    table = spark.createDataFrame([("L", "live"), ("S", "sandbox"), ("P", "paper")], "strategy_id string, mode string")
    names = {c: {r.strategy_id for r in reg.channel_targets(table, c).collect()} for c in ("live", "sandbox", "logging", None)}
    assert names == {"live": {"L"}, "sandbox": {"S"}, "logging": {"L", "S", "P"}, None: {"L", "S", "P"}}


def test_suffix_lookup_equals_theta_join(spark):
    ids = spark.range(300).select(F.concat_ws("-", F.lit("C"), F.col("id") % 7, F.lit("x"), F.col("id") % 5).alias("strategy_id"))
    handles = ["0", "x-1", "3-x-2", "C-4-x-3", "1-x", "-2", "x", "6-x-4", "4"]
    table = spark.createDataFrame([(h, "live") for h in handles], "strategy_id string, mode string")

    def resolve(i):
        fits = [h for h in handles if i == h or i.endswith("-" + h)]
        return max(fits, key=len) if fits else i

    got = {r.strategy_id: r.handle for r in reg.resolve_handles(ids, table).collect()}
    assert got == {i: resolve(i) for i in {f"C-{n % 7}-x-{n % 5}" for n in range(300)}}
