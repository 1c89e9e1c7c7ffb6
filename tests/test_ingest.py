from pyspark.sql import Row, functions as F

from tapewright.functions import amounts, values, vocab
from tapewright.operators import gates, ingest, labels
from tapewright.sources import log as logs


def log_of(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, topic string, payload string")
    return df.withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz")).withColumn("stream_key", F.lit("s"))


def test_topics(spark):
    keep = [
        "events.order.BINANCE",
        "events.position.BINANCE",
        "events.account.BINANCE",
        "events.system.DataEngine",
        "data.SignalCustom",
        "ops.report.positions",
    ]
    drop = ["data.quotes.BINANCE.LABUSDT-PERP", "data.trades.BINANCE.SOLUSDT-PERP", "data.bars.BINANCE.DOGEUSDT-PERP", None]
    got = ingest.forwarded_topics(log_of(spark, [(t, "{}") for t in keep + drop])).collect()
    assert [r.topic for r in got] == keep


def test_decoding_never_fails(spark):
    rows = [
        ("events.position.X", '{"type":"PositionOpened","side":"LONG"}'),
        ("a.b", "hello"),
        ("a.b", None),
        ("events.brand_new_topic", '{"some_new_field":"some_new_value"}'),
        ("a.b", "[1, 2]"),
        ("a.b", '{"type":"","strategy_id":5}'),
        ("a.b", '{"strategy_id":{"x":1}}'),
        ("a.b", '{"strategy_id":"S-1"}'),
        ("a.b", '{"type":"A","type":"B"}'),
    ]
    got = {r.seq: r for r in ingest.envelope(log_of(spark, rows)).drop("body").collect()}
    assert [got[i].decode_status for i in range(9)] == ["json", "raw", "null"] + ["json"] * 6
    assert [got[i].event_type for i in range(9)] == [
        "PositionOpened", "b", "b", "brand_new_topic", "b", "b", "b", "b", "B",
    ]
    assert [got[i].strategy_id for i in range(9)] == [None] * 7 + ["S-1", None]
    assert got[1].body_raw == "hello" and got[2].body_raw == ""


def test_binary_payloads(spark):
    raw = b"\x00\x01\x02\x03not-json"
    df = spark.createDataFrame([Row(topic="t", payload=bytearray(b)) for b in (b'{"a": 1}', raw, b"\xff" * 200)])
    got = ingest.decode(df).drop("body", "payload").collect()
    assert [r.decode_status for r in got] == ["json", "raw", "raw"]
    assert got[1].body_raw == raw.hex() and got[2].body_raw == "ff" * 200


def test_fields_of_bodies(spark):
    body = (
        '{"type":"AccountState","account_id":"A","event_id":"x","ts_init":1,"ts_event":2,"config":{"a":1},'
        '"balances":[{"currency":"USDT","total":"5","locked":"1","free":"4"},{"currency":"BTC","total":"2"}]}'
    )
    df = ingest.envelope(log_of(spark, [("events.account.X", body)]))
    assert ingest.without_noisy_keys(df).select(F.sort_array(F.map_keys("fields")).alias("k")).first().k == [
        "account_id", "balances", "type",
    ]
    rows = ingest.account_balances(df).select("account_id", "currency", "total", "locked").collect()
    assert [tuple(r) for r in rows] == [("A", "USDT", "5", "1"), ("A", "BTC", "2", None)]
    signal = '{"name":"WideSpread","data":7.5,"strategy_id":"S"}'
    assert ingest.signal_events(ingest.envelope(log_of(spark, [("data.SignalW", signal)]))).first().value == "7.5"


def test_numbers_and_money(spark):
    texts = ["8186.6", "1_000", "1__0", "_1", " 5 ", "1e3", "abc", "", None, "1.0f", "0x1p3", "nan", "inf", ".5", "5.", "1.5_0"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(values.safe_number("t").alias("n")).collect()

    def number(t):
        try:
            return None if t is None else float(t)
        except ValueError:
            return None

    assert [repr(r.n) for r in got] == [repr(number(t)) for t in texts]
    money = spark.createDataFrame([("10000.00 USDT",), ("100_000 USDT",), ("not-a-money",), (None,)], "t string")
    rows = money.select(values.money_amount("t").cast("double").alias("a"), values.money_currency("t").alias("c")).collect()
    assert [tuple(r) for r in rows] == [(10000.0, "USDT"), (100000.0, "USDT"), (None, None), (None, None)]


def test_times(spark):
    row = spark.range(1).select(
        values.millis_to_ts(F.lit("1700000000123")).cast("string").alias("ms"),
        values.nanos_to_ts(F.lit(1700000000123456789)).cast("string").alias("ns"),
    )
    assert tuple(row.first()) == ("2023-11-14 22:13:20.123", "2023-11-14 22:13:20.123456")


def test_gates(spark):
    kept = [
        "OrderFilled", "OrderCanceled", "OrderRejected", "OrderDenied", "OrderExpired", "OrderUpdated", "OrderTriggered",
        "PositionOpened", "PositionClosed", "Signal", "BrandNew", None,
    ]
    dropped = [*vocab.TRANSIENT_ORDER_EVENTS, *vocab.CHURN_EVENTS]
    df = spark.createDataFrame([(t, None) for t in kept + dropped], "type string, state string")
    assert [r.type for r in gates.type_gates(df).collect()] == kept
    states = ["RUNNING", "STOPPED", "DEGRADED", "FAULTED", "HIBERNATING", None]
    rows = [("ComponentStateChanged", s) for s in [*states, *vocab.TRANSIENT_COMPONENT_STATES]]
    rows += [("Signal", "READY"), (None, "READY")]
    got = [(r.type, r.state) for r in gates.type_gates(spark.createDataFrame(rows, "type string, state string")).collect()]
    assert got == [("ComponentStateChanged", s) for s in states] + [("Signal", "READY"), (None, "READY")]


def test_state_that_is_no_text_passes(spark):
    df = ingest.envelope(log_of(spark, [("events.system.X", '{"type":"ComponentStateChanged","state":7}')]))
    assert gates.type_gates(df.withColumn("state", gates.text_state())).count() == 1


def test_streams(spark):
    keys = [
        "trader-A-001:stream",
        "trader-A-002:stream",
        "trader-A-001:instruments:BTCUSDT-PERP.BINANCE",
        "trader-A-001:currencies:USDT",
        "trader-A-001:accounts:BINANCE-001",
        "trader-A-001:stream:events.order.X",
    ]
    log = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "stream_key string, seq long")
    assert [r.stream_key for r in logs.discover_streams(log).collect()] == keys[:2]
    skip = log.where(F.col("seq") == 0)
    assert [r.stream_key for r in logs.discover_streams(log, skip).collect()] == keys[1:2]


def test_cursors(spark):
    log = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "stream_key string, seq long")
    tails = logs.tail_cursors(log.where("stream_key = 'a' and seq < 3"))
    assert {(r.stream_key, r.seq) for r in logs.read_after(log, tails).collect()} == {("a", 3), ("a", 4), ("b", 0)}


def test_retention(spark):
    log = spark.range(1100).select(F.lit("ops:announce").alias("stream_key"), F.col("id").alias("seq"))
    log = log.withColumn("ts", F.timestamp_seconds(F.col("seq") * 60))
    assert logs.newest_entries(log.repartition(7)).agg(F.count("*"), F.min("seq")).first()[:] == (1000, 100)
    assert logs.recent_entries(log).agg(F.count("*"), F.min("seq")).first()[:] == (61, 1039)
    types = spark.createDataFrame([("OrderBookDelta",), ("OrderBookDeltas",), ("QuoteTick",), (None,)], "type string")
    assert [r.type for r in logs.without_types(types).collect()] == ["QuoteTick", None]


def test_messages(spark):
    topic, payload = labels.custom_message(F.lit("Risk"), F.lit("x" * 5000), F.lit(7))
    written = spark.range(1).select(F.col("id").alias("seq"), topic.alias("topic"), payload.alias("payload"))
    plain = spark.createDataFrame([(1, vocab.MESSAGE_TOPIC, "just text"), (2, vocab.MESSAGE_TOPIC, "{}"), (3, "other", "x")], "seq long, topic string, payload string")
    got = {r.seq: r for r in labels.read_messages(ingest.decode(written.unionByName(plain))).collect()}
    assert (got[0].title, len(got[0].text), got[0].color) == ("Risk", 5000, 7)
    assert (got[1].title, got[1].text, got[1].color) == ("Notice", "just text", None)
    assert (got[2].title, got[2].text) == ("Notice", "") and 3 not in got


def test_labels(spark):
    df = spark.createDataFrame([("OrderRejected", "BUY", "DEGRADED"), ("SwapSettled", "odd_lot", "RUNNING"), (None, None, None)], "type string, side string, state string")
    assert [tuple(r)[3:] for r in labels.with_labels(df).collect()] == [
        ("Order rejected", "Buy", "error", "warning"),
        ("Swap settled", "Odd lot", "info", "info"),
        (None, None, None, None),
    ]
    names = spark.createDataFrame([("SwapSettled", "Paid up")], "name string, label string")
    assert {r.type: r.title for r in labels.with_labels(df, names).collect()} == {"OrderRejected": "Order rejected", "SwapSettled": "Paid up", None: None}


def test_objects_behind_white_space(spark):
    rows = [("t", f'{space}{{"type":"A"}}') for space in ("", " ", "\n", "\t \r\n")] + [("t", '\n["type"]')]
    got = sorted(ingest.object_fields(log_of(spark, rows), ["type"]).collect(), key=lambda r: r.seq)
    assert [r.type for r in got] == ["A"] * 4 + [None]
    decoded = ingest.decode(log_of(spark, rows)).select("seq", ingest.is_object().alias("o")).collect()
    assert [r.o for r in sorted(decoded, key=lambda r: r.seq)] == [True] * 4 + [False]


def test_exact_quantities(spark):
    texts = ["8186.6", "1_000", "1__0", " 5 ", "1e3", "abc", "", None, "1.0f", "0x1", "nan", "inf"]
    df = amounts.with_amounts(spark.createDataFrame([(t,) for t in texts], "t string"), {"a": "t"})
    got = df.select(amounts.to_text("a").alias("n")).collect()
    assert [None if r.n is None else float(r.n) for r in got] == [8186.6, 1000.0, None, 5.0, 1000.0] + [None] * 7


def test_fields_in_one_parse(spark):
    rows = [
        ("t", '{"type":"A","quantity":5,"strategy_id":"S","extra":{"x":1}}'),
        ("t", '{"type":7,"strategy_id":5}'),
        ("t", '{"type":"A","type":"B","strategy_id":{"x":"S"}}'),
        ("t", '[{"type":"A"}]'),
        ("t", '"A"'),
        ("t", '{"type":"A", broken'),
        ("t", None),
    ]
    df = ingest.object_fields(log_of(spark, rows), ["type", "quantity"], text_only=["strategy_id"])
    got = sorted(df.collect(), key=lambda r: r.seq)
    assert [(r.type, r.quantity, r.strategy_id) for r in got] == [
        ("A", "5", "S"), ("7", None, None), ("B", None, None), *[(None, None, None)] * 4,
    ]


def test_one_value_takes_the_whole_payload(spark):
    """Text behind an object, a second value or a closed bracket makes a payload raw in both decoders."""
    good = ['{"type":"A"}', ' {"type":"A"} \n', '{"type":"A","x":"] [ } {"}']
    bad = ['{"type":"A"} trailing', '{"type":"A"}{"type":"B"}', '{"type":"A"},{"type":"B"}', '{"type":"A"}] [1', '{"type":"A"}]', '{"type":"A"']
    log = log_of(spark, [("t", p) for p in good + bad])
    fields = sorted(ingest.object_fields(log, ["type"]).collect(), key=lambda r: r.seq)
    assert [r.type for r in fields] == ["A"] * len(good) + [None] * len(bad)
    decoded = sorted(ingest.decode(log).select("seq", "decode_status", ingest.field("$.type").alias("type")).collect(), key=lambda r: r.seq)
    assert [(r.decode_status, r.type) for r in decoded] == [("json", "A")] * len(good) + [("raw", None)] * len(bad)
    texts = log_of(spark, [("t", p) for p in ("null", "7", '"x"', "[1, 2]", "", "1, 2", "1] [2")])
    states = [r.decode_status for r in sorted(ingest.decode(texts).select("seq", "decode_status").collect(), key=lambda r: r.seq)]
    assert states == ["json"] * 4 + ["raw"] * 3
