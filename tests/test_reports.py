from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tapewright.functions import vocab
from tapewright.operators import orders, reports
from tapewright.sources import sinks

POSITION = (
    "position_id string, seq long, ts timestamp_ntz, type string, strategy_id string, instrument_id string, side string, quantity double, "
    "avg_px_open double, realized_pnl decimal(18,4), unrealized_pnl decimal(18,4), exposure decimal(18,4), venue string, currency string"
)
T0 = datetime(2024, 1, 1)


def positions(spark, rows):
    """``(position, minute, type, realized, unrealized)``; the rest is filled in."""
    from decimal import Decimal

    data = [
        (p, i, T0 + timedelta(minutes=m), t, "S", "BTCUSDT.BYBIT", "LONG", 1.0, 2.0, Decimal(str(r)), Decimal(str(u)), Decimal("5000"), "BYBIT", "USDT")
        for i, (p, m, t, r, u) in enumerate(rows)
    ]
    return spark.createDataFrame(data, POSITION)


def test_only_open_positions(spark):
    df = positions(spark, [("A", 0, "PositionOpened", 0, 1), ("B", 1, "PositionOpened", 0, 2), ("A", 2, "PositionClosed", 5, 0), ("B", 3, "PositionChanged", 0, 3)])
    got = reports.open_positions(df).collect()
    assert [(r.position_id, float(r.unrealized_pnl)) for r in got] == [("B", 3.0)]
    earlier = reports.open_positions(df, as_of=F.lit(T0 + timedelta(minutes=1)).cast("timestamp_ntz"))
    assert {r.position_id for r in earlier.collect()} == {"A", "B"}


def test_preferred_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "zzz int, quantity int, instrument_id int")
    assert reports.preferred_columns(df, vocab.POSITION_COLUMNS).columns == ["instrument_id", "quantity"]
    assert reports.preferred_columns(df.select("zzz"), vocab.POSITION_COLUMNS).columns == []


def test_account_pnl(spark):
    df = positions(spark, [("A", 0, "PositionClosed", 120.5, 0), ("B", 1, "PositionOpened", 0, -15)])
    pnl = reports.account_pnl(df)
    row = pnl.first()
    assert (float(row.realized), float(row.unrealized), float(row.net_exposure)) == (120.5, -15.0, 5000.0)
    block = reports.account_pnl_map(pnl).first().account_pnl
    assert float(block["realized"]["USDT"]) == 120.5 and float(block["net_exposure"]["USDT"]) == 5000.0
    assert reports.account_pnl(df.limit(0)).count() == 0


def fills(spark, n):
    return spark.range(n).select(
        F.lit("S").alias("strategy_id"), F.format_string("O%03d", "id").alias("client_order_id"), F.col("id").alias("seq"), F.lit("OrderFilled").alias("type"),
        F.lit("I").alias("instrument_id"), F.lit("BUY").alias("order_side"), F.lit(1).alias("last_qty"), F.lit(2).alias("last_px"), F.lit(None).cast("string").alias("commission"),
        F.lit(T0).cast("timestamp_ntz").alias("ts"),
    )


def test_preview(spark):
    got = reports.preview(reports.fills_report(fills(spark, 20)), [F.col("client_order_id")]).collect()
    assert len(got) == 12 and {(r.row_count, r.remaining) for r in got} == {(20, 8)}
    assert [r.client_order_id for r in sorted(got, key=lambda r: r.position)] == [f"O{i:03d}" for i in range(12)]
    few = reports.preview(reports.fills_report(fills(spark, 3)), [F.col("client_order_id")]).collect()
    assert {(r.row_count, r.remaining) for r in few} == {(3, 0)}


def test_summary_and_csv(spark, tmp_path):
    registry = spark.createDataFrame([("S", "live"), ("EMPTY", "sandbox")], "strategy_id string, mode string")
    report = reports.fills_report(fills(spark, 5))
    assert {(r.strategy_id, r.row_count) for r in reports.report_summary(report, registry).collect()} == {("S", 5), ("EMPTY", 0)}
    sinks.write_report(report, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 5 and "client_order_id" in back.columns
    assert reports.report_summary(report.limit(0), registry).agg(F.sum("row_count")).first()[0] == 0


def test_orders_report(spark):
    rows = [("O1", 0, "OrderInitialized", "10", None), ("O1", 1, "OrderFilled", None, "10"), ("O2", 0, "OrderInitialized", "10", None),
            ("O2", 1, "OrderFilled", None, "3"), ("O3", 0, "OrderInitialized", "10", None), ("O3", 1, "OrderCanceled", None, None),
            ("O4", 0, "OrderInitialized", "1", None), ("O5", 0, "OrderRejected", None, None)]
    df = spark.createDataFrame(rows, "client_order_id string, seq long, type string, quantity string, last_qty string")
    blanks = {c: F.lit(None).cast("string") for c in ("last_px", "order_side", "order_type", "time_in_force", "strategy_id", "instrument_id")}
    df = orders.readable_numbers(df.withColumns(blanks)).withColumn("ts", F.lit(T0).cast("timestamp_ntz"))
    got = {r.client_order_id: r.status for r in reports.orders_report(df).collect()}
    assert got == {"O1": "FILLED", "O2": "PARTIALLY_FILLED", "O3": "CANCELED", "O4": "ACCEPTED", "O5": "REJECTED"}
    log = spark.createDataFrame([("a", T0), ("b", T0)], "stream_key string, ts timestamp_ntz")
    pos = positions(spark, [("A", 0, "PositionOpened", 0, 0), ("B", 0, "PositionClosed", 0, 0), ("C", 99, "PositionClosed", 0, 0)])
    day = F.lit(T0).cast("timestamp_ntz")
    assert tuple(reports.daily_summary(pos, df, log).first()) == (1, 2, 2, 2)
    assert tuple(reports.daily_summary(pos, df, log, as_of=day).first()) == (1, 1, 2, 2)
    assert tuple(reports.daily_summary(pos.limit(0), df.limit(0), log.limit(0)).first()) == (0, 0, 0, 0)


def test_inventory(spark):
    keys = ["trader-A:stream", "trader-A:stream:events.order.X", "trader-A:stream:data.SignalW", "ops:control:S", "trader-A:instruments:I", "ops:control:S"]
    df = spark.createDataFrame([(k,) for k in keys], "stream_key string")
    assert [tuple(r) for r in reports.stream_inventory(df).collect()] == [
        ("ops:control:S", 2), ("trader-A:stream", 1), ("trader-A:stream:data.SignalW", 1), ("trader-A:stream:events.order.X", 1),
    ]
    assert reports.stream_inventory(df, contains="control").count() == 1


def test_periodic_snapshots(spark):
    rows = [("A", -90, "PositionOpened", 0, 1), ("A", 0, "PositionChanged", 0, 2), ("A", 31, "PositionChanged", 0, 3), ("A", 40, "PositionChanged", 0, 4),
            ("A", 100, "PositionClosed", 0, 0), ("B", 60, "PositionOpened", 0, 9), ("B", 61, "PositionClosed", 0, 9), ("C", 115, "PositionOpened", 0, 7)]
    got = reports.periodic_snapshots(positions(spark, rows), "2024-01-01 00:00:00", "2024-01-01 03:00:00").collect()
    want = set()
    for n in range(7):
        at = n * 30
        for p in "ABC":
            seen = [(i, r) for i, r in enumerate(rows) if r[0] == p and r[1] <= at]
            if seen and seen[-1][1][2] != "PositionClosed":
                want.add((T0 + timedelta(minutes=at), p, float(seen[-1][1][4])))
    assert {(r.snapshot_ts, r.position_id, float(r.unrealized_pnl)) for r in got} == want
