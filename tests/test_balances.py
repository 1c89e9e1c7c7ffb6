from pyspark.sql import functions as F

from tapewright.operators import balances


def snapshots(spark, *maps):
    return spark.createDataFrame([(f"T{i}", "V", m) for i, m in enumerate(maps)], "trader_id string, venue string, balances map<string,string>")


def test_parse_is_all_or_nothing(spark):
    df = snapshots(
        spark,
        {"USDT": "10000.00 USDT", "BTC": "0.5 BTC"},
        None,
        {},
        {"USDT": "not-a-money"},
        {"USDT": "1 USDT", "BTC": "bad"},
        {"USDT": "12345"},
        {"KEY": "7 ETH"},
        {"A": "1 USDT", "B": "2 USDT"},
        {"USDT": "100_000 USDT"},
    )
    got = {(r.trader_id, r.currency, float(r.amount)) for r in balances.parse_snapshots(df).collect()}
    assert got == {("T0", "USDT", 10000.0), ("T0", "BTC", 0.5), ("T6", "ETH", 7.0), ("T7", "USDT", 2.0), ("T8", "USDT", 100000.0)}


def test_stored_json(spark):
    texts = ['{"USDT":"5 USDT"}', '{"USDT":5}', "[1]", "rot", None, "{}"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(balances.read_snapshot_json("t").alias("m")).collect()
    assert [r.m for r in got] == [{"USDT": "5 USDT"}, None, None, None, None, {}]


def test_totals_and_round_trip(spark):
    schema = "trader_id string, venue string, seq long, balances array<struct<currency string, total string, locked string, free string>>"
    rows = [("T", "V", 1, [("USDT", "9000", "0", "9000")]), ("T", "V", 2, [("USDT", "8000", "1000", "7000"), ("BTC", "0.25", "0", "0.25")])]
    totals = balances.latest_totals(spark.createDataFrame(rows, schema))
    assert {(r.currency, float(r.total)) for r in totals.collect()} == {("USDT", 8000.0), ("BTC", 0.25)}
    rebuilt = balances.rebuilt(totals)
    assert {(float(r.locked), r.free == r.total) for r in rebuilt.collect()} == {(0.0, True)}
    assert balances.inconsistent(rebuilt).count() == 0
    assert balances.inconsistent(rebuilt.withColumn("free", F.col("free") + 1)).count() == 2
    back = balances.parse_snapshots(balances.serialized(totals))
    assert {(r.currency, float(r.amount)) for r in back.collect()} == {("USDT", 8000.0), ("BTC", 0.25)}
    assert spark.range(1).select(balances.balance_key(F.lit("T"), F.lit("V"))).first()[0] == "ops:sandbox:balance:T:V"
