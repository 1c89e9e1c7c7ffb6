"""Spreads of prices of any size."""

from pyspark.sql import functions as F

from tapewright.functions import values


def test_large_prices_have_a_spread(spark):
    quotes = [("6000000000", "6100000000"), ("99.9", "100.1"), ("100", "100"), ("5", "4"), (None, "4")]
    df = spark.createDataFrame(quotes, "bid string, ask string").select(*[F.col(c).cast("decimal(28,10)").alias(c) for c in ("bid", "ask")])
    got = [r.b for r in df.select(values.spread_bps("bid", "ask").cast("double").alias("b")).collect()]
    assert abs(got[0] - 1e8 * 20000 / 1.21e10) < 1e-9 and abs(got[1] - 20) < 1e-9 and got[2:] == [None] * 3
