"""Values that small test tables do not show: tiny prices, huge products, running totals, missing settings."""

import random
from datetime import datetime
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F

from tapewright import session
from tapewright.functions import amounts
from tapewright.operators import orders, reports

EVENT = (
    "client_order_id string, seq long, type string, quantity string, last_qty string, last_px string, order_side string, order_type string, "
    "time_in_force string, instrument_id string, strategy_id string"
)


def progress(spark, fills):
    rows = [("o", i, "OrderFilled", None, q, p, None, None, None, "i", "s") for i, (q, p) in enumerate(fills)]
    events = orders.readable_numbers(spark.createDataFrame(rows, EVENT))
    return orders.final_progress(events).first(), orders.order_progress(events).orderBy(F.desc("seq")).first()


@pytest.mark.parametrize(
    "fills, vwap",
    [
        ([("1000000", "0.000000012345")], 1.2345e-8),
        ([("0.5", "0.000000000003"), ("1.5", "0.000000000003")], 3e-12),
        ([("1000000000000", "1200000000")], 1.2e9),
        ([("1000000000000", "1200000000"), ("1", "5")], (1.2e21 + 5) / (1e12 + 1)),
        ([("2", "3"), ("2", "nan"), ("4", "6")], 30 / 8),
    ],
)
def test_average_price_keeps_its_digits(spark, fills, vwap):
    for r in progress(spark, fills):
        assert r.vwap == pytest.approx(vwap, rel=1e-12)


@pytest.mark.parametrize("hot_rows", [2, 10**9])
def test_one_order_over_the_whole_range(spark, hot_rows):
    """Fills of 1e-12, 1e18 and 1e25 add up exactly; the last part of 1e-12 tells complete from incomplete."""
    total = "10000001000000000000000000.000000002001"
    fills = [("1e-12", "1"), ("1e18", "2.5"), ("1e25", "3"), ("0.000000001", None), ("0.000000000999", "1"), ("1e-12", "0")]
    rows = [("o", 0, "OrderInitialized", total, None, None, None, None, None, "i", "s")]
    rows += [("o", 1 + i, "OrderFilled", None, q, p, None, None, None, "i", "s") for i, (q, p) in enumerate(fills)]
    events = spark.createDataFrame(rows, EVENT)
    got = orders.order_progress(events, hot_rows=hot_rows).orderBy("seq").collect()
    filled, paid = Decimal(0), Decimal(0)
    with localcontext() as exact:
        exact.prec = 100
        for r, (q, p) in zip(got[1:], fills, strict=True):
            filled += Decimal(q)
            paid += Decimal(q) * Decimal(p or 0)
            assert Decimal(r.qty_filled) == filled and Decimal(r.remainder) == Decimal(total) - filled
            # A product is rounded once, to a double; sums of products are exact.
            assert float(r.notional) == pytest.approx(float(paid), rel=1e-15) and r.vwap == pytest.approx(float(paid / filled), rel=1e-15)
            assert r.is_complete == (filled >= Decimal(total) - Decimal("1e-9"))
    assert [r.is_complete for r in got] == [False, False, False, False, True, True, True]
    assert [r.after_complete for r in got] == [False] * 5 + [True] * 2
    final = orders.final_progress(events).first()
    assert (final.qty_filled, final.notional, final.vwap) == (got[-1].qty_filled, got[-1].notional, got[-1].vwap)


def test_amounts_in_any_order(spark):
    rng = random.Random(2)
    texts = [f"{rng.choice(['', '-'])}{rng.randrange(10 ** rng.randrange(1, 40))}e{rng.randrange(-36, 5)}" for _ in range(300)]
    texts += ["1_000.5", " 7 ", "nan", "-inf", "x", "", None, "1e99999999999", "00.50", "5.", "-.5e-3"]
    df = amounts.with_amounts(spark.createDataFrame([(t,) for t in texts], "t string").repartition(7), {"a": "t"})
    shown = df.select("t", amounts.to_text("a").alias("x"), amounts.to_double("a").alias("d"), amounts.not_negative("a").alias("n"), amounts.carried("a").alias("a"))
    shown = shown.withColumn("y", amounts.to_text("a"))
    sum_ = Decimal(0)
    with localcontext() as exact:
        exact.prec = 200
        for r in shown.collect():
            try:
                want = Decimal(r.t.strip().replace("_", ""))
                want = want if want.is_finite() and want.adjusted() < 300 else None
            except (ArithmeticError, AttributeError):
                want = None
            assert (r.x is None) == (want is None)
            if want is not None:
                sum_ += want
                assert Decimal(r.x) == want and r.d == float(want) and r.n == (want >= 0) and r.y == r.x
        total = df.agg(amounts.total(F.col("a")).alias("s")).select(amounts.to_text("s").alias("s")).first().s
        assert Decimal(total) == sum_


def test_amounts_beyond_the_bands_are_rounded_not_lost(spark):
    df = amounts.with_amounts(spark.createDataFrame([("1e60",), ("2e60",), ("5",), ("1e-40",)], "t string"), {"a": "t"})
    got = df.agg(amounts.total(F.col("a")).alias("s")).select(amounts.to_double("s").alias("d"), amounts.not_negative("s").alias("n")).first()
    assert got.d == pytest.approx(3e60) and got.n


def test_realized_pnl_is_a_running_total_per_cycle(spark):
    steps = [("Opened", 0), ("Changed", 10), ("Changed", 15), ("Closed", 20), ("Opened", 0), ("Changed", 7), ("Closed", 3), ("Opened", 0), ("Changed", 4)]
    rows = [("p", i, datetime(2024, 1, 1), f"Position{t}", Decimal(r), Decimal(0), Decimal(1), "V", "USD") for i, (t, r) in enumerate(steps)]
    kind = (
        "position_id string, seq long, ts timestamp_ntz, type string, realized_pnl decimal(18,4), unrealized_pnl decimal(18,4), "
        "exposure decimal(18,4), venue string, currency string"
    )
    got = reports.account_pnl(spark.createDataFrame(rows, kind)).first()
    assert got.realized == 20 + 3 + 4


def test_true_is_more_than_one_word(spark):
    rows = [("true", "1", True), ("True", "yes", True), ("1", "on", True), ("false", "0", False), ("", "False", False), (None, None, False)]
    df = spark.createDataFrame(rows, "post_only string, reduce_only string, want boolean")
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("order_type", "time_in_force", "known_type", "known_tif")})
    for r in df.select("want", orders.instruction().alias("i")).collect():
        assert r.i == (["post_only", "reduce_only"] if r.want else [])


def test_no_guess_for_a_shared_folder_on_a_cluster():
    assert session.default_folder("local[4]", "file:/w/").startswith("file:/w/")
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.default_folder(master, "file:/w")
