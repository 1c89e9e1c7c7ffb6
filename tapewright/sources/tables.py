"""Event tables derived from the sales and click tables, so that every operator runs on real rows.

Orders become order events, line items their fills, clickstream events the operations log. ``seq`` of order
events is a struct (phase, time, line, part, supplier): the line items carry no number that is unique and
ordered inside an order, and half of them ship before their order date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


TRANSIENT_AND_OTHER_STATES = (
    "PRE_INITIALIZED",
    "READY",
    "RUNNING",
    "STOPPED",
    "DEGRADED",
    "FAULTED",
    "DISPOSED",
    "STARTING",
    "HIBERNATING",
    "STOPPING",
)
ORDER_TYPES_SEEN = (
    "OrderInitialized",
    "OrderSubmitted",
    "OrderAccepted",
    "OrderPendingUpdate",
    "OrderPendingCancel",
    "OrderReleased",
    "OrderEmulated",
    "OrderFilled",
    "OrderRejected",
    "OrderSplit",
)
POSITION_TYPES_SEEN = ("PositionOpened", "PositionChanged", "PositionClosed", "AccountState", "Signal")
ACTIONS_SENT = ("pause", "resume", "flatten", "ping", "report", "fills", "orders", "explode")
CHANNELS = ("live", "sandbox", "logging")
REPORT_TOPICS = ("ops.report.positions", "ops.report.fills", "ops.report.orders")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: tuple[str, ...], index: Column) -> Column:
    """Element of a fixed list by a non-negative number."""
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index % len(names) + 1).cast("int"))


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


# --- orders and line items -----------------------------------------------------------------------


def order_id(key: Column) -> Column:
    return F.concat(F.lit("O"), _text(key))


def order_strategy(key: Column) -> Column:
    return F.concat(F.lit("Cls-S"), _text(key % 200))


def order_instrument(key: Column) -> Column:
    return F.concat(F.lit("I"), _text(key % 50), F.lit(".V"), _text(key % 5))


def order_buy_sell(key: Column) -> Column:
    return F.when(key % 2 == 0, "BUY").otherwise("SELL")


def priority_type(priority: Column) -> Column:
    return (
        F.when(priority == "1-URGENT", "MARKET")
        .when(priority == "2-HIGH", "LIMIT")
        .when(priority == "3-MEDIUM", "STOP_MARKET")
        .otherwise("STOP_LIMIT")
    )


def priority_tif(priority: Column) -> Column:
    return F.when(priority == "1-URGENT", "IOC").when(priority == "5-LOW", "DAY").otherwise("GTC")


def _seq(phase: int, ts: str, line: Column, part: Column, supp: Column) -> Column:
    return F.struct(
        F.lit(phase).alias("phase"),
        F.col(ts).alias("happened"),
        line.cast("int").alias("line"),
        part.cast("bigint").alias("part"),
        supp.cast("bigint").alias("supp"),
    )


def is_wide(key: Column) -> Column:
    """Some orders have quantities of very different size: their lines count in 10^24, 10^18 and 10^-11."""
    return key % 40 == 3


def initialized(orders: DataFrame) -> DataFrame:
    key, zero = F.col("o_orderkey"), F.lit(0)
    return orders.select(
        order_id(key).alias("client_order_id"),
        _seq(0, "o_orderdate", zero, zero, zero).alias("seq"),
        F.col("o_orderdate").alias("ts"),
        F.lit("OrderInitialized").alias("type"),
        order_strategy(key).alias("strategy_id"),
        order_instrument(key).alias("instrument_id"),
        order_buy_sell(key).alias("order_side"),
        priority_type(F.col("o_orderpriority")).alias("order_type"),
        priority_tif(F.col("o_orderpriority")).alias("time_in_force"),
        F.when(is_wide(key), F.concat(_text(2 + key % 10 * 2), F.lit("e24"))).otherwise(_text(20 + (key % 10) * 20)).alias("quantity"),
    )


def filled(lineitem: DataFrame) -> DataFrame:
    key = F.col("l_orderkey")
    price = F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).cast("decimal(26,8)")
    line, whole = F.col("l_linenumber"), _text(F.col("l_quantity").cast("decimal(26,8)"))
    power = F.when(line == 1, "e24").when(line == 2, "e18").when(line == 3, "e-11").otherwise("")
    tiny = is_wide(key) & (line == 3)
    return lineitem.select(
        order_id(key).alias("client_order_id"),
        _seq(1, "l_shipdate", F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")).alias("seq"),
        F.col("l_shipdate").alias("ts"),
        F.lit("OrderFilled").alias("type"),
        order_strategy(key).alias("strategy_id"),
        order_instrument(key).alias("instrument_id"),
        order_buy_sell(key).alias("order_side"),
        F.when(is_wide(key), F.concat(whole, power)).otherwise(whole).alias("last_qty"),
        F.when(~tiny, _text(price)).alias("last_px"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("commission"),
    )


def canceled(orders: DataFrame) -> DataFrame:
    key, zero = F.col("o_orderkey"), F.lit(0)
    return orders.where(F.col("o_orderstatus") == "F").select(
        order_id(key).alias("client_order_id"),
        _seq(2, "o_orderdate", zero, zero, zero).alias("seq"),
        F.col("o_orderdate").alias("ts"),
        F.lit("OrderCanceled").alias("type"),
        order_strategy(key).alias("strategy_id"),
    )


def order_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed order events: initialized, filled, canceled."""
    orders = table(spark, sf_dir, "orders")
    events = initialized(orders).unionByName(filled(table(spark, sf_dir, "lineitem")), allowMissingColumns=True)
    events = events.unionByName(canceled(orders), allowMissingColumns=True)
    return events.withColumn("topic", F.lit("events.order.V1"))


def order_log(events: DataFrame) -> DataFrame:
    """The same events as raw log entries with JSON payloads; numbers travel as text."""
    payload = F.to_json(
        F.struct(
            "type",
            "strategy_id",
            "client_order_id",
            "instrument_id",
            "order_side",
            "order_type",
            "time_in_force",
            _text("quantity").alias("quantity"),
            _text("last_qty").alias("last_qty"),
            _text("last_px").alias("last_px"),
        )
    )
    return events.select(
        F.concat(F.lit("trader-T"), F.substring_index("strategy_id", "-S", -1), F.lit(":stream")).alias("stream_key"),
        "seq",
        "ts",
        F.lit("events.order.V1").alias("topic"),
        payload.alias("payload"),
    )


def text_seq() -> Column:
    """``seq`` of order events as a text that sorts the same way, for readers that want a plain column."""
    return F.concat_ws(
        "-",
        _text("seq.phase"),
        F.date_format("seq.happened", "yyyyMMddHHmmss"),
        F.lpad(_text("seq.line"), 3, "0"),
        F.lpad(_text("seq.part"), 15, "0"),
        F.lpad(_text("seq.supp"), 15, "0"),
    )


def live_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations log and order log in one."""
    orders = order_log(order_events(spark, sf_dir)).withColumn("seq", text_seq())
    ops = ops_log(spark, sf_dir).withColumn("seq", F.lpad(_text("seq"), 20, "0"))
    return orders.unionByName(ops)


def order_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with nested options, prices as text and book-keeping flags."""
    key, priority = F.col("o_orderkey"), F.col("o_orderpriority")
    price = _text(F.col("o_totalprice").cast("decimal(18,2)"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        order_id(key).alias("client_order_id"),
        order_strategy(key).alias("strategy_id"),
        order_instrument(key).alias("instrument_id"),
        order_buy_sell(key).alias("side"),
        F.lit(None).cast("string").alias("order_side"),
        priority_type(priority).alias("order_type"),
        priority_tif(priority).alias("time_in_force"),
        F.when(key % 3 == 0, "true").when(key % 3 == 1, "false").alias("post_only"),
        F.when(key % 4 == 0, "true").otherwise("false").alias("reduce_only"),
        _text(20 + (key % 10) * 20).alias("quantity"),
        # Top-level price is missing, empty or zero for most orders; limit orders then have one in the options.
        F.when(key % 7 == 0, price).when(key % 7 == 1, "").when(key % 7 == 2, "0").alias("price"),
        F.when(priority == "2-HIGH", price).alias("option_price"),
        F.when(priority == "3-MEDIUM", price).alias("trigger_price"),
        F.when(priority == "3-MEDIUM", "LAST_PRICE").alias("trigger_type"),
        F.when(priority == "1-URGENT", F.when(key % 2 == 0, "OrderDenied").otherwise("OrderRejected"))
        .when(key % 3 == 0, "OrderAccepted")
        .otherwise("OrderFilled")
        .alias("type"),
        F.when(priority == "1-URGENT", F.concat(F.lit("REFUSED_"), priority)).alias("reason"),
        (F.col("o_orderstatus") != "F").alias("is_open"),
        (key % 5 == 0).alias("is_emulated"),
        "o_orderdate",
    )


def position_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position events of customers: one per order, closed by orders of status F."""
    key = F.col("o_orderkey")
    pnl = (F.col("o_totalprice") / 100).cast("decimal(18,4)")
    closed = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("P"), _text("o_custkey")).alias("position_id"),
        F.struct(F.col("o_orderdate").alias("happened"), key.alias("number")).alias("seq"),
        F.col("o_orderdate").alias("ts"),
        F.when(closed, "PositionClosed").when(F.col("o_orderstatus") == "O", "PositionOpened").otherwise("PositionChanged").alias("type"),
        F.concat(F.lit("S"), _text(F.col("o_custkey") % 200)).alias("strategy_id"),
        F.concat(F.lit("I"), _text(F.col("o_custkey") % 50), F.lit(".V"), _text(F.col("o_custkey") % 5)).alias("instrument_id"),
        F.concat(F.lit("V"), _text(F.col("o_custkey") % 5)).alias("venue"),
        F.when(F.col("o_custkey") % 2 == 0, "USDT").otherwise("BTC").alias("currency"),
        F.when(closed, "FLAT").when(key % 2 == 0, "LONG").otherwise("SHORT").alias("side"),
        (20 + (key % 10) * 20).alias("quantity"),
        F.col("o_totalprice").alias("avg_px_open"),
        F.when(closed, F.col("o_totalprice")).alias("avg_px_close"),
        F.when(closed, pnl).otherwise(F.lit(0).cast("decimal(18,4)")).alias("realized_pnl"),
        F.when(~closed, pnl).otherwise(F.lit(0).cast("decimal(18,4)")).alias("unrealized_pnl"),
        F.when(~closed, F.col("o_totalprice").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)")).alias("exposure"),
    )


# --- clickstream events --------------------------------------------------------------------------


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the number inside their ``props``."""
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").withColumn("k", k)


def _by_kind(purchase: Column, view: Column, error: Column, signup: Column, other: Column) -> Column:
    kind = F.col("event_type")
    return (
        F.when(kind == "purchase", purchase)
        .when(kind == "view", view)
        .when(kind == "error", error)
        .when(kind == "signup", signup)
        .otherwise(other)
    )


def ops_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw operations log. Payloads range from missing and plain text to objects with odd field types."""
    user, k = _text("user_id"), F.col("k")
    trader = F.concat(F.lit("trader-T"), user)
    stream_key = _by_kind(
        F.concat(trader, F.lit(":stream")),
        F.concat(trader, F.lit(":stream:events.position.V1")),
        F.concat(trader, F.lit(":stream:data.SignalSpread")),
        F.concat(F.lit("ops:control:S"), user),
        F.concat(trader, F.lit(":instruments:I"), _text(k % 5)),
    )
    topic = _by_kind(*[F.lit(t) for t in ("events.order.V1", "events.position.V1", "events.system.C1", "ops.announce", "data.quotes.V1")])
    step = F.floor(k / 10).cast("int")
    type_ = _by_kind(
        _pick(ORDER_TYPES_SEEN, step),
        _pick(POSITION_TYPES_SEEN, step),
        F.lit("ComponentStateChanged"),
        F.lit("Announced"),
        F.lit("QuoteTick"),
    )
    strategy = F.concat(F.lit("Cls-S"), user)
    state = _pick(TRANSIENT_AND_OTHER_STATES, step)
    full = F.to_json(
        F.struct(type_.alias("type"), strategy.alias("strategy_id"), state.alias("state"), F.col("event_id"), F.lit(1).alias("ts_init"))
    )
    payload = (
        F.when(k % 10 == 0, F.lit(None).cast("string"))
        .when(k % 10 == 1, F.concat(F.lit("note "), _text(k)))
        .when(k % 10 == 2, F.concat(F.lit("["), _text(k), F.lit("]")))
        .when(k % 10 == 3, F.to_json(F.struct(F.lit("").alias("type"), strategy.alias("strategy_id"))))
        .when(k % 10 == 4, F.to_json(F.struct(type_.alias("type"), F.col("user_id").alias("strategy_id"), F.lit(7).alias("state"))))
        .when(k % 10 == 5, F.to_json(F.struct(type_.alias("type"), F.lit("").alias("strategy_id"), state.alias("state"))))
        .otherwise(full)
    )
    return clicks(spark, sf_dir).select(
        stream_key.alias("stream_key"), F.col("event_id").alias("seq"), "ts", topic.alias("topic"), payload.alias("payload")
    )


def announces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, user = F.col("k"), F.col("user_id")
    return (
        clicks(spark, sf_dir)
        .where(F.col("event_type") == "signup")
        .select(
            F.lit("ops:announce").alias("stream_key"),
            F.col("event_id").alias("seq"),
            F.when(k % 50 != 49, F.concat(F.lit("S"), _text(user))).alias("strategy_id"),
            F.when(k % 25 == 0, F.lit(None).cast("string"))
            .when(k % 7 == 0, "paper")
            .when(k % 2 == 0, "live")
            .otherwise("sandbox")
            .alias("mode"),
            F.when(k % 10 != 9, F.concat(F.lit("T"), _text(user % 40))).alias("trader_id"),
            F.when(k % 4 == 0, "1.226.0").when(k % 4 != 3, "1.227.0").alias("engine_version"),
            F.when(k % 3 != 2, F.when(k % 6 == 0, "2").otherwise("1")).alias("protocol_version"),
            "ts",
        )
    )


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control entries: objects, plain text and broken JSON, from three channels."""
    k, user = F.col("k"), F.col("user_id")
    action = _pick(ACTIONS_SENT, k)
    strategy = F.concat(F.lit("S"), _text(user))
    payload = (
        F.when(k % 11 == 10, F.concat(F.lit("{broken "), _text(k)))
        .when(k % 11 == 9, F.concat(F.lit(" "), action, F.lit(" ")))
        .when(k % 11 == 8, F.to_json(F.struct(F.lit("x").alias("note"))))
        .otherwise(F.to_json(F.struct(action.alias("action"), F.col("event_id").alias("ts"))))
    )
    return (
        clicks(spark, sf_dir)
        .where(F.col("event_type") == "click")
        .select(
            F.concat(F.lit("ops:control:"), strategy).alias("stream_key"),
            F.col("event_id").alias("seq"),
            "ts",
            strategy.alias("strategy_id"),
            _pick(CHANNELS, k).alias("channel"),
            (k % 13 != 0).alias("has_strategy"),
            payload.alias("payload"),
        )
    )


def report_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_side(spark, sf_dir, "click")


def report_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_side(spark, sf_dir, "view")


def _report_side(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return (
        clicks(spark, sf_dir)
        .where(F.col("event_type") == kind)
        .select(
            _pick(REPORT_TOPICS, F.col("k")).alias("topic"),
            F.concat(F.lit("S"), _text("user_id")).alias("strategy_id"),
            F.col("event_id").alias("seq"),
            "ts",
        )
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes per user with ten distinct spreads, zero among them."""
    ask = F.lit(100).cast("decimal(20,10)") + (F.col("k") % 10).cast("decimal(20,10)") / F.lit(20)
    return clicks(spark, sf_dir).select(
        F.concat(F.lit("I"), _text("user_id")).alias("instrument_id"),
        F.col("event_id").alias("seq"),
        "ts",
        F.lit(100).cast("decimal(20,10)").alias("bid"),
        ask.cast("decimal(20,10)").alias("ask"),
    )


def interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-interest readings per user at irregular times."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("I"), _text("user_id")).alias("instrument_id"), F.col("event_id").alias("seq"), "ts", "value"
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types, sides and states with a few nobody has heard of."""
    k = F.col("k")
    known = ("OrderFilled", "OrderCanceled", "OrderDenied", "PositionOpened", "PositionClosed", "Signal", "OrderSplit")
    return clicks(spark, sf_dir).select(
        "event_id",
        _pick(known, k).alias("type"),
        _pick(("BUY", "SELL", "LONG", "SHORT", "FLAT", "ODD"), k).alias("side"),
        _pick(TRANSIENT_AND_OTHER_STATES, k).alias("state"),
    )


def market_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of several types, order-book changes among them."""
    type_ = _by_kind(
        F.lit("QuoteTick"), F.lit(None).cast("string"), F.lit("OrderBookDelta"), F.lit("TradeTick"), F.lit("OrderBookDeltas")
    )
    return table(spark, sf_dir, "events").select("event_id", "ts", type_.alias("type"))


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as they may be written, and things that are none."""
    k, n = F.col("k"), _text("k")
    text = (
        F.when(k % 12 == 0, F.concat(n, F.lit("_000")))
        .when(k % 12 == 1, F.concat(n, F.lit("__000")))
        .when(k % 12 == 2, F.concat(F.lit("  "), n, F.lit(" ")))
        .when(k % 12 == 3, F.concat(n, F.lit("e3")))
        .when(k % 12 == 4, F.lit("nan"))
        .when(k % 12 == 5, F.lit("-inf"))
        .when(k % 12 == 6, F.concat(F.lit("x"), n))
        .when(k % 12 == 7, F.lit(""))
        .when(k % 12 == 8, F.concat(n, F.lit(".0f")))
        .when(k % 12 == 9, F.concat(F.lit("0x"), n))
        .when(k % 12 == 10, F.concat(n, F.lit(".25")))
        .otherwise(F.concat(F.lit("-."), n))
    )
    return clicks(spark, sf_dir).select("event_id", text.alias("text"))


def message_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as custom messages: objects with and without title and colour, and plain text."""
    turn = F.col("turn")
    topic_and_body = F.to_json(
        F.struct(
            F.when(turn % 2 == 0, F.col("role")).alias("title"),
            F.col("text").alias("text"),
            F.when(turn % 3 == 0, F.lit(255)).alias("color"),
        )
    )
    plain = F.concat(F.lit("note: "), F.col("text"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id",
        "turn",
        F.lit("ops.message").alias("topic"),
        F.when(turn % 4 == 3, plain).otherwise(topic_and_body).alias("payload"),
    )


def handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry in which handles end in one another: every nation, and some again behind ``X-``."""
    nation = table(spark, sf_dir, "nation")
    plain = nation.select(F.col("n_name").alias("strategy_id"), F.when(F.col("n_nationkey") % 2 == 0, "live").otherwise("sandbox").alias("mode"))
    longer = nation.where(F.col("n_nationkey") % 3 == 0).select(
        F.concat(F.lit("X-"), F.col("n_name")).alias("strategy_id"),
        F.when(F.col("n_nationkey") % 2 == 0, "sandbox").otherwise("live").alias("mode"),
    )
    return plain.unionByName(longer)


def handle_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ids of customers that end in such handles, or in a name that is none."""
    key = F.col("c_custkey")
    middle = F.when(key % 4 == 0, "").when(key % 4 == 1, "X-").when(key % 4 == 2, "Y-Z-").otherwise("X")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("C"), _text(key % 1000), F.lit("-"), middle, F.lit("NATION_"), _text("c_nationkey")).alias("strategy_id")
    )


# --- customers -----------------------------------------------------------------------------------


def _amount_text(amount: Column, currency: str) -> Column:
    return F.concat(_text(amount.cast("decimal(18,2)")), F.lit(f" {currency}"))


def balance_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored balances per customer; every tenth snapshot has a bad value, some repeat a currency."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    second = F.when(key % 10 == 0, F.lit("not-a-money")).when(key % 7 == 0, _amount_text(balance * 2, "USDT"))
    balances = F.create_map(
        F.lit("USDT"), _amount_text(balance, "USDT"), F.lit("XBT"), second.otherwise(_amount_text(balance * 3, "BTC"))
    )
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("T"), _text(key)).alias("trader_id"),
        F.col("c_mktsegment").alias("venue"),
        F.when(key % 17 != 3, balances).alias("balances"),
    )


def account_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account states of customers with three balances each, shared by 40 traders per venue."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")

    def entry(currency: str, factor: int) -> Column:
        total = (balance * factor).cast("decimal(18,2)")
        locked = (balance * 0).cast("decimal(18,2)") + F.lit(1).cast("decimal(18,2)")
        return F.struct(
            F.lit(currency).alias("currency"),
            _text(total).alias("total"),
            _text(locked).alias("locked"),
            _text(total - locked).alias("free"),
        )

    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("T"), _text(key % 40)).alias("trader_id"),
        F.col("c_mktsegment").alias("venue"),
        key.alias("seq"),
        F.array(entry("USDT", 1), entry("BTC", 2), entry("ETH", 3)).alias("balances"),
    )
