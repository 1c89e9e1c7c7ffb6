"""Account balances: latest totals, rebuilt balances, stored snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapewright.functions import values, vocab

ACCOUNT = ["trader_id", "venue"]


def balance_key(trader_id: Column | str, venue: Column | str, prefix: str = vocab.BALANCE_KEY_PREFIX) -> Column:
    return F.concat_ws(":", F.lit(prefix), trader_id, venue)


def latest_totals(accounts: DataFrame) -> DataFrame:
    """Latest total per currency of every account; ``balances`` is an array of texts per event."""
    rows = accounts.select(*ACCOUNT, "seq", F.inline("balances"))
    total = F.max_by("total", "seq").try_cast(values.MONEY)
    return rows.groupBy(*ACCOUNT, "currency").agg(total.alias("total"))


def rebuilt(totals: DataFrame) -> DataFrame:
    """Balances to start over with: nothing locked, everything free."""
    return totals.withColumns({"locked": F.lit(0).cast(values.MONEY), "free": F.col("total")})


def inconsistent(balances: DataFrame) -> DataFrame:
    """Quality check: balances whose parts do not add up."""
    return balances.where(F.col("total") - F.col("locked") != F.col("free"))


def serialized(totals: DataFrame) -> DataFrame:
    """One map per account: currency -> ``"<amount> <CURRENCY>"``. An account has one entry per currency."""
    entry = F.struct("currency", F.concat_ws(" ", F.col("total").cast("string"), "currency"))
    return totals.groupBy(*ACCOUNT).agg(F.map_from_entries(F.collect_list(entry)).alias("balances"))


def read_snapshot_json(text: Column | str) -> Column:
    """Stored JSON to a map of texts; NULL when it is no JSON object or a value is no text."""
    text = F.col(text) if isinstance(text, str) else text
    body = F.try_parse_json(text)
    as_variants = F.try_variant_get(body, "$", "map<string,variant>")
    all_text = F.forall(F.map_values(as_variants), lambda v: F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False)))
    return F.when(all_text, F.try_variant_get(body, "$", "map<string,string>"))


def parse_snapshots(snapshots: DataFrame) -> DataFrame:
    """Amounts per currency of stored snapshots, all or nothing.

    One value that is no money makes the whole snapshot unusable. The currency is the one in the value, not the
    key; if two values share one, the later wins. A snapshot is one row, so this needs no shuffle.
    """
    entries = F.map_values("balances")
    parsed = F.transform(
        entries, lambda v: F.struct(values.money_currency(v).alias("currency"), values.money_amount(v).alias("amount"))
    )
    usable = F.forall("_parsed", lambda m: m["currency"].isNotNull() & m["amount"].isNotNull())
    df = snapshots.withColumn("_parsed", parsed).where(F.col("_parsed").isNotNull() & usable)
    kept = df.select(*ACCOUNT, F.posexplode("_parsed").alias("_pos", "_money"), "_parsed")
    later = F.exists(
        F.slice("_parsed", F.col("_pos") + 2, F.size("_parsed")), lambda m: m["currency"] == F.col("_money.currency")
    )
    return kept.where(~later).select(*ACCOUNT, "_money.currency", "_money.amount")
