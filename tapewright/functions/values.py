"""Column expressions for values as they arrive on the wire."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F

# What a number may look like on the wire: single underscores between digits, exponent, nan and inf are fine.
NUMBER_PATTERN = (
    r"^[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?|(?i:nan|inf|infinity))$"
)
MONEY_PATTERN = r"^([+-]?[0-9_]*\.?[0-9]+) ([A-Z][A-Z0-9]*)$"

NOTIONAL = "decimal(26,8)"
MONEY = "decimal(38,18)"
# What rounding to eight decimals may take from a product for it to be kept in them.
FIXED_ERROR = 1e-9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def truthy(text: Column | str) -> Column:
    """The text itself, or NULL where it is empty."""
    return F.nullif(_col(text), F.lit(""))


def number_text(text: Column | str) -> Column:
    """The text without digit separators where it spells a number, else NULL."""
    trimmed = F.trim(_col(text))
    return F.when(trimmed.rlike(NUMBER_PATTERN), F.regexp_replace(trimmed, "_", ""))


def safe_number(text: Column | str) -> Column:
    """Text to DOUBLE; anything that is no number becomes NULL."""
    return number_text(text).try_cast("double")


def product_text(quantity: str, price: str) -> Column:
    """Quantity times price (names of DOUBLE columns) as text: with eight decimals where that costs no digits, else with all.

    A large product is a whole number; its digits come from three parts of 53 bits, as the text of a DOUBLE is rounded.
    """
    two53, two106 = f"{2**53}BD", f"{2**106}BD"
    parts = (
        "transform(array(abs(p)), s -> named_struct('high', floor(s / 8.112963841460668E31D), 's', s))[0]",
        "transform(array({0}), h -> named_struct('high', h.high, 'rest', h.s - cast(h.high as double) * 8.112963841460668E31D))[0]",
        "transform(array({0}), h -> named_struct('high', h.high, 'mid', floor(h.rest / 9007199254740992D), 'rest', h.rest))[0]",
    )
    split = parts[0]
    for part in parts[1:]:
        split = part.format(split)
    low = "cast(h.rest - cast(h.mid as double) * 9007199254740992D as bigint)"
    whole = (
        f"cast(cast(cast(h.high as decimal(10,0)) * {two106} as decimal(38,0)) + cast(cast(h.mid as decimal(17,0)) * {two53} as decimal(38,0)) "
        f"as decimal(38,0)) + cast({low} as decimal(19,0))"
    )
    large = f"concat(if(p < 0, '-', ''), cast(cast(transform(array({split}), h -> {whole})[0] as decimal(38,0)) as string))"
    fixed = f"transform(array(try_cast(p as {NOTIONAL})), f -> if(abs(cast(f as double) - p) <= abs(p) * {FIXED_ERROR!r}D, cast(f as string), cast(p as string)))[0]"
    shown = f"case when p is null then null when abs(p) >= 1e16D and abs(p) < 1e37D then {large} else coalesce({fixed}, cast(p as string)) end"
    return F.expr(f"transform(array({quantity} * {price}), p -> {shown})[0]")


def money_amount(text: Column | str) -> Column:
    """Amount of ``"<amount> <CURRENCY>"``, NULL when the text is no money."""
    number = F.regexp_extract(_col(text), MONEY_PATTERN, 1)
    return F.regexp_replace(number, "_", "").try_cast(MONEY)


def money_currency(text: Column | str) -> Column:
    """Currency code of ``"<amount> <CURRENCY>"``, NULL when the text is no money."""
    return truthy(F.regexp_extract(_col(text), MONEY_PATTERN, 2))


def starts_with_any(text: Column | str, prefixes: Iterable[str]) -> Column:
    text = _col(text)
    hit = F.lit(False)
    for prefix in prefixes:
        hit = hit | text.startswith(prefix)
    return hit


def not_in(value: Column | str, names: Iterable[str]) -> Column:
    """Deny list that lets NULL through: only a known name is refused."""
    return ~F.coalesce(_col(value).isin(*names), F.lit(False))


def label(value: Column | str, names: Mapping[str, object], default: Column) -> Column:
    """Look ``value`` up in a fixed table of names."""
    value = _col(value)
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), default)


def topic_leaf(topic: Column | str) -> Column:
    return F.substring_index(_col(topic), ".", -1)


def millis_to_ts(millis: Column | str) -> Column:
    """Epoch milliseconds, as text or number, to a timestamp."""
    return F.timestamp_millis(_col(millis).try_cast("bigint"))


def nanos_to_ts(nanos: Column | str) -> Column:
    """Epoch nanoseconds to a timestamp; keep the number itself where ties matter."""
    return F.timestamp_micros(F.floor(_col(nanos).try_cast("bigint") / F.lit(1000)).cast("bigint"))


def spread_bps(bid: Column | str, ask: Column | str) -> Column:
    """Spread over mid in basis points at a fixed scale; NULL unless the spread is positive."""
    bid, ask = _col(bid), _col(ask)
    spread = ask - bid
    # Operand types that leave the quotient more digits than are kept.
    twice = (spread * F.lit(20000)).try_cast("decimal(22,10)")
    bps = F.try_divide(twice, (ask + bid).try_cast("decimal(20,10)")).try_cast("decimal(20,10)")
    # Prices beyond these types: to the digits of a double.
    rough = F.try_divide(spread.cast("double") * 20000, ask.cast("double") + bid.cast("double")).try_cast("decimal(20,10)")
    return F.when(spread > 0, F.coalesce(bps, rough))


def floor_hour(ts: Column | str) -> Column:
    return F.date_trunc("hour", _col(ts)).cast("timestamp_ntz")


def right_labelled_hour(ts: Column | str) -> Column:
    """Label of the bucket ``(H-1, H]`` that holds ``ts``; a timestamp on the hour keeps its own."""
    ts = _col(ts)
    floor = floor_hour(ts)
    return F.when(ts == floor, floor).otherwise(floor + F.expr("interval 1 hour"))


def next_daily(now: Column | str, hh_mm: str) -> Column:
    """Next time of day ``hh_mm`` after ``now``; interval arithmetic carries it over the end of a month."""
    now = _col(now)
    hours, minutes = (int(x) for x in hh_mm.split(":", 1))
    today = F.date_trunc("day", now).cast("timestamp_ntz") + F.expr(f"interval {hours} hours {minutes} minutes")
    return F.when(today > now, today).otherwise(today + F.expr("interval 1 day"))
