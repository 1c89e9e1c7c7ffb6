"""Exact amounts in three bands of 27 digits.

An amount is ``high * 10^18 + mid + low * 10^-36``: ``mid`` has eighteen digits before the point and nine behind it, ``low`` the 27
digits below, ``high`` the 27 above. Each band is a decimal with ten digits to spare, so bands add up one by one, in any order
and in any grouping - windows, aggregates and stored state alike - for ten billion amounts before one is carried over into the
next. Nearly all amounts have a middle band only; a missing band is NULL and costs nothing. Only what is shown,
compared or stored is carried over. Amounts of 10^45 or more and digits below 10^-36 have no band: such an amount goes as a DOUBLE
into ``rest``, so that it is rounded but never lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tapewright.functions import values

TYPES = {"low": "decimal(37,0)", "mid": "decimal(37,9)", "high": "decimal(37,0)", "rest": "double"}
TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in TYPES.items()) + ">"
LOWEST, WIDTH = -36, 81  # power of ten of the lowest digit, and digits of all bands

_PLAIN = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"
# Most numbers: they lie in the middle band.
_SHORT = r"^[+-]?\d{1,18}(\.\d{1,9})?$"


def _struct(**fields: Column) -> Column:
    """An amount; absent fields are NULL."""
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in TYPES.items()])


def zero() -> Column:
    return _struct(mid=F.lit(0))


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for ``value``, which is looked at once. Such parts run for the rows that get there only."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _wide(text: str) -> str:
    """SQL of the amount of any number: its digits laid out from the highest band to the lowest, and cut."""
    zeros = f"repeat('0', {WIDTH})"
    shift = f"r.power - r.behind + length(r.every) - length(rtrim('0', r.every)) - ({LOWEST})"
    laid = (
        f"case when q.digits = '' then {zeros} when q.shift >= 0 and length(q.digits) + q.shift <= {WIDTH} "
        f"then lpad(concat(q.digits, repeat('0', least(q.shift, {WIDTH}))), {WIDTH}, '0') end"
    )
    sign = "if(startswith(t, '-'), '-', '')"
    bands = {
        "low": "substring(d, 55, 27)",
        "mid": "concat(substring(d, 28, 18), '.', substring(d, 46, 9))",
        "high": "substring(d, 1, 27)",
    }
    fields = ", ".join(f"'{n}', nullif(cast(concat({sign}, {band}) as {TYPES[n]}), cast(0 as {TYPES[n]}))" for n, band in bands.items())
    amount = f"named_struct({fields}, 'rest', if(d is null, try_cast(t as double), cast(null as double)))"
    digits = f"named_struct('digits', ltrim('0', rtrim('0', r.every)), 'shift', {shift})"
    parts = (
        "named_struct('every', replace(substring_index(u, 'e', 1), '.', ''), "
        "'behind', if(contains(u, '.'), length(substring_index(substring_index(u, 'e', 1), '.', -1)), 0), "
        "'power', if(contains(u, 'e'), try_cast(substring_index(u, 'e', -1) as int), 0))"
    )
    body = _let("ltrim('+-', t)", "u", _let(parts, "r", _let(digits, "q", _let(laid, "d", amount))))
    finite = f"t rlike r'{_PLAIN}' and abs(try_cast(t as double)) < double('inf')"
    number = f"lower(if(trim({text}) rlike r'{values.NUMBER_PATTERN}', replace(trim({text}), '_', ''), null))"
    return _let(number, "t", f"if({finite}, {body}, null)")


def with_amounts(df: DataFrame, texts: dict[str, Column | str]) -> DataFrame:
    """Add an amount for each text; what is no finite number gives NULL."""
    given = {f"_x_{name}": F.col(text) if isinstance(text, str) else text for name, text in texts.items()}

    def amount(x: str) -> Column:
        none = ", ".join(f"'{n}', cast({x if n == 'mid' else 'null'} as {t})" for n, t in TYPES.items())
        return F.expr(f"case when {x} rlike r'{_SHORT}' then named_struct({none}) when {x} is not null then {_wide(x)} end")

    return df.withColumns(given).withColumns({name: amount(f"_x_{name}") for name in texts}).drop(*given)


def total(amount: Column, over=None) -> Column:
    """Sum of a column of amounts; NULLs count as zero."""
    sums = {n: F.sum(amount.getField(n)) for n in TYPES}
    return _struct(**(sums if over is None else {n: s.over(over) for n, s in sums.items()}))


# What follows takes names of columns that hold amounts: each is looked at several times.


def _combined(a: str, b: str, sign: str) -> Column:
    def field(n: str, t: str) -> str:
        added = f"cast(coalesce({a}.{n}, 0) {sign} coalesce({b}.{n}, 0) as {t})"
        return f"'{n}', if({a}.{n} is null and {b}.{n} is null, cast(null as {t}), {added})"

    return F.expr(f"named_struct({', '.join(field(n, t) for n, t in TYPES.items())})")


def plus(a: str, b: str) -> Column:
    """Sum of two amounts; NULL counts as zero."""
    return _combined(a, b, "+")


def minus(a: str, b: str) -> Column:
    """Difference of two amounts; NULL counts as zero."""
    return _combined(a, b, "-")


_E27, _E18 = "1" + "0" * 27 + "BD", "1" + "0" * 18 + "BD"


def _carried(a: str, sign: str = "") -> str:
    """SQL of the amount (or its negative) with its two lower bands between zero and their size: ``high`` has the sign of the whole."""
    low, mid, high = (f"{sign}coalesce({a}.{n}, cast(0 as {TYPES[n]}))" for n in ("low", "mid", "high"))
    first = f"named_struct('low', cast(pmod({low}, {_E27}) as decimal(27,0)), 'up', cast((({low}) - pmod({low}, {_E27})) div {_E27} as decimal(18,0)))"
    second = f"named_struct('low', p.low, 'mid', cast({mid} + cast(p.up * 0.000000001BD as decimal(27,9)) as {TYPES['mid']}))"
    third = (
        f"named_struct('low', q.low, 'mid', cast(pmod(q.mid, {_E18}) as decimal(27,9)), "
        f"'high', cast({high} + cast((q.mid - pmod(q.mid, {_E18})) div {_E18} as decimal(18,0)) as {TYPES['high']}))"
    )
    return f"transform(array({first}), p -> transform(array({second}), q -> {third})[0])[0]"


def _short(a: str) -> str:
    """SQL: whether the middle band alone is in use."""
    return f"({a} is not null and {a}.low is null and {a}.high is null and {a}.rest is null)"


def _wide_text(a: str) -> str:
    def digits(done: str) -> str:
        middle = "lpad(cast(cast(d.mid * 1000000000BD as decimal(27,0)) as string), 27, '0')"
        parts = (
            f"named_struct('w', ltrim('0', concat(cast(d.high as string), substring({middle}, 1, 18))), "
            f"'f', rtrim('0', concat(substring({middle}, 19, 9), lpad(cast(d.low as string), 27, '0'))))"
        )
        shown = "concat(if(x.w = '', '0', x.w), if(x.f = '', '', concat('.', x.f)))"
        return f"transform(array({done}), d -> transform(array({parts}), x -> {shown})[0])[0]"

    exact = f"if({_carried(a)}.high < 0, concat('-', {digits(_carried(a, '-'))}), {digits(_carried(a))})"
    return f"if({a}.rest is null, {exact}, cast(cast({exact} as double) + {a}.rest as string))"


def _mid(a: str) -> str:
    return f"coalesce({a}.mid, cast(0 as {TYPES['mid']}))"


def carried(a: str) -> Column:
    """The same amount with its lower bands carried over, for storing: stored amounts never use up the digits to spare."""
    fields = ", ".join(f"'{n}', cast(nullif(d.{n}, 0) as {TYPES[n]})" for n in ("low", "mid", "high"))
    done = f"transform(array({_carried(a)}), d -> named_struct({fields}, 'rest', {a}.rest))[0]"
    return F.expr(f"case when {_short(a)} then {a} when {a} is not null then {done} end")


def to_text(a: str) -> Column:
    """The amount as plain decimal text without needless zeros; with a rest the DOUBLE nearest to it, as text."""
    short = f"if({_mid(a)} = 0, '0', rtrim('.', rtrim('0', cast({_mid(a)} as string))))"
    return F.expr(f"case when {_short(a)} then {short} when {a} is not null then {_wide_text(a)} end")


def to_double(a: str) -> Column:
    """The DOUBLE nearest to the amount."""
    return F.expr(f"case when {_short(a)} then cast({_mid(a)} as double) when {a} is not null then cast({_wide_text(a)} as double) end")


def not_negative(a: str) -> Column:
    """Whether an amount is zero or more; with a rest the doubles decide."""
    wide = f"if({a}.rest is null, {_carried(a)}.high >= 0, cast({_wide_text(a)} as double) >= 0)"
    return F.expr(f"case when {_short(a)} then {_mid(a)} >= 0 when {a} is not null then {wide} end")
