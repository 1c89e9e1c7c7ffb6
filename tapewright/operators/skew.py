"""Ordered scans and top-k that stay correct and balanced when one key holds most of the rows.

* :func:`running` - running sums and first/last values along an order. A key with many rows is cut into blocks of about equal
  size along that order; each block is scanned on its own and receives the totals of the blocks before it.
* :func:`top_per_key` - first n rows per key in two steps, so that no task sees more than its share.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tapewright.functions import amounts

# Of a key with more rows than this no task holds more than a block. There are at most as many such keys as the table
# has millions of rows, so their list is small beside any executor's share of it.
HOT_ROWS = 1_000_000
# Sampled positions a block, and blocks of a key at most: its splitters are one array.
SAMPLES, MOST_BLOCKS, STEP = 256, 1024, 32
BUCKETS = 1 << 16  # counts by which hot keys are looked for at first

_BLOCK, _HOT, _SALT = "_block", "_hot", "_salt"


@dataclass(frozen=True)
class Track:
    """One running value: ``sum``, ``count`` and ``amount`` start at zero, ``first``/``last``/``max`` skip NULLs.

    ``amount`` adds up exact amounts (``functions.amounts``) band by band.
    """

    kind: str
    value: Column

    def over(self, window) -> Column:
        if self.kind == "sum":
            return F.coalesce(F.sum(self.value).over(window), F.lit(0))
        if self.kind == "amount":
            return amounts.total(self.value, window)
        if self.kind == "count":
            return F.count(self.value).over(window)
        if self.kind == "first":
            return F.first(self.value, ignorenulls=True).over(window)
        if self.kind == "last":
            return F.last(self.value, ignorenulls=True).over(window)
        return F.max(self.value).over(window)

    def total(self, position: Column) -> Column:
        """Value of a whole block; partial aggregation runs before the shuffle."""
        if self.kind == "sum":
            return F.sum(self.value)
        if self.kind == "amount":
            return amounts.total(self.value)
        if self.kind == "count":
            return F.count(self.value)
        if self.kind == "max":
            return F.max(self.value)
        known = F.when(self.value.isNotNull(), position)
        return F.min_by(self.value, known) if self.kind == "first" else F.max_by(self.value, known)

    def carry(self, name: str, window) -> Column:
        """Value of all earlier blocks."""
        kind = "sum" if self.kind == "count" else self.kind
        return Track(kind, F.col(name)).over(window)

    def merge(self, carried: Column, local: Column) -> Column:
        if self.kind in ("sum", "count"):
            return local + F.coalesce(carried, F.lit(0))
        if self.kind == "first":
            return F.coalesce(carried, local)
        if self.kind == "last":
            return F.coalesce(local, carried)
        return F.greatest(local, carried)


def _same(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])


def has_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> bool:
    """Whether any key has more than ``hot_rows`` rows; runs a job over the key columns.

    Rows are first counted by a hash of their key: where no count is larger, no key's is. Else keys are counted themselves.
    """

    def any_above(*by: Column | str) -> bool:
        counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
        return not counts.where(F.col("_rows") > hot_rows).isEmpty()

    return any_above(F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))) and any_above(*keys)


def splitters(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row for each key with more than ``hot_rows`` rows: positions along ``order`` that cut it into blocks of equal depth.

    The positions are quantiles of a sample of the key's own rows. A row is in the sample by the hash of its key and position, so
    every run takes the same; some hundred rows a block make blocks that differ by a few percent.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    hot = counts.withColumnsRenamed({k: f"_key_{k}" for k in keys})
    blocks = F.least(F.ceil(F.col("_rows") / hot_rows), F.lit(MOST_BLOCKS)).cast("int")
    share = F.least(F.lit(1.0), blocks * SAMPLES / F.col("_rows"))
    position = F.struct(*order)
    drawn = F.pmod(F.xxhash64(*keys, *order), F.lit(1 << 30)) < share * (1 << 30)
    sample = df.select(*keys, *order).join(F.broadcast(hot), _same(keys)).where(drawn)
    sample = sample.groupBy(*[f"_key_{k}" for k in keys]).agg(
        F.array_sort(F.collect_list(position)).alias("_all"), F.first(blocks).alias("_blocks")
    )
    cuts = F.expr("transform(sequence(1, greatest(_blocks - 1, 1)), i -> _all[cast(i * size(_all) div greatest(_blocks, 2) as int)])")
    return sample.select(*[f"_key_{k}" for k in keys], cuts.alias("_cuts"))


def _block_of(position: Column, cuts: Column) -> Column:
    """Number of cuts at or before a position: first among every ``STEP``-th cut, then among the few between two of these."""
    coarse = F.filter(cuts, lambda c, i: (i % STEP == STEP - 1) & (c <= position))
    after = F.size(coarse) * STEP
    return after + F.size(F.filter(F.slice(cuts, after + 1, STEP), lambda c: c <= position))


def mark_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], hot_rows: int = HOT_ROWS, block: Column | None = None) -> DataFrame:
    """Add ``_block``: the block of a row whose key is hot, NULL for all other rows. A NULL key may be hot like any.

    Blocks have about ``hot_rows`` rows each; ``block`` may name others, which must never decrease along ``order``.
    """
    if block is not None:
        hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
        hot = hot.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.lit(True).alias(_HOT))
        marked = df.join(F.broadcast(hot), _same(keys), "left").withColumn(_BLOCK, F.when(F.col(_HOT), block))
        return marked.drop(_HOT, *[f"_key_{k}" for k in keys])
    cuts = splitters(df, keys, order, hot_rows)
    marked = df.join(F.broadcast(cuts), _same(keys), "left")
    inside = F.when(F.col("_cuts").isNotNull(), _block_of(F.struct(*order), F.col("_cuts")))
    return marked.withColumn(_BLOCK, inside).drop("_cuts", *[f"_key_{k}" for k in keys])


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    tracks: dict[str, Track],
    *,
    block: Column | None = None,
    reverse: bool = False,
    exclusive: bool = False,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """Add one running value per track, per ``keys`` along ``order``.

    ``order`` has to be a total order inside a key. Hot keys are cut into blocks of equal depth, or into ``block``, which
    must never decrease along it. ``reverse`` scans from the end, ``exclusive`` leaves the current row out. A job looks for hot
    keys first: without any, plain windows over ``keys`` do, in one shuffle. A caller that knows that says ``hot_rows=None``.
    """
    if hot_rows is None or not has_hot(df, keys, hot_rows):
        ahead = W.partitionBy(*keys).orderBy(*[F.col(c).desc() if reverse else F.col(c).asc() for c in order])
        ahead = ahead.rowsBetween(W.unboundedPreceding, -1 if exclusive else W.currentRow)
        return df.select("*", *[t.over(ahead).alias(n) for n, t in tracks.items()])
    marked = mark_blocks(df, keys, order, hot_rows, block)

    def along(columns: Sequence[str]) -> list[Column]:
        return [F.col(c).desc() if reverse else F.col(c).asc() for c in columns]

    inner = W.partitionBy(*keys, _BLOCK).orderBy(*along(order))
    inner = inner.rowsBetween(W.unboundedPreceding, -1 if exclusive else W.currentRow)
    local = marked.select("*", *[t.over(inner).alias(f"_local_{n}") for n, t in tracks.items()])

    position = F.struct(*order)
    totals = (
        marked.where(F.col(_BLOCK).isNotNull())
        .groupBy(*keys, _BLOCK)
        .agg(*[_facing(t, reverse).total(position).alias(n) for n, t in tracks.items()])
    )
    outer = W.partitionBy(*keys).orderBy(*along([_BLOCK])).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(*keys, _BLOCK, *[t.carry(n, outer).alias(f"_carry_{n}") for n, t in tracks.items()])

    names = [*keys, _BLOCK]
    carried = carried.withColumnsRenamed({k: f"_key_{k}" for k in names})
    joined = local.join(carried, _same(names), "left")

    def merged(name: str, track: Track) -> Column:
        if track.kind == "amount":
            both = amounts.plus(f"_local_{name}", f"_carry_{name}")
            return F.when(F.col(f"_carry_{name}").isNull(), F.col(f"_local_{name}")).otherwise(both).alias(name)
        # A sum of sums has a wider decimal type than a sum; adding both would cost decimals.
        as_type = local.schema[f"_local_{name}"].dataType
        return track.merge(F.col(f"_carry_{name}").cast(as_type), F.col(f"_local_{name}")).alias(name)

    return joined.select(*df.columns, *[merged(n, t) for n, t in tracks.items()])


def _facing(track: Track, reverse: bool) -> Track:
    """Scanned from the end, the last value seen in a block is the one with the smallest position."""
    if not reverse or track.kind not in ("first", "last"):
        return track
    return Track("first" if track.kind == "last" else "last", track.value)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, *, rank: str | None = None, salts: int | None = None
) -> DataFrame:
    """First ``n`` rows per key (of everything when ``keys`` is empty), with their rank if asked for.

    Each key is ranked in as many slices as the session has shuffle partitions (or ``salts``), then once more.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not keys:
        few = df.orderBy(*order).limit(n)
        return few.withColumn(rank, F.row_number().over(W.orderBy(*order))) if rank else few
    by_salt = W.partitionBy(*keys, _SALT).orderBy(*order)
    few = (
        df.withColumn(_SALT, F.pmod(F.spark_partition_id(), F.lit(salts)))
        .withColumn("_rank", F.row_number().over(by_salt))
        .where(F.col("_rank") <= n)
        .drop(_SALT, "_rank")
    )
    final = W.partitionBy(*keys).orderBy(*order)
    top = few.withColumn("_rank", F.row_number().over(final)).where(F.col("_rank") <= n)
    return top.withColumnRenamed("_rank", rank) if rank else top.drop("_rank")
