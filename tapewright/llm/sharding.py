"""Sharding along a Hilbert curve: rows are ordered by several metadata dimensions at once and cut into equal runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapewright.llm.common import saved, table

BITS = 4  # of each dimension: 16 steps
SHARDS = 24


def curve(spark, dims: int, bits: int = BITS) -> DataFrame:
    """All cells of a grid with their place on the Hilbert curve: 2^(dims * bits) rows, a bound that no data changes.

    ``cell`` holds the coordinates, first dimension in the highest bits. The place comes from the usual bit
    transformation of coordinates: from the top bit down, exchange or invert the lower bits of the first axis, then
    Gray-decode and interleave.
    """

    def axis(c: Column, i) -> Column:
        return F.element_at(c, i + 1)

    def put(c: Column, i, v: Column) -> Column:
        return F.transform(c, lambda x, k: F.when(k == i, v).otherwise(x))

    start = F.array(*[F.shiftright(F.col("cell"), bits * (dims - 1 - d)).bitwiseAND((1 << bits) - 1) for d in range(dims)])
    steps = [(1 << q, i) for q in range(bits - 1, 0, -1) for i in range(dims)]
    frame = spark.range(1 << (dims * bits)).select(F.col("id").cast("int").alias("cell")).withColumn("axes", start)
    step = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(i).alias("i")) for q, i in steps])

    def turn(axes: Column, s: Column) -> Column:
        q, i = s["q"], s["i"]
        low = q - 1
        first, own = axis(axes, F.lit(0)), axis(axes, i)
        differ = first.bitwiseXOR(own).bitwiseAND(low)
        inverted = put(axes, F.lit(0), first.bitwiseXOR(low))
        exchanged = F.transform(
            axes, lambda x, k: F.when((k == 0) | (k == i), x.bitwiseXOR(differ)).otherwise(x)
        )
        return F.when(own.bitwiseAND(q) != 0, inverted).otherwise(exchanged)

    if steps:
        frame = frame.withColumn("axes", F.aggregate(step, F.col("axes"), turn))
    for d in range(1, dims):  # Gray code along the axes
        frame = frame.withColumn("axes", put(F.col("axes"), d, axis(F.col("axes"), F.lit(d)).bitwiseXOR(axis(F.col("axes"), F.lit(d - 1)))))
    flip = F.lit(0)
    last = axis(F.col("axes"), F.lit(dims - 1))
    for q in range(bits - 1, 0, -1):
        flip = F.when(last.bitwiseAND(1 << q) != 0, flip.bitwiseXOR((1 << q) - 1)).otherwise(flip)
    frame = frame.withColumn("flip", flip)
    place = F.lit(0)
    for q in range(bits - 1, -1, -1):
        for d in range(dims):
            bit = F.shiftright(axis(F.col("axes"), F.lit(d)).bitwiseXOR(F.col("flip")), q).bitwiseAND(1)
            place = F.shiftleft(place, 1).bitwiseOR(bit)
    return frame.select("cell", place.cast("int").alias("place"))


def _ordered(column: str, kind: T.DataType) -> Column:
    """A dimension's values in their order: numbers as doubles, all others as text."""
    return F.col(column).cast("double" if isinstance(kind, T.NumericType) else "string")


def _ranges(frame: DataFrame, n: Column) -> tuple[DataFrame, DataFrame]:
    """Of a frame that is sorted across its partitions: its rows with ``_hc_range``, and each range's ``_hc_start``, the sum
    of ``n`` before it, and ``_hc_total``. The second one has a row for each partition, whatever the data."""
    ranked = frame.withColumn("_hc_id", F.monotonically_increasing_id()).withColumn("_hc_range", F.shiftright("_hc_id", 33))
    sizes = ranked.groupBy("_hc_range").agg(n.alias("n"))
    before = W.orderBy("_hc_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "_hc_range",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_hc_start"),
        F.sum("n").over(W.partitionBy()).alias("_hc_total"),
    )
    return ranked, starts


def cut_values(rows: DataFrame, value: Column, steps: int) -> list[tuple]:
    """Values that cut a column into ``steps`` runs of about equal numbers of rows, by exact ranks: the first value of each
    step but the first, with its step, so at most ``steps - 1`` pairs.

    Equal values are counted first, so a frequent one costs one row. Values and counts are sorted by ranges, no task or window
    holds more than a range of distinct values. Nulls are left out; a value that holds several shares leaves the steps behind it empty.
    """
    counted = rows.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    ranked, starts = _ranges(saved(counted.repartitionByRange("v").sortWithinPartitions("v")), F.sum("n"))
    passed = W.partitionBy("_hc_range").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    ranked = ranked.withColumn("_hc_in", F.coalesce(F.sum("n").over(passed), F.lit(0))).join(F.broadcast(starts), "_hc_range")
    step = F.expr(f"((_hc_start + _hc_in) * {steps}L) div _hc_total")
    firsts = ranked.groupBy(step.alias("step")).agg(F.min("v").alias("v")).filter("step > 0")
    return [(r.v, r.step) for r in firsts.orderBy("step").collect()]


def _step(value: Column, cuts: list[tuple]) -> Column:
    """Step of a value, that of the last cut it reaches; a null is step 0."""
    reached = F.lit(0)
    for cut, step in cuts:
        reached = F.when(value >= F.lit(cut), F.lit(int(step))).otherwise(reached)
    return reached


def hilbert_shards(
    rows: DataFrame, dims: list[str], ties: list[str], shards: int = SHARDS, bits: int = BITS
) -> DataFrame:
    """``rows`` with ``shard`` and ``slot``: runs of the Hilbert order whose row counts differ by one at most.

    Every dimension is cut at exact quantiles of its whole column, numbers in their order and other values in that of
    their text, so a shard covers a part of each one's values and a filter on any of them skips shards (``shard_ranges``). Rows
    of one cell stand in the order of ``ties``, so equal texts of one cell stand together if a text checksum comes first;
    those of other metadata may stand elsewhere. A null stands before any value, rows equal in all ties count as
    interchangeable. No cell is gathered: the order is cut by ranges of cell *and* ties,
    which splits a cell of any size, and written to the shared folder; a row's rank is its place in its range plus
    the sizes of the ranges before. An empty table gives an empty result. ``rows`` keeps its columns; ones named
    ``shard`` or ``slot`` are replaced, and no name may begin with ``_hc_``.
    """
    rows = rows.drop("shard", "slot")
    values = {d: _ordered(d, rows.schema[d].dataType) for d in dims}
    cell = F.lit(0)
    for d in dims:
        cell = F.shiftleft(cell, bits).bitwiseOR(_step(values[d], cut_values(rows, values[d], 1 << bits)))
    places = curve(rows.sparkSession, len(dims), bits).select(F.col("cell").alias("_hc_cell"), F.col("place").alias("_hc_place"))
    placed = rows.withColumn("_hc_cell", cell).join(F.broadcast(places), "_hc_cell").drop("_hc_cell")
    order = ["_hc_place", *ties]
    ranges = saved(placed.repartitionByRange(*order).sortWithinPartitions(*order))
    ranked, starts = _ranges(ranges, F.count(F.lit(1)))
    ranked = ranked.withColumn("_hc_row", F.col("_hc_id").bitwiseAND((1 << 33) - 1))
    ranked = ranked.join(F.broadcast(starts), "_hc_range")
    ranked = ranked.withColumn("_hc_rank", F.col("_hc_start") + F.col("_hc_row"))
    ranked = ranked.withColumn("shard", F.expr(f"cast((_hc_rank * {shards}L) div _hc_total as int)"))
    # The first rank of a shard is the smallest r with r * shards div total = shard.
    first = F.expr(f"(shard * _hc_total + {shards - 1}L) div {shards}L")
    return ranked.withColumn("slot", F.col("_hc_rank") - first).select(*rows.columns, "shard", "slot")


def shard_ranges(sharded: DataFrame, dims: list[str]) -> DataFrame:
    """Smallest and largest value of each dimension by shard, nulls aside: what a reader prunes files with."""
    ends = [f(F.col(d)).alias(f"{n}_{d}") for d in dims for f, n in ((F.min, "min"), (F.max, "max"))]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), *ends)


def op10_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``rows``. ``grown_shard`` is null: the law is not ``key``."""
    docs = table(spark, sf_dir, "documents")
    raw = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = docs.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length(raw).cast("long") + 8).alias("size"),
        F.crc32(raw).alias("text_crc32"),
    )
    cut = hilbert_shards(rows, ["lang", "source", "size"], ["text_crc32", "doc_id"])
    return cut.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
