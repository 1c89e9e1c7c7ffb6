"""Packing of token sequences as a cutting-stock problem: a linear program over patterns of lengths, priced by a knapsack.

Every document's ids end with one end id. Runs of ``CAPACITY`` ids fill sequences of their own; what is left of a
document, its rest, is an item of fewer ids. The items are known by their histogram alone, which has one row a length
whatever the corpus holds. A pattern is a set of lengths that fills a sequence exactly; the linear program uses as many
patterns as the histogram allows, and a knapsack over the duals of the lengths proposes patterns until none is worth
it. Uses are rounded down, rests are dealt to them by their rank within a length, and what no pattern takes - at most
the rounding of one pattern a length - is laid end to end and cut freely.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapewright.llm.bpe import vocabulary_path
from tapewright.llm.common import FEW, saved, sized, spread, table

CAPACITY = 2048
END = 1  # id after each document
GAP = 1e-3  # the program ends this near to its bound
PIVOTS = 1000  # and after so many exchanges of the basis: a basis is a valid packing at any time
PRICED = 300  # patterns that a round of pricing adds


@dataclass
class Stock:
    """Patterns in use: ``uses`` sequences of each, with their lengths and copies."""

    uses: list[int]
    patterns: list[tuple[tuple[int, int], ...]]  # ((length, copies), ...) by falling length


def cheapest(costs: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack: the least cost of filling each room 0..capacity exactly, and the length that comes last in it."""
    by_length = np.full(capacity + 1, np.inf)
    by_length[lengths] = costs
    best = np.full(capacity + 1, np.inf)
    last = np.zeros(capacity + 1, np.int64)
    best[0] = 0.0
    for room in range(1, capacity + 1):
        sums = by_length[1 : room + 1] + best[room - 1 :: -1]
        at = int(sums.argmin())
        best[room], last[room] = sums[at], at + 1
    return best, last


def _filled(first: int, last: np.ndarray, capacity: int) -> tuple[tuple[int, int], ...]:
    counts = {first: 1}
    room = capacity - first
    while room:
        step = int(last[room])
        counts[step] = counts.get(step, 0) + 1
        room -= step
    return tuple(sorted(counts.items(), reverse=True))


class _Program:
    """Most patterns within the demand, by the simplex method with the basis inverse kept; columns come as they are priced."""

    def __init__(self, demand: np.ndarray):
        m = len(demand)
        # Tiny different amounts keep ties from going round in circles.
        self.demand = demand + 1e-7 * (1 + np.arange(m) * 0.6180339887 % 1)
        self.inverse = np.eye(m)
        self.level = self.demand.copy()
        self.basis = np.full(m, -1)  # -1: unused demand
        self.duals = np.zeros(m)
        self.rows: list[np.ndarray] = []
        self.copies: list[np.ndarray] = []
        self.pivots = 0

    def add(self, rows: np.ndarray, copies: np.ndarray) -> None:
        self.rows.append(rows)
        self.copies.append(copies)

    def joined(self) -> None:
        """The columns end to end, for one pass over all of them."""
        sizes = np.array([len(r) for r in self.rows])
        self.all_rows, self.all_copies, self.begin = np.concatenate(self.rows), np.concatenate(self.copies), np.cumsum(sizes) - sizes

    def worth(self) -> np.ndarray:
        """What one more use of each known column is worth."""
        return 1.0 - np.add.reduceat(self.duals[self.all_rows] * self.all_copies, self.begin)

    def enter(self, column: int) -> None:
        worth = 1.0 - float(self.duals[self.rows[column]] @ self.copies[column])
        step = self.inverse[:, self.rows[column]] @ self.copies[column]
        able = np.flatnonzero(step > 1e-9)
        ratio = self.level[able] / step[able]
        tied = able[ratio <= ratio.min() + 1e-12]
        out = int(tied[step[tied].argmax()])
        row = self.inverse[out] / step[out]
        self.level -= (theta := self.level[out] / step[out]) * step
        self.level[out] = theta
        self.duals = self.duals + worth * row
        step[out] = 0
        down, across = np.flatnonzero(np.abs(step) > 1e-12), np.flatnonzero(row)
        self.inverse[np.ix_(down, across)] -= np.outer(step[down], row[across])
        self.inverse[out] = row
        self.basis[out] = column
        self.pivots += 1

    def settle(self, limit: int) -> None:
        """Exchanges until no known column is worth it."""
        if self.rows:
            self.joined()
        while self.rows and self.pivots < limit:
            worth = self.worth()
            best = int(worth.argmax())
            if worth[best] <= 1e-9:
                return
            self.enter(best)

    def value(self) -> float:
        return float(self.level[self.basis >= 0].sum())


def cutting_stock(histogram: dict[int, int], capacity: int = CAPACITY, gap: float = GAP, pivots: int = PIVOTS) -> Stock:
    """Patterns that fill sequences of ``capacity`` exactly, within the number of items of each length.

    Lengths are 1 to capacity - 1. The columns known at first are pairs of lengths and one length many times; each round
    of pricing adds the cheapest patterns with each length. It ends when the value is within ``gap`` of the bound that the
    duals prove. Uses are rounded down; then each known pattern takes what is left, those with the largest part cut off
    first, and the few items still left are put together by subset sums.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return Stock([], [])
    counts = np.array([histogram[int(k)] for k in lengths], np.int64)
    place = {int(k): i for i, k in enumerate(lengths)}
    known: dict[tuple[tuple[int, int], ...], int] = {}
    program = _Program(counts.astype(float))

    def learn(pattern: tuple[tuple[int, int], ...]) -> None:
        if pattern not in known:
            known[pattern] = len(known)
            program.add(np.array([place[k] for k, _ in pattern]), np.array([float(n) for _, n in pattern]))

    for k in place:
        if 2 * k > capacity and capacity - k in place:
            learn(((k, 1), (capacity - k, 1)))
        if capacity % k == 0:
            learn(((k, capacity // k),))
    total = float(lengths @ counts) / capacity
    while True:
        program.settle(pivots)
        best, last = cheapest(np.maximum(program.duals, 0.0), lengths, capacity)
        value, least = program.value(), float(best[capacity])
        if not np.isfinite(least):  # no pattern at all
            return Stock([], [])
        bound = min(total, float(counts @ np.maximum(program.duals, 0.0)) / least) if least > 0 else total
        if value >= bound * (1 - gap) or least >= 1 - 1e-7 or program.pivots >= pivots:
            break
        through = np.maximum(program.duals, 0.0) + best[capacity - lengths]
        for i in np.argsort(through, kind="stable")[:PRICED]:
            if through[i] >= 1 - 1e-7:
                break
            learn(_filled(int(lengths[i]), last, capacity))
    order = [p for p, _ in sorted(known.items(), key=lambda item: item[1])]
    level = np.zeros(len(order))
    used = program.basis >= 0
    level[program.basis[used]] = np.maximum(program.level[used], 0.0)
    uses = np.floor(level + 1e-3).astype(np.int64)
    left = counts.copy()
    for i in np.flatnonzero(uses):  # rounding never takes more than there is
        rows, copies = program.rows[i], program.copies[i].astype(np.int64)
        uses[i] = min(int(uses[i]), int((left[rows] // copies).min()))
        left[rows] -= uses[i] * copies
    for i in np.argsort(uses - level, kind="stable"):
        rows, copies = program.rows[i], program.copies[i].astype(np.int64)
        more = int((left[rows] // copies).min())
        if more > 0:
            uses[i] += more
            left[rows] -= more * copies
    chosen = {p: int(u) for p, u in zip(order, uses, strict=True) if u}
    for pattern, more in _put_together({int(k): int(n) for k, n in zip(lengths, left, strict=True) if n}, capacity):
        chosen[pattern] = chosen.get(pattern, 0) + more
    return Stock(list(chosen.values()), list(chosen))


def _put_together(left: dict[int, int], capacity: int) -> Iterator[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns that hold no more of a length than there is, from the longest item left down, and their uses."""
    everything = (1 << capacity + 1) - 1
    for first in sorted(left, reverse=True):
        while left.get(first):
            # Bit r of reach: r ids can be filled with the lengths looked at so far, each within its number.
            reach, steps = 1 << first, []
            for k, n in sorted(left.items(), reverse=True):
                n = min(n - (k == first), capacity // k)
                if k > first or n <= 0 or first + k > capacity:
                    continue
                steps.append((k, n, reach))
                for _ in range(n):
                    grown = reach | reach << k & everything
                    if grown == reach:
                        break
                    reach = grown
                if reach >> capacity & 1:
                    break
            if not reach >> capacity & 1:
                break
            counts, room = {first: 1}, capacity
            for k, _, before in reversed(steps):
                while not before >> room & 1:
                    room -= k
                    counts[k] = counts.get(k, 0) + 1
            uses = min(left[k] // n for k, n in counts.items())
            for k, n in counts.items():
                left[k] -= uses * n
                if not left[k]:
                    del left[k]
            yield tuple(sorted(counts.items(), reverse=True)), uses


class Layout:
    """Where the item of a length and a rank stands: in a pattern's sequence, or in the run of items that is cut freely."""

    def __init__(self, histogram: dict[int, int], stock: Stock, capacity: int):
        self.capacity = capacity
        self.taken = np.zeros(capacity + 1, np.int64)
        parts: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, copies, offset
        sequence = 0
        for uses, pattern in zip(stock.uses, stock.patterns, strict=True):
            offset = 0
            for length, copies in pattern:
                parts.append((length, int(self.taken[length]), sequence, copies, offset))
                self.taken[length] += uses * copies
                offset += length * copies
            sequence += uses
        self.patterned = sequence
        parts.sort()
        self.length, self.first, self.sequence, self.copies, self.offset = np.array(parts, np.int64).reshape(-1, 5).T
        counts = np.zeros(capacity + 1, np.int64)
        for length, n in histogram.items():
            counts[length] = n
        left = (counts - self.taken) * np.arange(capacity + 1)
        self.start = np.cumsum(left) - left
        total = int(left.sum())
        # The run's sequences are full but for the last ones, whose sizes are the powers of two of what is left over.
        whole, over = divmod(total, capacity)
        sizes = [1 << b for b in range(over.bit_length() - 1, -1, -1) if over >> b & 1]
        self.whole = whole
        self.tail = whole * capacity + np.cumsum([0, *sizes])

    def in_pattern(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(whether a pattern takes the item, its sequence, its offset)"""
        inside = rank < self.taken[length]
        if not len(self.length):
            return inside, np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        wide = np.int64(max(int(self.first.max(initial=0)), int(rank.max(initial=0))) + 1)
        at = np.searchsorted(self.length * wide + self.first, length * wide + rank, side="right") - 1
        own = rank - self.first[at]
        turn, copy = np.divmod(own, self.copies[at])
        return inside, self.sequence[at] + turn, self.offset[at] + copy * length

    def cut(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """(start in the item, length, sequence of the run, offset) of the pieces of an item that no pattern takes."""
        at = int(self.start[length]) + (rank - int(self.taken[length])) * length
        end, out, begin = at + length, [], at
        while at < end:
            if at < self.whole * self.capacity:
                sequence, offset = divmod(at, self.capacity)
                stop = (sequence + 1) * self.capacity
            else:
                k = int(np.searchsorted(self.tail, at, side="right")) - 1
                sequence, offset, stop = self.whole + k, at - int(self.tail[k]), int(self.tail[k + 1])
            stop = min(stop, end)
            out.append((at - begin, stop - at, sequence, offset))
            at = stop
        return out


@functools.cache
def _encoders(path: str):
    """The library's tokenizer and, for the same vocabulary, its ranks in a faster library; kept for the worker's life."""
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    slow = Tokenizer.from_file(path)
    slow.no_padding()
    slow.no_truncation()
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    from tapewright.llm.bpe import byte_symbols

    byte_of = {s: b for b, s in enumerate(byte_symbols())}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in data["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return slow, fast


def token_ids(text: str, path: str) -> list[int]:
    """Ids as the tokenizers library gives them. Texts with very long pieces, which the faster library refuses, go to it itself."""
    slow, fast = _encoders(path)
    try:
        return fast.encode(text, allowed_special="all")
    except BaseException as refused:  # noqa: BLE001 - a panic of the native code is no Exception
        if isinstance(refused, KeyboardInterrupt | SystemExit | GeneratorExit):
            raise
        return slow.encode(text, add_special_tokens=False).ids


TOKENS = "part int, row_rank long, whole_before long, rest int, whole long, n long, ids binary"


def tokenised(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Compressed 32-bit ids of every document, with its rank among its partition's rows of equal rest, in the shared folder."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity, np.int64)
        whole_seen = np.zeros(capacity, np.int64)
        for batch in sized(batches):
            rows = []
            for t in batch.column("text").to_pylist():
                ids = np.array([*token_ids(t or "", path), end], "<u4")
                whole, rest = divmod(len(ids), capacity)
                rows.append((part, int(seen[rest]), int(whole_seen[rest]), rest, whole, len(ids), pa.compress(ids.tobytes(), "zstd", asbytes=True)))
                seen[rest] += 1
                whole_seen[rest] += whole
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), types, strict=True)]
            names = [c.split()[0] for c in TOKENS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *columns], ["key", *names])

    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return saved(slim.mapInArrow(run, f"key {kind}, {TOKENS}"))


def packed(
    docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", end: int = END
) -> DataFrame:
    """One row for each piece of a document's ids (the text's ids, then ``end``) and its place in a sequence.

    ``key``, ``start`` (ids of the document before the piece), ``length``, ``ids`` (of the piece), ``doc_tokens``, ``sequence_id``
    and ``offset``. Sequences are full or, a few at the end, as long as a power of two, so none needs padding. A null
    text counts as empty and has the end id alone; null and repeated keys are kept, each row for itself; an empty table
    gives no piece; other columns of ``docs`` play no part, whatever their names.

    No group is gathered: a row's rank among the rests of its length is its rank in its partition plus what the
    partitions before hold, a table of at most one row for each partition and length. That table is broadcast if it is
    small and joined by shuffle if not. The driver sees the histogram, at most ``capacity`` rows, and solves the program.
    """
    tokens = tokenised(docs, path, capacity, key, text, end)
    held = saved(tokens.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("rows"), F.sum("whole").alias("whole")))
    totals = held.groupBy("rest").agg(F.sum("rows").alias("rows"), F.sum("whole").alias("whole")).collect()
    histogram = {r.rest: r.rows for r in totals if r.rest}
    layout = Layout(histogram, cutting_stock(histogram, capacity), capacity)
    whole = np.zeros(capacity, np.int64)
    for r in totals:
        whole[r.rest] = r.whole
    first_whole = np.cumsum(whole) - whole
    wholes = int(whole.sum())

    before = W.partitionBy("rest").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = saved(
        held.select(
            "part",
            "rest",
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rank_start"),
            F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("whole_start"),
        )
    )
    starts = F.broadcast(starts) if starts.count() <= FEW else starts
    placed = tokens.join(starts, ["part", "rest"]).select(
        "key", "rest", "whole", "n", "ids", (F.col("rank_start") + F.col("row_rank")).alias("rank"), (F.col("whole_start") + F.col("whole_before")).alias("whole_rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest, full, n, rank, whole_rank = (
                batch.column(c).to_numpy().astype(np.int64) for c in ("rest", "whole", "n", "rank", "whole_rank")
            )
            inside, sequence, offset = layout.in_pattern(rest, rank)
            first = np.where(rest > 0, first_whole[rest], first_whole[0]) + whole_rank
            owner, start, length, where, at = [], [], [], [], []
            if full.any():  # runs that fill a sequence
                turn = spread(np.zeros(len(full), np.int64), full)
                owner.append(np.repeat(np.arange(len(full)), full))
                start.append(turn * capacity)
                length.append(np.full(len(turn), capacity))
                where.append(np.repeat(first, full) + turn)
                at.append(np.zeros(len(turn), np.int64))
            own = np.flatnonzero(inside & (rest > 0))
            owner.append(own)
            start.append(full[own] * capacity)
            length.append(rest[own])
            where.append(wholes + sequence[own])
            at.append(offset[own])
            loose = [(i, *piece) for i in np.flatnonzero(~inside & (rest > 0)) for piece in layout.cut(int(rest[i]), int(rank[i]))]
            i, s, k, q, o = np.array(loose, np.int64).reshape(-1, 5).T
            owner.append(i)
            start.append(full[i] * capacity + s)
            length.append(k)
            where.append(wholes + layout.patterned + q)
            at.append(o)
            owner, start, length, where, at = (np.concatenate(x) for x in (owner, start, length, where, at))
            order = np.lexsort((start, owner))
            owner, start, length, where, at = (x[order] for x in (owner, start, length, where, at))
            cells, now, ids = [], -1, b""
            held_ids = batch.column("ids")
            for o, s, k in zip(owner.tolist(), start.tolist(), length.tolist(), strict=True):
                if o != now:
                    now, ids = o, pa.decompress(held_ids[o].as_py(), 4 * int(n[o]), "zstd", asbytes=True)
                cells.append(ids[4 * s : 4 * (s + k)])
            out = [batch.column("key").take(pa.array(owner)), *(pa.array(x, pa.int64()) for x in (start, length)), pa.array(cells, pa.binary())]
            out += [pa.array(x, pa.int64()) for x in (n[owner], where, at)]
            yield pa.RecordBatch.from_arrays(out, ["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = docs.schema[key].dataType.simpleString()
    pieces = placed.mapInArrow(run, f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return pieces.withColumnRenamed("key", key)


def op11_cutting_stock(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 ids; ids are little-endian unsigned 32-bit numbers in ``ids`` of the operator."""
    pieces = packed(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
