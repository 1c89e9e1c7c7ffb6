"""Spelling variants: words one edit apart, found in a trie of letter-group counts.

A word is a vector: how often each group of letters occurs in it. One edit changes the vector by a surplus of one in a
group, a deficit of one in a group, or both. The trie has one level a group; a search goes down from a word's own counts
and may spend one surplus and one deficit on its way. Words at the leaves it reaches are verified letter by letter.

The upper levels of the trie are dealt out: a word goes to the cell of its own first counts and, as a question, to the
cells that it may reach by spending on these. A cell with too many words is cut by the next levels; words that agree in
all groups are, if too many, compared through what is left of them without one letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import FEW, mixed, partitions, saved, spread, table

GROUPS = 12
TOP = 4  # levels that are dealt out at first
MORE = 4  # levels by which a large cell is cut
LIMIT = 50_000  # words of a cell that one task holds
HELD = 200_000  # words and questions that one search takes
CHECKED = 1 << 20  # letters that one comparison takes: its indices are many times as large, and two tasks share an executor
CROWDED = 64  # comparisons a word from which a leaf is searched by what is left without one letter
RATIO = 10  # a form occurs so many times as often
LEAST = 7
RUNS = f"([A-Za-z\\u00C0-\\u00FF]{{{LEAST},}})"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDITED = 31  # one run in so many loses a letter


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n``: lower-cased runs of Latin letters over whole texts, one in 31 without a letter, that occur twice at least.

    The checksum of key and run says which run loses which letter. A null key counts as empty there, a null text has no words.
    """
    low = F.translate(F.col(text), UPPER, LOWER)
    runs = docs.select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(low, F.lit(RUNS), F.lit(1))).alias("run")
    )
    hashed = runs.withColumn("h", F.crc32(F.encode(F.concat("k", F.lit(":"), "run"), "UTF-8")))
    cut = F.expr("concat(substr(run, 1, cast(h % length(run) as int)), substr(run, cast(h % length(run) as int) + 2))")
    words = hashed.select(F.when(F.col("h") % EDITED == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LEAST).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


# --- words as arrays


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words end to end, and where each begins (one more entry at the end)."""
    values = words.to_pylist()
    lengths = np.fromiter(map(len, values), np.int64, len(values))
    points = np.frombuffer("".join(values).encode("utf-32-le", "surrogatepass"), "<u4")
    return points, np.concatenate([[0], np.cumsum(lengths)])


def group_table(words: DataFrame, groups: int = GROUPS) -> np.ndarray:
    """Group of each code point: letters are dealt out by falling number in the words, always to the group with fewest so far.

    Letters are as many as the alphabet has, at most all code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            total += np.bincount(letters_of(batch.column("word"))[0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["letter", "n"])

    counts = words.select("word").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n")).collect()
    out = np.arange(0x110000, dtype=np.int64) % groups
    sums = [0] * groups
    for r in sorted(counts, key=lambda r: (-r.n, r.letter)):
        g = sums.index(min(sums))
        out[r.letter] = g
        sums[g] += r.n
    return out.astype(np.uint8)


def vectors_of(points: np.ndarray, starts: np.ndarray, of: np.ndarray, groups: int) -> np.ndarray:
    """Letter-group counts, one row for each word."""
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    return np.bincount(owner * groups + of[points], minlength=n * groups).reshape(n, groups)


def cells_of(cell: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Names of the cells below ``cell`` after the next counts, column by column."""
    for k in range(counts.shape[1]):
        cell = mixed(cell.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + counts[:, k].astype(np.int64).astype(np.uint64))
    return cell


# --- verification


def near(points: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of words: do they differ by exactly one inserted, deleted or replaced letter?

    Equal letters from the left and from the right must leave no more than one letter of the longer word between them.
    """
    out = np.zeros(len(a), bool)
    size = np.diff(starts)
    longer, shorter = np.maximum(size[a], size[b]), np.minimum(size[a], size[b])
    order = np.flatnonzero(longer - shorter <= 1)
    order = order[np.argsort(longer[order], kind="stable")]
    padded = np.concatenate([points, np.zeros(1, points.dtype)])
    at = 0
    while at < len(order):
        width = int(longer[order[at]])
        stop = at + max(1, CHECKED // max(width, 1))
        part = order[at:stop]
        while len(part) > 1 and int(longer[part[-1]]) * len(part) > 2 * CHECKED:  # far longer words than the first
            part = part[: len(part) // 2]
        at += len(part)
        width = int(longer[part[-1]])
        x, y, short = a[part], b[part], shorter[part]
        step = np.arange(width)
        inside = step[None, :] < short[:, None]

        def agree(left: np.ndarray, right: np.ndarray, inside=inside) -> np.ndarray:
            same = padded[np.minimum(left, len(points))] == padded[np.minimum(right, len(points))]
            return np.where(inside & ~same, 0, 1).cumprod(1, dtype=np.int8)

        front = (agree(starts[x][:, None] + step, starts[y][:, None] + step) * inside).sum(1)
        back_x, back_y = starts[x + 1][:, None] - 1 - step, starts[y + 1][:, None] - 1 - step
        back = (agree(np.maximum(back_x, 0), np.maximum(back_y, 0)) * inside).sum(1)
        out[part] = (front + back >= longer[part] - 1) & (front < longer[part])
    return out


def without_one(points: np.ndarray, starts: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, words, hashes of the words without the letter there): ``words`` are indices of words of one length."""
    width = int(starts[words[0] + 1] - starts[words[0]])
    for lo in range(0, len(words), max(1, CHECKED // max(width, 1))):
        own = words[lo : lo + max(1, CHECKED // max(width, 1))]
        letters = points[starts[own][:, None] + np.arange(width)].astype(np.uint64)
        powers = np.cumprod(np.full(width + 1, 0x100000001B3, np.uint64))
        here = (mixed(letters + np.uint64(1)) * powers[:width]).cumsum(1, dtype=np.uint64)  # letters at their own place
        left = (mixed(letters + np.uint64(1)) * np.concatenate([[np.uint64(1)], powers[: width - 1]])).cumsum(1, dtype=np.uint64)
        for k in range(width):  # what stands right of the letter moves one place to the left
            head = here[:, k - 1] if k else np.zeros(len(own), np.uint64)
            yield k, own, head + left[:, -1] - left[:, k]


def crowded_pairs(points: np.ndarray, starts: np.ndarray, asking: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate pairs between words whose lengths are equal, or one more in ``asked``, by equal hashes without one letter."""
    size = np.diff(starts)
    left, right = [], []

    def joined(ka: np.ndarray, a: np.ndarray, kb: np.ndarray, b: np.ndarray) -> None:
        order = np.argsort(kb, kind="stable")
        lo, hi = np.searchsorted(kb[order], ka), np.searchsorted(kb[order], ka, side="right")
        left.append(np.repeat(a, hi - lo))
        right.append(b[order[spread(lo, hi - lo)]])

    if size[asked[0]] == size[asking[0]]:
        by_place: dict[int, list] = {}
        for k, own, h in without_one(points, starts, asked):
            by_place.setdefault(k, []).append((h, own))
        for k, own, h in without_one(points, starts, asking):
            joined(h, own, np.concatenate([x for x, _ in by_place[k]]), np.concatenate([x for _, x in by_place[k]]))
    else:
        width = int(size[asking[0]])
        powers = np.cumprod(np.full(width, 0x100000001B3, np.uint64))
        letters = points[starts[asking][:, None] + np.arange(width)].astype(np.uint64)
        whole = (mixed(letters + np.uint64(1)) * powers).sum(1, dtype=np.uint64)
        for _, own, h in without_one(points, starts, asked):
            joined(whole, asking, h, own)
    return np.concatenate(left), np.concatenate(right)


# --- search


def search(points, starts, vectors, cell, own, fresh, spent) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of words one edit apart: questions (and ``fresh`` own words) go down the trie of the ``own`` words.

    ``cell`` names where each row stands, ``vectors`` has the counts of the levels below. Of a pair's two vectors the one with the smaller
    count where they first differ asks, so a pair is found once: a search spends its surplus first, then its deficit.
    """
    held = np.flatnonzero(own)
    if not len(held):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    levels = vectors.shape[1]
    held = held[np.lexsort((*vectors[held].T[::-1], cell[held]))]
    # Node of each held word at each level, and for each level the sorted keys (node, count) of its children.
    tops, node = np.unique(cell[held], return_inverse=True)
    keys, wide = [], int(vectors.max(initial=0)) + 3
    for k in range(levels):
        key, node = np.unique(node * wide + vectors[held, k] + 1, return_inverse=True)
        keys.append(key)
    leaf = np.searchsorted(node, np.arange(node[-1] + 2))  # the words of a leaf stand together

    asks = np.flatnonzero(~own | fresh)
    at = np.searchsorted(tops, cell[asks])
    known = (at < len(tops)) & (tops[np.minimum(at, len(tops) - 1)] == cell[asks])
    stack = [(0, asks[known], at[known], spent[asks[known]].astype(np.int8))]
    left, right = [], []
    position = np.full(len(cell), -1)
    position[held] = np.arange(len(held))

    def verified(a: np.ndarray, b: np.ndarray) -> None:
        ok = near(points, starts, a, b)
        left.append(a[ok])
        right.append(b[ok])

    while stack:
        level, who, where, gone = stack.pop()
        if len(who) > HELD:
            half = len(who) // 2
            stack += [(level, who[:half], where[:half], gone[:half]), (level, who[half:], where[half:], gone[half:])]
            continue
        if level == levels:
            order = np.argsort(where, kind="stable")
            who, where, gone = who[order], where[order], gone[order]
            n, n_asks = np.diff(leaf)[where], np.bincount(where, minlength=len(leaf) - 1)[where]
            crowd = n * n_asks > CROWDED * (n + n_asks)
            for x in np.unique(where[crowd]):
                lo, hi = np.searchsorted(where, x), np.searchsorted(where, x, side="right")
                members = held[leaf[x] : leaf[x + 1]]
                for state in (0, 1, 2):  # those of one state have one length
                    ask = who[lo:hi][gone[lo:hi] == state]
                    if len(ask):
                        a, b = crowded_pairs(points, starts, ask, members)
                        keep = (position[a] < position[b]) | (state != 0)
                        pair = np.unique(a[keep] * len(cell) + b[keep])
                        verified(pair // len(cell), pair % len(cell))
            who, where, gone, n = who[~crowd], where[~crowd], gone[~crowd], n[~crowd]
            cuts = [*np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()), 4 * HELD)), len(n)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                a = np.repeat(who[lo:hi], n[lo:hi])
                b = held[spread(leaf[where[lo:hi]], n[lo:hi])]
                keep = (position[a] < position[b]) | (np.repeat(gone[lo:hi], n[lo:hi]) != 0)
                verified(a[keep], b[keep])
            continue
        for delta, may in ((0, slice(None)), (1, gone == 0), (-1, gone == 1)):
            asked, under, state = who[may], where[may], gone[may]
            key = under * wide + vectors[asked, level] + delta + 1
            child = np.minimum(np.searchsorted(keys[level], key), len(keys[level]) - 1)
            found = keys[level][child] == key
            if found.any():
                stack.append((level + 1, asked[found], child[found], state[found] + abs(delta)))
    return np.concatenate([*left, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*right, np.empty(0, np.int64)]).astype(np.int64)


ROWS = "cell long, own boolean, spent int, word string, n long"


def dealt(rows: DataFrame, of: np.ndarray, groups: int, depth: int, levels: int) -> DataFrame:
    """Rows one or more levels further down: an own word to the cell of its counts, each row to those it reaches by spending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, starts = letters_of(batch.column("word"))
            counts = vectors_of(points, starts, of, groups)[:, depth : depth + levels]
            cell = batch.column("cell").to_numpy().view(np.uint64)
            spent, own = batch.column("spent").to_numpy(), batch.column("own").to_numpy(zero_copy_only=False)
            every = np.arange(batch.num_rows)
            ways = [(every, counts, 0)]
            for i in range(levels):
                up = np.zeros(levels, np.int64)
                up[i] = 1
                one = every[spent == 0]
                ways.append((one, counts[one] + up, 1))
                for j in range(i + 1, levels):
                    both = up.copy()
                    both[j] = -1
                    two = one[counts[one, j] > 0]
                    ways.append((two, counts[two] + both, 2))
                last = every[(spent == 1) & (counts[:, i] > 0)]
                ways.append((last, counts[last] - up, 1))
            for who, where, cost in ways:
                out = [
                    pa.array(cells_of(cell[who], where).view(np.int64)),
                    pa.array(own[who] & (cost == 0)),
                    pa.array(spent[who] + cost, pa.int32()),
                    batch.column("word").take(pa.array(who)),
                    batch.column("n").take(pa.array(who)),
                ]
                yield pa.RecordBatch.from_arrays(out, ["cell", "own", "spent", "word", "n"])

    return rows.mapInArrow(run, ROWS)


PAIRS = "a string, b string, a_n long, b_n long"


def searched(rows: DataFrame, of: np.ndarray, groups: int, depth: int, parts: int) -> DataFrame:
    """Pairs of words one edit apart within cells that hold at most ``LIMIT`` words each, however many questions they get."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "own", "spent", "word", "n"]

        def found(held: pa.Table, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
            words = held.column("word").combine_chunks()
            points, starts = letters_of(words)
            a, b = search(
                points,
                starts,
                vectors_of(points, starts, of, groups)[:, depth:],
                held.column("cell").to_numpy(),
                held.column("own").to_numpy(),
                fresh,
                held.column("spent").to_numpy(),
            )
            n = held.column("n").combine_chunks()
            if len(a):
                a, b = pa.array(a), pa.array(b)
                yield pa.RecordBatch.from_arrays([words.take(a), words.take(b), n.take(a), n.take(b)], ["a", "b", "a_n", "b_n"])

        kept = None  # own words of the cell that the last search ended in, already compared with each other
        parts_, size = [], 0
        for batch in batches:
            parts_.append(batch.select(names))
            size += batch.num_rows
            if size < HELD:
                continue
            now = pa.Table.from_batches(parts_)
            cell, own = now.column("cell").to_numpy(), now.column("own").to_numpy()
            last = int(np.searchsorted(cell, cell[-1]))
            # Cells that may go on wait for more, unless their own words are complete and questions have begun.
            stop = len(cell) if not own[-1] else last
            if stop:
                seen = kept.num_rows if kept is not None else 0
                part = now.slice(0, stop)
                if seen:
                    part = pa.concat_tables([kept, part])
                yield from found(part, np.arange(part.num_rows) >= seen)
                if stop == len(cell):
                    same = (part.column("cell").to_numpy() == cell[-1]) & part.column("own").to_numpy()
                    kept = part.filter(pa.array(same))
                else:
                    kept = None
            rest = now.slice(stop)
            parts_, size = rest.to_batches(), rest.num_rows
        if parts_ and size:
            part = pa.Table.from_batches(parts_)
            seen = kept.num_rows if kept is not None else 0
            if seen:
                part = pa.concat_tables([kept, part])
            yield from found(part, np.arange(part.num_rows) >= seen)

    # Dealt by a hash of the cell: a deal by the cell itself is left out behind a join by it, and the join may then be run in another deal.
    ordered = rows.repartition(parts, F.xxhash64("cell")).sortWithinPartitions("cell", F.desc("own"))
    return ordered.mapInArrow(run, PAIRS)


def full_leaves(rows: DataFrame) -> DataFrame:
    """Pairs within leaves of any size: words meet by what is left of them without one letter, at most an alphabet a place.

    Rows of a leaf that spent nothing or both have its length and meet others of it without the same place; those
    that spent the surplus alone are shorter by one and meet whole.
    """
    gone = F.transform(
        F.sequence(F.lit(1), F.length("word")),
        lambda i: F.struct(i.alias("at"), F.xxhash64("cell", i, F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1))).alias("h")),
    )
    bare = F.transform(
        F.sequence(F.lit(1), F.length("word")), lambda i: F.xxhash64("cell", F.concat(F.substr("word", F.lit(1), i - 1), F.substr("word", i + 1)))
    )
    own = rows.filter("own")
    replaced = rows.filter("spent <> 1").withColumn("g", F.explode(gone)).select("g.h", "own", F.col("word").alias("a"), F.col("n").alias("a_n"))
    targets = own.withColumn("g", F.explode(gone)).select("g.h", F.col("word").alias("b"), F.col("n").alias("b_n"))
    same = replaced.join(targets, "h").filter("a <> b and (not own or a < b)").drop("h", "own")
    shorter = rows.filter("spent = 1").select(F.xxhash64("cell", "word").alias("h"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    longer = own.withColumn("h", F.explode(F.array_distinct(bare))).select("h", F.col("word").alias("b"), F.col("n").alias("b_n"))
    inserted = shorter.join(longer, "h").drop("h")
    exact = (F.length("a") == F.length("b")) | (F.length("a") + 1 == F.length("b"))
    return same.union(inserted).filter(exact & (F.levenshtein("a", "b") == 1)).distinct().select("a", "b", "a_n", "b_n")


def near_pairs(words: DataFrame, groups: int = GROUPS, limit: int = LIMIT) -> DataFrame:
    """``a``, ``b``, ``a_n``, ``b_n``: every pair of distinct words (``word``, ``n``) one edit apart, once.

    Words may be of any length and alphabet. Cells beyond ``limit`` words are cut by further levels, round by round; a
    round's rows are written to the shared folder.
    """
    parts = partitions(words.sparkSession)
    of = group_table(words, groups)
    rows = words.select(F.lit(0).cast("long").alias("cell"), F.lit(True).alias("own"), F.lit(0).alias("spent"), "word", "n")
    depth, pairs = 0, None
    while True:
        step = min(TOP if depth == 0 else MORE, groups - depth)
        rows = saved(dealt(rows, of, groups, depth, step))
        depth += step
        sizes = saved(rows.filter("own").groupBy("cell").agg(F.count(F.lit(1)).alias("held")))
        sized = rows.join(F.broadcast(sizes) if sizes.count() <= FEW else sizes, "cell")  # cells without words answer nothing
        found = searched(sized.filter(F.col("held") <= limit).drop("held"), of, groups, depth, parts)
        pairs = found if pairs is None else pairs.union(found)
        large = sizes.filter(F.col("held") > limit)
        if large.isEmpty():
            return pairs
        rows = sized.filter(F.col("held") > limit).drop("held")
        if depth == groups:
            return pairs.union(full_leaves(rows))


def spelling_forms(words: DataFrame, groups: int = GROUPS, limit: int = LIMIT, ratio: int = RATIO) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of each row of ``words`` (distinct ``word``, count ``n``).

    A form is the near word that occurs most (ties: the first in code-point order), if it does ``ratio`` times as often.
    Following forms ends at the root. Counts grow by ``ratio`` with each step, so few rounds of pointer doubling do.
    """
    words = saved(words.select("word", "n"))
    pairs = near_pairs(words, groups, limit)
    # Both sides come from one look at the pairs: which word of a pair stands first may differ from one run of the search to the next.
    sides = pairs.selectExpr("inline(array(struct(a as word, b as other, b_n as other_n), struct(b as word, a as other, a_n as other_n)))")
    best = sides.groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("top")
    )
    joined = words.join(best, "word", "left")
    most = -F.col("top.less")
    is_form = most >= ratio * F.col("n")
    formed = saved(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("top.other")).alias("form"),
            F.when(is_form, most).alias("form_n"),
        )
    )
    links = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = saved(links.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if links.filter("moved").isEmpty():
            break
        links = links.drop("moved")
    return formed.join(links.select("word", "root"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op12_count_trie(spark, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return spelling_forms(word_counts(table(spark, sf_dir, "documents")))
