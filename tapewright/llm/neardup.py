"""Near-duplicates by SuperMinHash: signatures, bands, verification on whole shingle sets, union-find grouping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm import blocks
from tapewright.llm.blocks import ANSWER, ASKS, TABLE, Cells
from tapewright.llm.common import flat, mixed, pack, partitions, saved, sized, spread, table, unpack
from tapewright.llm.components import components

WORDS = 5  # of a shingle
BANDS, ROWS = 48, 7  # a link at 0.85 shares no band in one of 1e8 cases, at 0.8 in one of 1e5
PERCENT = 85
PIECE = 1 << 20
DOCS = 4096  # documents whose bands a task combines before it asks

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ODD = 0xC2B2AE3D27D4EB4F


def _powers(base: int, count: int) -> np.ndarray:
    out = np.empty(max(count, 1), np.uint64)
    out[0] = 1
    done, step = 1, base
    while done < count:
        more = min(done, count - done)
        out[done : done + more] = out[:more] * np.uint64(step)
        done += more
        step = step * step % (1 << 64)
    return out


def word_hashes(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and each text's first word number (and the total). Texts lie one after another."""
    if not len(buf):
        return np.empty(0, np.uint64), np.zeros(len(ends), np.int64)
    inside = ~SPACE[buf]
    edge = ends[:-1][ends[:-1] < len(buf)]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[edge] = inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    before = edge[edge > 0] - 1
    last[before] = inside[before]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[buf]] * _powers(_ODD, len(buf)), out=total[1:])
    back = _powers(pow(_ODD, -1, 1 << 64), len(buf))
    sums = (total[stops] - total[starts]) * back[starts]
    return mixed(sums + (stops - starts).astype(np.uint64)), np.searchsorted(starts, ends)


def shingle_sets(buf: np.ndarray, ends: np.ndarray, width: int = WORDS) -> list[np.ndarray]:
    """Each text's sorted set of shingle hashes; with fewer words than ``width``, one for the whole sequence."""
    words, bounds = word_hashes(buf, ends)
    joined = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        joined *= np.uint64(_ODD)
        joined += mixed(words[k : k + len(joined)] + np.uint64(k))
    joined = mixed(joined)
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            own = np.sort(joined[a : b - width + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            sets.append(own[keep])
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = mixed(h * np.uint64(3) + words[k : k + 1])
            sets.append(h)
        else:
            sets.append(np.empty(0, np.uint64))
    return sets


def super_minhash(sets: list[np.ndarray], slots: int = BANDS * ROWS) -> np.ndarray:
    """Signature of each set: one row of ``slots`` values.

    Every element runs through its own random permutation of the slots, one place a level, and offers level plus a
    fraction to the slot it reaches; a slot keeps the least offer. Offers of one element differ in all slots, which
    gives less variance than independent hashes. A set is done once no slot can get better: when the level has passed
    the largest level its slots hold. All sets of a batch advance a level at a time.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    signature = np.full((len(sets), slots), np.iinfo(np.uint64).max, np.uint64)
    if not sizes.sum():
        return signature
    element = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    swaps: list[np.ndarray] = []
    place = signature.ravel()
    for level in range(slots):
        draw = mixed(element + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        swap = level + (mixed(draw ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(slots - level)).astype(np.int64)
        # What stands at the swapped index after the earlier swaps: follow them back.
        slot = swap.copy()
        for k in range(level - 1, -1, -1):
            slot[swaps[k] == slot] = k
        np.minimum.at(place, owner * slots + slot, (draw >> np.uint64(12)) | np.uint64(level << 52))
        swaps.append(swap)
        highest = (signature.max(axis=1) >> np.uint64(52)).astype(np.int64)
        live = (highest > level)[owner]
        if not live.all():
            element, owner = element[live], owner[live]
            swaps = [s[live] for s in swaps]
        if not len(element):
            break
    return signature


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Name of each band of signatures of low bytes: the band's number and its bytes, hashed."""
    out = np.empty((len(signature), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(signature), b + 1, np.uint64)
        for r in range(rows):
            h = mixed(h * np.uint64(_ODD) + signature[:, b * rows + r].astype(np.uint64))
        out[:, b] = h
    return out


def signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)


#: Of each slot the low byte is kept: unequal slots agree in one of 256 cases.
SKETCH = "doc_id long, n_shingles long, same1 long, same2 long, signature binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sized(batches, "text", PIECE):
        sets = shingle_sets(*flat(batch.column("text")))
        names = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) for s in sets]).reshape(-1, 2)
        first: dict[bytes, int] = {}
        for i, s in enumerate(sets):
            if len(s):
                first.setdefault(names[i].tobytes(), i)
        chosen = sorted(first.values())
        kept: list[bytes | None] = [None] * len(sets)
        low = (super_minhash([sets[i] for i in chosen]) & np.uint64(255)).astype(np.uint8)
        for i, row in zip(chosen, low, strict=True):
            kept[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(names[:, 0]),
                pa.array(names[:, 1]),
                pa.array(kept, pa.binary()),
            ],
            ["doc_id", "n_shingles", "same1", "same2", "signature"],
        )


# Which documents share a band: every one is told the smallest document of each of its bands.


def _ask_bands(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    out = Cells()
    ids, keys, held = [], [], 0

    def close() -> None:
        nonlocal ids, keys, held
        if not ids:
            return
        doc, key = np.concatenate(ids), np.concatenate(keys)
        ids, keys, held = [], [], 0
        row = np.repeat(np.arange(len(doc)), BANDS)
        order = np.lexsort((doc[row], key))
        head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        times = np.diff(np.append(np.flatnonzero(head), len(order)))
        chunk = blocks.chunk_id(doc)
        # A key's number in the chunk stands for all its documents there.
        out.add(chunk, int(chunk % n), TABLE, pack(doc, row[order].astype(np.uint32), times.astype(np.uint32)))
        own, least = key[order][head], doc[row][order][head]
        greatest = doc[row][order][np.cumsum(times) - 1]
        for bucket, at in blocks.by_bucket(own, n):
            out.add(chunk, bucket, ASKS, pack(own[at], least[at], (greatest[at] > least[at]).astype(np.uint8), at.astype(np.uint32)))

    for batch in batches:
        ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64))
        keys.append(band_keys(signatures(batch.column("signature"))).ravel())
        held += batch.num_rows
        if held >= DOCS:
            close()
        if out.full():
            yield from out.take()
    close()
    yield from out.take()


def _answer_bands(asks: list[tuple[int, bytes]], out: Cells) -> None:
    parts = [unpack(body, np.uint64, np.int64, np.uint8, np.uint32) for _, body in asks]
    key, least, several, at = (np.concatenate([p[k] for p in parts]) for k in range(4))
    owner = np.repeat(np.arange(len(asks)), [len(p[0]) for p in parts])
    order = np.lexsort((least, key))
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    group = np.empty(len(key), np.int64)
    group[order] = np.cumsum(head) - 1
    center = least[order][head][group]
    shared = (np.bincount(group)[group] > 1) | (several > 0)
    for i in np.unique(owner[shared]):
        mine = np.flatnonzero(shared & (owner == i))
        out.add(asks[i][0], 0, ANSWER, pack(at[mine], center[mine]))


def _merge_bands(own: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
    doc, row, times = unpack(own, np.int64, np.uint32, np.uint32)
    if not answers:
        return
    parts = [unpack(body, np.uint32, np.int64) for body in answers]
    at, center = (np.concatenate([p[k] for p in parts]) for k in range(2))
    starts = np.cumsum(times, dtype=np.int64) - times
    members = doc[row[spread(starts[at], times[at].astype(np.int64))]]
    pairs = np.unique(np.stack([members, np.repeat(center, times[at])]), axis=1)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sized(batches, "text", PIECE):
        sets = shingle_sets(*flat(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "shingles"])


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(x) > len(y):
        x, y = y, x
    common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def _confirm(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
            if _similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent):
                keep.append(i)
        yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))


SHARE = 500  # partners that one copy of a document's set serves


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets reach the similarity. A document with many partners is spread over copies."""
    many = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    salted = pairs.join(many, "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / SHARE)).cast("int")).select("a", "b", "salt")
    size = F.octet_length(F.col("shingles"))
    right = salted.select("b", "salt").distinct().join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
    left = salted.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"), size.alias("n_x")), "a")
    both = left.join(right, ["b", "salt"]).withColumn("n_y", F.octet_length("y"))
    fits = F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent
    return both.filter(fits).select("a", "b", "x", "y").mapInArrow(lambda b: _confirm(b, percent), "a long, b long")


# Bands that still hold several components: every pair across components is judged where it first shares a band.

ACROSS = 2000  # members of a band that one task holds, but for those outside its main component
DEVIATIONS = 5.5  # by which a signature may lie below the similarity: less than one of 1e7 links lies lower


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = band_keys(signatures(batch.column("signature"))).view(np.int64)
        row = np.repeat(np.arange(batch.num_rows), BANDS)
        doc = batch.select(["doc_id", "component"]).take(pa.array(row))
        slot = pa.array(np.tile(np.arange(BANDS, dtype=np.int32), batch.num_rows))
        yield pa.RecordBatch.from_arrays([*doc.columns, slot, pa.array(keys.ravel())], ["doc_id", "component", "slot", "band"])


def _across(frames: Iterator[pa.RecordBatch], percent: int, final: bool) -> Iterator[pa.RecordBatch]:
    """For members of one band and salt after another: the documents that have a likely partner, or the links."""
    share = percent / 100
    slots = BANDS * ROWS
    least = slots * (share - DEVIATIONS * (share * (1 - share) / slots) ** 0.5)
    held: list[pa.RecordBatch] = []

    def judged() -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        doc, part, n = (rows.column(c).to_numpy() for c in ("doc_id", "component", "n_shingles"))
        minor = rows.column("minor").to_numpy(zero_copy_only=False)
        lead_salt = rows.column("salt")[0].as_py() == 0
        slot = rows.column("slot")[0].as_py()
        signature = signatures(rows.column("signature"))
        sets = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()] if final else []
        a, b = [], []
        for i in np.flatnonzero(minor):
            fits = (part != part[i]) & (np.minimum(n, n[i]) * 100 >= np.maximum(n, n[i]) * percent)
            fits &= ~minor | (lead_salt & (doc > doc[i]))
            at = np.flatnonzero(fits)
            at = at[(signature[at] == signature[i]).sum(axis=1) >= least]
            equal = (signature[at] == signature[i]).reshape(-1, BANDS, ROWS).all(axis=2)
            at = at[equal.argmax(axis=1) == slot]
            if final:
                at = np.array([j for j in at if _similar(sets[i], sets[j], percent)], np.int64)
            a.append(np.full(len(at), doc[i]))
            b.append(doc[at])
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        if final:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
        else:
            found = np.unique(np.concatenate([a, b]))
            band, salt = (pa.array([rows.column(c)[0].as_py()] * len(found), rows.column(c).type) for c in ("band", "salt"))
            yield pa.RecordBatch.from_arrays([band, salt, pa.array(found)], ["band", "salt", "doc_id"])

    now = None
    for batch in frames:
        keys = np.stack([batch.column("band").to_numpy(), batch.column("salt").to_numpy().astype(np.int64)], axis=1)
        cuts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y == x:
                continue
            if now is not None and (keys[x] != now).any():
                yield from judged()
                held = []
            now = keys[x]
            held.append(batch.slice(x, y - x))
    if held:
        yield from judged()


def links_across(lead: DataFrame, found: DataFrame, busy: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between documents of different components that share a band.

    A band's main component is spread over salts, the others go to each of them. First only signatures travel and name
    the documents with a likely partner; then these documents' whole sets are compared where they meet. Neither step
    makes rows of pairs.
    """
    parts = partitions(lead.sparkSession)
    label = F.coalesce(F.col("component"), F.col("doc_id")).alias("component")
    members = lead.join(busy, "doc_id").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    rows = members.select("doc_id", label, "signature").mapInArrow(_bands, "doc_id long, component long, slot int, band long")
    counts = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    bands = counts.groupBy("band").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("components")
    )
    bands = bands.filter("components > 1").select("band", "main", F.ceil(F.col("n") / ACROSS).cast("int").alias("salts"))
    minor = F.col("component") != F.col("main")
    salts = F.when(minor, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int")))
    open_ = saved(rows.join(bands, "band").select("band", "slot", F.explode(salts).alias("salt"), "doc_id", "component", minor.alias("minor")))

    def judged(rows: DataFrame, schema: str, final: bool) -> DataFrame:
        dealt = rows.repartition(parts, "band", "salt").sortWithinPartitions("band", "salt")
        return dealt.mapInArrow(lambda b: _across(b, percent, final), schema)

    signed = open_.join(lead.select("doc_id", "n_shingles", "signature"), "doc_id")
    likely = judged(signed, "band long, salt int, doc_id long", False).distinct()
    whole = signed.join(likely, ["band", "salt", "doc_id"]).join(sets, "doc_id")
    return judged(whole, "a long, b long", True).distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` for every row of ``docs`` (``doc_id``, ``text``).

    Documents link when 100 * common >= percent * united shingles. A null or blank text has no shingles and links with
    nothing; rows with a null id are their own component (null) and link with nothing; repeated rows fall together.
    An empty table gives an empty result.

    Equal sets are put together first and go on as their smallest document. Each document is then compared with the
    smallest document of each of its bands: that joins a group of copies of any size with as many comparisons as it
    has members. What remains are bands that still hold several components; only documents of these are compared, in
    place, first by signature and then by whole sets.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    n = blocks.buckets(parts)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    sketch = saved(slim.mapInArrow(_sketch, SKETCH))
    known = sketch.filter("doc_id is not null and n_shingles > 0")
    same = ["same1", "same2"]
    lead = known.groupBy(*same).agg(F.min("doc_id").alias("lead"), F.first("n_shingles").alias("n_shingles"), F.first("signature", ignorenulls=True).alias("signature"))
    lead = saved(lead.select(*same, F.col("lead").alias("doc_id"), "n_shingles", "signature"))

    asked = lead.select("doc_id", "signature").mapInArrow(lambda b: _ask_bands(b, n), blocks.MOVED)
    stars = blocks.gathered(blocks.answered(asked, parts, _answer_bands), parts, _merge_bands, "a long, b long")
    stars = saved(stars.distinct())
    busy = stars.select(F.col("a").alias("doc_id")).union(stars.select(F.col("b").alias("doc_id"))).distinct()
    sets = saved(slim.join(busy.hint("shuffle_hash"), "doc_id").mapInArrow(_sets, "doc_id long, shingles binary").dropDuplicates(["doc_id"]))

    links = saved(confirmed(stars.filter("a <> b"), sets, percent))
    found = saved(components(links))
    more = saved(links_across(lead, found, busy, sets, percent))
    chain = found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)
    final = components(chain).withColumnRenamed("node", "doc_id")

    named = lead.join(final, "doc_id", "left").select(*same, F.coalesce("component", "doc_id").alias("group"))
    out = sketch.join(named, same, "left")
    own = F.when(F.col("n_shingles") > 0, F.coalesce("group", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def op6_super_minhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
