"""Removal of long repeats: suffixes of all texts in order, previous and next smaller documents, covered bytes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Suffix order
brings equal strings together; of a suffix's neighbours, the nearest ones before and after it with a smaller document
id share the longest prefix with it that any smaller document has. If that is ``LENGTH`` bytes or more, the string is
a later copy.

All suffixes of a corpus in one array is more than a cluster can sort at once, so they are split by content. Every
string of ``LENGTH`` bytes takes the smallest hash of its ``SEED``-byte substrings as its key; equal strings have equal
keys, neighbours mostly share theirs, and a run of starts with one key is a segment. Two rounds of questions (see
``blocks``) follow: which keys stand at more than one place, and then, for their segments only, the suffix arrays of
each bucket of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm import blocks
from tapewright.llm.blocks import ANSWER, ASKS, TABLE, Cells
from tapewright.llm.common import digest, flat, mixed, pack, partitions, sized, spread, table, unpack

LENGTH = 50
SEED = 20
PIECE = 1 << 20  # bytes hashed at once
CHUNK = 12 << 20  # bytes of text whose facts a task combines before it asks
#: A key at more places than this is asked about string by string, so that no bucket gets all that stands around a
#: frequent passage. The result is the same either way.
FREQUENT = 2000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _words(buf: np.ndarray, count: int, step: int) -> np.ndarray:
    """The eight bytes from each position, in the machine's order; ``buf`` has ``count + step + 7`` bytes."""
    view = np.ndarray((count,), "<u8", buf, step, (1,))
    return view.astype(np.uint64)


def _keys(buf: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Key of the string of ``length`` bytes from each position of ``buf``."""
    count = len(buf) - seed + 1
    h = _words(buf, count, 0) * _M1
    for step in [*range(8, seed - 8, 8), seed - 8]:
        h ^= h >> np.uint64(29)
        h += _words(buf, count, step)
        h *= _M2
    h ^= h >> np.uint64(32)
    h *= _M3
    h ^= h >> np.uint64(29)
    width = length - seed + 1
    span = 1
    while span * 2 <= width:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    rest = width - span
    return np.minimum(h[: len(h) - rest], h[rest:]) if rest else h


def segments(buf: np.ndarray, ends: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Runs of starts with one key: first start, number of starts, key, and document; texts lie one after another.

    The runs of a text do not depend on the texts around it.
    """
    starts, counts, keys, owners = [], [], [], []
    sizes = np.diff(ends)
    pieces = [(0, int(ends[-1]))]
    if len(sizes) == 1 and sizes[0] > PIECE:
        pieces = [(a, min(a + PIECE + length - 1, int(sizes[0]))) for a in range(0, int(sizes[0]) - length + 1, PIECE)]
    for a, b in pieces:
        if b - a < length:
            continue
        key = _keys(buf[a:b], length, seed)
        doc = np.searchsorted(ends, np.arange(a, a + len(key)), side="right") - 1 if len(pieces) == 1 else np.zeros(len(key), np.int64)
        whole = np.arange(a, a + len(key)) + length <= ends[doc + 1]
        cut = np.ones(len(key) + 1, bool)
        cut[1:-1] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
        edge = np.flatnonzero(cut)
        first = edge[:-1]
        good = whole[first]
        starts.append((first + a)[good])
        counts.append(np.diff(edge)[good])
        keys.append(key[first][good])
        owners.append(doc[first][good])
    if not starts:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64), none
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(keys), np.concatenate(owners)


def _content(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each run (eight bytes or more), the same wherever it stands in a buffer."""
    count = len(buf) - 7
    h = mixed(_words(buf, count, 0))
    out = np.zeros(len(starts), np.uint64)
    # Sum of position-weighted hashes: weights are powers of an odd number, which has an inverse.
    odd, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    power = np.empty(count, np.uint64)
    power[0] = 1
    done, step = 1, odd
    while done < count:
        more = min(done, count - done)
        power[done : done + more] = power[:more] * np.uint64(step)
        done += more
        step = step * step % (1 << 64)
    total = np.zeros(count + 1, np.uint64)
    np.cumsum(h * power, out=total[1:])
    out = total[starts + lengths - 7] - total[starts]
    back = np.empty(count, np.uint64)
    back[0] = 1
    done, step = 1, inverse
    while done < count:
        more = min(done, count - done)
        back[done : done + more] = back[:more] * np.uint64(step)
        done += more
        step = step * step % (1 << 64)
    return mixed(out * back[starts] + lengths.astype(np.uint64))


def suffix_order(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes from ``starts`` by their first ``length`` bytes, and which share all of these with the one before."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    steps = [*range(0, length - 8, 8), length - 8]
    columns = [np.ndarray((len(padded) - s - 7,), ">u8", padded, s, (1,))[starts].astype(np.uint64) for s in steps]
    order = np.lexsort(columns[::-1])
    same = np.ones(len(starts), bool)
    for c in columns:
        c = c[order]
        same[1:] &= c[1:] == c[:-1]
    if len(same):
        same[0] = False
    return order, same


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """Index of the nearest smaller value before each one, or -1. Pointers jump over what is known to be no smaller."""
    at = np.arange(-1, len(values) - 1)
    live = np.arange(len(values))
    while len(live):
        live = live[at[live] >= 0]
        live = live[values[at[live]] >= values[live]]
        at[live] = at[at[live]]
    return at


def copied(buf: np.ndarray, starts: np.ndarray, docs: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes have an earlier factor: a document with a smaller id shares their first ``length`` bytes."""
    order, same = suffix_order(buf, starts, length)
    run = np.cumsum(~same)
    doc = docs[order]
    n = len(order)
    before = previous_smaller(doc)
    after = n - 1 - previous_smaller(doc[::-1])[::-1]  # n: none
    found = (before >= 0) & (run[np.maximum(before, 0)] == run)
    found |= (after < n) & (run[np.minimum(after, n - 1)] == run)
    out = np.empty(n, bool)
    out[order] = found
    return out


# First round: which keys stand at more than one place.


def _ask_keys(batches: Iterator[pa.RecordBatch], n: int, length: int, seed: int) -> Iterator[pa.RecordBatch]:
    out = Cells()
    ids, marks, counts, keys, size = [], [], [], [], 0

    def close() -> None:
        nonlocal ids, marks, counts, keys, size
        if not ids:
            return
        doc, tag, per, key = (np.concatenate(x) for x in (ids, marks, counts, keys))
        ids, marks, counts, keys, size = [], [], [], [], 0
        if not len(key):
            return
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        head = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
        times = np.diff(np.append(head, len(key)))
        first = order[head]  # stable: the first place of each key
        several = np.repeat(times > 1, times)
        lead = np.repeat(first, times)[several]
        chunk = blocks.chunk_id(doc, tag)
        body = pack(doc, tag, per.astype(np.int32), lead.astype(np.uint32), order[several].astype(np.uint32))
        out.add(chunk, int(chunk % n), TABLE, body)
        by_place = np.argsort(first)
        first, own, times = first[by_place], sorted_key[head][by_place], times[by_place]
        for bucket, at in blocks.by_bucket(own, n):
            gaps = np.diff(first[at], prepend=0)
            gaps = gaps.astype(np.uint16 if gaps.max() < 65536 else np.uint32)
            low = own[at]
            body = pack(
                np.array([gaps.itemsize], np.uint8),
                gaps,
                (low & np.uint64(0xFFFFFFFF)).astype(np.uint32),
                ((low >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8),
                np.minimum(times[at], 255).astype(np.uint8),
            )
            out.add(chunk, bucket, ASKS, body)

    for batch in sized(batches, "text", PIECE):
        buf, ends = flat(batch.column("text"))
        _, _, key, owner = segments(buf, ends, length, seed)
        ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64))
        marks.append(batch.column("digest").to_numpy(zero_copy_only=False).astype(np.int64))
        counts.append(np.bincount(owner, minlength=batch.num_rows))
        keys.append(key)
        size += len(buf)
        if size >= CHUNK:
            close()
        if out.full():
            yield from out.take()
    close()
    yield from out.take()


def _answer_keys(asks: list[tuple[int, bytes]], out: Cells, frequent: int) -> None:
    keys, places, times = [], [], []
    for _, body in asks:
        (wide,) = unpack(body, *[np.uint8] * 5)[0]
        _, gaps, low, high, count = unpack(body, np.uint8, np.uint16 if wide == 2 else np.uint32, np.uint32, np.uint8, np.uint8)
        keys.append(low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32))
        places.append(np.cumsum(gaps, dtype=np.int64))
        times.append(count.astype(np.int64))
    owner = np.repeat(np.arange(len(asks)), [len(k) for k in keys])
    key, place, count = np.concatenate(keys), np.concatenate(places), np.concatenate(times)
    order = np.argsort(key)
    head = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    total = np.empty(len(key), np.int64)
    total[order] = np.add.reduceat(count[order], np.flatnonzero(head))[np.cumsum(head) - 1]
    shared = total > 1
    for i in np.unique(owner[shared]):
        at = _slice(owner, i)
        at = at[shared[at]]
        out.add(asks[i][0], 0, ANSWER, pack(place[at].astype(np.uint32), (total[at] > frequent).astype(np.uint8)))


def _slice(owner: np.ndarray, i: int) -> np.ndarray:
    """Indices of one owner; ``owner`` ascends."""
    return np.arange(np.searchsorted(owner, i), np.searchsorted(owner, i, side="right"))


MARKED = "doc_id long, digest long, marks binary"


def _merge_keys(own: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
    doc, tag, per, lead, place = unpack(own, np.int64, np.int64, np.int32, np.uint32, np.uint32)
    state = np.zeros(int(per.sum()), np.uint8)
    for body in answers:
        at, often = unpack(body, np.uint32, np.uint8)
        state[at] = 1 + often
    state[place] = state[lead]
    stops = np.cumsum(per)
    rows = []
    for i in np.flatnonzero(np.add.reduceat(np.append(state, 0).astype(np.int64), np.minimum(stops - per, len(state))) * (per > 0)):
        mine = state[stops[i] - per[i] : stops[i]]
        at = np.flatnonzero(mine)
        rows.append((doc[i], tag[i], pack(at.astype(np.uint32), mine[at])))
    yield from _batches(rows, "marks")


def _batches(rows: list[tuple[int, int, bytes]], name: str) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(rows), 2048):
        doc, tag, body = zip(*rows[k : k + 2048], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(tag, pa.int64()), pa.array(body, pa.binary())], ["doc_id", "digest", name])


# Second round: suffix arrays of the segments whose keys stand at more than one place.


def _ask_segments(batches: Iterator[pa.RecordBatch], n: int, length: int, seed: int) -> Iterator[pa.RecordBatch]:
    out = Cells()
    parts: list[tuple] = []
    ids, tags, size, texts = [], [], 0, []

    def close() -> None:
        nonlocal parts, ids, tags, size, texts
        if not parts:
            return
        doc, tag = np.concatenate(ids), np.concatenate(tags)
        row, start, count, key, where, content = (np.concatenate([p[k] for p in parts]) for k in range(6))
        text = np.concatenate(texts)
        parts, ids, tags, size, texts = [], [], [], 0, []
        chunk = blocks.chunk_id(doc, tag)
        # Equal segments: only those of the smallest document ask, the others are later copies for certain.
        order = np.lexsort((doc[row], content, key))
        head = np.ones(len(order), bool)
        head[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
        least = np.empty(len(order), np.int64)
        least[order] = doc[row][order][head][np.cumsum(head) - 1]
        later = doc[row] > least
        spans = (row[later].astype(np.uint32), start[later].astype(np.uint32), (count[later] + length - 1).astype(np.uint32))
        out.add(chunk, int(chunk % n), TABLE, pack(doc, tag, *spans))
        keep = np.flatnonzero(~later)
        squeeze = zstandard.ZstdCompressor(level=1)
        for bucket, at in blocks.by_bucket(key[keep], n):
            at = keep[at]
            letters = text[spread(where[at], count[at] + length - 1)]
            at_row, at_doc = row[at], doc[row[at]]
            body = pack(
                np.diff(at_row, prepend=0).astype(np.int32),
                np.diff(at_doc - at_row, prepend=0),
                start[at].astype(np.uint32),
                count[at].astype(np.uint32),
                letters,
            )
            out.add(chunk, bucket, ASKS, squeeze.compress(body))

    rows = 0
    for batch in sized(batches, "text", PIECE):
        batch = batch.filter(batch.column("marks").is_valid())
        if not batch.num_rows:
            continue
        buf, ends = flat(batch.column("text"))
        start, count, key, owner = segments(buf, ends, length, seed)
        offset = np.searchsorted(owner, np.arange(batch.num_rows))
        picks, often = [], []
        for i, body in enumerate(batch.column("marks").to_pylist()):
            at, state = unpack(body, np.uint32, np.uint8)
            picks.append(at + offset[i])
            often.append(state == 2)
        pick, hot = np.concatenate(picks), np.concatenate(often)
        start, count, key, owner = (x[pick] for x in (start, count, key, owner))
        if hot.any():  # string by string, keyed by its own content
            each = spread(start[hot], count[hot])
            names = _content(buf, each, np.full(len(each), length))
            start = np.concatenate([start[~hot], each])
            owner = np.concatenate([owner[~hot], np.repeat(owner[hot], count[hot])])
            key = np.concatenate([key[~hot], names])
            count = np.concatenate([count[~hot], np.ones(len(each), np.int64)])
        if len(start):
            content = _content(buf, start, count + length - 1)
            letters = buf[spread(start, count + length - 1)]
            where = size + np.cumsum(count + length - 1) - (count + length - 1)
            parts.append((owner + rows, start - ends[owner], count, key, where, content))
            texts.append(letters)
            size += len(letters)
        ids.append(batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64))
        tags.append(batch.column("digest").to_numpy(zero_copy_only=False).astype(np.int64))
        rows += batch.num_rows
        if size >= CHUNK:
            close()
            rows = 0
        if out.full():
            yield from out.take()
    close()
    yield from out.take()


def _first_keys(text: np.ndarray, where: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Key of the string at each of the places ``where`` (ascending), of some of them at a time."""
    step = max(1, PIECE // length)
    out = [np.empty(0, np.uint64)]
    for k in range(0, len(where), step):
        at = where[k : k + step]
        out.append(_keys(text[spread(at, np.full(len(at), length))], length, seed)[::length])
    return np.concatenate(out)


def _key_groups(key: np.ndarray, size: np.ndarray, order: np.ndarray) -> Iterator[np.ndarray]:
    """Segments in order of their keys, some whole keys of about ``PIECE`` bytes (or a single larger one) at a time."""
    edge = np.append(np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])), len(order))
    total = np.concatenate([[0], np.cumsum(size[order])])[edge]  # bytes before each key
    at = 0
    while at < len(edge) - 1:
        stop = max(at + 1, int(np.searchsorted(total, total[at] + PIECE, side="right")) - 1)
        yield order[edge[at] : edge[stop]]
        at = stop


def _copies(text, ask, row, doc, start, count, key, length: int) -> list[tuple[np.ndarray, ...]]:
    """Spans (asking chunk, row, start, bytes) that are later copies among the segments of some whole keys; ``text`` has them end to end."""
    size = count.astype(np.int64) + length - 1
    where = np.cumsum(size) - size
    content = _content(text, where, size)
    order = np.lexsort((doc, content, key))
    new_key = np.ones(len(order), bool)
    new_key[1:] = key[order][1:] != key[order][:-1]
    head = new_key.copy()
    head[1:] |= content[order][1:] != content[order][:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(head) - 1
    least = doc[order][head]
    later = doc > least[group]
    # One segment of each content goes into the suffix array, if its key has others.
    of_key = np.cumsum(new_key)[head]
    lonely = np.bincount(of_key)[of_key] == 1
    chosen = order[head]
    spans = [(ask[later], row[later], start[later].astype(np.int64), size[later])]
    busy = np.flatnonzero(~lonely)
    if len(busy):
        unit = chosen[busy]
        counts = count[unit].astype(np.int64)
        suffix = spread(where[unit], counts)
        found = copied(text, suffix, np.repeat(least[busy], counts), length)
        edge = np.cumsum(counts) - counts
        inner = np.arange(len(suffix)) - np.repeat(edge, counts)
        begin = found & ((inner == 0) | ~np.concatenate([[False], found[:-1]]))
        stop = found & ((inner == np.repeat(counts, counts) - 1) | ~np.concatenate([found[1:], [False]]))
        first, last = np.flatnonzero(begin), np.flatnonzero(stop)
        owner = busy[np.repeat(np.arange(len(busy)), counts)[first]]
        low, long = inner[first], inner[last] - inner[first] + length
        # Every place of that content in the smallest document has these spans.
        at_home = np.flatnonzero(~later)
        at_home = at_home[np.argsort(group[at_home], kind="stable")]
        lo = np.searchsorted(group[at_home], owner)
        hi = np.searchsorted(group[at_home], owner, side="right")
        home = at_home[spread(lo, hi - lo)]
        times = hi - lo
        spans.append((ask[home], row[home], start[home] + np.repeat(low, times), np.repeat(long, times)))
    return spans


def _answer_segments(asks: list[tuple[int, bytes]], out: Cells, length: int, seed: int) -> None:
    got = [[] for _ in range(5)]
    expand = zstandard.ZstdDecompressor()
    for _, body in asks:
        row, doc, *rest = unpack(expand.decompress(body), np.int32, np.int64, np.uint32, np.uint32, np.uint8)
        row = np.cumsum(row, dtype=np.int64)
        for held, part in zip(got, (row, np.cumsum(doc) + row, *rest), strict=True):
            held.append(part)
    ask = np.repeat(np.arange(len(asks)), [len(k) for k in got[0]])
    row, doc, start, count, text = (np.concatenate(x) for x in got)
    del got
    size = count.astype(np.int64) + length - 1
    where = np.cumsum(size) - size
    key = _first_keys(text, where, length, seed)
    order = np.argsort(key, kind="stable")
    spans = []
    for at in _key_groups(key, size, order):
        letters = text[spread(where[at], size[at])]
        spans += _copies(letters, ask[at], row[at], doc[at], start[at], count[at], key[at], length)
    who, row, start, size = (np.concatenate([s[k] for s in spans]) for k in range(4))
    order = np.argsort(who, kind="stable")
    who = who[order]
    for i in np.unique(who):
        at = order[_slice(who, i)]
        out.add(asks[i][0], 0, ANSWER, pack(row[at].astype(np.uint32), start[at].astype(np.uint32), size[at].astype(np.uint32)))


SPANS = "doc_id long, digest long, spans binary"


def _merge_segments(own: bytes, answers: list[bytes]) -> Iterator[pa.RecordBatch]:
    doc, tag, *spans = unpack(own, np.int64, np.int64, np.uint32, np.uint32, np.uint32)
    parts = [spans, *[unpack(body, np.uint32, np.uint32, np.uint32) for body in answers]]
    row, start, size = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(3))
    order = np.lexsort((start, row))
    row, start, stop = row[order], start[order], (start + size)[order]
    rows = []
    for i in np.unique(row):
        at = _slice(row, i)
        reach = np.maximum.accumulate(stop[at])
        fresh = np.flatnonzero(np.concatenate([[True], start[at][1:] > reach[:-1]]))
        ends = np.append(fresh[1:], len(at)) - 1
        rows.append((doc[i], tag[i], pack(start[at][fresh].astype(np.uint32), reach[ends].astype(np.uint32))))
    yield from _batches(rows, "spans")


def repeated_spans(docs: DataFrame, length: int = LENGTH, seed: int = SEED, frequent: int = FREQUENT) -> DataFrame:
    """``doc_id``, ``digest`` (of the text), ``spans``: maximal runs of bytes to remove, packed starts and ends.

    ``docs`` has ``doc_id``, ``text`` and ``digest``. Documents without such runs have no row, nor do null ids.
    """
    parts = partitions(docs.sparkSession)
    n = blocks.buckets(parts)
    docs = docs.select("doc_id", "text", "digest")
    asked = docs.filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    keys = asked.mapInArrow(lambda b: _ask_keys(b, n, length, seed), blocks.MOVED)
    marks = blocks.gathered(blocks.answered(keys, parts, lambda asks, out: _answer_keys(asks, out, frequent)), parts, _merge_keys, MARKED)
    marks = marks.dropDuplicates(["doc_id", "digest"])
    # A left join as in ``without_repeats``, so that both read one exchange of the texts.
    busy = docs.join(marks.hint("shuffle_hash"), ["doc_id", "digest"], "left").select("doc_id", "digest", "text", "marks")
    # In order, so that a task that runs again makes the same chunks: rows of a shuffle arrive in any order.
    busy = busy.sortWithinPartitions("doc_id", "digest")
    asked = busy.mapInArrow(lambda b: _ask_segments(b, n, length, seed), blocks.MOVED)
    answers = blocks.answered(asked, parts, lambda asks, out: _answer_segments(asks, out, length, seed))
    return blocks.gathered(answers, parts, _merge_segments, SPANS).dropDuplicates(["doc_id", "digest"])


def without_repeats(docs: DataFrame, length: int = LENGTH, whole_chars: bool = False, frequent: int = FREQUENT) -> DataFrame:
    """``docs`` (with ``doc_id`` and ``text``) and ``removed`` (array of start and end bytes) and ``kept`` (binary).

    Judged on the input, overlaps count, nothing crosses documents. With ``whole_chars`` a character that is covered
    in part stays, so that what is kept is UTF-8. A null text counts as empty. Rows with equal ids never remove each
    other, repeated rows get the same result each; a null id neither removes nor loses anything. Texts shorter than
    ``length`` bytes stay; an empty table gives an empty result. Other columns are kept, but for those
    named ``digest``, ``spans``, ``removed`` or ``kept``, which are replaced.
    """
    seed = min(SEED, length)
    docs = docs.drop("digest", "spans", "removed", "kept")
    names = docs.columns
    tagged = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.coalesce(F.col("text"), F.lit(""))).withColumn("digest", digest())
    joined = tagged.join(repeated_spans(tagged, length, seed, frequent).hint("shuffle_hash"), ["doc_id", "digest"], "left").select(*names, "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches):
            buf, ends = flat(batch.column("text"))
            removed, kept = [], []
            for i, body in enumerate(batch.column("spans").to_pylist()):
                text = buf[ends[i] : ends[i + 1]]
                if body is None:
                    removed.append([])
                    kept.append(text.tobytes())
                    continue
                low, high = (x.astype(np.int64) for x in unpack(body, np.uint32, np.uint32))
                if whole_chars:
                    inside = np.append((text & 0xC0) == 0x80, False)
                    for _ in range(3):
                        low, high = low + inside[low], high - inside[high]
                    low, high = low[low < high], high[low < high]
                stay = np.zeros(len(text) + 1, np.int8)
                np.add.at(stay, low, 1)
                np.add.at(stay, high, -1)
                removed.append([{"start": int(a), "end": int(b)} for a, b in zip(low, high, strict=True)])
                kept.append(text[np.cumsum(stay[:-1]) == 0].tobytes())
            columns = [batch.column(c) for c in names]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(removed, kind), pa.array(kept, pa.binary())], [*names, "removed", "kept"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "spans")
    return joined.mapInArrow(cut, f"{fields}, removed array<struct<start: int, end: int>>, kept binary")


def op2_suffix_repeats(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = without_repeats(docs)
    return out.select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        (F.octet_length("text") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
