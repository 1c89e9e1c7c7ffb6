"""Byte-pair encoding by speculation: longest matches propose tokens, pair checks confirm them, the rest is merged exactly."""

from __future__ import annotations

import functools
import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.common import sized, table

T = TypeVar("T")

# Fixed values of the vocabulary's format.
WORD_END = "</w>"
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
CHUNKS = re.compile(f"[^{SPACE}]+")


def class_of(kind: str) -> str:
    """Ranges of all characters of a general category, as this Python knows them."""
    inside = np.array([unicodedata.category(chr(c))[0] == kind for c in range(0x110000)])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edges.reshape(-1, 2))


@functools.cache
def pieces_pattern() -> re.Pattern:
    """Contractions, runs of letters, single digits, runs of anything else but white space."""
    letters, digits = class_of("L"), class_of("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{SPACE}{letters}{digits}]+")


#: Characters at which str.split() parts a text and the format does not.
NOT_SPACE = re.compile("[\x1c-\x1f]")

#: Chunks that a worker remembers in each of two halves, and the length from which a chunk is not kept.
KEPT, LONG = 200_000, 48


def byte_symbols() -> list[str]:
    """The printable character of each byte: itself where it is printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Merges and tokens of one vocabulary file; ids grow with merge rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self.ids: dict[str, int] = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.special_text = re.compile("|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        size = max([*self.ids.values(), *self.special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.left = np.arange(size)
        self.right = np.arange(size)
        self.merge: dict[int, int] = {}  # of the pair (x, y), by x * size + y
        for a, b in data["model"]["merges"]:
            i, x, y = self.ids[a + b], self.ids[a], self.ids[b]
            self.left[i], self.right[i] = x, y
            self.merge[x * size + y] = i
        made = np.flatnonzero(self.left != np.arange(size))
        key = self.left[made] * size + self.right[made]
        order = np.argsort(key)
        self.size, self.pair_keys, self.pair_ids = size, key[order], made[order]
        self.symbols = byte_symbols()
        self.table = {b: s for b, s in enumerate(self.symbols) if b != 10}
        self.spaced = [f" {t}" for t in self.tokens]
        self.symbol_ids = np.full((2, 512), -1, np.int64)  # of each symbol inside a piece and at its end
        for s in self.symbols:
            self.symbol_ids[:, ord(s)] = self.ids[s], self.ids[s + WORD_END]
        # Prefixes of tokens with the id of the token that ends there, or -1: one walk finds the longest match.
        self.walk: dict[str, int] = {}
        self.ends: dict[str, int] = {}
        for t, i in self.ids.items():
            if t.endswith(WORD_END) and t != WORD_END:
                self.ends[t[: -len(WORD_END)]] = i
            else:
                self.walk[t] = i
        for t in list(self.walk):
            for k in range(1, len(t)):
                self.walk.setdefault(t[:k], -1)
        self.longest = max(map(len, self.ends))
        self.sound = self._sound()

    def _sound(self) -> np.ndarray:
        """Which tokens exact merging makes out of their own bytes. A proposal may hold these only."""
        size = self.size
        ok = np.ones(size, bool)
        made = np.flatnonzero(self.left != np.arange(size))
        ok[made] = self.stable(self.left[made], self.right[made], made)
        for i in made:  # parts have smaller ids
            ok[i] &= ok[self.left[i]] and ok[self.right[i]]
        return ok

    def stable(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For adjacent tokens: does no merge ever join bytes of ``a`` with bytes of ``b``?

        Merging runs in order of rank, so it is played backwards: undo the later of the two tokens at the border and
        ask each time whether the pair then at the border has a merge that would have come first. Of equal ranks the
        left one was merged first, hence is undone last, and beats the pair; a pair beats an equal one on its right.
        ``limit`` is the rank from which on merges are of no interest (by default none).
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 2 * self.size) if limit is None else limit.astype(np.int64)
        result = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y, top = a[live], b[live], limit[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
            fires = (self.pair_keys[at] == key) & (self.pair_ids[at] < top)
            result[live[fires]] = False
            base_x, base_y = self.left[x] == x, self.left[y] == y
            undo_x = ~base_x & (base_y | (x > y))
            undo_y = ~base_y & ~undo_x
            limit[live] = np.where(undo_x, x, np.where(undo_y, y + 1, top))
            a[live] = np.where(undo_x, self.right[x], x)
            b[live] = np.where(undo_y, self.left[y], y)
            live = live[~fires & (undo_x | undo_y)]
        return result

    def propose(self, piece: str) -> list[int]:
        """Greedy longest matches over a piece of byte symbols; its last symbol carries the word end."""
        out, at, size, walk, ends, longest = [], 0, len(piece), self.walk, self.ends, self.longest
        while True:
            rest = ends.get(piece[at:]) if size - at <= longest else None
            if rest is not None:
                out.append(rest)
                return out
            best, stop, k = -1, at, at + 1
            while k < size:  # the last symbol belongs to a token with the word end
                found = walk.get(piece[at:k])
                if found is None:
                    break
                if found >= 0:
                    best, stop = found, k
                k += 1
            out.append(best)
            at = stop

    def merged(self, piece: str) -> list[int]:
        """Exact merging: always the pair of lowest rank, of equal ones the leftmost."""
        ids = [self.ids[s] for s in piece[:-1]]
        ids.append(self.ends[piece[-1]])
        n, size, find = len(ids), self.size, self.merge.get
        if n <= LONG:
            none = size + 1
            ranks = [find(x * size + y, none) for x, y in zip(ids, ids[1:])]
            while ranks and (rank := min(ranks)) != none:
                i = ranks.index(rank)
                ids[i : i + 2] = [rank]
                del ranks[i]
                if i:
                    ranks[i - 1] = find(ids[i - 1] * size + rank, none)
                if i < len(ranks):
                    ranks[i] = find(rank * size + ids[i + 1], none)
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := find(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, x, y = heapq.heappop(heap)
            j = after[i]
            if ids[i] != x or j >= n or ids[j] != y:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n:
                    r = find(ids[k] * size + ids[after[k]])
                    if r is not None:
                        heapq.heappush(heap, (r, k, ids[k], ids[after[k]]))
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        """Token ids of each piece: proposals, then pair checks over all of them at once, then exact merging where one fails."""
        proposed = [self.propose(p) for p in pieces]
        counts = np.fromiter(map(len, proposed), np.int64, len(proposed))
        ids = np.fromiter((i for p in proposed for i in p), np.int64, int(counts.sum()))
        owner = np.repeat(np.arange(len(pieces)), counts)
        bad = np.zeros(len(pieces), bool)
        bad[owner[~self.sound[ids]]] = True
        border = np.flatnonzero(owner[1:] == owner[:-1])
        bad[owner[border[~self.stable(ids[border], ids[border + 1])]]] = True
        failed = np.flatnonzero(bad)
        for i, own in zip(failed, self.merged_all([pieces[i] for i in failed]), strict=True):
            proposed[i] = own
        return proposed

    def merged_all(self, pieces: list[str]) -> list[list[int]]:
        """Exact merging of many pieces: rows of ids of one width make their first merge of lowest rank and go on one narrower.

        Long pieces are merged one by one.
        """
        out: list[list[int]] = [[]] * len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self.merged(pieces[i])
        none = self.size + 1
        who = np.empty(0, np.int64)
        ids, ranks = np.empty((0, LONG), np.int64), np.empty((0, LONG - 1), np.int64)
        for width in range(LONG, 0, -1):
            fresh = np.flatnonzero(sizes == width)
            if len(fresh):
                symbols = np.frombuffer("".join([pieces[i] for i in fresh]).encode("utf-32-le"), "<u4").reshape(-1, width)
                first = self.symbol_ids[0][symbols]
                first[:, -1] = self.symbol_ids[1][symbols[:, -1]]
                who = np.concatenate([who, fresh])
                ids = np.concatenate([ids, first])
                ranks = np.concatenate([ranks, self.rank_of(first[:, :-1], first[:, 1:])])
            if not len(who):
                ids, ranks = ids[:, 1:], ranks[:, 1:]
                continue
            if width > 1:
                at = ranks.argmin(axis=1)
                row = np.arange(len(who))
                rank = ranks[row, at]
                over = rank == none
            else:
                over = np.ones(len(who), bool)
            for i, own in zip(who[over].tolist(), ids[over].tolist(), strict=True):
                out[i] = own
            if width == 1:
                break
            who, ids, ranks, at, rank = who[~over], ids[~over], ranks[~over], at[~over], rank[~over]
            row = np.arange(len(who))
            ids[row, at] = rank
            stay = np.ones(ids.shape, bool)
            stay[row, at + 1] = False
            ids = ids[stay].reshape(len(who), width - 1)
            stay = np.ones(ranks.shape, bool)
            stay[row, at] = False
            ranks = ranks[stay].reshape(len(who), width - 2)
            for k in (at - 1, at):
                inner = np.flatnonzero((k >= 0) & (k < width - 2))
                k = k[inner]
                ranks[inner, k] = self.rank_of(ids[inner, k], ids[inner, k + 1])
        return out

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Id of the token that a pair merges to, or a number above all ids."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], self.size + 1)

    def pieces(self, chunk: str) -> list[str]:
        """Normalized pieces of a chunk without white space, as byte symbols."""
        return self.as_symbols(self.parted([chunk])[0])

    def parted(self, chunks: list[str]) -> list[list[str]]:
        """Normalized pieces of each chunk; a line feed, which no chunk has, keeps chunks apart while they are normalized at once."""
        if not chunks:
            return []
        text = "\n".join(chunks)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        find = pieces_pattern().findall
        return [[c] if c.isalpha() else find(c) for c in text.lower().split("\n")]

    def as_symbols(self, pieces: list[str]) -> list[str]:
        """The byte symbols of each piece; none has a line feed."""
        if not pieces:
            return []
        return "\n".join(pieces).encode("utf-8", "surrogatepass").decode("latin-1").translate(self.table).split("\n")

    def encode_chunks(self, chunks: list[str]) -> list[tuple[bytes, str]]:
        """Token ids of chunks without white space, four bytes each, and their texts, a blank before each; a special token's chunk has its id."""
        parts = [[c] if c in self.special else own for c, own in zip(chunks, self.parted(chunks), strict=True)]
        distinct = list({p: None for own in parts for p in own if p not in self.special})
        codes = self.encode_pieces(self.as_symbols(distinct))
        distinct += self.special
        codes += [[i] for i in self.special.values()]
        ends = np.cumsum(np.fromiter(map(len, codes), np.int64, len(codes))) * 4
        body = np.fromiter(itertools.chain.from_iterable(codes), np.int32, int(ends[-1]) // 4).tobytes() if codes else b""
        token = self.spaced.__getitem__
        known, at = {}, 0
        for p, own, end in zip(distinct, codes, ends.tolist(), strict=True):
            known[p] = body[at:end], "".join(map(token, own))
            at = end

        def whole(own: list[str]) -> tuple[bytes, str]:
            if len(own) == 1:
                return known[own[0]]
            return b"".join([known[p][0] for p in own]), "".join([known[p][1] for p in own])

        return list(map(whole, parts))


@functools.cache
def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process: its vocabulary and the chunks it remembers serve task after task."""
    return Encoder(Vocabulary(path))


class Encoder:
    """Encodes texts; remembers what chunks become, up to a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, tuple[bytes, str]] = {}  # ids, four bytes each, and their texts, a blank before each
        self.older: dict[str, tuple[bytes, str]] = {}

    def chunks(self, text: str) -> list[str]:
        if "<|" in text:
            text = self.vocabulary.special_text.sub(lambda m: f" {m[0]} ", text)
        return CHUNKS.findall(text) if NOT_SPACE.search(text) else text.split()

    def looked_up(self, texts: list[str], take: Callable[[list[str]], T]) -> list[T]:
        """``take`` of each text's chunks, all of which are known meanwhile."""
        split = [self.chunks(t) for t in texts]
        new = set().union(*split)
        if len(self.known) > KEPT:  # what is still in use moves over from the older half
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new = new.difference(known)
        known.update((c, older[c]) for c in new if c in older)
        new = [c for c in new if c not in older]
        known.update(zip(new, self.vocabulary.encode_chunks(new), strict=True))
        out = list(map(take, split))
        for c in new:
            if len(c) > LONG:
                del known[c]
        return out

    def encode(self, texts: list[str]) -> list[list[int]]:
        known = lambda own: b"".join([self.known[c][0] for c in own])
        return [np.frombuffer(ids, np.int32).tolist() for ids in self.looked_up(texts, known)]

    def encode_and_decode(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        """The ids of each text, four bytes each, and its decoded text."""

        def take(own: list[str]) -> tuple[bytes, str]:
            if not own:
                return b"", ""
            ids, texts = zip(*map(self.known.__getitem__, own), strict=True)
            return b"".join(ids), "".join(texts)[1:]

        both = self.looked_up(texts, take)
        return [ids for ids, _ in both], [text for _, text in both]

    def decode(self, ids: list[int]) -> str:
        """Token texts joined by blanks: the format has no decoder of its own."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ids`` (token ids of the whole text) and ``decoded`` (their text) of every row.

    A null text counts as empty and has no tokens; null keys and repeated rows are kept as they are. Texts that
    contain the special tokens' own strings get the special ids there. Work is row by row: no shuffle, memory bounded
    by a few megabytes of text and the remembered chunks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches):
            encoder = encoder_of(path)
            ids, decoded = encoder.encode_and_decode([t or "" for t in batch.column("text").to_pylist()])
            counts = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(i) // 4 for i in ids], out=counts[1:])
            flat = pa.array(np.frombuffer(b"".join(ids), np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.ListArray.from_arrays(pa.array(counts), flat), pa.array(decoded, pa.string())], ["key", "ids", "decoded"]
            )

    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, f"key {kind}, ids array<int>, decoded string").withColumnRenamed("key", key)


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    out = encode(docs, path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded_digests(table(spark, sf_dir, "documents"), vocabulary_path())
