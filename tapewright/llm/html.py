"""Main text of web pages: blocks from markup, and boilerplate found by what a host's pages repeat."""

from __future__ import annotations

import functools
import hashlib
import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewright.llm.blocks import ANSWER, ASKS, MOVED, TABLE, Cells, answered, by_bucket, chunk_id
from tapewright.llm.common import mixed, pack, partitions, sized, spread, table, unpack

RUN = 8  # tokens of the shortest run that counts as repeated
GRAM = 4  # tokens whose least hash is a run's key
PAGES = 3  # distinct pages that make a repeated run boilerplate; 2 on a host that has no more
FREQUENT = 2000  # distinct pages of a key above which its windows are dealt one by one

# Names of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul br".split()
)
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "noframes", "xmp", "title", "svg", "object")
ASIDE = set("nav footer aside form header head button select menu dialog fieldset label input option datalist optgroup".split())
ENDS_ITSELF = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

#: Parts of a class, id or role that mark what is not the article.
ASIDE_NAMES = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb "
    "breadcrumbs sidebar side aside complementary footer contentinfo header masthead cookie cookies consent gdpr notice notices popup modal overlay "
    "alert newsletter subscribe subscription signup login search share sharing social related recommended comment comments respond reply replies "
    "disqus pager pagination widget toolbar copyright legal disclaimer hidden skip".split()
)
CONTENT_NAMES = set("article articlebody post entry story content main".split())
#: Parts of names after which stands what a box has, lacks or shows, not what it is.
ABOUT = set("has no with without is not non had show hide".split())
#: Names of boxes that hold a whole page.
FRAMES = set("layout wrapper wrap container page site grid row col column columns inner outer".split())
READERS = set("comment comments respond reply replies disqus".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

# A quote holds a value only behind an equals sign; anywhere else it is a character like any.
MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|"""
    r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*'|)|["'])*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTES = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
INVISIBLE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in RAW}


def attributes(text: str) -> dict[str, str]:
    """Names and values of a tag's attributes; of repeated names the first counts, a name without a value has an empty one."""
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTES.findall(text):
        found.setdefault(name.lower(), references.unescape(double or single or bare))
    return found


def _names(value: str) -> list[list[str]]:
    """Class tokens in lower case, each in its parts up to a word such as ``has`` or ``no``, parts up to their first digit."""
    found = []
    for token in value.lower().split():
        parts = []
        for part in re.split(r"[_-]+", token):
            part = re.split(r"\d", part, maxsplit=1)[0]
            if part in ABOUT:
                break
            if part:
                parts.append(part)
        if parts:
            found.append(parts)
    return found


@functools.lru_cache(maxsize=20_000)
def _declares_known(tag: str, text: str, article: bool) -> tuple[bool, bool]:
    return declares(tag, attributes(text), article)


def declares(tag: str, of: dict[str, str], article: bool) -> tuple[bool, bool]:
    """Whether a tag's attributes name an article, and whether they name something apart from it.

    Tokens of class, role, id and label are judged one by one. A token that is an aside name sets the box apart. One that
    holds such a name among other parts (``right-sidebar``) does so unless another token names the article or the frame
    of a page. Inside an article ``header`` is not apart, a label says nothing, and the id of a heading or section is an
    anchor of the text, unless it is an aside name or ends with a name of reader comments.
    """
    if "hidden" in of or of.get("aria-hidden", "").strip().lower() == "true" or INVISIBLE.search(of.get("style", "")):
        return False, True
    names, ids = _names(of.get("class", "") + " " + of.get("role", "")), _names(of.get("id", ""))
    content = any(not CONTENT_NAMES.isdisjoint(parts) and ASIDE_NAMES.isdisjoint(parts) for parts in names + ids)
    framed = any(len(parts) == 1 and parts[0] in FRAMES for parts in names + ids)
    if tag in HEADINGS:
        ids = []
    elif article and tag == "section":
        ids = [parts for parts in ids if len(parts) == 1 or parts[-1] in READERS]
    if not article and tag in BLOCKS and tag not in HEADINGS:
        ids = ids + _names(of.get("aria-label", ""))
    apart = ASIDE_NAMES - {"header"} if article or tag in HEADINGS else ASIDE_NAMES
    marked = [parts for parts in names + ids if not apart.isdisjoint(parts)]
    return content, any(len(parts) == 1 for parts in marked) or bool(marked) and not (content or framed)


@dataclass
class Block:
    text: str
    article: bool  # inside a declared article
    open: bool  # inside nothing that is declared to be something else


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order: references decoded, white space inside a block made one blank, empty ones left out.

    A tag that is never closed ends with what surrounds it; end tags without a start, comments and unknown tags end no
    block. Scripts, styles and the like have no text.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # name, in an article, aside
    parts: list[str] = []
    article = aside = False

    def close_block() -> None:
        if parts:
            text = " ".join(references.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(text, article and not aside, not aside))

    def leave(depth: int) -> None:
        nonlocal article, aside
        state = (stack[depth - 1][1], stack[depth - 1][2]) if depth else (False, False)
        # The end of a link or of bold words is inside a block.
        if state != (article, aside) or any(n in BLOCKS for n, _, _ in stack[depth:]):
            close_block()
        del stack[depth:]
        article, aside = state

    at, end = 0, len(page)
    while at < end:
        m = MARKUP.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    leave(depth)
                    break
            else:
                if name in BLOCKS:
                    close_block()
            continue
        if name in BLOCKS:
            close_block()
        enders = [d for d in range(len(stack)) if name in ENDS_ITSELF.get(stack[d][0], ())]
        if enders:
            inner = max(enders)
            # An open paragraph or item ends here, unless something that holds blocks was opened in it.
            if all(n not in BLOCKS or n == stack[inner][0] or name in ("tr", "td", "th") for n, _, _ in stack[inner + 1 :]):
                leave(inner)
        if name in RAW:
            found = RAW_END[name].search(page, at)
            at = found.end() if found else end
            continue
        if name in VOID or m[3].endswith("/"):
            continue
        # Pages of a site repeat their tags; long attributes, such as addresses of pictures, are not remembered.
        known = _declares_known(name, m[3], article) if len(m[3]) <= 100 else declares(name, attributes(m[3]), article)
        content, named = known
        was = aside
        inside = article or name in ("article", "main") or content and name in ("div", "section")
        # A page's header is not the article; an article's own header is part of it.
        apart = name in ASIDE and not (name == "header" and article)
        if name not in ("html", "body", "article", "main"):
            apart = apart or named
        if name in BLOCKS or apart != was or inside != article:
            close_block()
        aside = aside or apart
        article = inside
        stack.append((name, article, aside))
    close_block()
    return out


def host(url: str | None) -> str:
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "", re.I)
    return m[1].lower() if m else ""


#: Values of a byte at each of a word's first places.
PLACED = mixed(np.arange(1, (256 << 6) + 1, dtype=np.uint64))


def _tokens(texts: list[str]) -> np.ndarray:
    """Values of the words of texts, which stand one blank apart: sums of what their bytes are worth at their places."""
    if not texts:
        return np.empty(0, np.uint64)
    buf = np.frombuffer((" ".join(texts).lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(buf == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = (np.arange(len(buf)) - np.repeat(starts, ends - starts + 1)) * 256 + buf
    values = PLACED[np.minimum(place, len(PLACED) - 1)]
    far = np.flatnonzero(place >= len(PLACED))
    values[far] = mixed(place[far].astype(np.uint64) + np.uint64(1))
    return np.add.reduceat(values, starts)


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


#: Parsed pages travel once, compressed some megabytes at a time; a cell's content names it.
CELLS = "chunk long, body binary"
LEVEL = 9  # of their compression: a quarter less than at the usual one, for some hundredths of a second a MB of text
TEXTS = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("texts", pa.list_(pa.string())), ("kinds", pa.list_(pa.int8()))])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of some pages as one compressed cell."""
    for batch in sized(batches, "html"):
        pages = [blocks(text or "") for text in batch.column("html").to_pylist()]
        texts = pa.array([[b.text for b in page] for page in pages], TEXTS.field("texts").type)
        kinds = pa.array([[b.article + 2 * b.open for b in page] for page in pages], TEXTS.field("kinds").type)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, TEXTS, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", LEVEL))) as out:
            out.write_batch(pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), texts, kinds], schema=TEXTS))
        body = sink.getvalue().to_pybytes()
        yield pa.RecordBatch.from_arrays([pa.array([chunk_id(np.frombuffer(body, np.uint8))]), pa.array([body], pa.binary())], ["chunk", "body"])


def _pages(body: bytes) -> tuple[list[int | None], list[str | None], list[list[Block]]]:
    cell = pa.ipc.open_stream(body).read_all()
    ids, urls, texts, kinds = (cell.column(c).to_pylist() for c in TEXTS.names)
    return ids, urls, [[Block(t, bool(k & 1), bool(k & 2)) for t, k in zip(*of, strict=True)] for of in zip(texts, kinds, strict=True)]


class Streams:
    """Token streams of a cell's pages with an id: all their blocks, declared ones included, one page after another."""

    def __init__(self, body: bytes):
        ids, urls, pages = _pages(body)
        self.rows = np.array([i for i, of in enumerate(ids) if of is not None], np.int64)
        pages = [pages[i] for i in self.rows]
        tokens, held, size = [], [], 0
        for page in pages:
            held += [b.text for b in page]
            size += sum(len(b.text) for b in page)
            if size > 1 << 20:
                tokens.append(_tokens(held))
                held, size = [], 0
        self.stream = np.concatenate([*tokens, _tokens(held)])
        counts = [[b.text.count(" ") + 1 for b in page] for page in pages]
        self.ends = np.cumsum([0] + [sum(of) for of in counts])
        self.page = np.repeat(np.arange(len(pages)), np.diff(self.ends))
        self.open = np.repeat(np.array([b.open for page in pages for b in page], bool), np.array([n for of in counts for n in of], np.int64))
        self.hosts = np.array([_hash("//" + host(urls[i])) for i in self.rows], np.uint64)
        #: A page is named by its open text: pages that say the same count as one.
        says = [self.stream[a:b][self.open[a:b]].tobytes() for a, b in zip(self.ends[:-1], self.ends[1:], strict=True)]
        self.names = np.array([int.from_bytes(hashlib.blake2b(of, digest_size=8).digest(), "little", signed=True) for of in says], np.int64)

    def pieces(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Neighbouring windows of ``RUN`` tokens of a page that share a key: their first place, their count and the key.

        A window's key is the least hash of its ``GRAM`` tokens and the host.
        """
        windows = len(self.stream) - RUN + 1
        if windows < 1:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        grams = self.hosts[self.page[: windows + RUN - GRAM]]
        for k in range(GRAM):
            grams = mixed(grams + self.stream[k : k + len(grams)])
        keys = grams[:windows]
        for k in range(1, RUN - GRAM + 1):
            keys = np.minimum(keys, grams[k : k + windows])
        at = np.flatnonzero(self.page[:windows] == self.page[RUN - 1 : RUN - 1 + windows])
        keys, page = keys[at], self.page[at]
        first = np.flatnonzero(_changes(keys, page))
        return at[first], np.diff(first, append=len(at)), keys[first]

    def hosted(self) -> tuple[np.ndarray, np.ndarray]:
        """Hosts and up to ``PAGES`` of their pages' names."""
        order = np.lexsort([self.names, self.hosts])
        hosts, names = self.hosts[order], self.names[order]
        new = _changes(hosts, names)
        hosts, names = hosts[new], names[new]
        few = _rank(_changes(hosts)) < PAGES
        return hosts[few], names[few]


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which of the rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _rank(new: np.ndarray) -> np.ndarray:
    """Place of each row in its group, from 0; ``new`` marks the groups' first rows."""
    first = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(first, np.diff(first, append=len(new)))


def _halves(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Low and high halves of numbers below 2**32: high ones are mostly zeros, which take no room in a shuffle."""
    return (values & 65535).astype(np.uint16), (values >> 16).astype(np.uint16)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.int64) + (high.astype(np.int64) << 16)


def _asked(of: Streams, keys: np.ndarray, at: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    """What a cell asks each bucket: its keys of one page, page by page, its keys of several, and hosts with some names.

    Of a key its low half travels: keys that share it are compared in vain, none is lost.
    """
    names = of.names[of.page[at]]
    order = np.lexsort([names, keys])
    keys, names = keys[order], names[order]
    new = _changes(keys, names)
    keys, names = keys[new], names[new]
    first = np.flatnonzero(_changes(keys))
    count = np.diff(first, append=len(keys))
    single, several = first[count == 1], first[count > 1]
    order = np.lexsort([keys[single], names[single]])
    single, count = single[order], np.minimum(count[count > 1], 65535).astype(np.uint16)
    hosts, says = of.hosted()
    parts = [dict(by_bucket(k, n)) for k in (keys[single], keys[several], mixed(mixed(hosts)))]
    none = np.empty(0, np.int64)
    for b in sorted(set().union(*parts)):
        one, more, held = (p.get(b, none) for p in parts)
        new = np.flatnonzero(_changes(names[single[one]]))
        groups = names[single[one]][new], *_halves(np.diff(new, append=len(one)))
        low = [keys[k].astype(np.uint32) for k in (single[one], several[more])]
        yield b, keys[single[one]], keys[several[more]], pack(np.array([b]), *groups, *low, count[more], hosts[held], says[held])


ASKED = (np.int64, np.int64, np.uint16, np.uint16, np.uint32, np.uint32, np.uint16, np.uint64, np.int64)


def _asks(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Cells()
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("body").to_pylist(), strict=True):
                of = Streams(body)
                at, _, keys = of.pieces()
                for b, _, _, ask in _asked(of, keys, at, n):
                    out.add(chunk, b, ASKS, ask)
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


def _shared(frequent: int):
    """Answers of a bucket: which keys stand on several distinct pages (1) or on more than ``frequent`` (2), and how many pages its hosts have.

    Pages of a host are counted up to ``PAGES``.
    """

    def answer(asks: list[tuple[int, bytes]], out: Cells) -> None:
        parts = [unpack(body, *ASKED) for _, body in asks]
        _, names, low, high, single, several, many, hosts, says = (np.concatenate(c) for c in zip(*parts, strict=True))
        names = np.repeat(names, _joined(low, high))
        order = np.lexsort([names, single])
        alone = single[order][_changes(single[order], names[order])]
        keys, of = np.unique(np.concatenate([alone, several]), return_inverse=True)
        pages = np.bincount(of, np.concatenate([np.ones(len(alone)), many]), len(keys))
        state = (pages > 1).astype(np.uint8) + (pages > max(frequent, 1))
        order = np.lexsort([says, hosts])
        new = _changes(hosts[order], says[order])
        known, need = np.unique(hosts[order][new], return_counts=True)
        need = np.minimum(need, PAGES).astype(np.uint8)
        for (chunk, _), (b, *_, single, several, _, hosts, _) in zip(asks, parts, strict=True):
            own = np.unique(hosts)
            got = [state[np.searchsorted(keys, k)] for k in (single, several)]
            out.add(chunk, int(b[0]), ANSWER, pack(b, *got, own, need[np.searchsorted(known, own)]))

    return answer


def _segments(n: int):
    """The pieces of a cell whose keys stand on several pages, each once with up to ``PAGES`` of its pages' names.

    Windows of frequent keys are pieces of their own, dealt by their tokens. A table tells where the pieces stand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Cells()
        for batch in batches:
            for chunk, body, answers in zip(*(batch.column(c).to_pylist() for c in ("chunk", "body", "answers")), strict=True):
                if answers:
                    _add_segments(chunk, Streams(body), {b: body for b, _, body in map(_cell, answers)}, n, out)
                if out.full():
                    yield from out.take()
        yield from out.take()

    return run


def _cell(of: dict) -> tuple[int, int, bytes]:
    return of["bucket"], of["kind"], of["body"]


def _add_segments(chunk: int, of: Streams, answers: dict[int, bytes], n: int, out: Cells) -> None:
    at, count, keys = of.pieces()
    asked, states, hosts, needs = [], [], [], []
    for b, single, several, _ in _asked(of, keys, at, n):
        _, one, more, own, need = unpack(answers[b], np.int64, np.uint8, np.uint8, np.uint64, np.uint8)
        asked += [single, several]
        states += [one, more]
        hosts.append(own)
        needs.append(need)
    if not asked:
        return
    order = np.argsort(np.concatenate(asked))
    asked, states = np.concatenate(asked)[order], np.concatenate(states)[order]
    order = np.argsort(np.concatenate(hosts))
    hosts, needs = np.concatenate(hosts)[order], np.concatenate(needs)[order]

    state = states[np.searchsorted(asked, keys)] if len(asked) else np.zeros(len(keys), np.uint8)
    need = needs[np.searchsorted(hosts, of.hosts[of.page[at]])]
    whole, dealt = np.flatnonzero((state == 1) & (need > 1)), np.flatnonzero((state == 2) & (need > 1))
    window = spread(at[dealt], count[dealt])
    hashed = of.hosts[of.page[window]]
    for k in range(RUN):
        hashed = mixed(hashed + of.stream[window + k])
    first, size = np.concatenate([at[whole], window]), np.concatenate([count[whole], np.ones(len(window), np.int64)])
    if not len(first):
        return
    dealer, need = np.concatenate([keys[whole], hashed]), np.concatenate([need[whole], np.repeat(need[dealt], count[dealt])])

    known: dict[tuple[int, bytes], int] = {}
    piece = np.empty(len(first), np.int64)
    for i, (a, b, h) in enumerate(zip(first.tolist(), (first + size + RUN - 1).tolist(), of.hosts[of.page[first]].tolist(), strict=True)):
        piece[i] = known.setdefault((h, of.stream[a:b].tobytes()), len(known))
    one = np.unique(piece, return_index=True)[1]
    names = of.names[of.page[first]]
    order = np.lexsort([names, piece])
    new = _changes(piece[order], names[order])
    owner, names = piece[order][new], names[order][new]
    few = _rank(_changes(owner)) < PAGES
    owner, names = owner[few], names[few]
    start, each = np.searchsorted(owner, np.arange(len(one))), np.bincount(owner, minlength=len(one))

    page = of.page[first]
    out.add(chunk, chunk % n, TABLE, pack(*_halves(piece), *_halves(of.rows[page]), *_halves(first - of.ends[page])))
    for b, ids in by_bucket(dealer[one], n):
        row = one[ids]
        words, codes = np.unique(of.stream[spread(first[row], size[row] + RUN - 1)], return_inverse=True)
        hosts, place = np.unique(of.hosts[of.page[first[row]]], return_inverse=True)
        own = names[spread(start[ids], each[ids])]
        small = need[row], each[ids].astype(np.uint8)
        out.add(chunk, b, ASKS, pack(hosts, own, words, *small, *_halves(ids), *_halves(place), *_halves(size[row]), *_halves(codes)))


SEGMENTS = (np.uint64, np.int64, np.uint64, np.uint8, np.uint8, *[np.uint16] * 8)


def _repeated(asks: list[tuple[int, bytes]], out: Cells) -> None:
    """Suffix array of a bucket's pieces: answers the places in pieces whose ``RUN`` tokens stand on as many pages as their host needs.

    Suffixes are in order, and those of a host that share ``RUN`` tokens form a run. Its distinct pages are counted up
    to ``PAGES``: a piece names so many of its pages.
    """
    ids, hosts, needs, sizes, each, names, values, cell = [], [], [], [], [], [], [], []
    for i, (_, body) in enumerate(asks):
        places, says, words, need, pages, *halves = unpack(body, *SEGMENTS)
        own, place, size, codes = (_joined(*halves[k : k + 2]) for k in range(0, 8, 2))
        ids.append(own)
        hosts.append(places[place])
        needs.append(need)
        sizes.append(size)
        each.append(pages.astype(np.int64))
        names.append(says)
        values.append(words[codes])
        cell.append(np.full(len(own), i))
    ids, hosts, needs, sizes, each, names, values, cell = (np.concatenate(c) for c in (ids, hosts, needs, sizes, each, names, values, cell))
    first = np.cumsum(sizes + RUN - 1) - (sizes + RUN - 1)
    said = np.cumsum(each) - each
    piece = np.repeat(np.arange(len(ids)), sizes)
    inner = spread(np.zeros(len(ids), np.int64), sizes)
    at = first[piece] + inner
    # A suffix stands once for each page that its piece names.
    row = np.repeat(np.arange(len(piece)), each[piece])
    page = names[spread(said[piece], each[piece])]
    columns = [hosts[piece][row], *[values[at + k][row] for k in range(RUN)]]
    order = np.lexsort([page, *columns[::-1]])
    head = _changes(*[c[order] for c in columns])
    run = np.cumsum(head) - 1
    pages = np.bincount(run[head | _changes(page[order])])[run]
    hit = np.unique(row[order[np.minimum(pages, PAGES) >= needs[piece[row[order]]]]])
    cuts = np.searchsorted(cell[piece[hit]], np.arange(len(asks) + 1))
    for i, (chunk, _) in enumerate(asks):
        own = hit[cuts[i] : cuts[i + 1]]
        if len(own):
            out.add(chunk, 0, ANSWER, pack(*_halves(ids[piece[own]]), *_halves(inner[own])))


def _starts(answers: list[dict] | None, pages: int) -> list[list[int]]:
    """Of each page of a cell the places at which a repeated run of tokens begins."""
    cells = [_cell(of) for of in answers or ()]
    tables = [body for _, kind, body in cells if kind == TABLE]
    hits = [unpack(body, *[np.uint16] * 4) for _, kind, body in cells if kind == ANSWER]
    found: list[list[int]] = [[] for _ in range(pages)]
    if tables and hits:
        halves = unpack(tables[0], *[np.uint16] * 6)  # equal cells have equal tables
        piece, page, at = (_joined(*halves[k : k + 2]) for k in (0, 2, 4))
        ids, inner = (np.concatenate([_joined(*of[k : k + 2]) for of in hits]) for k in (0, 2))
        order = np.argsort(ids, kind="stable")
        ids, inner = ids[order], inner[order]
        low, high = np.searchsorted(ids, piece), np.searchsorted(ids, piece, side="right")
        start = np.repeat(at, high - low) + inner[spread(low, high - low)]
        for of, s in zip(np.repeat(page, high - low).tolist(), start.tolist(), strict=True):
            found[of].append(s)
    return found


def main_text(page: list[Block], starts: list[int]) -> list[Block]:
    """The blocks of the main text. ``starts``: places in the page's stream at which a repeated run of tokens begins.

    Open blocks are kept but for what repeated runs cover, at any share and inside declared articles too; a block that
    they cover in part keeps its other tokens. Of what is left, the declared blocks are the main text if they hold
    more words than the other open blocks, else all of it is.
    """
    sizes = [len(b.text.split()) for b in page]
    total = sum(sizes)
    covered = np.zeros(total + 1, np.int32)
    for s in starts:
        covered[s] += 1
        covered[min(s + RUN, total)] -= 1
    covered = np.cumsum(covered[:-1]) > 0
    kept, at = [], 0
    for b, size in zip(page, sizes, strict=True):
        c = covered[at : at + size]
        at += size
        if not b.open or c.all():
            continue
        if c.any():  # what only touches the block's ends belongs to a run of its neighbours
            edge = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]])))
            for low, high in edge.reshape(-1, 2):
                c[low:high] = high - low >= RUN
            b = Block(" ".join(w for w, gone in zip(b.text.split(), c, strict=True) if not gone), b.article, True)
        kept.append(b)
    declared = [b for b in kept if b.article]
    words = [sum(len(b.text.split()) for b in some) for some in (declared, kept)]
    return declared if 2 * words[0] > words[1] else kept


def extract(pages: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``page_id``, ``url``, ``text``: the main text of every row of ``pages`` (``page_id``, ``url``, ``html``).

    Blocks stand in page order, joined by two line feeds. A null or blank page gives an empty text; a null url is a
    host of its own; repeated rows give equal results each, and pages with equal open texts are no distinct pages; null
    ids are kept and compared with nothing. An empty table gives an empty result.

    The token streams of all pages are compared. A run of ``RUN`` tokens is keyed by its host and the least hash of its
    ``GRAM`` tokens; keys of one page are left out first. A bucket sorts the suffixes of whole keys; the windows of a key
    on more than ``frequent`` distinct pages are dealt one by one. Pages are parsed once and travel once, compressed as
    cells of neighbours; cells and buckets ask and answer in packed arrays. Equal pieces of a cell are put together
    before they travel: ``PAGES`` of their pages tell on how many a run stands.
    """
    n = partitions(pages.sparkSession)
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    cells = own.mapInArrow(_cells, CELLS).repartition(n, "chunk")  # read three times, written once

    def with_answers(answers: DataFrame) -> DataFrame:
        answers = answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "kind", "body")).alias("answers"))
        return cells.join(answers.hint("shuffle_hash"), "chunk", "left")

    shared = answered(cells.mapInArrow(_asks(n), MOVED), n, _shared(frequent))
    found = answered(with_answers(shared).mapInArrow(_segments(n), MOVED), n, _repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, answers in zip(batch.column("body").to_pylist(), batch.column("answers").to_pylist(), strict=True):
                ids, urls, parsed = _pages(body)
                texts = ["\n\n".join(b.text for b in main_text(*of)) for of in zip(parsed, _starts(answers, len(ids)), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return with_answers(found).mapInArrow(run, "page_id long, url string, text string")


def op3_host_suffixes(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
