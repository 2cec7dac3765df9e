r"""Main text of web pages by a host suffix array.

A page is cut into blocks of text, each with a zone: *article* or *main* inside
such an element, *box* inside a menu, footer, advert, form and the like, *open*
where the markup says nothing, and *article?* or *main?* inside an element of the
main text whose class is also used for parts of articles (related, share, more).

The token streams of all blocks of all pages of a host are concatenated; a suffix
array over them finds the substrings of GRAM tokens and more, and on how many
distinct pages each is. A token lies in a substring that LEAST_PAGES pages share,
however long, exactly if it lies in one of GRAM tokens, so these are what is
kept. Partial arrays, one for each batch of pages, are merged by counting equal
substrings, so a host of any size is spread over all tasks. Pages that are equal
as a whole count as one, so copies of a page do not make its text boilerplate.

Each page's text is then what the array leaves of its article blocks (or main
ones, where no page element is an article; of a page without either, of its open
blocks):

* of open and doubtful blocks, tokens that LEAST_PAGES pages share go;
* of several articles, those that LEAST_PAGES pages share as a whole go;
* of an article's other blocks, those of GRAM tokens and more go that are in whole
  on over half of the host's pages and on TEMPLATE_PAGES: a notice that the
  host's template puts there. Lines that fewer articles have are their text;
* the last two only if over half of the article text stays: the rest is copies.

Boxes are no text of the page, whether other pages repeat them or not.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Tokens of the shortest substring that counts as repeated.
GRAM = 6
#: A substring is boilerplate on this many different pages of a host, whatever its size.
LEAST_PAGES = 3
#: A block inside an article is the template's on this many pages at least, and over half of the host's.
TEMPLATE_PAGES = 6
#: Substrings that go to the workers by broadcast, at most (16 bytes each); more are joined.
BROADCAST_GRAMS = 1 << 21
#: Substrings that a task holds before it passes them on, and that one range of keys has, about.
HELD_GRAMS = 1 << 22
RANGE_GRAMS = 1 << 18
#: Bits of a substring's key below those of its range: two keys are equal by chance once in 2 ** 26.
KEY_BITS = 44
KEY_BYTES = -(-KEY_BITS // 8)

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.DOTALL)
HINT = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
#: Fixed names: elements whose content is not text of the page.
RAW = frozenset("script style textarea title noscript template iframe svg math object".split())
#: Fixed names: elements that hold something else than the article.
BOXES = frozenset("nav footer aside form button select option dialog menu datalist fieldset label input".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new sibling closes although it has no end tag.
CLOSES_ITSELF = {"p": frozenset(["p"]), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
#: Words in class, id and role that mark a box.
BOX_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription sidebar side widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist reply replies respond disqus "
    "related recommend recommended recommendations more share sharing social login signin signup register search pagination pager toolbar copyright skip hidden complementary contentinfo".split()
)
#: Of these, the ones that say nothing inside the main text beside other words.
SOFT = frozenset(("header", "side", "more"))
#: Of these, the ones that articles use too: inside the main text, the host's pages decide.
DOUBTFUL = frozenset("related recommend recommended recommendations more share sharing social search widget widgets header side menu pagination pager toolbar".split())
#: Words that mark the main text of a page without article and main elements.
MAIN_WORDS = re.compile(r"(?:^|\s)(?:article|post|entry|story|page)[-_]?(?:body|content|text)(?:\s|$)|(?:^|\s)articlebody(?:\s|$)", re.IGNORECASE)


#: Kinds of elements seen, by tag, attributes and place; bounded.
_KINDS: dict[tuple[str, str, bool], str] = {}


def _kind(tag: str, attrs: str, in_main: bool) -> str:
    """box, main, doubt or nothing, for an element."""
    key = tag, attrs, in_main
    if key not in _KINDS:
        if len(_KINDS) >= 4096:
            _KINDS.clear()
        _KINDS[key] = _kind_of(tag, attrs, in_main)
    return _KINDS[key]


def _kind_of(tag: str, attrs: str, in_main: bool) -> str:
    if tag in BOXES:
        return "box"
    if tag == "header":
        return "" if in_main else "box"
    if re.search(r"(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", attrs, re.IGNORECASE):
        return "box"
    hints = [next(filter(None, m.groups()), "") for m in HINT.finditer(attrs)] if "=" in attrs else []
    if tag not in ("article", "main", "body", "html") or tag == "article":
        for h in hints:
            words = set(re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", h).lower()))
            # article-header and the like belong to the article
            if marks := words & BOX_WORDS - (SOFT if in_main and len(words) > 1 else frozenset()):
                return "doubt" if in_main and marks <= DOUBTFUL else "box"
    if tag in ("article", "main") or any(h.strip().lower() == "main" or MAIN_WORDS.search(h) for h in hints):
        return "main"
    if re.search(r"itemprop\s*=\s*[\"']?articleBody", attrs):
        return "main"
    return ""


def blocks(page: str) -> list[tuple[str, int, str]]:
    """(zone, unit, text) of each block with text, in page order.

    Zones: article (in an article), main, box, open; article? and main? of doubtful elements.
    The unit numbers outermost article and main elements."""
    out: list[tuple[str, int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str, int]] = []  # element, zone and unit inside it
    zone, unit, units = "open", 0, 0

    def end() -> None:
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = html.unescape(text)
            if text := " ".join(text.split()):
                out.append((zone, unit, text))
            parts.clear()

    pos, n = 0, len(page)
    while pos < n:
        m = MARKUP.search(page, pos)
        if not m:
            parts.append(page[pos:])
            break
        if m.start() > pos:
            parts.append(page[pos : m.start()])
        pos = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if not closing and tag in RAW:
            if tag in BLOCKS:
                end()
            if not (attrs.endswith("/") and tag in ("svg", "math")):
                stop = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, pos)
                pos = stop.end() if stop else n
            continue
        if tag in BLOCKS or tag in BOXES:
            end()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            _, zone, unit = stack[-1] if stack else ("", "open", 0)
        elif tag not in VOID:
            if tag in CLOSES_ITSELF and stack and stack[-1][0] in CLOSES_ITSELF[tag]:
                stack.pop()
                _, zone, unit = stack[-1] if stack else ("", "open", 0)
            if tag in BLOCKS or tag in BOXES or tag in ("span", "a"):
                if zone == "box":
                    inner = "box"
                else:
                    kind = _kind(tag, attrs, zone != "open")
                    inner = {"box": "box", "main": "article" if tag == "article" or zone.startswith("article") else "main", "doubt": zone.rstrip("?") + "?", "": zone}[kind]
                    if zone.endswith("?") and inner == zone[:-1]:
                        inner = zone
                if tag not in BLOCKS and tag not in BOXES:
                    if inner == zone:
                        stack.append((tag, zone, unit))
                        continue
                    end()
                if inner != "box" and inner.rstrip("?") != zone.rstrip("?"):
                    units += 1
                    unit = units
                stack.append((tag, inner, unit))
                zone = inner
            else:
                stack.append((tag, zone, unit))
    end()
    return out


def zoned(page: str) -> tuple[list[str], list[str]]:
    """The texts of a page's blocks, and the zone and unit of each as one word."""
    found = blocks(page)
    return [t for _, _, t in found], [f"{z}:{u}" for z, u, _ in found]


def suffix_array(tokens: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of the suffixes by their first ``depth`` tokens, numbers below their
    count, by prefix doubling: equal ranks have equal prefixes."""
    rank = tokens - tokens.min()
    have = 1
    while have < depth:
        step = min(have, depth - have)
        later = np.zeros(len(rank), dtype=np.int64)
        later[: len(rank) - step] = rank[step:] + 1
        _, rank = np.unique(rank.astype(np.int64) * (len(rank) + 2) + later, return_inverse=True)
        have += step
    return rank


#: Odd factors, one for each place in a substring.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)


def laid(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """The blocks' tokens one after the other as numbers of words, each block followed by
    gaps (-1), so that no substring runs over its end; the words; each block's begin and size."""
    words: dict[str, int] = {}
    numbers: list[int] = []
    begin, size, gap = [], [], [-1] * (GRAM - 1)
    for text in texts:
        t = text.split()
        begin.append(len(numbers))
        size.append(len(t))
        numbers += [words.setdefault(w, len(words)) for w in t]
        numbers += gap
    return np.array(numbers, dtype=np.int64), list(words), np.array(begin, dtype=np.int64), np.array(size, dtype=np.int64)


def starts(numbers: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Where substrings of GRAM tokens start; a shorter block has one of all its tokens."""
    full = np.zeros(len(numbers), dtype=bool)
    full[: len(numbers) - GRAM + 1] = numbers[GRAM - 1 :] >= 0
    full &= numbers >= 0
    full[begin[size > 0]] = True
    return np.flatnonzero(full)


def gram_hashes(numbers: np.ndarray, words: list[str]) -> np.ndarray:
    """A hash of the GRAM tokens from each place on; a gap adds nothing."""
    import xxhash

    known = np.array([xxhash.xxh3_64_intdigest(w) or 1 for w in words] + [0], dtype=np.uint64)
    t = np.concatenate([known[numbers], np.zeros(GRAM - 1, dtype=np.uint64)])
    out = np.zeros(len(numbers), dtype=np.uint64)
    for j in range(GRAM):
        out += t[j : j + len(numbers)] * PLACES[j]
    return out


def host_hash(host: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(host)


def keyed(hashes: np.ndarray, host: np.ndarray | np.uint64, bits: int) -> np.ndarray:
    """Keys of hosts' substrings: ``bits`` for their range and KEY_BITS below. No tokens
    at all, hash 0, have the key under which a host's pages are counted."""
    x = hashes ^ host
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(64 - KEY_BITS - bits)


def grams(block: str) -> list[int]:
    """A hash of the GRAM tokens from each token on; a shorter block has one of all tokens."""
    numbers, words, begin, size = laid([block])
    return gram_hashes(numbers, words)[starts(numbers, begin, size)].view(np.int64).tolist()


def host_repeats(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each GRAM-token substring of the pages' blocks, and its number of
    distinct pages: adjacent suffixes of the array with an equal prefix."""
    numbers, words, begin, size = laid([t for p in pages for t in p])
    if not words:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    page = np.repeat(np.repeat(np.arange(len(pages)), [len(p) for p in pages]), size + GRAM - 1)
    at = starts(numbers, begin, size)
    rank = suffix_array(numbers, GRAM)[at].astype(np.int64)
    _, first = np.unique(rank, return_index=True)
    _, count = np.unique(np.unique(rank * len(pages) + page[at]) // len(pages), return_counts=True)
    return gram_hashes(numbers, words)[at[first]], count


def host_substrings(pages: list[list[str]]) -> dict[int, int]:
    """What ``host_repeats`` finds, as a dict."""
    hashes, count = host_repeats(pages)
    return dict(zip(hashes.view(np.int64).tolist(), count.tolist(), strict=True))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of the counts of each."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts[order], at)


def packed(numbers: np.ndarray, width: int) -> bytes:
    """Whole numbers below 256 ** width, byte by byte of all of them, which compresses well."""
    return zlib.compress(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def unpacked(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel().astype(np.uint64)


def uncovered(texts: list[str], boilerplate: set[int]) -> list[str]:
    """The blocks without the tokens that a boilerplate substring covers."""
    out = []
    for block in texts:
        t = block.split()
        covered = [False] * len(t)
        for i, g in enumerate(grams(block)):
            if g in boilerplate:
                covered[i : i + GRAM] = [True] * len(covered[i : i + GRAM])
        if left := " ".join(w for w, c in zip(t, covered, strict=True) if not c):
            out.append(left)
    return out


class Asked:
    """Pages, and what the array is asked about them: the keys of the substrings of the
    blocks that may be a page's text, page by page, and last in each the key of its host's pages."""

    def __init__(self, texts: Iterator, zones: Iterator[str], hosts: Iterator[str], bits: int) -> None:
        self.found, self.main = [], []
        for t, z in zip(texts, zones, strict=True):
            at = [(x, int(u)) for x, _, u in (w.rpartition(":") for w in z.split())]
            kinds = {x for x, _ in at}
            main = next((x for x in ("article", "main", "article?", "main?") if x in kinds), "open").rstrip("?")
            self.main.append(main)
            self.found.append([(x, u, text) for (x, u), text in zip(at, t, strict=True) if x.rstrip("?") == main])
        self.numbers, words, self.begin, self.size = laid([t for f in self.found for _, _, t in f])
        blocks = np.cumsum([0, *(len(f) for f in self.found)])
        ends = np.append(self.begin, len(self.numbers))[blocks]
        self.blocks = blocks.tolist()
        place = starts(self.numbers, self.begin, self.size) if words else np.empty(0, dtype=np.int64)
        hashes = gram_hashes(self.numbers, words)[place] if words else np.empty(0, dtype=np.uint64)
        last = np.searchsorted(place, ends[1:])
        # a place of -1 stands for the host's pages
        self.place = np.insert(place, last, -1)
        self.edges = np.concatenate([[0], last + np.arange(1, len(last) + 1)])
        page = np.repeat(np.arange(len(last)), np.diff(self.edges))
        self.keys = keyed(np.insert(hashes, last, np.uint64(0)), np.array([host_hash(h) for h in hosts], dtype=np.uint64)[page], bits)

    def text(self, i: int, n: np.ndarray, least_pages: int) -> str:
        """The text of a page, see above; ``n`` are the pages that have each of its substrings, 0 for rare ones."""
        found, main = self.found[i], self.main[i]
        if len(n) < 2 or n[:-1].max() < least_pages:
            return " ".join(t for _, _, t in found)
        place, n, all_pages = self.place[self.edges[i] : self.edges[i + 1] - 1], n[:-1], n[-1]
        begin, size = (x[self.blocks[i] : self.blocks[i + 1]] for x in (self.begin, self.size))
        numbers = self.numbers[begin[0] : begin[-1] + size[-1] + GRAM - 1]

        def cover(hit: np.ndarray) -> np.ndarray:
            out = np.zeros(len(numbers), dtype=bool)
            for j in range(GRAM):
                out[place[hit] - begin[0] + j] = True
            return out & (numbers >= 0)

        shared = cover(n >= least_pages)
        spans = [slice(b, b + k) for b, k in zip((begin - begin[0]).tolist(), size.tolist(), strict=True)]
        gone = set()
        if main != "open":
            template = cover((n >= TEMPLATE_PAGES) & (2 * n > all_pages))
            own = [j for j, (z, _, _) in enumerate(found) if z == main]
            units: dict[int, bool] = {}
            for j in own:
                units[found[j][1]] = units.get(found[j][1], True) and bool(shared[spans[j]].all())
            teasers = {u for u, x in units.items() if x} if not all(units.values()) else set()
            gone = {j for j, (_, u, _) in enumerate(found) if u in teasers} | {j for j in own if size[j] >= GRAM and template[spans[j]].all()}
            if 2 * sum(size[j] for j in gone) >= size.sum():
                gone = set()
        out = []
        for j, (z, _, t) in enumerate(found):
            if j in gone:
                continue
            covered = shared[spans[j]]
            if (z != main or main == "open") and covered.any():
                t = " ".join(w for w, c in zip(t.split(), covered.tolist(), strict=True) if not c)
            if t:
                out.append(t)
        return " ".join(out)


def looked_up(wanted: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The counts of the wanted keys, 0 for others than ``keys``, which are in order."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64)
    wanted = wanted.view(np.int64)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[i] == wanted, counts[i], 0)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``.

    White space inside a block is one space, blocks are joined by one space in
    page order, character references are decoded. A null html counts as empty;
    a page without text has an empty text. Null or odd URLs share the host "".
    Pages are told apart by row, so null and repeated ids are extracted each.
    An empty table gives an empty result; other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    rows = C.small_batches(pages).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), C.whole_text(html_col).alias("html"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [zoned(h) for h in b["html"]]
            digest = [hashlib.sha256("\x01".join([h, " ".join(z), *t]).encode("utf-8", "surrogatepass")).digest()[:20] for h, (t, z) in zip(b["host"], got, strict=True)]
            yield pd.DataFrame({"row": b["row"], "page_id": b["page_id"].astype("Int64"), "url": b["url"], "host": b["host"], "texts": [t for t, _ in got], "zones": [" ".join(z) for _, z in got], "digest": digest})

    parsed = rows.mapInPandas(read, "row bigint, page_id bigint, url string, host string, texts array<string>, zones string, digest binary")
    # row numbers are written with the blocks, so that all that follows agrees on them
    parsed = C.materialise(parsed, "html-blocks", "zstd")

    # pages that are equal as a whole count as one
    same = parsed.groupBy("digest").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = C.materialise(same, "html-copies")
    n_copies = same.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    different = parsed.select("row", "host", "texts")
    if n_copies:
        copies = C.join_by_digest(parsed.select("row", "digest"), same, "digest", "n", n_copies, "row").where("row > first").select("row")
        different = C.without(different, "row", copies)

    # ranges of keys: as many as the tokens need, of which a page has one for five characters or so
    chars = parsed.agg(F.sum(F.aggregate("texts", F.lit(0).cast("bigint"), lambda n, t: n + F.length(t)))).first()[0] or 0
    bits = min(16, max(4, (chars // 5 // RANGE_GRAMS).bit_length()))

    def arrays(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pd.DataFrame:
            keys, counts = summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            ranges = (keys >> np.uint64(KEY_BITS)).astype(np.int64)
            low = keys & np.uint64((1 << KEY_BITS) - 1)
            edges = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(keys)]
            parts = [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            return pd.DataFrame({"range": [int(ranges[x.start]) for x in parts], "keys": [packed(np.diff(low[x], prepend=np.uint64(0)), KEY_BYTES) for x in parts], "counts": [packed(counts[x], 4) for x in parts]})

        for b in batches:
            streams = defaultdict(list)
            for h, texts in zip(b["host"], b["texts"], strict=True):
                streams[h].append(list(texts))
            for h, texts in streams.items():
                hashes, counts = host_repeats(texts)
                held.append((keyed(np.append(hashes, np.uint64(0)), np.uint64(host_hash(h)), bits), np.append(counts, len(texts))))
            if sum(len(k) for k, _ in held) >= HELD_GRAMS:
                yield emit()
        if held:
            yield emit()

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.cumsum(unpacked(x, KEY_BYTES), dtype=np.uint64) for x in part["keys"]])
        keys, n = summed(keys, np.concatenate([unpacked(x, 4).astype(np.int64) for x in part["counts"]]))
        keys, n = keys[n >= least_pages], n[n >= least_pages]
        return pd.DataFrame({"gram": ((np.uint64(part["range"].iloc[0]) << np.uint64(KEY_BITS)) | keys).view(np.int64), "n": n})

    found = different.select("host", "texts").mapInPandas(arrays, "range bigint, keys binary, counts binary")
    found = C.materialise(found.groupBy("range").applyInPandas(merged, "gram bigint, n bigint"), "html-grams")
    n_found = found.count()
    schema = "page_id bigint, url string, text string"

    if n_found <= BROADCAST_GRAMS:
        got = found.toArrow()
        keys, counts = got["gram"].to_numpy(), got["n"].to_numpy()
        order = np.argsort(keys)
        sent = pages.sparkSession.sparkContext.broadcast((keys[order], counts[order]))

        def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                asked = Asked(b["texts"], b["zones"], b["host"], bits)
                n = looked_up(asked.keys, *sent.value)
                text = [asked.text(i, n[x:y], least_pages) for i, (x, y) in enumerate(zip(asked.edges[:-1], asked.edges[1:], strict=True))]
                yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": text})

        out = parsed.select("page_id", "url", "host", "texts", "zones").mapInPandas(decide, schema)
        return out.withColumn("n_chars", F.length("text").cast("bigint"))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked = Asked(b["texts"], b["zones"], b["host"], bits)
            got = pd.DataFrame({"row": np.repeat(b["row"].to_numpy(), np.diff(asked.edges)), "key": asked.keys.view(np.int64)})
            yield got.drop_duplicates()

    def trim(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            asked, text = Asked(b["texts"], b["zones"], b["host"], bits), []
            for i, met in enumerate(b["met"]):
                pairs = sorted((x["gram"], x["n"]) for x in met) if met is not None else []
                n = looked_up(asked.keys[asked.edges[i] : asked.edges[i + 1]], np.array([g for g, _ in pairs], dtype=np.int64), np.array([c for _, c in pairs], dtype=np.int64))
                text.append(asked.text(i, n, least_pages))
            yield pd.DataFrame({"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": text})

    wanted = parsed.select("row", "host", "texts", "zones").mapInPandas(own, "row bigint, key bigint")
    total = found.agg(F.sum("n")).first()[0]
    met = C.join_by_digest(wanted, found.select(F.col("gram").alias("key"), "gram", "n"), "key", "n", total, "row")
    met = met.where("gram is not null").groupBy("row").agg(F.collect_list(F.struct("gram", "n")).alias("met"))
    out = parsed.join(met, "row", "left").select("page_id", "url", "host", "texts", "zones", "met").mapInPandas(trim, schema)
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


C.ship(__name__)
