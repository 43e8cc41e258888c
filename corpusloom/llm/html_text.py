"""HTML extraction: structure, and a suffix array over the pages of a host.

A page becomes blocks: runs of text between block tags, with character references decoded and white space made
one space. Never text are scripts, styles, forms and the like, navigation and sidebars, headers and footers of the page, and elements
whose class or id names an advert, a notice, a menu, related pages or reader comments (an <article> in a comment section included). Of
a header in an article its headings are text, of a footer nothing. Of a page with an <article> or <main>, the
blocks inside are the article. There, names that only hint at what stands around a text (`social`, `share`, `widget`) do not
mark paragraphs, headings, quotations or code.

Every page's blocks then go through repeats on its host: the token streams of the host's pages are concatenated and a suffix array
is built over them by doubling or tripling; neighbours in it give every token run of at least `least` tokens that occurs on two distinct
pages, in one block or across several. A page has a stream of its open blocks and one of its author's; runs don't go from one to the other,
and author's words only equal author's words. Open are all blocks of a page without an article, and in an article
blocks that are neither paragraphs nor headings, quotations, code or tables (lists and bare text of containers: share
links, author notes, teasers). A block is boilerplate if runs that stand on three
distinct bodies (and ids) of the host cover at least `share` of its tokens; equal streams are one body. What
only two bodies share can be a copy or a quote, which is text of the page, and stays. A check of the structure follows: an author's block stays even if it is
boilerplate by its repeats, as repeats in an article's paragraphs are the author's (quotes, summaries, passages) and the main text must be whole.

A host may hold a third of all pages: hosts are dealt to shards of about PAGES pages by a number that each row gets once,
so equal rows are spread too, and the number of shards of a host comes from a table of 65,536 counters (an upper bound of a host's
pages whose size doesn't grow). The suffix array of a host in one shard has all its repeats. Repeats of a host in several shards are those of the whole host too:
each shard sends the least hash of GRAM tokens in each of its runs, once (equal runs have equal ones, and neighbours share theirs), and learns which of them
other shards have; the 64-bit keys of runs that may so be repeated are dealt to buckets by key, counted there over all pages, and those of the repeated ones go back to the
shards, where they mark places of the suffix array. The shards change no result. The pages are parsed once for the shuffle to shards, which all passes read;
the number that deals rows follows the order of reading, so a table has to be read in the same order if a task is run again.

Null html is the empty page, whose text is empty. Very long pages are read whole. Repeated rows are pages of one id; runs that they share don't
count as distinct pages. Pages without a host share the host "". Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import M1, M2, column, mix, read

LEAST = 8
SHARE = 0.8
#: Distinct bodies of a host that boilerplate stands on, at least.
BODIES = 3
PAGES = 512
COUNTERS = 1 << 16
#: Characters of html whose runs share a bucket of keys.
BUCKET = 1 << 25
#: Tokens of the parts of a run of which the one with the least hash stands for it in other shards.
GRAM = 4
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br_ dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption center".split())
#: Elements that never hold main text; header and footer only outside an article.
DROPPED = frozenset("head title script style noscript template nav aside form button select option textarea input iframe svg canvas object audio video dialog menu".split())
OUTSIDE = frozenset(("header", "footer"))
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp"))
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words of class and id names of adverts, notices, comments and the like: they mark any element.
MARKS = frozenset("ad ads adv advert advertisement adverts advertising sponsor sponsored cookie cookies consent gdpr newsletter subscribe subscription signup login comment comments disqus reply replies breadcrumb breadcrumbs pagination pager hidden".split())
#: Words that mark elements which hold others, but not paragraphs, headings, quotations or code inside an article.
HINTS = frozenset("banner promo promoted sidebar side-bar aside nav navbar navigation menu header masthead footer notice notices popup modal overlay share sharing social related recommended widget toolbar".split())
#: With one of these beside it, a hint names the layout of a whole page (`page-with-sidebar`), not a part of it.
LAYOUT = frozenset("with has no page layout wrapper wrap container site row grid".split())
#: Elements of an article whose text is the author's.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table tr td th caption figcaption dl dt dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)|[^<]+|<", re.DOTALL)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: A start tag that ends an open paragraph.
CLOSES_P = BLOCK - {"html", "body", "br_", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}


def _dropped(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is no text by its tag, role, class or id; `inside` an article."""
    if tag in DROPPED or (tag in OUTSIDE and not inside):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            for n in value.split():
                words = {*re.split(r"[-_]+", n), n}
                if words & MARKS or words & HINTS and not words & LAYOUT and not (inside and tag in PROSE) and tag != "article":
                    return True
        elif name == "role" and value in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


#: Kinds of blocks: outside of an article; open ones inside; the author's.
OUTER, OPEN, AUTHOR = "-", "?", "+"


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of each visible block, in order."""
    out: list[tuple[str, str]] = []
    run: list[str] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, dropped, inside an article, in prose, in an article's header
    dropped = inside = prose = heading = False

    def close() -> None:
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                out.append((OUTER if not inside else AUTHOR if prose else OPEN, text))
            run.clear()

    def pop(to: int) -> None:
        nonlocal dropped, inside, prose, heading
        del stack[to:]
        dropped, inside, prose, heading = stack[-1][1:] if stack else (False, False, False, False)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        hidden = dropped or heading and not prose
        if not tag:
            if not hidden and (page[m.start()] != "<" or m[0] == "<"):
                run.append(m[0])
            elif not hidden and m[0].startswith("<![CDATA["):
                run.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), (m[3] or m[6] or "")
        if tag == "br" or tag == "hr":
            run.append(" ") if not hidden else None
            close() if tag == "hr" else None
            continue
        if tag in BLOCK:
            close()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if stack[k][0] in ("article", "main", "body", "table") and tag not in ("html", "body", "main", "article"):
                    break
            continue
        if tag in CLOSES_P or tag in ("p", "li", "dd", "dt", "td", "th", "tr", "option"):
            peers = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr",), "option": ("option",)}.get(tag, ())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" and tag in CLOSES_P or stack[k][0] in peers:
                    pop(k)
                    break
                if stack[k][0] in BLOCK or stack[k][1]:
                    break
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        within = inside or tag in ("article", "main")
        hide = dropped or _dropped(tag, attributes, within) or tag == "footer" and inside
        if tag in RAW:
            close_at = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.IGNORECASE).search(page, at)
            if not hide and not hidden:
                run.append(page[at : close_at.start() if close_at else end])
            at = close_at.end() if close_at else end
            continue
        head = heading or tag == "header" and inside
        stack.append((tag, hide, within, within and (heading and prose or tag in HEADINGS if head else prose or tag in PROSE), head))
        dropped, inside, prose, heading = stack[-1][1:]
    close()
    return out


def streamed(found: list[tuple[str, str]]) -> tuple[list[str], list[str]]:
    """The blocks of a page's two streams: open ones of an article, or all of a page without one; and the author's."""
    if all(k == OUTER for k, _ in found):
        return [t for _, t in found], []
    return [t for k, t in found if k == OPEN], [t for k, t in found if k == AUTHOR]


def suffix_array(s: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions in order of their suffixes, and the ranks of positions; with `depth`, in order of so many tokens at least.

    By doubling, or more: a step sorts by as many ranks, one behind the other, as fit into 63 bits.
    """
    n = len(s)
    rank = s.astype(np.int64) - s.min() if n else np.zeros(0, np.int64)
    if n and rank.max() >= 1 << 31:
        rank = np.unique(s, return_inverse=True)[1]
    k = 1
    while True:
        bits = int(rank.max() + 1).bit_length() if n else 1
        ranks = max(2, min(63 // bits, n if depth is None else -(-depth // k)))
        key = rank + 1
        for j in range(1, ranks):
            key <<= bits
            key[: max(0, n - j * k)] += rank[j * k :] + 1
        sa = np.argsort(key)
        key = key[sa]
        rank = np.empty(n, np.int64)
        rank[sa] = np.cumsum(np.r_[0, key[1:] != key[:-1]])[:n]
        k *= ranks
        if n == 0 or rank[sa[-1]] == n - 1 or depth is not None and k >= depth:
            return sa, rank


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little")


def run_keys(hashes: np.ndarray, host: np.ndarray | np.uint64, least: int) -> np.ndarray:
    """The key of the run of `least` tokens at each place that has so many, from the hashes of tokens and of the host."""
    key = np.zeros(max(0, len(hashes) - least + 1), np.uint64) + host
    for j in range(least):
        key = mix(key * M1 + hashes[j : j + len(key)])
    return key


def word_hashes(words: pa.LargeStringArray) -> np.ndarray:
    """A 64-bit hash of each word: of its length and the sum of scrambled pairs of byte and place."""
    if not len(words):
        return np.zeros(0, np.uint64)
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    sizes = np.diff(at)
    letters = np.frombuffer(words.buffers()[2] or b"", np.uint8)[at[0] : at[-1]].astype(np.uint64)
    places = (np.arange(len(letters)) - np.repeat(at[:-1] - at[0], sizes)).astype(np.uint64)
    sums = np.r_[np.uint64(0), np.cumsum(mix((places << np.uint64(8) | letters) * M1 + M2))]
    return mix(sums[at[1:] - at[0]] - sums[at[:-1] - at[0]] + sizes.astype(np.uint64) * M1)


def repeated(pages: list[list[list[int]]], page_ids: list, least: int = LEAST) -> list[list[int]]:
    """Tokens of each block of each page that lie in a run of at least `least` tokens found on two distinct page ids.

    Every block ends with a number of its own, so that no run goes beyond a block.
    """
    found = [b for page in pages for b in page]
    sizes, owner = np.array([len(b) for b in found], np.int64), np.repeat(np.arange(len(pages)), [len(p) for p in pages])
    ids = np.unique(np.array([str(i) for i in page_ids]), return_inverse=True)[1]
    counts = iter(coverage(np.array([x for b in found for x in b], np.int64), sizes, owner, ids, least)[0].tolist())
    return [[next(counts) for _ in page] for page in pages]


def coverage(tokens: np.ndarray, sizes: np.ndarray, owner: np.ndarray, ids: np.ndarray, least: int, elsewhere: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None, bodies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each block what `repeated` counts, and the same of runs that are boilerplate.

    tokens are those of all blocks, one after the other, not negative; of each block sizes and owner give the number of its tokens and its page.
    ids and bodies are numbers of each page, from 0. Boilerplate stands on BODIES distinct ids and bodies.
    elsewhere(places) tells of the runs of `least` tokens at places of `tokens` whether they are found on two ids of the whole host, and
    whether they are boilerplate there. With bodies, runs go on to the end of a page.
    """
    starts = np.cumsum(sizes) - sizes
    if bodies is None:
        parts, part, page = sizes, np.arange(len(sizes)), owner
    else:
        ends, page = np.r_[0, np.cumsum(sizes)], np.arange(len(ids))
        parts, part = np.diff(ends[np.searchsorted(owner, np.arange(len(ids) + 1))]), owner
    if not len(tokens):
        return np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    # each part ends with a number of its own
    shift = np.repeat(np.arange(len(parts)), parts + 1)
    last = np.cumsum(parts + 1) - 1
    s = np.empty(len(tokens) + len(parts), np.int64)
    s[last] = -1 - np.arange(len(parts))
    s[np.arange(len(tokens)) + np.repeat(np.arange(len(parts)), parts)] = tokens
    page = page[shift]
    sa, _ = suffix_array(s, least)
    # neighbours that share `least` tokens are one group; a group on two ids covers its places
    padded, near = np.concatenate([s, -np.arange(1, least + 1) - len(s) - 1]), np.arange(len(sa) - 1)
    for j in reversed(range(least)):
        near = near[padded[sa[near + 1] + j] == padded[sa[near] + j]]
    new = np.ones(len(sa), bool)
    new[near + 1] = False
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, len(sa)])
    often, boilerplate = np.zeros(len(start), bool), np.zeros(len(start), bool)
    group, pages = _members(start, size, size > 1, page[sa])
    often[size > 1] = _distinct(group, ids[pages]) > 1
    if bodies is not None:
        many = size >= BODIES
        group, pages = _members(start, size, many, page[sa])
        boilerplate[many] = np.minimum(_distinct(group, ids[pages]), _distinct(group, bodies[pages])) >= BODIES
    if elsewhere is not None:
        head = sa[start]
        whole = np.flatnonzero(last[shift[head]] - head >= least)
        two, most = elsewhere(head[whole] - shift[head[whole]])
        often[whole] |= two
        boilerplate[whole] |= most
    counts, starts = [], starts + part
    for chosen in (often, boilerplate):
        edge = np.zeros(len(s) + least + 1, np.int64)
        places = sa[np.repeat(chosen, size)]
        edge[places] += 1
        edge[places + least] -= 1
        covered = np.r_[0, np.cumsum(np.cumsum(edge)[: len(s)] > 0)]
        counts.append(covered[starts + sizes] - covered[starts])
    return counts[0], counts[1]


def main_text(found: list[tuple[str, str]], kept: tuple[Iterator[bool], Iterator[bool]]) -> str:
    """The article's blocks, or all of a page without one, that are `kept`; that tells of the blocks of both streams, in order."""
    kinds = (OPEN, AUTHOR) if any(k != OUTER for k, _ in found) else (OUTER, "")
    at = dict(zip(kinds, kept, strict=True))
    return "\n".join(text for kind, text in found if kind in at and next(at[kind]))


def host(url) -> F.Column:
    """The host of a url in lower case, or ""."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


class _Streams:
    """The token streams of a shard's pages, two a page, as numbers of words, and their bodies; the author's words have odd numbers, others even ones."""

    def __init__(self, table: pa.Table) -> None:
        self.found = [[(x[0], x[1:]) for x in zlib.decompress(b).decode().split("\n") if x] for b in table["blocks"].to_pylist()]
        streams = [s for f in self.found for s in streamed(f)]
        #: Of each block its stream and number of tokens.
        self.owner = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
        words = pc.split_pattern(pa.array([t for s in streams for t in s], pa.large_string()), " ")
        self.sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        self.tokens = 2 * coded.indices.to_numpy().astype(np.int64) + np.repeat(self.owner & 1, self.sizes)
        self.bodies = [digest("\n".join(s)) >> 1 for s in streams]
        hashes = word_hashes(coded.dictionary)
        self.hashes = np.stack([hashes, mix(hashes ^ M1)], axis=1).reshape(-1)[self.tokens]
        self.salt = np.array(table["salt"].to_pylist()[:1], np.int64).view(np.uint64)
        self.shard, self.alone = table["shard"][0].as_py(), table["parts"][0].as_py() == 1

    def runs(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The places where a run of `least` tokens begins, and their streams."""
        of = np.repeat(self.owner, self.sizes)
        at = np.flatnonzero(of[: max(0, len(of) - least + 1)] == of[least - 1 :])
        return at, of[at]

    def keys(self, least: int) -> np.ndarray:
        return run_keys(self.hashes, self.salt, least)

    def marks(self, least: int) -> np.ndarray:
        """What stands for the run at each place in other shards: the least hash of its parts of GRAM tokens, scrambled."""
        n = min(GRAM, least)
        parts = self.keys(n)
        size = max(0, len(self.hashes) - least + 1)
        return mix(np.minimum.reduce([parts[j : j + size] for j in range(least - n + 1)]))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _short(marks: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and last 32 bits of marks, as one number."""
    return _bucket(marks, buckets).view(np.uint64) << np.uint64(32) | marks & np.uint64(0xFFFFFFFF)


def _spans(of: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal numbers."""
    cuts = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True]) if len(of) else np.zeros(1, np.int64)
    return list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def _twice(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once."""
    order, out = np.argsort(keys), np.zeros(len(keys), bool)
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    out[order[same]] = out[order[same + 1]] = True
    return out


def _among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each key is one of `some`; a table of their last bits tells first which can be."""
    last = np.uint64((1 << min(26, max(10, 4 + len(some).bit_length()))) - 1)
    table = np.zeros(int(last) + 1, bool)
    table[some & last] = True
    out = table[keys & last]
    out[out] = np.isin(keys[out], some)
    return out


def _marked(table: pa.Table) -> pa.Table:
    """Of one bucket: for each shard, its marks that another shard has."""
    rows = [np.frombuffer(x, np.uint32) for x in table["marks"].to_pylist()]
    marks, shard = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    often = _twice(marks)
    marks, shard = marks[often], shard[often]
    spans = _spans(shard)
    return pa.table({"bucket": pa.array(table["bucket"].to_pylist()[:1] * len(spans), pa.int64()), "shard": pa.array([table["shard"][int(shard[a])].as_py() for a, _ in spans], pa.int64()), "marks": pa.array([marks[a:b].tobytes() for a, b in spans], pa.binary())})


def _members(start: np.ndarray, size: np.ndarray, chosen: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The members of chosen groups, which lie one behind the other: their group, numbered from 0, and what `of` has for them."""
    n = size[chosen]
    return np.repeat(np.arange(len(n)), n), of[np.repeat(start[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def _distinct(group: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many distinct numbers each group has; groups are numbered from 0 and none is empty."""
    base = int(of.max(initial=0)) + 1
    pairs = np.sort(group * base + of)
    return np.bincount(pairs[np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)]] // base)


def _counted(table: pa.Table) -> pa.Table:
    """Of one bucket: for each shard, the keys that it holds and that lie on two distinct ids, and whether on enough ids and bodies to be boilerplate."""
    keys = np.concatenate([np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()])
    n, ids, shards, bodies = np.concatenate([np.frombuffer(x, np.int64).reshape(4, -1) for x in table["pages"].to_pylist()], axis=1)
    ids, bodies = (np.unique(x, return_inverse=True)[1] for x in (ids, bodies))
    order = np.argsort(keys)
    page = np.repeat(np.arange(len(n), dtype=np.int32), n)[order]
    keys = keys[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    of = ids[page]
    often = np.repeat(np.minimum.reduceat(of, start) < np.maximum.reduceat(of, start), np.diff(np.r_[start, len(keys)]))
    keys, page = keys[often], page[often]
    if not len(keys):
        return pa.table({"shard": pa.array([], pa.int64()), "keys": pa.array([], pa.binary()), "boilerplate": pa.array([], pa.binary())})
    group = np.cumsum(np.r_[True, keys[1:] != keys[:-1]]) - 1
    enough = (np.minimum(_distinct(group, ids[page]), _distinct(group, bodies[page])) >= BODIES)[group]
    shard = shards[page]
    order = np.lexsort((keys, shard))
    keys, shard, enough = keys[order], shard[order], enough[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (shard[1:] != shard[:-1])]
    keys, shard, enough = keys[new], shard[new], enough[new]
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
    spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return pa.table({"shard": pa.array(shard[cuts[:-1]], pa.int64()), "keys": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), "boilerplate": pa.array([keys[a:b][enough[a:b]].tobytes() for a, b in spans], pa.binary())})


def extract(pages: DataFrame, least: int = LEAST, share: float = SHARE, per_shard: int = PAGES) -> DataFrame:
    """(page_id, url, text, repeated_tokens) of each row; repeated_tokens counts tokens of open and author's blocks in runs shared with another page of the host."""
    rows = pages.select(column(pages, "page_id", "long").alias("page_id"), column(pages, "url", "string").alias("url"), column(pages, "html", "string").alias("html"), host(column(pages, "url", "string")).alias("host"))
    source = rows.select("page_id", "url", "html", F.xxhash64("host").alias("salt"), F.xxhash64("page_id").alias("id"))

    counts, size = np.zeros(COUNTERS, np.int64), 0
    slot = F.pmod(F.xxhash64("salt"), F.lit(COUNTERS))
    for r in source.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("html")).alias("size")).collect():  # COUNTERS rows at most
        counts[r["slot"]] = r["n"]
        size += r["size"] or 0
    shards, buckets = pages.sparkSession.sparkContext.broadcast(np.maximum(1, -(-counts // per_shard))), size // BUCKET + 1

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of pages, and their shard: a hash of host and share of it."""
        turn = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                packed = [zlib.compress("\n".join(k + t for k, t in blocks(h or "")).encode(), 1) for h in part.column(2).to_pylist()]
                turns = mix(np.array(part.column(4).to_pylist(), np.int64).view(np.uint64) + np.arange(turn, turn + part.num_rows, dtype=np.uint64) * M1).view(np.int64)
                turn += part.num_rows
                parts = shards.value[np.array(part.column(5).to_pylist(), np.int64)]
                shard = mix(mix((turns % parts).astype(np.uint64) + M1) ^ np.array(part.column(3).to_pylist(), np.int64).view(np.uint64)).view(np.int64)
                yield pa.record_batch({"page_id": part.column(0), "url": part.column(1), "salt": part.column(3), "id": part.column(4), "shard": pa.array(shard, pa.int64()), "parts": pa.array(parts, pa.int64()), "blocks": pa.array(packed, pa.binary())})

    def marks(table: pa.Table) -> pa.Table:
        """Of a shard of several of its host: its marks, once each, by bucket."""
        streams = _Streams(table)
        short = np.zeros(0, np.uint64) if streams.alone else np.sort(_short(streams.marks(least)[streams.runs(least)[0]], buckets))
        short = short[np.r_[True, short[1:] != short[:-1]][: len(short)]]
        bucket = short >> np.uint64(32)
        spans = _spans(bucket)
        return pa.table({"bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), "shard": pa.array([streams.shard] * len(spans), pa.int64()), "marks": pa.array([short[a:b].astype(np.uint32).tobytes() for a, b in spans], pa.binary())})

    def keys(table: pa.Table, seen: pa.Table) -> pa.Table:
        """Of a shard of several of its host, by bucket: the keys of runs that it holds twice or whose marks others have, in order of streams, and of each stream its number of keys, id, shard and body."""
        streams = _Streams(table)
        at, of = streams.runs(least) if not streams.alone else [np.zeros(0, np.int64)] * 2
        others = np.concatenate([np.zeros(0, np.uint64), *(np.uint64(b << 32) | np.frombuffer(x, np.uint32).astype(np.uint64) for b, x in zip(seen["bucket"].to_pylist(), seen["marks"].to_pylist(), strict=True))])
        keys = streams.keys(least)[at]
        maybe = _twice(keys) | _among(_short(streams.marks(least)[at], buckets), others)
        keys, of = keys[maybe], of[maybe]
        bucket = _bucket(keys, buckets)
        order = np.lexsort((of, bucket))
        keys, of, bucket = keys[order], of[order], bucket[order]
        ids, bodies, spans, rows = np.repeat(np.array(table["id"].to_pylist(), np.int64), 2), np.array(streams.bodies, np.int64), _spans(bucket), []
        for a, b in spans:
            some, n = np.unique(of[a:b], return_counts=True)
            rows.append(np.stack([n, ids[some], np.full(len(some), streams.shard), bodies[some]]).tobytes())
        return pa.table({"bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int64()), "keys": pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()), "pages": pa.array(rows, pa.binary())})

    def shard_text(table: pa.Table, often: pa.Table) -> pa.Table:
        streams = _Streams(table)
        two, boilerplate = (np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in often[c].to_pylist())]) for c in ("keys", "boilerplate"))

        def elsewhere(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            keys = streams.keys(least)[at]
            return _among(keys, two), _among(keys, boilerplate)

        ids, bodies = (np.unique(np.array(x), return_inverse=True)[1] for x in ([str(i) for i in table["page_id"].to_pylist() for _ in range(2)], streams.bodies))
        covered, cut = coverage(streams.tokens, streams.sizes, streams.owner, ids, least, None if streams.alone else elsewhere, bodies)
        author = streams.owner & 1 == 1
        kept = (cut < share * streams.sizes) | author
        turns = iter(kept[~author].tolist()), iter(kept[author].tolist())
        text = [main_text(f, turns) for f in streams.found]
        some = np.r_[0, np.cumsum(covered)][np.searchsorted(streams.owner, 2 * np.arange(len(text) + 1))]
        return pa.table({"page_id": table["page_id"], "url": table["url"], "text": pa.array(text, pa.string()), "repeated_tokens": pa.array(np.diff(some), pa.int64())})

    found = source.withColumn("slot", slot).mapInArrow(parsed, "page_id long, url string, salt long, id long, shard long, parts long, blocks binary").groupBy("shard")
    often = pages.sparkSession.createDataFrame([], "shard long, keys binary, boilerplate binary")
    if counts.max() > per_shard:
        seen = found.applyInArrow(marks, "bucket long, shard long, marks binary").groupBy("bucket").applyInArrow(_marked, "bucket long, shard long, marks binary")
        often = found.cogroup(seen.groupBy("shard")).applyInArrow(keys, "bucket long, keys binary, pages binary").groupBy("bucket").applyInArrow(_counted, "shard long, keys binary, boilerplate binary")
    return found.cogroup(often.groupBy("shard")).applyInArrow(shard_text, "page_id long, url string, text string, repeated_tokens long")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(read(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "repeated_tokens")
