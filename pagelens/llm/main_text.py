"""Main text of web pages.

A page is read tag by tag into blocks of visible text, and what pages of a host share is found: the token streams of all pages of the host, put
together, as suffixes; suffixes are named by prefix doubling up to RUN tokens, so that suffixes with equal names are neighbours in the host's suffix array with a common prefix of
RUN tokens or more, and the tokens that such prefixes cover are those of all the long substrings that repeat across LEAST_PAGES distinct pages. Names are counted by packed keys, so no host's pages are sorted by one task.

What is covered is boilerplate and goes, but for what the page marks as its article (or main part): that is wanted whole, and articles do quote the same passages. Blocks outside it stay
only if they are running text (LONG tokens or more) of which less than half is covered; where a page marks nothing, all uncovered tokens stay. Menus, headers,
footers, sidebars, notices, adverts, forms and reader comments that hosts don't repeat word by word are left out by their elements and by the words in their class, id and role.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Tokens of a repeated substring (a power of two), distinct pages of the host that make it boilerplate, tokens of running text outside the marked article.
RUN, LEAST_PAGES, LONG = 8, 3, 20

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# Fixed values of HTML: elements that break blocks, whose content is no text, that have no end tag.
BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style noscript template iframe object svg math title textarea noembed noframes xmp audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("nav aside footer form button select fieldset dialog menu head search".split())
CLOSES_P = BLOCK - frozenset("body head html caption tbody td tfoot th thead tr option optgroup legend summary button select".split())
#: Elements that end when one of the same kind begins.
SELF_CLOSING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Whole classes, ids and roles, and words of them, that mark what isn't main text; classes of articles within an article that only lead to another page.
HEADERS, TEASERS = frozenset("header site-header page-header main-header global-header top-header header-wrapper".split()), frozenset("card teaser tease preview tile".split())
SIGNS = frozenset("ad ads adv advert adverts advertisement advertising advertorial banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notices outbrain overlay pagination pager popup promo promos promotion recommendations recommended related reply replies respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets".split())
SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def signs(attributes: str, teaser: bool = False) -> tuple[bool, bool]:
    """Whether an element's attributes mark it as no main text (or hidden, or as a teaser where there can be one), and whether as the main part."""
    if not attributes.strip():
        return False, False
    found, main = False, False
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            parts = [w.lower() for w in SPLIT.split(value)]
            found |= any(w in SIGNS or (teaser and w in TEASERS) for w in parts) or any(w.lower() in HEADERS for w in value.split())
            main |= (name == "role" and value.lower() == "main") or (name != "role" and value.lower() in ("article-body", "articlebody", "entry-content", "post-content", "main-content"))
        elif name == "itemprop":
            main |= value.lower() == "articlebody"
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            found = True
    return found, main


def visible(html: str) -> list[tuple[bool, str]]:
    """The page's blocks in order: whether the block is in the article or main part, and its text."""
    out: list[tuple[bool, str]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, whether its text is left out, whether in the main part
    parts: list[str] = []
    skip, main, at = False, False, 0

    def flush() -> None:
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append((main, text))
            parts.clear()

    def state() -> None:
        nonlocal skip, main
        skip, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def close(names: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                flush()
                del stack[k:]
                state()
                return
            if stack[k][0] in stop:
                return

    while at < len(html):
        m = TAG.search(html, at)
        if not skip:
            parts.append(html[at : m.start()] if m else html[at:])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BLOCK:
                flush()
            if name == "p" and not any(e[0] == "p" for e in stack):
                continue
            close({name}, frozenset() if name in ("article", "main", "body", "html") else frozenset({"article", "main"}) - {name})
            continue
        if name == "br":
            if not skip:
                parts.append(" ")
            continue
        if name in BLOCK:
            flush()
        if name in RAW:
            if not (m[3] or m[6] or "").rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(html, at)
                at = end.end() if end else len(html)
            continue
        if name in CLOSES_P:
            close({"p"}, frozenset("button table td th article main section div".split()))
        if name in SELF_CLOSING:
            close(SELF_CLOSING[name], frozenset("ul ol dl table tbody thead tfoot select article main".split()))
        if name in VOID:
            continue
        odd, own = signs(m[3] or m[6] or "", name == "article" and main) if name not in ("html", "body") else (False, False)
        here = main or ((name in ("article", "main") or own) and not skip)
        left = skip or odd or name in ASIDE or (name == "header" and not main)
        if left != skip or here != main:
            flush()
        stack.append((name, left, here))
        state()
    flush()
    return out


def names_of(host: str, tokens: list[str]) -> np.ndarray:
    """The name of the suffix at each place that has RUN tokens before the stream's end, by prefix doubling."""
    if len(tokens) < RUN:
        return np.zeros(0, np.uint64)
    x = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64)
    k = 1
    while k < RUN:
        x = x[:-k] * np.uint64(0x9E3779B97F4A7C15) + (x[k:] ^ (x[k:] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(32)
        k *= 2
    return x ^ np.uint64(xxhash.xxh3_64_intdigest(host))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _streams(rows: pa.Table) -> Iterator[tuple[str, list[tuple[bool, str]], bool, np.ndarray]]:
    """Each page's host, blocks, whether it marks a main part, and names; a page whose host isn't known shares with none."""
    for url, html in zip(rows["url"].to_pylist(), rows["text"].to_pylist(), strict=True):
        found, host = visible(html), host_of(url)
        marked = any(main for main, _ in found)
        yield host, found, marked, names_of(host, [w for main, text in found if not main for w in text.split(" ")] if host else [])


def _distinct(keys: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs of a key and a page, sorted, and how many pairs of its key come before each."""
    order = np.lexsort((pages, keys))
    keys, pages = keys[order], pages[order]
    fresh = np.concatenate(([True], (keys[1:] != keys[:-1]) | (pages[1:] != pages[:-1]))) if len(keys) else np.zeros(0, bool)
    keys, pages = keys[fresh], pages[fresh]
    return keys, pages, np.arange(len(keys)) - np.searchsorted(keys, keys)


def _ask(rows: pa.Table, part: bool) -> list[tuple[int, np.ndarray, list[np.ndarray]]]:
    """For each name LEAST_PAGES digests of pages that have it, zero where there are fewer: pages with equal blocks are one."""
    own, pages = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for _, found, _, names in _streams(rows):
        own.append(np.unique(names))
        digest = xxhash.xxh3_64_intdigest("\n".join(text for _, text in found).encode("utf-8", "surrogatepass")) or 1
        pages.append(np.full(len(own[-1]), digest, np.uint64))
    names, pages, rank = _distinct(np.concatenate(own), np.concatenate(pages))
    keys, first = np.unique(names, return_inverse=True)
    values = np.zeros((LEAST_PAGES, len(keys)), np.uint64)
    few = rank < LEAST_PAGES
    values[rank[few], first[few]] = pages[few]
    return [(0, keys, list(values))]


def _answer(level: int, keys: np.ndarray, values: list[list[np.ndarray]], parts: np.ndarray) -> list[list[np.ndarray]]:
    """The number of distinct pages of each name, LEAST_PAGES standing for any more."""
    places = np.concatenate([v[0] for v in values for _ in v[1:]])
    pages = np.concatenate([x for v in values for x in v[1:]])
    count = np.bincount(_distinct(places[pages > 0], pages[pages > 0])[0], minlength=len(keys)).clip(max=LEAST_PAGES).astype(np.uint64)
    return [[count[v[0]]] for v in values]


def _texts(rows: pa.Table, part: bool, found: pd.DataFrame) -> pd.DataFrame:
    pages = list(_streams(rows))
    keys = np.unique(np.concatenate([p[3] for p in pages])) if pages else np.zeros(0, np.uint64)
    shared = blocks.answers(found, 0)[0] >= LEAST_PAGES if len(keys) else np.zeros(0, bool)
    out = []
    for _, own, marked, names in pages:
        words = [text.split(" ") for main, text in own if not main]
        covered = np.zeros(sum(map(len, words)) + 1, np.int64)
        for i in np.flatnonzero(shared[np.searchsorted(keys, names)]).tolist() if len(names) else []:
            covered[i] += 1
            covered[i + RUN] -= 1
        covered, at, kept = np.cumsum(covered) > 0, 0, []
        for main, text in own:
            if main:
                kept.append(text)
                continue
            ws = text.split(" ")
            rest = [w for k, w in enumerate(ws) if not covered[at + k]]
            at += len(ws)
            if marked:
                if len(ws) >= LONG and 2 * len(rest) > len(ws):
                    kept.append(text)
            elif rest:
                kept.append(" ".join(rest))
        out.append("\n".join(kept))
    return pd.DataFrame({"page_id": pd.Series(rows["page_id"].to_pylist(), dtype="Int64"), "url": rows["url"].to_pylist(), "text": out, "n_chars": [len(t) for t in out]})


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Text: the blocks of the article or main part, and running text beside it that the host doesn't repeat; of a page that marks none, all blocks that are no menu, header and so on, without
    the runs of RUN or more tokens that LEAST_PAGES distinct pages of its host share. A null, empty or blank html gives an empty text; a very long page is read whole. Words that pages'
    articles share stay: the article is wanted whole. A page whose url has no host shares with none. Repeated rows come out as often as they went in; pages of
    a host with equal blocks (rows, crawls, mirrors) count as one. Other columns aren't read. Without rows the result is empty. page_id is a whole number or null.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("text"))
    corpus = blocks.gather(rows)
    replies = blocks.exchange(corpus, _ask, _answer, blocks.shard_count(corpus))
    return blocks.each(corpus, replies, _texts, "page_id long, url string, text string, n_chars long")
