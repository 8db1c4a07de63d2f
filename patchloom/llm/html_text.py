"""Main text of web pages by line-block distribution.

Markup is stripped into blocks of text, the lines of the method. Parts of a page that are no
article (menus, adverts, forms and the like, told by element, role, class or id) are taken out; the
weight of another line is the length of its text outside links. Weights are summed over sliding
windows of lines; the sum surges where the article begins and dives to 0 where it ends, and the
lines between are kept. If the page marks its article and the windows surge there, that is kept
whole, links included. One pass over the pages, no shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WINDOW = 3                   # lines whose weights are summed
SURGE = 80                   # characters in a window that an unmarked article reaches
LEAST_SHARE = 0.25           # of the largest stretch, that another one needs to be kept

# --- fixed values: elements and words of HTML pages ---
RAW = ("script style noscript template iframe svg object title textarea select option "
       "button canvas audio video annotation annotation-xml").split()
BLOCKS = frozenset((
    "address article aside blockquote body br caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu "
    "nav ol p pre section summary table tbody td tfoot th thead tr ul head").split())
CONTAINERS = frozenset((
    "article aside blockquote body details dialog div dl fieldset figure footer form header main "
    "menu nav ol pre section table tbody tr td th ul").split())
WHOLE = frozenset("html head body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
HOLDERS = frozenset("main article div td".split())  # elements that hold whole articles
ARTICLE = frozenset(["article", "main"])
NO_ARTICLE = frozenset("nav aside footer form menu dialog fieldset".split())
NO_ARTICLE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert dialog menu menubar".split())
NO_ARTICLE_WORDS = frozenset((
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup "
    "login search sidebar aside menu nav navbar navigation breadcrumb breadcrumbs toc pager "
    "pagination masthead footer comment comments reply replies respond disqus share sharing "
    "social related recommended widget skip hidden").split())
HEADER_WORDS = frozenset(["header", "topbar"])
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
# --- end of fixed values ---

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)"
    r"((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>?)", re.DOTALL)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
TEXT_ONLY = frozenset("script style iframe textarea title noscript".split())
_BLOCK = "</?(?:" + "|".join(sorted(BLOCKS - {"hr", "br"})) + ")"
NEXT_BLOCK = re.compile(_BLOCK + r"(?=[\s/>])", re.IGNORECASE)
# Elements that also end where another tag begins; that tag is read again.
ENDED_BY = {"title": r"</head|<body",
            "option": r"</?(?:option|optgroup|select|datalist)|" + _BLOCK}
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?" + (
    rf"|(?=(?:{ENDED_BY[name]})(?:[\s/>]|\Z))" if name in ENDED_BY else ""), re.IGNORECASE)
    for name in RAW}
RAW_TAG = {name: re.compile(rf"<(/?){name}(?=[\s/>]|\Z)[^>]*>?", re.IGNORECASE) for name in RAW}
WORD_PARTS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
WHITE = re.compile(r"\s+")


def raw_end(name: str, page: str, at: int) -> int:
    """Where the content of a raw element ends that begins at ``at``. One without an end tag ends
    at the next block, a script at the end of the page."""
    if name in TEXT_ONLY or name in ENDED_BY:
        end = RAW_END[name].search(page, at)
        if end or name == "script":
            return end.end() if end else len(page)
    else:
        depth = 1
        for tag in RAW_TAG[name].finditer(page, at):
            depth += -1 if tag.group(1) else 0 if tag.group().endswith("/>") else 1
            if not depth:
                return tag.end()
    end = NEXT_BLOCK.search(page, at)
    return end.start() if end else len(page)


def judge(name: str, attributes: str, in_article: bool) -> str:
    """"out" for an element that is no part of an article, "" for one that may be. Others are in
    doubt by a word of their class or id, see ``standing``: "word" is a whole one, "part" one of
    several ("has-sidebar"), "talk" a part that begins it ("comment-list"), and "id" a whole id
    inside an article. A header inside an article is part of it; headings are never in doubt."""
    if name in NO_ARTICLE or (name == "header" and not in_article):
        return "out"
    if name in WHOLE or not attributes.strip(" /"):
        return ""
    found = {k.lower(): (v or "").strip("\"'") for k, v in ATTRIBUTE.findall(attributes)}
    if "hidden" in found or found.get("role", "").lower() in NO_ARTICLE_ROLES or re.search(
            r"display\s*:\s*none", found.get("style", ""), re.IGNORECASE):
        return "out"
    names, ids = (found.get(key, "").split() for key in ("class", "id"))
    if name in HEADINGS or not (names or ids):
        return ""
    whole, whole_ids = {w.lower() for w in names}, {w.lower() for w in ids}
    if (whole | whole_ids) & COMMENT_WORDS:
        return "out"
    parts = [[w.lower() for w in WORD_PARTS.split(x) if w] for x in names + ids]
    if name in ARTICLE:
        return "out" if any(w[:1] in (["comment"], ["reply"]) for w in parts) else ""
    words = NO_ARTICLE_WORDS if in_article else NO_ARTICLE_WORDS | HEADER_WORDS
    if in_article:
        return "word" if whole & words else "id" if whole_ids & words else ""
    if (whole | whole_ids) & words:
        return "word"
    if any(w and w[0] in COMMENT_WORDS for w in parts):
        return "talk"
    return "part" if any(words.intersection(w) for w in parts) else ""


class Line(NamedTuple):
    """A block's text, its characters in links, and where it lies."""

    text: str
    links: int
    out: bool     # in a part that is no article
    doubt: int    # the innermost element in doubt around it, 0 for none
    article: int  # the outermost marked article around it, 0 for none
    holder: int   # the innermost holder around it, 0 for the page


class Open(NamedTuple):
    """An open element, with what holds for the lines inside it."""

    name: str
    out: bool
    doubt: int
    article: int
    holder: int


class Doubt:
    """An element that words of its class or id call no article."""

    def __init__(self, kind: str, parent: int, article: int):
        self.kind, self.parent, self.article = kind, parent, article
        self.holds, self.stands, self.chars, self.links = False, False, 0, 0


def lines_of(page: str) -> tuple[list[Line], list[Doubt], list[int]]:
    """The page's blocks in order, without those that have no text, the elements in doubt (from 1
    on) and the holder around each holder (from 1 on)."""
    lines, text, link_chars = [], [], 0
    doubts, holders = [Doubt("", 0, 0)], [0]
    stack, here = [], Open("", False, 0, 0, 0)
    in_link, inline, inline_out, inline_doubt = False, "", False, 0
    n_articles, at = 0, 0

    def end_line():
        nonlocal text, link_chars
        line = WHITE.sub(" ", html.unescape("".join(text))).strip()
        if line:
            lines.append(Line(line, min(link_chars, len(line)), here.out or inline_out,
                              inline_doubt or here.doubt, here.article, here.holder))
        text, link_chars = [], 0

    def doubted(kind: str) -> int:
        if kind in ("", "out"):
            return 0
        doubts.append(Doubt(kind, here.doubt, here.article))
        return len(doubts) - 1

    while at < len(page):
        m = TOKEN.search(page, at)
        piece = page[at:m.start() if m else len(page)]
        if piece:
            text.append(piece)
            if in_link:
                link_chars += len(WHITE.sub(" ", html.unescape(piece)))
        if m is None:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        closing, name, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if not m.group(4):  # a broken quote or the end of the page inside a tag
            end = page.find(">", at)
            at = len(page) if end < 0 else end + 1
        if name in RAW_END and not closing:
            if name != "svg" or not attributes.endswith("/"):
                at = raw_end(name, page, at)
            continue
        if name == "a":
            in_link = not closing
            continue
        if name not in BLOCKS:
            # An inline element that is no article ends its line on both sides.
            if not closing and not inline and name not in VOID:
                kind = judge(name, attributes, bool(here.article))
                if kind:
                    end_line()
                    inline, inline_out, inline_doubt = name, kind == "out", doubted(kind)
            elif closing and name == inline:
                end_line()
                inline, inline_out, inline_doubt = "", False, 0
            continue
        end_line()
        if name in VOID:
            continue
        if inline:
            inline, inline_out, inline_doubt = "", False, 0
        if name not in CONTAINERS:
            kind = "" if closing else judge(name, attributes, bool(here.article))
            if kind:  # until the next block begins or it ends
                inline, inline_out, inline_doubt = name, kind == "out", doubted(kind)
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].name == name:
                    del stack[k:]
                    break
            here = stack[-1] if stack else Open("", False, 0, 0, 0)
            continue
        kind = judge(name, attributes, bool(here.article))
        out = here.out or kind == "out"
        article, doubt, holder = here.article, doubted(kind) or here.doubt, here.holder
        if name in ARTICLE and not out and not article:
            n_articles += 1
            article, k = n_articles, doubt
            while k and not doubts[k].holds:
                doubts[k].holds, k = True, doubts[k].parent
        if name in HOLDERS:
            holders.append(holder)
            holder = len(holders) - 1
        here = Open(name, out, doubt, article, holder)
        stack.append(here)
    end_line()
    return lines, doubts, holders


def standing(lines: list[Line], doubts: list[Doubt]) -> list[bool]:
    """Which lines lie in an element that words rightly call no article?

    A part of a name counts only for elements that hold no marked article and are short or mostly
    links, a whole id inside an article only if they are mostly links. A whole name counts, unless
    its element has most of the article's text, or of the page's if no other article is marked."""
    if len(doubts) == 1:
        return [False] * len(lines)
    for line in lines:
        if not line.out and line.doubt:
            doubts[line.doubt].chars += len(line.text)
            doubts[line.doubt].links += line.links
    for d in reversed(doubts[1:]):  # inner ones come after outer ones
        doubts[d.parent].chars += d.chars
        doubts[d.parent].links += d.links

    def settle(kinds, stands):
        for d in doubts[1:]:
            if d.kind in kinds:
                d.stands = stands(d)
        inside = [False] * len(doubts)
        for k, d in enumerate(doubts[1:], 1):
            inside[k] = d.stands or inside[d.parent]
        return [inside[line.doubt] for line in lines]

    settle(("part", "id"), lambda d: 2 * d.links >= d.chars or (
        d.kind == "part" and d.chars - d.links < SURGE) if not d.holds else False)
    for d in doubts[1:]:
        d.stands |= d.kind in ("word", "talk")
    clear, articles, total = 0, {}, 0
    for line, inside in zip(lines, settle((), None)):
        if not line.out:
            total += len(line.text)
            articles[line.article] = articles.get(line.article, 0) + len(line.text)
            clear += len(line.text) if line.article and not inside else 0
    return settle(("word", "talk"), lambda d: 2 * d.chars <= articles.get(d.article, 0)
                  if d.article else d.kind == "talk" or clear >= LEAST_SHARE * d.chars if clear
                  else 2 * d.chars <= total)


def stretches(weights: np.ndarray, window: int) -> list[tuple[int, int, int]]:
    """(first, end, peak) of the lines between surge and dive: runs over which the window sum does
    not fall to 0, from the first to the last line with a weight."""
    if not len(weights):
        return []
    sums = np.convolve(weights, np.ones(window, np.int64))[window - 1:]  # this line and the next
    out, filled = [], np.flatnonzero(weights)
    for run in np.split(filled, np.flatnonzero(np.diff(filled) > window) + 1):
        if len(run):
            out.append((int(run[0]), int(run[-1]) + 1, int(sums[run[0]:run[-1] + 1].max())))
    return out


def main_holder(lines: list[Line], weights: np.ndarray, holders: list[int]) -> int:
    """The innermost holder of nearly all of a stretch's text, 0 for the page."""
    inside = dict.fromkeys(range(len(holders)), 0)
    for line, weight in zip(lines, weights.tolist()):
        inside[line.holder] += weight
    least, found = (1 - LEAST_SHARE) * weights.sum(), 0
    for k in range(len(holders) - 1, 0, -1):  # inner ones come after outer ones
        if inside[k] >= least:
            found = max(found, k)
        inside[holders[k]] += inside[k]
    return found


def unmarked_text(lines: list[Line], weights: np.ndarray, holders: list[int], window: int,
                  surge: int) -> np.ndarray:
    """Which lines surge and dive keep: the largest stretch, others of its kind of size, and all
    others in its holder, whatever lies between. If nothing surges, the page's highest stretch is
    its article, unless that is mostly links."""
    keep = np.zeros(len(lines), bool)
    found = stretches(weights, window)
    if max((s[2] for s in found), default=0) < surge:
        surge = max((s[2] for s in found), default=0)
        found = [s for s in found if s[2] < surge or 2 * weights[s[0]:s[1]].sum() > sum(
            len(x.text) for x in lines[s[0]:s[1]])]
    high = [s for s in found if s[2] >= surge]
    if not high:
        return keep
    first, end, _ = max(high, key=lambda s: weights[s[0]:s[1]].sum())
    most = weights[first:end].sum()
    holder = main_holder(lines[first:end], weights[first:end], holders)
    held = [k == holder for k in range(len(holders))]  # of the page only what no holder has
    for k in range(holder + 1, len(holders)):
        held[k] = holder > 0 and held[holders[k]]
    for first, end, peak in found:
        keep[first:end] = (peak >= surge and weights[first:end].sum() >= LEAST_SHARE * most) or any(
            held[x.holder] for x, w in zip(lines[first:end], weights[first:end]) if w)
    return keep


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's text: blocks with white space turned to one space, joined by one space.

    Lines that are no article are taken out before the windows are laid, so they cut nothing in
    two. A marked article is kept whole and overrides the stretches, unless it does not surge and
    other lines do; then both are kept."""
    lines, doubts, holders = lines_of(page or "")
    lines = [x for x, d in zip(lines, standing(lines, doubts)) if not (x.out or d)]
    if not lines:
        return ""
    sizes = np.array([len(x.text) for x in lines], np.int64)
    article = np.array([x.article for x in lines], np.int64)
    marked = np.bincount(article, sizes, minlength=2)
    marked[0] = 0
    # Several marked articles: the one with most text, and others of its kind of size.
    chosen = np.flatnonzero(marked >= max(1, marked.max() * LEAST_SHARE))
    keep = np.isin(article, chosen)
    if max((s[2] for s in stretches(np.where(keep, sizes, 0), window)), default=0) < surge:
        weights = np.where(article > 0, 0, sizes - np.array([x.links for x in lines], np.int64))
        if not keep.any() or max((s[2] for s in stretches(weights, window)), default=0) >= surge:
            keep |= unmarked_text(lines, weights, holders, window, surge)
    return " ".join(x.text for x, k in zip(lines, keep) if k)


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """page_id, url, text, n_chars per page.

    The whole html is read; null and empty pages give an empty text. Character references are
    decoded once. Pages cut off inside a tag, an element or a reference keep what came before.
    Repeated rows are read one by one; columns besides page_id, url and html are not read."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(page, window, surge) for page in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64").array,
                                "url": batch["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    return pages.select("page_id", "url", "html").mapInPandas(
        run, "page_id bigint, url string, text string, n_chars bigint")
