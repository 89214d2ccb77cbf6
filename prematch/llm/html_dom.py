"""Block-level elements of a page, the blocks of text inside them, and statistics of each element."""

from __future__ import annotations

import html
import re

import numpy as np

# Fixed values of HTML.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_ENDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr",), "th": ("tr",), "option": ("select",)}
# Elements and attribute tokens that speak for or against being the article.
GOOD_TAGS = frozenset("article main".split())
BAD_TAGS = frozenset("nav header footer aside form head button select dialog menu fieldset".split())
GOOD_TOKENS = frozenset("article body content entry main post prose story text".split())
BAD_TOKENS = frozenset("ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer form header login menu nav navbar navigation newsletter notice pager pagination popup promo related reply replies share sharing sidebar signup social sponsor sponsored subscribe tags toolbar widget".split())

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile(r"""[>"']""")
LONG_REFERENCE = re.compile(r"&#[xX]?[0-9a-fA-F]{20,};?")
ATTRIBUTE = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WHITE = re.compile(r"[\x20\x09-\x0D]+")
FEATURES = ("depth", "good_tag", "bad_tag", "good_tokens", "bad_tokens", "good_above", "bad_above", "is_p", "is_heading", "is_list", "is_table", "own_log", "text_log", "share", "per_element",
            "link_share", "children", "p_children", "place", "siblings", "same_siblings", "text_of_parent", "commas", "blocks")


class Markup:
    """The tags of a page in order, in time linear in its length.

    A tag is ``<``, an optional ``/``, a name and attributes up to a ``>`` outside quotes. Comments and declarations are skipped, and an
    unfinished tag at the end. Any other ``<`` is text, so is one whose quotes never close. Whether a tag closes depends only
    on the first ``>`` or quote after its name; places from which none closes are remembered, and no search is made beyond the last
    character of its kind.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = {c: page.rfind(c) for c in "<>\"'"}
        self.special, self.unclosed = -1, set()

    def _next_special(self, at: int) -> int:
        if self.special < at:
            m = SPECIAL.search(self.page, at)
            self.special = m.start() if m else len(self.page)
        return self.special

    def closing(self, at: int) -> int:
        """The place of the ``>`` that ends a tag whose name ends at ``at``; -1 if there is none."""
        if at > self.last[">"]:
            return -1
        place, passed = self._next_special(at), []
        while place < len(self.page) and place not in self.unclosed:
            c = self.page[place]
            if c == ">":
                return place
            passed.append(place)
            if place >= self.last[c]:
                break
            m = SPECIAL.search(self.page, self.page.find(c, place + 1) + 1)
            place = m.start() if m else len(self.page)
        self.unclosed.update(passed)
        return -1

    def after(self, at: int) -> tuple[int, int, re.Match | None]:
        """(start, end, name) of the next thing at or after ``at`` that is not text; the name is None if it is no tag; start -1: only text is left."""
        page = self.page
        while 0 <= (start := page.find("<", at) if at <= self.last["<"] else -1):
            head = page[start + 1:start + 2]
            if page.startswith("!--", start + 1):
                end = page.find("-->", start + 4)
                return start, len(page) if end < 0 else end + 3, None
            if head in ("!", "?") and start < self.last[">"]:
                return start, page.find(">", start) + 1, None
            if m := NAME.match(page, start + 1):
                end = self.closing(m.end())
                if end >= 0:
                    return start, end + 1, m
            if start == self.last["<"] and start > self.last[">"] and (head in ("/", "!", "?") or (head.isascii() and head.isalpha())):
                return start, len(page), None
            at = start + 1
        return -1, len(page), None

    def raw_end(self, tag: str, at: int) -> int:
        """Where the content and the end tag of a script or the like are over."""
        m = re.compile(rf"</{re.escape(tag)}", re.I).search(self.page, at)
        return self.page.find(">", m.end()) + 1 if m and m.end() <= self.last[">"] else len(self.page)


def decoded(text: str) -> str:
    try:
        return html.unescape(text)
    except ValueError:  # a number too long to be read
        return html.unescape(LONG_REFERENCE.sub("\ufffd", text))


class Dom:
    """Elements by number, parents before children: tag, parent, depth, tokens; blocks: (element, text) in page order."""

    def __init__(self, page: str):
        self.tag, self.parent, self.depth, self.tokens = ["#"], [-1], [0], [()]
        self.blocks: list[tuple[int, str]] = []
        self.links: dict[int, int] = {}
        stack, at, text, in_link = [0], 0, [], 0
        open_at: dict[str, list[int]] = {}  # where in the stack the open elements of each tag are

        def flush() -> None:
            if text:
                line = WHITE.sub(" ", decoded("".join(text))).strip(" ")
                if line:
                    self.blocks.append((stack[-1], line))
                text.clear()

        def close(tag: str, until: tuple[str, ...] = ()) -> None:
            if not open_at.get(tag) or any(open_at[u][-1] > open_at[tag][-1] for u in until if open_at.get(u)):
                return
            flush()
            for _ in range(len(stack) - open_at[tag][-1]):
                open_at[self.tag[stack.pop()]].pop()

        n, markup = len(page), Markup(page)
        while at < n:
            start, end, name = markup.after(at)
            piece = page[at:start] if start >= 0 else page[at:]
            if piece:
                text.append(piece)
                if in_link:
                    self.links[stack[-1]] = self.links.get(stack[-1], 0) + len(piece)
            if start < 0:
                break
            at = end
            if name is None:
                continue
            tag, attributes = name[2].lower(), page[name.end():end - 1]
            if name[1]:
                if tag in INLINE:
                    in_link = 0 if tag == "a" else in_link
                elif tag not in VOID:
                    close(tag)
                continue
            if tag in RAW and not attributes.endswith("/"):
                at = markup.raw_end(tag, at)
                continue
            if tag in INLINE:
                in_link = 1 if tag == "a" else in_link
                continue
            flush()
            if tag in VOID:
                continue
            if tag in ENDS_P:
                close("p", ("td", "th", "button"))
            if tag in SAME_ENDS:
                close(tag, SAME_ENDS[tag])
            in_link = 0
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            found = ATTRIBUTE.findall(attributes) if attributes else ()
            self.tokens.append(tuple(t for a in found for t in re.split(r"[^a-z0-9]+", "".join(a).lower()) if t))
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(len(self.tag) - 1)
        flush()

    def statistics(self) -> np.ndarray:
        """One row of FEATURES per element."""
        n = len(self.tag)
        parent, depth = np.array(self.parent), np.array(self.depth, float)
        own, commas, blocks, links = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
        for e, line in self.blocks:
            own[e] += len(line)
            commas[e] += line.count(",") + line.count(".")
            blocks[e] += 1
        for e, k in self.links.items():
            links[e] = k
        good = np.array([t in GOOD_TAGS for t in self.tag], float)
        bad = np.array([t in BAD_TAGS for t in self.tag], float)
        good_tokens = np.array([sum(t in GOOD_TOKENS for t in ts) for ts in self.tokens], float)
        bad_tokens = np.array([sum(t in BAD_TOKENS for t in ts) for ts in self.tokens], float)
        is_p = np.array([t == "p" for t in self.tag], float)
        text, inner, inner_links, all_blocks, all_commas = own.copy(), np.ones(n), links.copy(), blocks.copy(), commas.copy()
        for e in range(n - 1, 0, -1):
            p = parent[e]
            text[p] += text[e]
            inner[p] += inner[e]
            inner_links[p] += inner_links[e]
            all_blocks[p] += all_blocks[e]
            all_commas[p] += all_commas[e]
        above_good, above_bad, place, kinds = np.zeros(n), np.zeros(n), np.zeros(n), {}
        children, p_children, same = np.zeros(n), np.zeros(n), np.zeros(n)
        for e in range(1, n):
            p = parent[e]
            above_good[e] = above_good[p] + good[p] + min(good_tokens[p], 1)
            above_bad[e] = above_bad[p] + bad[p] + min(bad_tokens[p], 1)
            place[e] = children[p]
            children[p] += 1
            p_children[p] += is_p[e]
            kinds[p, self.tag[e]] = kinds.get((p, self.tag[e]), 0) + 1
        for e in range(1, n):
            same[e] = kinds[parent[e], self.tag[e]]
        up = np.maximum(parent, 0)
        one = np.maximum(text, 1)
        return np.stack([
            depth, good, bad, good_tokens, bad_tokens, above_good, above_bad, is_p, [t[0] == "h" and t[1:].isdigit() for t in self.tag],
            [t in ("ul", "ol", "li", "dl") for t in self.tag], [t in ("table", "tr", "td", "th", "tbody") for t in self.tag],
            np.log1p(own), np.log1p(text), text / max(text[0], 1), text / inner, inner_links / one, children, p_children, place / np.maximum(children[up], 1), children[up], same, text / np.maximum(text[up], 1),
            all_commas / one, all_blocks], axis=1).astype(np.float32)
