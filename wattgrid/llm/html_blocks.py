"""Leaf blocks of HTML pages, each with features of the tags above it and its text."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Container, Iterator
from dataclasses import dataclass

#: Elements by how they break text, and by how they end.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe textarea title noembed noframes xmp".split())
SKIPPED = frozenset("template svg object canvas video audio select".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}

START = re.compile(r"<(?:(?P<comment>!--)|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)|[!?/])")
ATTRIBUTES = re.compile(r"(?:[^\"'>]++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>")
CLOSED = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
NAMED = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
WORDS = re.compile(r"[a-z]+")
#: Elements that hold one piece of text or a list of them, and roots of names that are written as one word with others.
PIECES = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd td th tr tbody thead tfoot table blockquote pre figure figcaption center font hgroup address".split())
ROOTS = re.compile("comment|footer|header|sidebar|widget|article|content|advert|cookie|newsletter|breadcrumb|navbar|related|respon[ds]")


@dataclass
class Block:
    """above: features of the elements around the block; linked: characters inside links; home: its container; share, over: quarters of the page's text that the container and the one around it hold."""

    above: frozenset[str]
    text: str
    linked: int
    home: int = 0
    share: int = 4
    over: int = 4


def names_of(attributes: str) -> list[str]:
    """Words of class, id and role, and hidden for what is not shown."""
    if not attributes:
        return []
    found = [w for m in NAMED.finditer(attributes) for w in WORDS.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "").lower())]
    found += [root for w in found for root in ROOTS.findall(w) if root != w]
    return [*found, "hidden"] if HIDDEN.search(attributes) else found


def _marks(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, whether it ends an element, attributes) of each mark-up; comments and the like have no tag.

    Elements with raw text end only at a tag of just their name, and without one at the end of the page, as in browsers. A
    mark without its '>' takes the rest of the page; once quotes leave one open, later ones end at the next '>', quoted
    or not, so that no part of a page is looked through again and again.
    """
    at, quotes = 0, True
    while m := START.search(page, at):
        start, tag, attributes = m.start(), (m["tag"] or "").lower(), ""
        if m["comment"]:
            at = page.find("-->", start + 2) + 3
        else:
            found = ATTRIBUTES.match(page, m.end()) if tag and quotes else None
            if found:
                at = found.end()
            else:
                quotes = quotes and not tag
                at = page.find(">", m.end() if tag else start + 2) + 1
            attributes = page[m.end() : at - 1]
        if at <= start:
            yield start, len(page), "", False, ""
            return
        if tag in RAW and not m["end"]:
            close = CLOSED[tag].search(page, at)
            at = close.start() if close else len(page)
        yield start, at, tag, bool(m["end"]), attributes


def leaf_blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Blocks in page order: text between the tags of block elements, in time that grows with the page.

    Scripts, styles, comments, form texts and drawings are left out; tags that pages leave open are closed as browsers do;
    references are decoded and white space is one space. Elements that are not shown are left out where they stand inside a
    text, and are a feature of the blocks below them elsewhere. known: the features that count, else all do.
    """
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset[str], int]] = []
    around = [0]  # the container around each container
    unseen, unseen_depth = "", 0  # the element inside a text that is not shown
    open_tags: Counter[str] = Counter()
    skipping: list[int] = []  # depths of the elements without text
    parts: list[str] = []
    linked, links, at = 0, 0, 0

    def counts(*features: str) -> set[str]:
        return {f for f in features if known is None or f in known}

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                above = stack[-1][1] | counts(f"last={stack[-1][0]}") if stack else frozenset()
                blocks.append(Block(above, text, min(linked, len(text)), stack[-1][2] if stack else 0))
            parts.clear()
        linked = 0

    def close(depth: int) -> None:
        open_tags.subtract(tag for tag, _, _ in stack[depth:])
        del stack[depth:]
        while skipping and skipping[-1] >= depth:
            skipping.pop()

    for start, end, tag, ends, attributes in _marks(page):
        if start > at and not skipping and not unseen:
            parts.append(page[at:start])
            if links:
                linked += start - at
        at = end
        if not tag:
            continue
        if tag in RAW:
            flush()
            continue
        if tag in INLINE:
            if tag == unseen:
                unseen_depth += -1 if ends else 1
                unseen = unseen if unseen_depth else ""
            elif not unseen and not ends and tag not in VOID and HIDDEN.search(attributes):
                unseen, unseen_depth = tag, 1
            if tag == "a":
                links = 0 if ends else 1
            continue
        if tag == "br":
            parts.append(" ")
            continue
        flush()
        links, unseen = 0, ""
        if ends:
            if open_tags[tag] > 0:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if stack and stack[-1][0] == "p":
            close(len(stack) - 1)
        if tag in CLOSES and any(open_tags[t] > 0 for t in CLOSES[tag]):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in SCOPES[tag]:
                    break
                if stack[k][0] in CLOSES[tag]:
                    close(k)
                    break
        if tag not in VOID and not attributes.endswith("/"):
            above, own = stack[-1][1] if stack else frozenset(), counts(f"tag={tag}", *(f"name={w}" for w in names_of(attributes)))
            if tag in SKIPPED:
                skipping.append(len(stack))
            open_tags[tag] += 1
            home = stack[-1][2] if stack else 0
            if tag not in PIECES:
                around.append(home)
                home = len(around) - 1
            stack.append((tag, above if own <= above else above | own, home))
    if at < len(page) and not skipping and not unseen:
        parts.append(page[at:])
        if links:
            linked += len(page) - at
    flush()
    held = [0] * len(around)
    for b in blocks:
        held[b.home] += (len(b.text) - b.linked) * (b.text.count(" ") >= 4)
    for k in range(len(around) - 1, 0, -1):  # containers come after those around them
        held[around[k]] += held[k]
    for b in blocks:
        b.share, b.over = (round(4 * held[k] / held[0]) if held[0] else 4 for k in (b.home, around[b.home]))
    return blocks
