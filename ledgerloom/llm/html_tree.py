"""A small forgiving reader of HTML: containers, blocks of text and what is not part of an article."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

#: Elements whose content is text of another kind, up to their end tag.
RAW = frozenset("script style noscript template textarea title iframe svg xmp".split())
_NAME = re.compile(r"[a-zA-Z][\w:.-]*+")
#: Where a tag ends, or where a quoted value in it begins.
_STOP = re.compile(r">|=\s*+([\"'])")
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
DROPPED = frozenset("head nav header footer aside form menu button select option dialog object canvas audio video map fieldset".split())
CONTAINERS = frozenset("html body main article section div td center blockquote content".split())
KEPT_WHOLE = frozenset("html body main article".split())
#: Words in class, id or role names that mark what is not article text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion banner nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside footer "
    "masthead comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations pagination pager toolbar search searchbox form forms skip contentinfo complementary".split()
)
#: Words that may stand beside a mark in the name of such a part. With any other word beside it, as in
#: "form-of-state" or "related-work", a mark is only a word.
BESIDE = frozenset(
    "site page top main global left right bottom center inner outer box block list item items wrap wrapper container bar area section widget widgets post posts article articles story stories "
    "news link links btn button buttons icon icons header head primary secondary sticky fixed col column row panel slot unit space text title body message inline mobile desktop js group set "
    "thread threads user users reader readers author media bottomline trail to me us now more also read you may like policy email mail google dfp mpu leaderboard skyscraper rail sub".split()
)
#: Words that say that a page has or lacks such a part, not that this is one.
NEGATING = frozenset(["has", "with", "no", "without"])
#: Marks only when they are the whole name, or stand after "site", "page" or "top".
WHOLE = frozenset(["header", "head", "topbar", "bar"])


def _tokens(source: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(first place, place after, name or null, whether it ends an element, attributes) of each tag, comment or raw element.

    Every search for the end of something that fails ends the reading, or is followed by one that goes over the same
    text for good, so the time is linear in the source.
    """
    at, size, last = 0, len(source), source.rfind(">")
    while True:
        start = source.find("<", at)
        if start < 0:
            return
        mark = source[start + 1 : start + 2]
        if mark in ("!", "?"):
            comment = source.startswith("<!--", start)
            end = source.find("-->" if comment else ">", start + 2)
            at = size if end < 0 else end + (3 if comment else 1)
            yield start, at, None, False, ""
            continue
        ending = mark == "/"
        name = _NAME.match(source, start + 1 + ending)
        if name is None:
            at = start + 1
            continue
        if last < start:  # a tag that never ends
            yield start, size, None, False, ""
            return
        place = name.end()
        while True:
            stop = _STOP.search(source, place)
            if stop is None:
                end = source.find(">", name.end())
                break
            if stop[1] is None:
                end = stop.start()
                break
            place = source.find(stop[1], stop.end()) + 1
            if not place:  # a quote that is never closed is no quote
                end = source.find(">", name.end())
                break
        at = size if end < 0 else end + 1
        tag = name[0].lower()
        if tag in RAW and not ending and source[at - 2 : at - 1] != "/":
            close = _RAW_END[tag].search(source, at)
            at = size if close is None else close.end()
            yield start, at, None, False, ""
        else:
            yield start, at, tag, ending, source[name.end() : at - 1]


@dataclass(slots=True)
class Node:
    """An element. What depends on those above it is handed down when it is made or once the page is read, so that nothing
    climbs up a deep page again and again."""

    tag: str
    name: str
    parent: Node | None
    dropped: bool
    #: Whether paragraphs of the same parent come before it, and whether it has paragraphs so far.
    after_text: bool = False
    has_text: bool = False
    score: float = 0.0
    chars: int = 0
    link_chars: int = 0
    links: int = 0
    #: Kept text at or under it.
    kept_chars: int = 0
    #: The nearest container at or above it, and the nearest article or main element above it.
    near: Node | None = None
    article: Node | None = None
    #: Whether it, or an element between it and the next container, comes after paragraphs.
    text_above: bool = False
    in_menu: bool = False
    #: A hash of the path of containers down to it.
    path_key: int = 0

    def __post_init__(self) -> None:
        up, inside = self.parent, self.tag in CONTAINERS
        self.near = self if inside or up is None else up.near
        self.article = None if up is None else up if up.tag in ("article", "main") else up.article
        self.text_above = not inside and up is not None and (self.after_text or up.text_above)
        self.path_key = 0 if up is None else path_key(up.path_key, self.name) if inside else up.path_key


def path_key(above: int, name: str) -> int:
    return hash((above, name))


def _is_marked(names: list[str], in_article: bool) -> bool:
    for name in names:
        parts = [p for p in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if len(p) > 1]
        if NEGATING.intersection(parts):
            continue
        if MARKS.intersection(parts) and all(p in MARKS or p in BESIDE for p in parts):
            return True
        if not in_article and parts and parts[-1] in WHOLE and (len(parts) == 1 or parts[-2] in ("site", "page", "top", "global", "main")):
            return True
    return False


def general_name(tag: str, names: list[str]) -> str:
    """The tag and its first class, with digits left out, as one step of a path."""
    kind = re.sub(r"\d+", "", names[0]).strip("-_ ").lower() if names else ""
    return f"{tag}.{kind}" if kind else tag


#: A container gives way to the one around it when it holds no more than this share of its text (half where that is the
#: whole page), or when another one of its name beside it has at least this part of its own text.
MOST, MOST_OF_PAGE, ALIKE = 3 / 4, 1 / 2, 1 / 4


class Page:
    """A parsed page: ``nodes`` are its elements other than inline ones, ``blocks`` its (node, text) in page order."""

    def __init__(self, source: str):
        self.root = root = Node("", "", None, False)
        self.nodes: list[Node] = [root]
        self.blocks: list[tuple[Node, str]] = []
        stack: list[Node] = [root]
        #: The places in the stack of each tag's open elements, and of those that end tags of others don't close.
        open_: dict[str, list[int]] = {}
        walls: list[int] = [0]
        text: list[str] = []
        links = 0
        in_link = False
        owner = root
        position = 0

        def flush():
            nonlocal links
            if text:
                joined = " ".join(html.unescape("".join(text)).split())
                if joined:
                    self.blocks.append((owner, joined))
                    owner.chars += len(joined)
                    owner.link_chars += min(links, len(joined))
                text.clear()
            links = 0

        def pop():
            gone = stack.pop()
            open_[gone.tag].pop()
            if walls[-1] == len(stack):
                walls.pop()

        for start, end, tag, ending, attributes in _tokens(source):
            if start > position:
                owner = stack[-1]
                piece = source[position:start]
                text.append(piece)
                if in_link:
                    links += len(piece)
            position = end
            if tag is None:
                continue
            if tag in INLINE:
                if tag == "a":
                    in_link = not ending
                    stack[-1].links += in_link
                continue
            if tag == "br" or tag == "wbr":
                text.append(" " if tag == "br" else "")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            flush()
            in_link = False
            if ending:
                places = open_.get(tag)
                if places and (tag in KEPT_WHOLE or places[-1] > walls[-1]):
                    depth = places[-1]
                    while len(stack) > depth:
                        pop()
                continue
            # An open paragraph ends where a block begins; list items, rows and cells end where the next one begins.
            while len(stack) > 1 and (stack[-1].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") or (stack[-1].tag == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option"))):
                pop()
            names = []
            for attribute in _ATTRIBUTE.finditer(attributes):
                value = attribute[2] or attribute[3] or attribute[4] or ""
                names += value.split() if attribute[1].lower() != "id" else [value]
            parent = stack[-1]
            in_article = parent.article is not None or parent.tag in ("article", "main")
            # The header of an article is part of it.
            of_page = tag in DROPPED and not (tag == "header" and in_article)
            dropped = parent.dropped or of_page or (tag not in KEPT_WHOLE and bool(names) and _is_marked(names, in_article))
            node = Node(tag, general_name(tag, names), parent, dropped, parent.has_text)
            parent.has_text = parent.has_text or tag == "p"
            self.nodes.append(node)
            if not attributes.rstrip().endswith("/"):
                open_.setdefault(tag, []).append(len(stack))
                if tag in KEPT_WHOLE:
                    walls.append(len(stack))
                stack.append(node)
        if position < len(source):
            owner = stack[-1]
            text.append(source[position:])
        flush()
        for node in reversed(self.nodes):
            if node.parent is not None:
                node.parent.chars += node.chars
                node.parent.link_chars += node.link_chars
                node.parent.links += node.links
        for node in self.nodes:
            node.in_menu = (node.parent is not None and node.parent.in_menu) or self.is_menu(node)
        for node, block in self.blocks:
            if self.kept(node):
                node.kept_chars += len(block)
        for node in reversed(self.nodes):
            if node.parent is not None:
                node.parent.kept_chars += node.kept_chars

    def path(self, node: Node) -> str:
        steps = []
        while node is not None and node.tag:
            if node.tag in CONTAINERS:
                steps.append(node.name)
            node = node.parent
        return "/".join(reversed(steps))

    def at(self, path: str) -> list[Node]:
        """The elements with text at a path of containers."""
        key = 0
        for name in path.split("/"):
            key = path_key(key, name)
        return [n for n in self.nodes if n.path_key == key and n.near is n and not n.dropped and n.chars]

    def is_menu(self, node: Node) -> bool:
        """Whether a list or table holds little but links and stands by itself: neither in an article nor after a
        paragraph of the same container, as a list of sources would."""
        if not (node.tag in ("ul", "ol", "dl", "table") and node.links >= 3 and node.link_chars >= 0.8 * node.chars):
            return False
        if node.parent.text_above or node.article is not None:
            return False
        place = node.parent.near
        return not (place.tag not in ("body", "html", "") and node.after_text)

    def kept(self, node: Node) -> bool:
        return not node.dropped and not node.in_menu

    def best(self) -> tuple[Node | None, float]:
        """The container with the most text of its own, and those around it as long as it is a part of them: a block counts
        for its container, and half for the one above."""
        found: dict[int, Node] = {}
        for node, text in self.blocks:
            if self.kept(node):
                first = node.near
                for share, place in ((1.0, first), (0.5, first.parent.near if first.parent is not None else self.root)):
                    place.score += share * len(text) * (2.0 if place.tag == "article" else 1.5 if place.tag == "main" else 1.0)
                    found[id(place)] = place
        if not found:
            return None, 0.0
        top = max(found.values(), key=lambda n: n.score)
        score = max(top.score, 1.0)
        if top.tag in ("article", "main") or top.article is not None:
            return top.article or top, score
        alike: dict[tuple[int, str], list[int]] = {}
        for node in self.nodes:
            if node.near is node and node.parent is not None and node.kept_chars:
                alike.setdefault((id(node.parent.near), node.name), []).append(node.kept_chars)
        while top.parent is not None:
            around = top.parent.near
            whole = around.tag in ("body", "html", "")
            beside = sorted(alike.get((id(around), top.name), []))[-2:]
            several = len(beside) > 1 and beside[0] >= ALIKE * top.kept_chars
            if top.tag in ("body", "html") or not (several or top.kept_chars <= (MOST_OF_PAGE if whole else MOST) * around.kept_chars):
                break
            top = around
        return top, score

    def text_under(self, chosen: list[Node]) -> list[str]:
        under = {id(n) for n in chosen}
        for node in self.nodes:
            if id(node.parent) in under:
                under.add(id(node))
        return [text for node, text in self.blocks if id(node) in under and self.kept(node)]
