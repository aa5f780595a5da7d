"""Leaf blocks of a page: whole texts between block-level tags, with the path
of tags they stand in."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Fixed values of HTML: elements that never have an end tag, whose content is no page text, and that stand within a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea iframe noframes xmp svg math object".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: An open element that the start of another one ends.
CLOSES = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody"]),
    "th": frozenset(["td", "th", "tr", "tbody"]),
    "option": frozenset(["option", "optgroup"]),
}
#: Elements beyond which an implied end does not reach.
SCOPE = frozenset("table ul ol dl div article section main aside nav body form".split())

#: What has an end of its own, and where a tag begins; what ends a tag or begins a quoted value in it.
_START = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)", re.S)
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)


class Node:
    """An open block-level element with the words of its class, id and role,
    and the one around it: a path that shares its beginning with others."""

    __slots__ = ("depth", "features", "hidden", "marks", "nearest", "parent", "tag")

    def __init__(self, tag: str, marks: tuple[str, ...], parent: Node | None):
        self.tag, self.marks, self.parent = tag, marks, parent
        self.depth = parent.depth + 1 if parent else 1
        self.hidden = "hidden" in marks or parent is not None and parent.hidden
        #: The element itself or the nearest one around it that says what it is for.
        self.nearest = self if marks or tag in SECTIONS else parent.nearest if parent else None
        self.features = None


#: Elements that say by their name what they are for.
SECTIONS = frozenset("article main section nav aside header footer form body".split())


@dataclass
class Block:
    text: str
    #: The innermost open block-level element; None outside of all.
    path: Node | None
    #: Characters within links.
    linked: int


def _marks(attrs: str) -> tuple[str, ...]:
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return ()
    found: list[str] = []
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                found.append("hidden")
        elif name == "hidden" or name == "aria-hidden":
            if value != "false":
                found.append("hidden")
        else:
            found += [x for x in re.split(r"[\s_\-]+", html.unescape(value)) if x]
    return tuple(dict.fromkeys(found))


class _Tags:
    """Ends of tags, without reading to the page's end for each one that has none."""

    def __init__(self, page: str):
        self.page, self.last = page, {c: page.rfind(c) for c in ">\"'"}

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``; -1 if there is none outside of quotes."""
        while at <= self.last[">"]:
            m = _STOP.search(self.page, at)
            c = m[0]
            if c == ">":
                return m.start()
            if m.start() == self.last[c]:
                return -1
            at = self.page.index(c, m.end()) + 1
        return -1


#: By the name of a new element, the open ones that it ends.
ENDS = {name: frozenset(o for o, by in CLOSES.items() if name in by) for name in frozenset().union(*CLOSES.values())}


def blocks(page: str) -> list[Block]:
    """The blocks of a page in page order; blank ones are left out."""
    stack: list[Node] = []
    opened: Counter[str] = Counter()
    tags = _Tags(page)
    out: list[Block] = []
    parts: list[str] = []
    linked, in_link, at, end, seek = 0, 0, 0, len(page), 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, stack[-1] if stack else None, linked))
            parts.clear()
        linked = 0

    def text(a: int, b: int) -> None:
        nonlocal linked
        if b > a:
            parts.append(page[a:b])
            if in_link:
                linked += b - a

    def leave(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]

    while at < end:
        m = _START.search(page, max(at, seek))
        if not m:
            text(at, end)
            break
        if m.group(3) is None:
            text(at, m.start())
            at = m.end()
            if m.group(1) is not None:
                parts.append(html.escape(m.group(1)))
            continue
        stop = tags.end(m.end())
        if stop < 0:  # no tag: the sign is text
            seek = m.start() + 1
            continue
        text(at, m.start())
        at = stop + 1
        close, name, attrs = m.group(2), m.group(3).lower(), page[m.end() : stop]
        alone = attrs.endswith("/")
        if close:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name in INLINE:
                continue
            flush()
            if opened[name]:
                k = len(stack) - 1
                while stack[k].tag != name:
                    k -= 1
                leave(k)
            continue
        if name in RAW:
            if not alone:
                tail = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = tail.end() if tail else end
            if name not in ("svg", "math", "object"):
                flush()
            continue
        if name in INLINE:
            if name == "a" and not alone:
                in_link += 1
            continue
        flush()
        if name in VOID:
            continue
        if any(opened[o] for o in ENDS.get(name, ())):
            for k in range(len(stack) - 1, -1, -1):
                if name in CLOSES.get(stack[k].tag, ()):
                    leave(k)
                    break
                if stack[k].tag in SCOPE:
                    break
        stack.append(Node(name, _marks(attrs[:-1] if alone else attrs), stack[-1] if stack else None))
        opened[name] += 1
        if name != "a" and in_link and name in ("nav", "article", "main", "footer", "header", "aside"):
            in_link = 0
    flush()
    return out
