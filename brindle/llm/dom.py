"""A small DOM for feature extraction: tolerant, linear in the page, without recursion."""

from __future__ import annotations

import html
import re
from collections import Counter

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe noframes".split())
#: Raw content that is code: left open, it runs to the end of the page.
CODE = frozenset(("script", "style"))
#: Content that is no text of the page whatever stands around it.
UNSEEN = frozenset("script style template noscript iframe noframes title head".split())
#: Tags that may stand in an open head; any other tag, or text, closes it.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead tr ul button".split()
)
#: An opening tag closes these open ones, up to the nearest of its scopes.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_P_SCOPE = frozenset("article aside body button div td th li main section header footer nav form table".split())
#: In a tag a quote opens a value only after "="; elsewhere it is part of a name, and the tag ends at the next ">".
_INSIDE = r"(?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+)?|[^>=])*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_INSIDE})(?:>|\Z)", re.S)
_ATTR = re.compile(r"""([^\s=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class Node:
    __slots__ = ("attrs", "children", "index", "parent", "tag")

    def __init__(self, tag: str, attrs: str, parent: int, index: int):
        self.tag, self.attrs, self.parent, self.index = tag, attrs, parent, index
        self.children: list[int] = []


def attribute_words(attrs: str) -> list[str]:
    """The words of class, id and role, in lower case, split at hyphens, underscores and changes of case."""
    if not attrs or "=" not in attrs:
        return []
    out: list[str] = []
    for m in _ATTR.finditer(attrs):
        if m[1].lower() in ("class", "id", "role", "itemprop", "aria-label") and m[2]:
            value = re.sub(r"([a-z])([A-Z])", r"\1 \2", m[2].strip("\"'"))
            out += [w for w in re.split(r"[^a-z0-9]+", value.lower()) if w]
    return out


def parse(page: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Nodes in page order (the first is the root) and the stream (node, text | None): None marks a break of block."""
    root = Node("#root", "", -1, 0)
    nodes, stack, tags, opened = [root], [0], ["#root"], Counter()
    stream: list[tuple[int, str | None]] = []
    hidden, at, page_end, search = 0, 0, len(page), _TOKEN.search  # hidden: depth of the stack at which unseen content began

    def cut(k: int) -> None:
        for t in tags[k:]:
            opened[t] -= 1
        del stack[k:], tags[k:]

    while True:
        m = search(page, at)
        stop = m.start() if m else page_end
        if hidden and stop > at and not _SPACE.fullmatch(page, at, stop):
            cut(hidden)
            hidden = 0
        if stop > at and not hidden:
            stream.append((stack[-1], page[at:stop]))
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if not hidden and m[0].startswith("<![CDATA["):
                stream.append((stack[-1], m[0][9:-3].replace("&", "&amp;")))
            continue
        tag = tag.lower()
        if m[1]:
            if opened[tag]:
                k = len(tags) - 1
                while tags[k] != tag:
                    k -= 1
                if not hidden or hidden >= k:
                    hidden = 0
                    if not BLOCK.isdisjoint(tags[k:]):
                        stream.append((stack[k - 1], None))
                cut(k)
            continue
        if hidden and tag not in IN_HEAD:
            cut(hidden)
            hidden = 0
        closes = CLOSES.get(tag)
        block = tag in BLOCK
        if closes is None and block and opened["p"]:
            closes = ({"p"}, _P_SCOPE)
        if closes and any(opened[t] for t in closes[0]):
            for k in range(len(tags) - 1, 0, -1):
                open_tag = tags[k]
                if open_tag in closes[0]:
                    cut(k)
                    if open_tag not in ("td", "th") or tag != "tr":
                        break
                elif open_tag in closes[1]:
                    break
        top = stack[-1]
        kin = nodes[top].children
        attrs = m[3]
        i = len(nodes)
        nodes.append(Node(tag, attrs or "", top, len(kin)))
        kin.append(i)
        if not hidden:
            if block:
                stream.append((i, None))
            elif tag == "br":
                stream.append((top, " "))
        if tag in VOID or attrs and attrs[-1] == "/":
            continue
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(page, at)
            if close is None and tag not in CODE:
                continue  # left open by mistake: it must not swallow the page
            end = close.start() if close else page_end
            if not hidden and tag not in UNSEEN:
                stream.append((i, page[at:end]))
                if block:
                    stream.append((top, None))
            at = close.end() if close else page_end
            continue
        stack.append(i)
        tags.append(tag)
        opened[tag] += 1
        if not hidden and tag in UNSEEN:
            hidden = len(tags) - 1
    return nodes, stream


def blocks(stream: list[tuple[int, str]], kept: list[bool] | None = None) -> list[str]:
    """The kept text by block: character references decoded, white space as one space, trimmed; empty blocks gone."""
    out, now = [], []
    for i, text in stream:
        if text is None:
            if now:
                out.append("".join(now))
                now = []
        elif kept is None or kept[i]:
            now.append(text)
    out.append("".join(now))
    return [b for x in out if (b := _SPACE.sub(" ", html.unescape(x) if "&" in x else x).strip(" "))]
