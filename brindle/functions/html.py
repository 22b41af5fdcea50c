"""HTML as copied between applications: tokens, styled runs and documents.

Three layers. ``tokens`` cuts bytes into markup and text and never fails. ``Flow`` keeps the open elements with
their styles and turns tokens into runs, with line breaks that are only made once text follows them. ``document``
joins the runs to one text with merged styles.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from html.entities import name2codepoint
from typing import Any, NamedTuple

import numpy as np

from .core import MAX_DEPTH, Bad

# Element classes.
RAW_TEXT = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
VOID = frozenset("area base basefont br col embed frame hr img input keygen link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote caption center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody tfoot thead tr ul".split())
CELL = frozenset(("td", "th"))
DROPPED = frozenset("script style head title meta link template noscript iframe object".split())
PRESERVING = frozenset("pre textarea xmp plaintext".split())
BOLD, ITALIC = frozenset(("b", "strong")), frozenset("i em cite var dfn address".split())
UNDERLINE, STRIKE = frozenset(("u", "ins")), frozenset(("s", "strike", "del"))
FORMATTING = BOLD | ITALIC | UNDERLINE | STRIKE | frozenset("font big small tt nobr code a".split())
BOLD_BY_DEFAULT = frozenset("th h1 h2 h3 h4 h5 h6".split())
#: A start tag closes the nearest open element of these names, unless a barrier is nearer.
P_BARRIERS = frozenset("table td th ul ol dl body blockquote div section article form fieldset".split())
IMPLIED = {
    "p": [({"p"}, P_BARRIERS)],
    "li": [({"li"}, {"table", "td", "th", "body"})],
    "td": [(CELL, {"table"})],
    "th": [(CELL, {"table"})],
    "tr": [(CELL, {"table"}), ({"tr"}, {"table"})],
}
# Character references. The HTML 4 names, and those of punctuation that newer documents use.
ENTITIES = {k: chr(v) for k, v in name2codepoint.items()} | {
    "NewLine": "\n",
    "Tab": "\t",
    "apos": "'",
    "ast": "*",
    "blank": "␣",
    "check": "✓",
    "colon": ":",
    "comma": ",",
    "commat": "@",
    "cross": "✗",
    "dollar": "$",
    "equals": "=",
    "excl": "!",
    "grave": "`",
    "half": "½",
    "lcub": "{",
    "lowbar": "_",
    "lpar": "(",
    "lsqb": "[",
    "midast": "*",
    "num": "#",
    "percnt": "%",
    "period": ".",
    "plus": "+",
    "quest": "?",
    "rcub": "}",
    "rpar": ")",
    "rsqb": "]",
    "semi": ";",
    "sol": "/",
    "starf": "★",
    "verbar": "|",
}
# Colours by name.
COLOURS = {
    "aqua": "00ffff", "aquamarine": "7fffd4", "beige": "f5f5dc", "black": "000000", "blue": "0000ff", "brown": "a52a2a", "crimson": "dc143c", "cyan": "00ffff",
    "darkblue": "00008b", "darkgray": "a9a9a9", "darkgreen": "006400", "darkgrey": "a9a9a9", "darkred": "8b0000", "fuchsia": "ff00ff", "gold": "ffd700",
    "gray": "808080", "green": "008000", "grey": "808080", "indigo": "4b0082", "lightblue": "add8e6", "lightgray": "d3d3d3", "lightgreen": "90ee90",
    "lightgrey": "d3d3d3", "lightyellow": "ffffe0", "lime": "00ff00", "magenta": "ff00ff", "maroon": "800000", "navy": "000080", "olive": "808000",
    "orange": "ffa500", "pink": "ffc0cb", "purple": "800080", "red": "ff0000", "silver": "c0c0c0", "teal": "008080", "violet": "ee82ee", "white": "ffffff", "yellow": "ffff00",
}
#: Font size keywords in points, and units in points.
SIZES = {"xx-small": 6.75, "x-small": 7.5, "small": 9.75, "medium": 12.0, "large": 13.5, "x-large": 18.0, "xx-large": 24.0}
UNITS = {"pt": 1.0, "px": 0.75, "pc": 12.0, "in": 72.0, "cm": 72.0 / 2.54, "mm": 72.0 / 25.4, "q": 72.0 / 101.6}
FONT_SCALE = (7.5, 9.75, 12.0, 13.5, 18.0, 24.0, 36.0)
TRANSPARENT = "transparent"

_WS = b" \t\n\r\x0c"
_SPACES = re.compile(rb"[\t\n\r\x0c][ \t\n\r\x0c]*| [ \t\n\r\x0c]+")
_REFERENCE = re.compile(rb"&(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|([A-Za-z0-9]{1,32})(;?))")
_TAG_NAME = re.compile(rb"[A-Za-z0-9\-_:]*")
_ATTR = re.compile(rb"[ \t\n\r\x0c=/>]*([^ \t\n\r\x0c=/>]+)[ \t\n\r\x0c]*(?:=[ \t\n\r\x0c]*(?:\"([^\"]*)\"?|'([^']*)'?|([^ \t\n\r\x0c>]*)))?")
_ATTRS_END = re.compile(rb"(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*")
_NUMBER = re.compile(rb"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)")


class Token(NamedTuple):
    kind: str  # start, end, text, comment, doctype
    offset: int
    name: str = ""
    raw: bytes = b""
    self_closing: bool = False
    verbatim: bool = False  # text of a raw-text element


def character(value: int) -> str:
    if 0x80 <= value <= 0x9F:
        try:
            return bytes((value,)).decode("cp1252")
        except UnicodeDecodeError:
            return chr(value)
    if value == 0 or value > 0x10FFFF or 0xD800 <= value <= 0xDFFF:
        return "\ufffd"
    return chr(value)


def reference(data: bytes, at: int, closed: bool = False) -> tuple[str, int] | None:
    """The character that a reference at ``at`` stands for and its length; None if there is none.

    Numbers of more than eight digits are taken whole and become U+FFFD. With a semicolon a name must be exact;
    without one the longest beginning that is a name counts, or, if ``closed``, nothing does.
    """
    m = _REFERENCE.match(data, at)
    if m is None or closed and data[m.end() - 1] != 0x3B:
        return None
    digits = m[1] or m[2]
    if digits is not None:
        return (character(int(digits, 16 if m[1] else 10)) if len(digits) <= 8 else "\ufffd"), m.end() - at
    name = m[3].decode()
    if m[4]:
        return (ENTITIES[name], m.end() - at) if name in ENTITIES else None
    for size in range(len(name), 0, -1):
        if name[:size] in ENTITIES:
            return ENTITIES[name[:size]], 1 + size
    return None


def lossy(b: bytes) -> str:
    return b.decode("utf-8", "replace")


def unescape(raw: bytes, closed: bool = False) -> str:
    """References decoded, broken UTF-8 repaired, white space as it is."""
    if b"&" not in raw:
        return lossy(raw)
    out, at = [], 0
    while True:
        amp = raw.find(b"&", at)
        if amp < 0:
            return "".join([*out, lossy(raw[at:])])
        out.append(lossy(raw[at:amp]))
        ref = reference(raw, amp, closed)
        out.append(ref[0] if ref else "&")
        at = amp + (ref[1] if ref else 1)


def text_of(raw: bytes, preserve: bool, boundary: bool, closed: bool = False) -> str:
    """Text of a span. Collapsing turns runs of white space into one space, none at a boundary; a character reference
    is never white space. Preserving keeps it, with line ends as LF and without the one that begins an element.
    """
    if preserve:
        if boundary:
            raw = raw[2:] if raw[:2] == b"\r\n" else raw[1:] if raw[:1] in (b"\r", b"\n") else raw
        return _eol(raw, closed)
    shown = _SPACES.sub(b" ", raw)
    return unescape(shown[1:] if boundary and shown[:1] == b" " else shown, closed)


def _eol(raw: bytes, closed: bool) -> str:
    return unescape(raw.replace(b"\r\n", b"\n").replace(b"\r", b"\n"), closed)


def tokens(data: bytes) -> Iterator[Token]:
    """Markup and text in order. Anything that is no markup is text; the contents of raw-text elements are one text."""
    at, size = 0, len(data)
    until = b""
    while at < size:
        start = at
        if until:
            m = re.compile(rb"</" + re.escape(until) + rb"(?=[>/ \t\n\r\x0c]|\Z)", re.I).search(data, at)
            at = m.start() if m else size
            until = b""
            if at > start:
                yield Token("text", start, raw=data[start:at], verbatim=True)
            continue
        if data[at] == 0x3C:  # <
            nxt = data[at + 1 : at + 2]
            if nxt == b"!":
                if data.startswith(b"<!--", at):
                    end = data.find(b"-->", at + 4)
                    body = data[at + 4 : end if end >= 0 else size]
                    at = end + 3 if end >= 0 else size
                    yield Token("comment", start, raw=body)
                elif data.startswith(b"<![CDATA[", at):
                    end = data.find(b"]]>", at + 9)
                    body = data[at + 9 : end if end >= 0 else size]
                    at = end + 3 if end >= 0 else size
                    yield Token("text", start, raw=body)
                else:
                    end = data.find(b">", at)
                    body = data[at : end if end >= 0 else size]
                    at = end + 1 if end >= 0 else size
                    yield Token("doctype", start, raw=body)
                continue
            if nxt == b"?":
                end = data.find(b">", at)
                body = data[at : end if end >= 0 else size]
                at = end + 1 if end >= 0 else size
                yield Token("doctype", start, raw=body)
                continue
            if nxt == b"/":
                name = _TAG_NAME.match(data, at + 2)[0]
                end = data.find(b">", at + 2 + len(name))
                at = end + 1 if end >= 0 else size
                if name:
                    yield Token("end", start, name.decode())
                continue
            if nxt.isalpha():
                name = _TAG_NAME.match(data, at + 1)[0]
                body = _ATTRS_END.match(data, at + 1 + len(name))[0]
                at = min(size, at + 1 + len(name) + len(body) + 1)
                closing = body.endswith(b"/")
                if name.lower().decode() in RAW_TEXT:
                    until = name
                yield Token("start", start, name.decode(), body[:-1] if closing else body, closing)
                continue
        end = data.find(b"<", at + 1)
        at = end if end >= 0 else size
        yield Token("text", start, raw=data[start:at])


def attributes(raw: bytes) -> Iterator[tuple[str, bytes]]:
    """(name, undecoded value) in order; an attribute without a value has an empty one."""
    for m in _ATTR.finditer(raw):
        try:
            name = m[1].decode()
        except UnicodeDecodeError:
            name = ""
        yield name, next((g for g in (m[2], m[3], m[4]) if g is not None), b"")


def attribute(raw: bytes, name: str) -> bytes | None:
    return next((v for k, v in attributes(raw) if k.lower() == name), None)


# -- CSS -----------------------------------------------------------------


def _split_top(block: bytes, sep: bytes) -> Iterator[tuple[int, int]]:
    """Pieces between separators outside quotes, parentheses and character references."""
    quote, depth, i, start = 0, 0, 0, 0
    while i < len(block):
        b = block[i]
        if not quote and b == 0x26 and (ref := reference(block, i)):
            i += ref[1]
            continue
        if quote:
            quote = 0 if b == quote else quote
        elif b in b"\"'":
            quote = b
        elif b == 0x28:
            depth += 1
        elif b == 0x29:
            depth = max(0, depth - 1)
        elif b == sep[0] and not depth:
            yield start, i
            start = i + 1
        i += 1
    yield start, len(block)


def declarations(block: bytes) -> Iterator[tuple[str, bytes]]:
    for a, b in _split_top(block, b";"):
        part = block[a:b]
        cut = next(_split_top(part, b":"))[1]
        name = part[:cut].strip(_WS)
        if cut < len(part) and name:
            try:
                yield name.decode().lower(), part[cut + 1 :].strip(_WS)
            except UnicodeDecodeError:
                yield "", part[cut + 1 :].strip(_WS)


def unquote(value: bytes) -> bytes:
    for q in (b'"', b"'", b"&quot;", b"&#34;", b"&apos;", b"&#39;"):
        if len(value) > 2 * len(q) - 1 and value.startswith(q) and value.endswith(q):
            return value[len(q) : len(value) - len(q)].strip(_WS)
    return value


def number(value: bytes) -> tuple[float, int] | None:
    m = _NUMBER.match(value)
    return (float(np.float32(float(m[0]))), m.end()) if m else None


def font_weight_bold(value: bytes) -> bool | None:
    v = value.strip(_WS).lower()
    if v in (b"bold", b"bolder"):
        return True
    if v in (b"normal", b"lighter"):
        return False
    n = number(v)
    return n[0] >= 600 if n and n[1] == len(v) else None


def font_style_italic(value: bytes) -> bool | None:
    return {b"italic": True, b"oblique": True, b"normal": False}.get(value.strip(_WS).lower())


def text_decoration(value: bytes) -> tuple[bool, bool] | None:
    """(underline, strike); None if no known word is there."""
    words = set(value.lower().split())
    found = b"underline" in words, b"line-through" in words
    return found if any(found) or b"none" in words else None


def colour(value: bytes) -> str | None:
    """rrggbb, ``transparent``, or None for what is no colour."""
    v = value.strip(_WS).lower()
    if v == b"transparent":
        return TRANSPARENT
    if v.startswith(b"#"):
        return _hex_colour(v[1:])
    if b"(" in v:
        name, _, args = v.partition(b"(")
        return _rgb(args[:-1]) if name in (b"rgb", b"rgba") else None
    return COLOURS.get(v.decode("ascii", "replace"))


def _hex_colour(h: bytes) -> str | None:
    if len(h) not in (3, 4, 6, 8) or not re.fullmatch(rb"[0-9a-f]+", h):
        return None
    digits = h.decode()
    if len(h) in (3, 4):
        digits = "".join(c * 2 for c in digits)
    return TRANSPARENT if digits[6:] == "00" else digits[:6]


def _rgb(args: bytes) -> str | None:
    parts: list[float] = []
    rest = args
    while len(parts) < 4:
        t = rest.strip(_WS)
        if not t:
            break
        n = number(t)
        if n is None:
            return None
        percent = t[n[1] : n[1] + 1] == b"%"
        parts.append(n[0] * 255 / 100 if percent else n[0])
        rest = t[n[1] + percent :].strip(_WS)
        rest = rest[1:] if rest[:1] in (b",", b"/") else rest
        if not rest:
            break
    if len(parts) < 3:
        return None
    if len(parts) == 4 and parts[3] == 0:
        return TRANSPARENT
    return "".join(f"{min(255, max(0, int(x + 0.5))):02x}" for x in parts[:3])


def font_size_pt(value: bytes, parent: float | None) -> float | None:
    v, base = value.strip(_WS).lower(), 12.0 if parent is None else parent
    word = v.decode("ascii", "replace")
    if word in SIZES:
        return SIZES[word]
    if word in ("smaller", "larger"):
        return _size(base / 1.2 if word == "smaller" else base * 1.2)
    n = number(v)
    if n is None:
        return None
    unit = v[n[1] :].strip(_WS).decode("ascii", "replace")
    factor = UNITS.get(unit) or {"em": base, "rem": base, "ex": base / 2, "ch": base / 2, "%": base / 100}.get(unit)
    return None if factor is None else _size(n[0] * factor)


def _size(x: float) -> float | None:
    x = float(np.float32(x))
    return x if np.isfinite(x) and x > 0 else None


def font_attr_size_pt(value: bytes) -> float | None:
    """The scale of one to seven, or steps from three."""
    v = value.strip(_WS)
    n = number(v)
    if n is None:
        return None
    at = 3 + n[0] if v[:1] in (b"+", b"-") else n[0]
    return FONT_SCALE[0 if at < 1 else 6 if at > 7 else int(at) - 1]


# -- styles and runs -----------------------------------------------------


@dataclass(frozen=True)
class Style:
    bold: bool = False
    italic: bool = False
    underline: bool = False
    strike: bool = False
    size_pt: float | None = None
    font_family: str | None = None
    color: str | None = None
    background: str | None = None


PLAIN = Style()


def _family(value: bytes) -> str | None:
    name = unquote(value.split(b",")[0].strip(_WS))
    return unescape(name) or None if name else None


def styled(name: str, raw: bytes, parent: Style) -> Style:
    """The style inside an element: its own default, then attributes, then ``style``."""
    new: dict[str, Any] = {}
    for names, key in ((BOLD | BOLD_BY_DEFAULT, "bold"), (ITALIC, "italic"), (UNDERLINE, "underline"), (STRIKE, "strike")):
        if name in names:
            new[key] = True
    if not raw.strip(_WS):
        return replace(parent, **new) if new else parent
    if name == "font":
        if (face := attribute(raw, "face")) is not None and (f := _family(face)):
            new["font_family"] = f
        if (c := attribute(raw, "color")) is not None and (rgb := colour(c)) not in (None, TRANSPARENT):
            new["color"] = rgb
        if (s := attribute(raw, "size")) is not None and (pt := font_attr_size_pt(s)):
            new["size_pt"] = pt
    seen = raw.lower()
    if b"bgcolor" in seen and (bg := attribute(raw, "bgcolor")) is not None and (rgb := colour(bg)) not in (None, TRANSPARENT):
        new["background"] = rgb
    for prop, value in declarations(attribute(raw, "style") or b"") if b"style" in seen else ():
        if prop == "font-weight" and (b := font_weight_bold(value)) is not None:
            new["bold"] = b
        elif prop == "font-style" and (i := font_style_italic(value)) is not None:
            new["italic"] = i
        elif prop in ("text-decoration", "text-decoration-line") and (d := text_decoration(value)):
            new["underline"], new["strike"] = d
        elif prop in ("color", "background-color", "background") and (c := colour(value)):
            new["color" if prop == "color" else "background"] = None if c == TRANSPARENT else c
        elif prop == "font-size" and (pt := font_size_pt(value, new.get("size_pt", parent.size_pt))):
            new["size_pt"] = pt
        elif prop == "font-family" and (f := _family(value)):
            new["font_family"] = f
    return replace(parent, **new) if new else parent


class Open(NamedTuple):
    name: str
    raw: bytes
    style: Style
    dropped: bool
    preserve: bool

    def child(self, name: str, raw: bytes) -> Open:
        return Open(name, raw, styled(name, raw, self.style), self.dropped or name in DROPPED, self.preserve or name in PRESERVING)


class Run(NamedTuple):
    text: str
    style: Style
    offset: int
    kind: str  # text, break, tab


def runs(data: bytes, closed: bool = False) -> Iterator[Run]:
    """Styled pieces of text. More than 64 open elements raise DepthLimit; nothing else does."""
    stack = [Open("", b"", PLAIN, False, False)]
    breaks, tab, started = 0, False, False
    boundary, fresh_line = True, True
    for t in tokens(data):
        if t.kind == "text":
            top = stack[-1]
            preserve = True if t.verbatim else top.preserve
            text = "" if top.dropped else text_of(t.raw, preserve, boundary and not t.verbatim, closed)
            if not text:
                continue
            if not started:
                breaks, tab = 0, False
            for _ in range(breaks):
                yield Run("\n", top.style, t.offset, "break")
            if breaks:
                boundary = True
            elif tab:
                yield Run("\t", top.style, t.offset, "tab")
            breaks, tab, started = 0, False, True
            yield Run(text, top.style, t.offset, "text")
            if preserve:
                boundary = False
            elif t.raw.strip(_WS):
                boundary = t.raw[-1:] in (b" ", b"\t", b"\n", b"\r", b"\x0c")
            else:
                boundary = True
            fresh_line = preserve and t.raw[-1:] in (b"\n", b"\r")
            continue
        if t.kind not in ("start", "end"):
            continue
        name = t.name.lower()
        if t.kind == "end":
            if not _close(stack, name):
                continue
            if name in BLOCK:
                breaks, tab, boundary = (breaks if fresh_line and not breaks else max(breaks, 1)), False, True
            elif name in CELL and not breaks:
                tab = True
            continue
        for names, barriers in IMPLIED.get(name, ()):
            _close_nearest(stack, names, barriers)
        if name in BLOCK:
            breaks, tab, boundary = (breaks if fresh_line and not breaks else max(breaks, 1)), False, True
        if name == "br":
            breaks, tab, boundary = min(2, breaks + 1), False, True
        if name in CELL and not breaks:
            tab = True
        if name in VOID or t.self_closing:
            continue
        if len(stack) > MAX_DEPTH:
            raise Bad("DepthLimit", t.offset)
        stack.append(stack[-1].child(name, t.raw))


def _close_nearest(stack: list[Open], names: frozenset | set, barriers: frozenset | set) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in names:
            del stack[i:]
            return
        if stack[i].name in barriers:
            return


def _close(stack: list[Open], name: str) -> bool:
    """Close the nearest element of a name; formatting elements above it are opened again under its parent."""
    at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
    if not at:
        return False
    again = [x for x in stack[at + 1 :] if x.name in FORMATTING]
    del stack[at:]
    for x in again:
        stack.append(stack[-1].child(x.name, x.raw))
    return True


def document(data: bytes, closed: bool = False) -> dict[str, Any]:
    """text and runs (byte ranges of the text, neighbours of one style merged); spaces at the end are gone.

    ``closed``: a reference without its semicolon stays as it is written.
    """
    parts: list[str] = []
    spans: list[list] = []  # start, end, style in bytes
    size = 0
    for r in runs(data, closed):
        n = len(r.text.encode())
        if spans and (spans[-1][2] is r.style or spans[-1][2] == r.style):
            spans[-1][1] = size + n
        else:
            spans.append([size, size + n, r.style])
        parts.append(r.text)
        size += n
    text = "".join(parts)
    kept = text.rstrip(" ")
    size -= len(text) - len(kept)
    merged = [{"start": a, "end": min(b, size), "style": vars(s)} for a, b, s in spans if a < size]
    return {"text": kept, "runs": merged}


def token_rows(data: bytes | str) -> Iterator[dict[str, Any]]:
    raw = data.encode() if isinstance(data, str) else bytes(data)
    for t in tokens(raw):
        attrs = [{"name": k, "value": unescape(v)} for k, v in attributes(t.raw)] if t.kind == "start" else None
        text = text_of(t.raw, True, False) if t.kind == "text" else lossy(t.raw) if t.kind in ("comment", "doctype") else None
        yield {"kind": t.kind, "offset": t.offset, "name": t.name or None, "attrs": attrs, "text": text, "self_closing": t.self_closing}


def run_rows(data: bytes | str) -> Iterator[dict[str, Any]]:
    raw = data.encode() if isinstance(data, str) else bytes(data)
    for r in runs(raw):
        yield {"kind": r.kind, "offset": r.offset, "text": r.text, "style": vars(r.style)}


STYLE = "struct<bold:boolean,italic:boolean,underline:boolean,strike:boolean,size_pt:double,font_family:string,color:string,background:string>"
DOCUMENT = f"struct<text:string,runs:array<struct<start:int,end:int,style:{STYLE}>>>"
TOKENS = "kind string, offset int, name string, attrs array<struct<name:string,value:string>>, text string, self_closing boolean"
RUNS = f"kind string, offset int, text string, style {STYLE}"
