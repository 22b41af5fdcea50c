"""RTF: tokens, styled runs, tables, documents and a writer."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any, NamedTuple

from .core import MAX_DEPTH, Bad
from .text import decode_byte

# Destinations whose text is no body text.
DESTINATIONS = frozenset(
    (
        "fonttbl colortbl stylesheet listtable listoverridetable revtbl rsidtbl filetbl file generator latentstyles themedata colorschememapping datastore xmlnstbl defchp defpap "
        "falt fname panose fontemb fontfile info title subject author manager company operator category keywords comment doccomm hlinkbase userprops propname staticval password "
        "passwordhash template keycode pict nonshppict object objdata objclass objname objalias objsect svblipuid blipuid header headerl headerr headerf footer footerl footerr "
        "footerf footnote ftnsep ftnsepc ftncn aftnsep aftnsepc aftncn annotation atnid atnauthor atndate atnicn atnref atntime atnparent bkmkstart bkmkend xe tc tcn fldinst "
        "datafield formfield ffname pn pntext pntxta pntxtb listtext nesttableprops nonesttables shpinst shprslt do"
    ).split()
)
# Words that are characters.
SYMBOLS = {
    "emdash": "\u2014",
    "endash": "\u2013",
    "emspace": "\u2003",
    "enspace": "\u2002",
    "qmspace": "\u2005",
    "bullet": "\u2022",
    "lquote": "\u2018",
    "rquote": "\u2019",
    "ldblquote": "\u201c",
    "rdblquote": "\u201d",
    "zwbo": "\u200b",
    "zwnbo": "\u2060",
    "zwj": "\u200d",
    "zwnj": "\u200c",
    "ltrmark": "\u200e",
    "rtlmark": "\u200f",
}
SIGNS = {0x7E: "\u00a0", 0x2D: "\u00ad", 0x5F: "\u2011", 0x5C: "\\", 0x7B: "{", 0x7D: "}"}
BREAKS = {"par": "\n", "sect": "\n", "page": "\n", "row": "\n", "nestrow": "\n", "line": "\n", "softline": "\n", "cell": "\t", "nestcell": "\t", "tab": "\t"}
FAMILIES = {"fnil": "Nil", "froman": "Roman", "fswiss": "Swiss", "fmodern": "Modern", "fscript": "Script", "fdecor": "Decor", "ftech": "Tech", "fbidi": "Bidi"}
#: ASCII stand-ins that a writer puts after an escape.
STAND_INS = {
    **dict.fromkeys("\u00a0\u2007\u202f", " "),
    **dict.fromkeys("\u00ad\u2010\u2011\u2012\u2013\u2014\u2015", "-"),
    **dict.fromkeys("\u2018\u2019\u201a\u201b", "'"),
    **dict.fromkeys("\u201c\u201d\u201e\u201f", '"'),
}

_WORD = re.compile(rb"([A-Za-z]+)(-?[0-9]+)?( ?)")
_TEXT = re.compile(rb"[^\\{}\r\n\x00\x80-\xff]+")
#: Body text of one state: characters, escapes of one unit (no surrogate) with their fallback, line ends, tabs, signs.
_SPAN = re.compile(
    rb"(?:[^\\{}\r\n\x00\x80-\xff]+|\\u(?:[0-9]{1,4}|[1-4][0-9]{4}|5[0-4][0-9]{3}|-(?:1[1-9]|2[0-9]|3[01])[0-9]{3})(?![0-9]) ?+[^\\{}\r\n\x00\x80-\xff]"
    rb"|\\(?:par|tab)(?![A-Za-z]|-?[0-9]) ?+|\\[\\{}])+"
)
_SPAN_ITEM = re.compile(r"\\(?:u(-?[0-9]+) ?+.|(par|tab) ?+|([\\{}]))", re.S)
_SIGNATURE = re.compile(rb"[ \t\r\n]*(\{)?[ \t\r\n]*(\\u?rtf)?")


class Token(NamedTuple):
    kind: str  # open, close, word, symbol, hex, text, byte, binary
    offset: int
    end: int
    name: str = ""
    param: int | None = None
    data: bytes = b""


def tokens(data: bytes, whole: Callable[[], bool] | None = None) -> Iterator[Token]:
    """Tokens in order; where ``whole`` agrees, body text with its escapes comes as one of kind ``span``."""
    at, size = 0, len(data)
    while at < size:
        if whole is not None and whole() and (m := _SPAN.match(data, at)):
            yield Token("span", at, m.end(), data=m[0])
            at = m.end()
            continue
        b = data[at]
        if b in b"{}":
            yield Token("open" if b == 0x7B else "close", at, at + 1)
            at += 1
        elif b in b"\r\n\0":
            at += 1
        elif b >= 0x80:
            yield Token("byte", at, at + 1, param=b)
            at += 1
        elif b != 0x5C:
            end = _TEXT.match(data, at).end()
            yield Token("text", at, end, data=data[at:end])
            at = end
        else:
            if at + 1 >= size:
                raise Bad("UnexpectedEof", at)
            m = _WORD.match(data, at + 1)
            if m is None:
                c = data[at + 1]
                if c == 0x27:
                    pair = data[at + 2 : at + 4]
                    if len(pair) < 2:
                        raise Bad("UnexpectedEof", at)
                    if not re.fullmatch(rb"[0-9A-Fa-f]{2}", pair):
                        raise Bad("Malformed", at)
                    yield Token("hex", at, at + 4, param=int(pair, 16))
                    at += 4
                else:
                    yield Token("symbol", at, at + 2, param=c)
                    at += 2
                continue
            param = None if m[2] is None else max(-(1 << 31), min((1 << 31) - 1, int(m[2])))
            name = m[1].decode()
            yield Token("word", at, m.end(), name, param)
            at = m.end()
            if name == "bin" and param and param > 0:
                if param > size - at:
                    raise Bad("UnexpectedEof", at)
                yield Token("binary", at, at + param, data=data[at : at + param])
                at += param


@dataclass(frozen=True)
class Props:
    bold: bool = False
    italic: bool = False
    underline: bool = False
    strike: bool = False
    half_points: int = 24
    font: int | None = None
    foreground: int | None = None
    background: int | None = None


class Group(NamedTuple):
    props: Props
    skip: int  # fallback characters after an escape
    place: str  # body, known, ignored


class Run(NamedTuple):
    text: str
    props: Props
    offset: int
    kind: str  # text, par, line


def span_text(data: bytes) -> str:
    text = data.decode("ascii")
    return _SPAN_ITEM.sub(_span_item, text) if "\\" in text else text


def _span_item(m: re.Match) -> str:
    if m[1]:
        unit = int(m[1])
        return chr(unit if unit >= 0 else unit + 0x10000)
    return BREAKS.get(m[2]) or SYMBOLS[m[2]] if m[2] else m[3]


def check_signature(data: bytes) -> None:
    m = _SIGNATURE.match(data)
    if not m[1]:
        raise Bad("BadMagic", len(data) - len(data.lstrip(b" \t\r\n")))
    if not m[2]:
        raise Bad("BadMagic", m.end())


def is_rtf(data: bytes) -> bool:
    m = _SIGNATURE.match(data)
    return bool(m[1] and m[2])


def page_of(name: str, param: int | None, now: int) -> int:
    """The code page after a charset word."""
    if name == "ansicpg":
        return now if param is None else max(0, min(0xFFFF, param))
    return {"ansi": 1252, "mac": 10000, "pc": 437, "pca": 850}.get(name, now)


class Machine:
    """Groups, destinations, properties and the counting of fallback characters."""

    def __init__(self, data: bytes, checked: bool = True):
        if checked:
            check_signature(data)
        self.data = data
        self.page, self.default_font = 1252, None

    def runs(self, whole: bool = False) -> Iterator[Run]:
        """Pieces of text with their properties; ``whole``: as few as tokens allow, all of kind text where joined."""
        stack = [Group(Props(), 1, "body")]
        skip, high, ignorable, begins = 0, None, False, False
        end = 0

        def put(text: str, offset: int, kind: str = "text") -> Iterator[Run]:
            nonlocal high
            if high is not None:  # half of a pair with nothing to join
                high = None
                yield Run("\ufffd", stack[-1].props, offset, "text")
            yield Run(text, stack[-1].props, offset, kind)

        def plain() -> bool:
            top = stack[-1]
            return not skip and high is None and not ignorable and top.skip == 1 and top.place == "body"

        for t in tokens(self.data, plain if whole else None):
            end = t.end
            offset = t.offset
            if t.kind == "span":
                begins = False
                yield Run(span_text(t.data), stack[-1].props, offset, "text")
                continue
            if skip:
                if t.kind in ("open", "close"):
                    skip = 0
                elif t.kind == "binary":
                    continue
                elif t.kind == "text":
                    gone = min(skip, len(t.data))
                    skip -= gone
                    if gone == len(t.data):
                        continue
                    offset += gone
                    t = t._replace(data=t.data[gone:])
                else:
                    skip -= 1
                    continue
            if t.kind == "symbol" and t.param == 0x2A:
                ignorable = begins
                continue
            if ignorable:
                ignorable = False
                known = t.kind == "word" and t.name in DESTINATIONS
                stack[-1] = stack[-1]._replace(place="known" if known else "ignored")
            begins = False
            top = stack[-1]
            if top.place == "ignored" and t.kind not in ("open", "close"):
                continue
            body = top.place == "body"
            if t.kind == "open":
                if len(stack) > MAX_DEPTH:
                    raise Bad("DepthLimit", offset)
                stack.append(top)
                begins = True
            elif t.kind == "close":
                if len(stack) == 1:
                    raise Bad("Malformed", offset)
                stack.pop()
            elif t.kind == "word":
                if t.name == "u":
                    skip = top.skip
                    if not body:
                        high = None
                        continue
                    p = t.param or 0
                    unit = p + 0x10000 if -32768 <= p < 0 else p
                    if 0xD800 <= unit <= 0xDBFF:
                        if high is not None:
                            yield Run("\ufffd", top.props, offset, "text")
                        high = unit
                    elif 0xDC00 <= unit <= 0xDFFF:
                        text = "\ufffd" if high is None else chr(0x10000 + ((high - 0xD800) << 10) + unit - 0xDC00)
                        high = None
                        yield Run(text, top.props, offset, "text")
                    else:
                        yield from put(chr(unit) if 0 <= unit <= 0x10FFFF else "\ufffd", offset)
                    continue
                text = self._word(t, stack)
                if text is not None and body:
                    kind = "text" if text not in "\n" else "line" if t.name in ("line", "softline") else "par"
                    yield from put(text, offset, kind)
            elif t.kind == "binary" or not body:
                continue
            elif t.kind == "text":
                yield from put(t.data.decode("ascii"), offset)
            elif t.kind in ("byte", "hex"):
                yield from put(decode_byte(self.page, t.param), offset)
            elif t.param in (0x0D, 0x0A):
                yield from put("\n", offset, "par")
            elif t.param in SIGNS:
                yield from put(SIGNS[t.param], offset)
        if len(stack) > 1:
            raise Bad("UnexpectedEof", len(self.data))
        if high is not None:
            yield Run("\ufffd", stack[-1].props, end, "text")

    def _word(self, t: Token, stack: list[Group]) -> str | None:
        """Apply a control word to the group; the text it stands for, if any."""
        name, p, top = t.name, t.param, stack[-1]
        number = None if p is None else max(0, min(0xFFFF, p))
        change: dict[str, Any] = {}
        if name in DESTINATIONS:
            stack[-1] = top._replace(place="known")
        elif name in ("b", "i", "strike", "striked"):
            change[{"b": "bold", "i": "italic"}.get(name, "strike")] = p != 0
        elif name == "ulnone":
            change["underline"] = False
        elif name.startswith("ul"):
            change["underline"] = p != 0
        elif name == "plain":
            stack[-1] = top._replace(props=Props())
        elif name == "fs":
            if p is not None:
                change["half_points"] = max(1, number)
        elif name == "f":
            change["font"] = number
        elif name == "cf":
            change["foreground"] = number
        elif name in ("cb", "chcbpat", "highlight"):
            change["background"] = number
        elif name == "uc":
            stack[-1] = top._replace(skip=1 if p is None else number)
        elif name == "deff":
            self.default_font = number
        elif name in ("ansi", "mac", "pc", "pca", "ansicpg"):
            self.page = page_of(name, p, self.page)
        else:
            return BREAKS.get(name) or SYMBOLS.get(name)
        if change:
            stack[-1] = top._replace(props=replace(top.props, **change))
        return None


def header(data: bytes) -> dict[str, Any]:
    check_signature(data)
    out = {"version": 1, "unicode_variant": False, "codepage": 1252, "default_font": None}
    for k, t in enumerate(tokens(data)):
        if k and t.kind in ("open", "close", "text"):
            break
        if t.kind != "word":
            continue
        if t.name in ("rtf", "urtf"):
            out["version"], out["unicode_variant"] = 1 if t.param is None else t.param, t.name == "urtf"
        elif t.name == "deff":
            out["default_font"] = None if t.param is None else max(0, min(0xFFFF, t.param))
        else:
            out["codepage"] = page_of(t.name, t.param, out["codepage"])
    return out


def _table(data: bytes, word: str) -> Iterator[tuple[Token, int]]:
    """Tokens inside the first destination of a name, with the depth below it."""
    depth, base = 0, None
    if b"\\" + word.encode() not in data:
        return
    try:
        for t in tokens(data):
            if t.kind == "open":
                depth += 1
            elif t.kind == "close":
                depth -= 1
                if base is not None and depth < base:
                    return
            if base is None:
                if t.kind == "word" and t.name == word:
                    base = depth
                    yield t, 0
                continue
            yield t, depth - base
    except Bad:
        return


def colors(data: bytes) -> Iterator[dict[str, Any]]:
    """Entries of the colour table; one without a component is automatic."""
    now: dict[str, int] = {}
    for t, _ in _table(data, "colortbl"):
        if t.kind == "word" and t.name in ("red", "green", "blue"):
            if t.param is not None:
                now[t.name] = max(0, min(255, t.param))
        elif t.kind == "text":
            for _ in range(t.data.count(b";")):
                yield {"color": "".join(f"{now.get(k, 0):02x}" for k in ("red", "green", "blue")) if now else None}
                now = {}


def text_field(raw: bytes, page: int) -> str:
    """Text of a table's field: escapes and bytes as in the body, groups gone."""
    m = Machine(b"{" + raw.strip(b" \t\r\n\x0c") + b"}", checked=False)
    m.page = page
    try:
        return "".join(r.text for r in m.runs())
    except Bad:
        return ""


def fonts(data: bytes, page: int = 1252) -> Iterator[dict[str, Any]]:
    """Entries of the font table, each in a group of its own or flat."""
    now: dict[str, Any] = {}
    start = 0

    def entry(end: int) -> Iterator[dict[str, Any]]:
        nonlocal now
        if "id" in now:
            yield {"id": now["id"], "family": now.get("family", "Nil"), "charset": now.get("charset"), "name": text_field(data[start:end], page)}
            now = {}

    for t, depth in _table(data, "fonttbl"):
        if t.kind == "open":
            if depth == 1:
                now, start = {}, t.end
        elif t.kind == "close":
            if depth == 0:
                yield from entry(t.offset)
            else:
                start = t.end
        elif t.kind == "word":
            if t.name == "f":
                now.pop("id", None)
                if t.param is not None:
                    now["id"] = max(0, min(0xFFFF, t.param))
            elif t.name == "fcharset":
                now["charset"] = None if t.param is None else max(0, min(0xFFFF, t.param))
            elif t.name in FAMILIES:
                now["family"] = FAMILIES[t.name]
            elif t.name == "u":
                continue
            start = t.end
        elif t.kind == "symbol" and t.param == 0x2A:
            start = t.end
        elif t.kind == "text":
            at = t.offset
            for piece in t.data.split(b";")[:-1]:
                at += len(piece)
                yield from entry(at)
                at += 1
                start = at


def generator(data: bytes, page: int = 1252) -> str | None:
    start = None
    if b"\\generator" not in data:
        return None
    try:
        for t in tokens(data):
            if t.kind == "word" and t.name == "generator":
                start = t.end
            elif start is not None and t.kind == "open":
                return None
            elif start is not None and t.kind == "close":
                raw = data[start : t.offset].strip(b" \t\r\n\x0c")
                return text_field(raw.removesuffix(b";"), page)
    except Bad:
        pass
    return None


def document(data: bytes) -> dict[str, Any]:
    """text and runs in byte ranges, sizes in points, fonts and colours looked up in their tables."""
    m = Machine(data)
    parts, spans, size = [], [], 0
    for r in m.runs(whole=True):
        n = len(r.text.encode())
        if spans and (spans[-1][2] is r.props or spans[-1][2] == r.props):
            spans[-1][1] = size + n
        else:
            spans.append([size, size + n, r.props])
        parts.append(r.text)
        size += n
    page = m.page
    names = {}
    for f in fonts(data, page):
        names.setdefault(f["id"], f["name"])
    table = [c["color"] for c in colors(data)]
    pick = lambda i: table[i] if i is not None and i < len(table) else None

    def style(p: Props) -> dict[str, Any]:
        family = names.get(p.font if p.font is not None else m.default_font)
        return {"bold": p.bold, "italic": p.italic, "underline": p.underline, "strike": p.strike, "size_pt": p.half_points / 2, "font_family": family or None, "color": pick(p.foreground), "background": pick(p.background)}

    return {"text": "".join(parts), "runs": [{"start": a, "end": b, "style": style(p)} for a, b, p in spans], "generator": generator(data, page)}


_PAIRED = re.compile(r"[\\{}\n\t]|[^ -~]")


def escape(text: str, stand_in: bool = True) -> bytes:
    """Text as RTF: CR, LF and CRLF are one paragraph mark, what is not ASCII an escape by UTF-16 unit.

    Only the characters that need it are looked at one by one.
    """
    return _PAIRED.sub(_shown if stand_in else _bare, re.sub("\r\n?", "\n", text)).encode()


def _shown(m: re.Match) -> str:
    return _escaped(m[0], True)


def _bare(m: re.Match) -> str:
    return _escaped(m[0], False)


@functools.lru_cache(maxsize=1 << 14)
def _escaped(c: str, stand_in: bool) -> str:
    if c in "\\{}":
        return "\\" + c
    if c == "\n":
        return "\\par "
    if c == "\t":
        return "\\tab "
    units, s, out = c.encode("utf-16-le", "surrogatepass"), STAND_INS.get(c, "?"), []
    for i in range(0, len(units), 2):
        value = int.from_bytes(units[i : i + 2], "little", signed=True)
        out.append(f"\\u{value}" + (" " + s if s == " " and stand_in else s if stand_in else " "))
    return "".join(out)


def half_points(points: float | None) -> int:
    if points is None or not points > 0 or points == float("inf"):
        return 24
    return max(1, min(0xFFFF, int(points * 2 + 0.5)))


def write(spans: list[tuple[str, dict[str, Any]]], creator: str | None = None) -> bytes:
    """Styled pieces as RTF: fonts and colours in tables, each run with its whole state after ``\\plain``."""
    faces, shades, body = [""], [], []
    for text, s in spans:
        if not text:
            continue
        face = s.get("font_family") or ""
        if face not in faces:
            faces.append(face)
        marks = [f"\\f{faces.index(face)}\\fs{half_points(s.get('size_pt'))}"]
        marks += [w for k, w in (("bold", "\\b"), ("italic", "\\i"), ("underline", "\\ul"), ("strike", "\\strike")) if s.get(k)]
        for key, words in (("color", ("\\cf",)), ("background", ("\\cb", "\\highlight"))):
            if s.get(key):
                if s[key] not in shades:
                    shades.append(s[key])
                marks += [f"{w}{shades.index(s[key]) + 1}" for w in words]
        state = "".join(marks)
        if body and body[-1][0] == state:
            body[-1][1].append(text)
        else:
            body.append((state, [text]))
    out = [b"{\\rtf1\\ansi\\ansicpg1252\\uc1\\deff0{\\fonttbl"]
    for i, face in enumerate(faces):
        name = escape(face, stand_in=False).replace(b";", b"\\'3b")
        out.append(f"{{\\f{i}\\fnil\\fcharset0".encode() + (b"" if face.isascii() else b"\\uc0") + b" " + name + b";}")
    out.append(b"}")
    if shades:
        table = "".join(f"\\red{int(c[:2], 16)}\\green{int(c[2:4], 16)}\\blue{int(c[4:], 16)};" for c in shades)
        out.append(b"{\\colortbl;" + table.encode() + b"}")
    if creator:
        out.append(b"{\\*\\generator " + escape(creator) + b";}")
    out.append(b"\n")
    out += [b"\\plain" + state.encode() + b" " + escape("".join(texts)) for state, texts in body]
    return b"".join(out) + b"}"


def token_rows(data: bytes) -> Iterator[dict[str, Any]]:
    for t in tokens(bytes(data)):
        yield {"kind": t.kind, "offset": t.offset, "name": t.name or None, "param": t.param, "data": t.data or None}


def run_rows(data: bytes) -> Iterator[dict[str, Any]]:
    for r in Machine(bytes(data)).runs():
        yield {"kind": r.kind, "offset": r.offset, "text": r.text, "props": vars(r.props)}


TOKENS = "kind string, offset int, name string, param bigint, data binary"
RUNS = "kind string, offset int, text string, props struct<bold:boolean,italic:boolean,underline:boolean,strike:boolean,half_points:int,font:int,foreground:int,background:int>"
HEADER = "struct<version:bigint,unicode_variant:boolean,codepage:int,default_font:int>"
