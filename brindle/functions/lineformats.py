"""Shortcut files made of lines: internet shortcuts, desktop entries with command lines, and URI lists with offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from .core import Bad, utf8_strict
from .text import decode_page

BOM = b"\xef\xbb\xbf"
_LINE = re.compile("([^\r\n]*)(\r\n|\r|\n|$)")


def lines(text: str, base: int = 0) -> Iterator[tuple[str, int]]:
    """(line, byte offset); ends are CRLF, LF or a lone CR, and nothing follows the last end."""
    at = 0
    while at < len(text):
        m = _LINE.match(text, at)
        yield m[1], base
        base += len(m[0].encode())
        at = m.end()


def decoded(data: bytes) -> tuple[str, int]:
    """UTF-8 text without a byte-order mark, and the offset at which it begins."""
    base = 3 if data.startswith(BOM) else 0
    return utf8_strict(data[base:], base), base


# -- URI lists -------------------------------------------------------------


def uri_list(data: bytes) -> list[dict[str, Any]]:
    """Comments and URIs with their offsets; one NUL at the end is no part of them."""
    if data.endswith(b"\0"):
        data = data[:-1]
    text, base = decoded(data)
    out = []
    for line, at in lines(text, base):
        kept = line.strip(" \t\x0c\x0b")
        if kept:
            lead = len(line) - len(line.lstrip(" \t\x0c\x0b"))
            out.append({"is_comment": kept.startswith("#"), "value": kept, "offset": at + lead})
    return out


def check_percent(text: str, base: int = 0) -> None:
    m = re.search("%(?![0-9A-Fa-f]{2})", text)
    if m:
        raise Bad("Malformed", base + len(text[: m.start()].encode()))


def percent_decode(text: str) -> bytes:
    """Strict: an escape that the end cuts off is UnexpectedEof, one that is no hex Malformed."""
    raw, out, at = text.encode(), bytearray(), 0
    while at < len(raw):
        if raw[at] != 0x25:
            out.append(raw[at])
            at += 1
            continue
        pair = raw[at + 1 : at + 3]
        if not re.fullmatch(b"[0-9A-Fa-f]*", pair):
            raise Bad("Malformed", at)
        if len(pair) < 2:
            raise Bad("UnexpectedEof", at)
        out.append(int(pair, 16))
        at += 3
    return bytes(out)


def percent_decode_text(text: str) -> str:
    return utf8_strict(percent_decode(text))


def copied_files(data: bytes) -> dict[str, Any]:
    """Verb and URIs of a copied-files payload."""
    text, base = decoded(data)
    first = next(lines(text, base), ("", 0))[0]
    verb = {"cut": "Cut", "copy": "Copy"}.get(first.strip().lower())
    if verb is None:
        raise Bad("BadMagic", base)
    rest = data[base + len(first.encode()) :]
    return {"action": verb, "uris": [x["value"] for x in uri_list(rest) if not x["is_comment"]]}


# -- internet shortcuts ------------------------------------------------------


def _section(line: str) -> str | None:
    t = line.rstrip()
    return t[1:-1] if len(t) >= 2 and t[0] == "[" and t[-1] == "]" else None


def ini(text: str, base: int = 0) -> list[dict[str, Any]]:
    """Entries (section, key, value, offset) in order. Comments begin with a semicolon; quotes around a value go."""
    out, section = [], None
    for line, at in lines(text, base):
        name = _section(line)
        if name is not None:
            section = name
            continue
        t = line.strip()
        if line.startswith("["):
            raise Bad("Malformed", at)
        if not t or t.startswith(";"):
            continue
        if section is None:
            raise Bad("Malformed", at)
        key, eq, value = line.partition("=")
        if eq:
            value = value.strip()
            if len(value) >= 2 and value[0] == value[-1] == '"':
                value = value[1:-1]
            out.append({"section": section, "key": key.strip(), "value": value, "offset": at})
    return out


def lookup(entries: list[dict[str, Any]], section: str, key: str) -> dict[str, Any] | None:
    """The first entry of a key, whatever the case of either name."""
    return next((e for e in entries if e["section"].lower() == section.lower() and e["key"].lower() == key.lower()), None)


def uint(text: str, at: int = 0) -> int:
    hexed = text[:2] in ("0x", "0X")
    if not re.fullmatch("[0-9A-Fa-f]+" if hexed else "[0-9]+", text[2:] if hexed else text):
        raise Bad("Malformed", at)
    n = int(text[2:], 16) if hexed else int(text)
    if n > 0xFFFFFFFF:
        raise Bad("Malformed", at)
    return n


def signed(text: str, at: int = 0) -> int:
    n = -uint(text[1:], at) if text.startswith("-") else uint(text, at)
    if not -(1 << 31) <= n < 1 << 31:
        raise Bad("TooLarge", at)
    return n


def modified(text: str, at: int = 0) -> dict[str, Any]:
    """A FILETIME in sixteen little-endian hex digits, and what follows it."""
    if len(text) < 16:
        raise Bad("BadLength", at)
    if not re.fullmatch("[0-9A-Fa-f]*", text):
        raise Bad("Malformed", at)
    return {"filetime": int.from_bytes(bytes.fromhex(text[:16]), "little"), "trailing": text[16:]}


def idlist_value(text: str, at: int = 0, checked: bool = True) -> bytes:
    """Bytes in hex before one byte with their sum; no text, no bytes."""
    if len(text) % 2:
        raise Bad("BadLength", at)
    if not re.fullmatch("[0-9A-Fa-f]*", text):
        raise Bad("Malformed", at)
    raw = bytes.fromhex(text)
    if raw and checked and sum(raw[:-1]) % 256 != raw[-1]:
        raise Bad("Malformed", at)
    return raw[:-1]


def url_file(data: bytes) -> dict[str, Any]:
    """Fields of an internet shortcut; without a URL it is Malformed."""
    text, base = decoded(data)
    entries = ini(text, base)
    get = lambda k: (e := lookup(entries, "InternetShortcut", k)) and e["value"]
    url = get("URL")
    if url is None:
        raise Bad("Malformed", 0)

    def soft(f: Any, key: str) -> Any:
        v = get(key)
        try:
            return None if v is None else f(v)
        except Bad:
            return None

    hot = soft(uint, "HotKey")
    return {
        "url": url,
        "working_directory": get("WorkingDirectory"),
        "icon_file": get("IconFile"),
        "icon_index": soft(signed, "IconIndex"),
        "hotkey": None if hot is None else {"key": hot & 0xFF, "modifiers": hot >> 8 & 0xFF},
        "show_command": soft(uint, "ShowCommand"),
        "modified": (soft(modified, "Modified") or {}).get("filetime"),
        "id_list": soft(idlist_value, "IDList"),
    }


def url_ansi(data: bytes, page: int) -> str | None:
    """URL of the section for legacy code pages."""
    e = lookup(ini(decode_page(data, page)), "InternetShortcut.A", "URL")
    return e and e["value"]


# -- desktop entries ---------------------------------------------------------

ESCAPES = {"s": " ", "n": "\n", "t": "\t", "r": "\r", "\\": "\\", ";": ";"}
FIELD_CODES = {"f": "SingleFile", "F": "FileList", "u": "SingleUrl", "U": "UrlList", "i": "Icon", "c": "Name", "k": "Location", "d": "Deprecated", "D": "Deprecated", "n": "Deprecated", "N": "Deprecated", "v": "Deprecated", "m": "Deprecated"}


def desktop(data: bytes) -> list[dict[str, Any]]:
    """Entries (group, key, locale, value, offset) in order; the grammar of groups and keys is checked."""
    text, base = decoded(data)
    out, group = [], None
    for line, at in lines(text, base):
        t = line.strip()
        if t.startswith("["):
            if not re.fullmatch(r"\[[^\[\]\x00-\x1f\x7f]+\]", t):
                raise Bad("Malformed", at)
            group = t[1:-1]
            continue
        if not t or t.startswith("#"):
            continue
        m = re.fullmatch(r"([A-Za-z0-9-]+)(?:\[([^\]]+)\])?", t.partition("=")[0].rstrip()) if group is not None and "=" in t else None
        if m is None:
            raise Bad("Malformed", at)
        value = t.partition("=")[2].lstrip()
        out.append({"group": group, "key": m[1], "locale": m[2], "value": value, "offset": at + len(line[: line.find(value)].encode()) if value else at + len(line.encode())})
    return out


def unescape(value: str, at: int = 0) -> str:
    out, i = [], 0
    while i < len(value):
        if value[i] != "\\":
            out.append(value[i])
            i += 1
            continue
        here = at + len(value[:i].encode())
        if i + 1 >= len(value):
            raise Bad("UnexpectedEof", here)
        if value[i + 1] not in ESCAPES:
            raise Bad("Malformed", here)
        out.append(ESCAPES[value[i + 1]])
        i += 2
    return "".join(out)


def unescape_lossy(value: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[0]), value, flags=re.S)


def list_items(value: str) -> list[str]:
    """Still escaped items between unescaped semicolons; the last semicolon may be left out."""
    out = re.findall(r"((?:[^\\;]|\\.|\\$)*)(;|$)", value, flags=re.S)
    items = [x for x, _ in out]
    return items[:-1]  # the empty match at the end


def rungs(tag: str | None) -> list[str]:
    """Locales to try, most specific first."""
    if not tag:
        return []
    base, _, mod = tag.partition("@")
    lang, _, country = base.partition(".")[0].partition("_")
    found = [f"{lang}_{country}@{mod}" if country and mod else None, f"{lang}_{country}" if country else None, f"{lang}@{mod}" if mod else None, lang]
    return [x for x in found if x]


def localized(entries: list[dict[str, Any]], group: str, key: str, tag: str | None) -> str | None:
    here = [e for e in entries if e["group"] == group and e["key"] == key]
    for rung in rungs(tag):
        for e in here:
            if e["locale"] and re.sub(r"\.[^@]*", "", e["locale"]) == rung:
                return e["value"]
    return next((e["value"] for e in here if e["locale"] is None), None)


def _unit(s: str, i: int) -> tuple[str, bool, int]:
    """A character of a value, whether it was escaped, and how long it is."""
    if s[i] != "\\" or i + 1 >= len(s):
        return s[i], False, 1
    return {"s": " ", "n": "\n", "t": "\t", "r": "\r"}.get(s[i + 1], s[i + 1]), True, 2


def exec_args(value: str, base: int = 0) -> list[dict[str, Any]]:
    """Arguments of a command line, still escaped: (raw, quoted, offset)."""
    out, i = [], 0
    at = lambda k: base + len(value[:k].encode())
    while True:
        while i < len(value) and _unit(value, i)[0] in " \t\n\r":
            i += _unit(value, i)[2]
        if i >= len(value):
            return out
        start = i
        if value[i] == '"':
            i += 1
            held = False
            body = i
            while True:
                if i >= len(value):
                    raise Bad("Malformed", at(start))
                c, escaped, n = _unit(value, i)
                if held:
                    held = False
                elif c == "\\" and escaped:
                    held = True
                elif c == '"' and not escaped:
                    break
                i += n
            out.append({"raw": value[body:i], "quoted": True, "offset": at(start)})
            i += 1
        else:
            while i < len(value) and _unit(value, i)[0] not in " \t\n\r":
                i += _unit(value, i)[2]
            out.append({"raw": value[start:i], "quoted": False, "offset": at(start)})


def exec_pieces(arg: dict[str, Any]) -> list[dict[str, Any]]:
    """Literal characters and field codes of one argument."""
    s, out, i = arg["raw"], [], 0
    while i < len(s):
        at = arg["offset"] + len(s[:i].encode())
        if s[i] not in "%\\":
            out.append({"char": s[i], "field": None})
            i += 1
            continue
        if i + 1 >= len(s):
            raise Bad("UnexpectedEof", at)
        c = s[i + 1]
        if s[i] == "%":
            if c == "%":
                out.append({"char": "%", "field": None})
            elif c in FIELD_CODES:
                out.append({"char": None, "field": c})
            else:
                raise Bad("Malformed", at)
            i += 2
        elif c in "sntr":
            out.append({"char": ESCAPES[c], "field": None})
            i += 2
        elif c == "\\" and not arg["quoted"]:
            out.append({"char": "\\", "field": None})
            i += 2
        elif c == "\\":
            if i + 2 >= len(s):
                raise Bad("UnexpectedEof", at)
            ch, _, n = _unit(s, i + 2)
            out.append({"char": ch, "field": None})
            i += 2 + n
        elif c in '"`$' and arg["quoted"]:
            out.append({"char": c, "field": None})
            i += 2
        else:
            raise Bad("Malformed", at)
    return out


def exec_check(value: str, base: int = 0) -> None:
    """One document code at most; lists and the icon alone in their argument; no code inside quotes."""
    documents = 0
    for arg in exec_args(value, base):
        parts = exec_pieces(arg)
        fields = [p["field"] for p in parts if p["field"]]
        if fields and arg["quoted"] or any(f in "FUi" for f in fields) and len(parts) != 1:
            raise Bad("Malformed", arg["offset"])
        documents += sum(f in "fFuU" for f in fields)
    if documents > 1:
        raise Bad("Malformed", base)


def as_bool(value: str, at: int = 0) -> bool:
    """``true`` or ``false``, spelled so; escapes are undone first."""
    word = unescape_lossy(value)
    if word not in ("true", "false"):
        raise Bad("Malformed", at)
    return word == "true"


def as_number(value: str, at: int = 0) -> float:
    """A number as the format spells it: digits, a point, an exponent, or inf and nan; no blanks or underscores."""
    if not re.fullmatch(r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf|infinity|nan)", value, re.I if value[-1:].isalpha() else 0):
        raise Bad("Malformed", at)
    return float(value)


def program(value: str) -> str | None:
    """The first argument of a command, still escaped."""
    found = exec_args(value)
    return found[0]["raw"] if found else None


def as_field(arg: dict[str, Any]) -> str | None:
    """The field code that an argument is, alone."""
    try:
        parts = exec_pieces(arg)
    except Bad:
        return None
    return parts[0]["field"] if len(parts) == 1 else None


def actions(data: bytes, locale: str | None = None) -> list[dict[str, Any]]:
    """The actions that the entry lists, in order, with name, icon and command of their groups; others are ignored."""
    entries = desktop(data)
    out = []
    for raw in list_items(localized(entries, "Desktop Entry", "Actions", None) or ""):
        name = unescape_lossy(raw)
        group = f"Desktop Action {name}"
        get = lambda k, tag=None, g=group: localized(entries, g, k, tag)
        command = get("Exec")
        out.append({"id": name, "found": any(e["group"] == group for e in entries), "name": None if (n := get("Name", locale)) is None else unescape_lossy(n), "icon": get("Icon", locale), "program": None if command is None else program(command)})
    return out


ACTIONS = "array<struct<id:string,found:boolean,name:string,icon:string,program:string>>"


def desktop_entry(data: bytes, locale: str | None = None) -> dict[str, Any]:
    """The main group's common fields, with arguments of its command."""
    entries = desktop(data)
    main = "Desktop Entry"
    get = lambda k: localized(entries, main, k, None)
    soft = lambda v: None if v is None else unescape_lossy(v)
    command = get("Exec")
    return {
        "type": get("Type"),
        "name": soft(localized(entries, main, "Name", locale)),
        "url": soft(get("URL")),
        "icon": soft(localized(entries, main, "Icon", locale)),
        "exec": None if command is None else ["".join(p["char"] or "%" + p["field"] for p in exec_pieces(a)) for a in exec_args(command)],
        "actions": [unescape_lossy(x) for x in list_items(get("Actions") or "")],
    }
