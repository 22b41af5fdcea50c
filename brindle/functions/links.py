"""Any shortcut file as a link: the format is told from the bytes, then its own reader is used."""

from __future__ import annotations

import re
from typing import Any

from . import lineformats, records
from .core import Bad

LINK = "struct<target_kind:string,target:string,title:string>"


def sniff(b: bytes) -> str | None:
    """Bookmark, Webloc, DesktopEntry or UrlFile by the first bytes; None for others."""
    if b[:4] in (b"book", b"alis"):
        return "Bookmark"
    if b.startswith(b"bplist00"):
        return "Webloc"
    head = b.removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n\x0c")
    if head.startswith(b"<"):
        return "Webloc"
    if head.startswith(b"[Desktop Entry]"):
        return "DesktopEntry"
    return "UrlFile" if head.startswith(b"[") else None


def classify(s: str) -> str:
    if not s:
        return "Unresolved"
    if re.match(r"/|\\\\|[A-Za-z]:[\\/]", s):
        return "Path"
    return "Url" if re.match("[A-Za-z][A-Za-z0-9+.-]*:", s) else "Unresolved"


def link_from_file(b: bytes) -> dict[str, Any]:
    kind, title = sniff(b), None
    if kind == "Bookmark":
        got = records.bookmark(b)
        target, title = got["url"], got["display_name"]
        if target is None:
            raise Bad("Unsupported", 0)
    elif kind == "Webloc":
        got = records.webloc(b)
        target, title = got["url"], got["url_name"]
    elif kind == "DesktopEntry":
        entries = lineformats.desktop(b)
        get = lambda k: lineformats.localized(entries, "Desktop Entry", k, None)
        if get("Type") != "Link":
            raise Bad("Unsupported", 0)
        raw = get("URL")
        if raw is None:
            raise Bad("Malformed", 0)
        target, name = lineformats.unescape(raw), get("Name")
        title = None if name is None else lineformats.unescape_lossy(name)
    elif kind == "UrlFile":
        target = lineformats.url_file(b)["url"]
    else:
        raise Bad("BadMagic", 0)
    return {"target_kind": classify(target), "target": target, "title": title}
