"""Shell items beyond plain files and folders: delegates, devices, libraries, entries of zip files; and property stores."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import Any

from .core import Bad, Reader, guid_text, utf16_lossy

# Signatures at byte 4 of an item, and the class of a wrapped item.
MTP_VOLUME, MTP_FILE = 0x10312005, 0x07192006
USERS_KNOWN_FOLDER = 0x23FEBBEE
USERS_VIEWS = (0x10141981, 0x23A3DFD5, USERS_KNOWN_FOLDER, 0x3B93AFBB, 0x49505241, 0xBEEBEE00)
DELEGATE = bytes.fromhex("741a595e96dfd3488d671733bcee28ba")
STRING_NAMED = bytes.fromhex("05d5cdd59c2e1b10939708002b2cf9ae")
APP_USER_MODEL = bytes.fromhex("55284c9f799f394ba8d0e1d42de1d5f3")
#: UTF-16 characters at byte offsets by which an entry of a zip file is known: two layouts.
ZIP_OLD = {26: "/", 32: "/", 38: " ", 40: " ", 46: ":", 52: "\0"}
ZIP_NEW = ({34: "N", 36: "/", 38: "A", 40: "\0"}, {38: "/", 44: "/", 54: " ", 56: " ", 62: ":", 68: ":", 74: "\0"})
TYPES = {0: "Empty", 1: "Null", 3: "I4", 19: "U4", 11: "Bool", 64: "FileTime", 72: "Clsid", 31: "Lpwstr", 8: "Bstr"}


def _wide(b: bytes) -> str:
    end = next((i for i in range(0, len(b) - 1, 2) if b[i : i + 2] == b"\0\0"), len(b))
    return utf16_lossy(b[:end])


def _counted(data: bytes, at: int, *counts: int, gap: int = 0) -> list[str | None]:
    """Strings of the given lengths in characters, one after another."""
    out: list[str | None] = []
    for n in counts:
        if n == 0 and not gap or at + 2 * n > len(data):
            out.append(None)
            continue
        out.append(_wide(data[at : at + 2 * n]) or None)
        at += 2 * n + gap
    return out


def delegate(data: bytes) -> bytes | None:
    """The item inside a delegate folder's item, without its size; None if it is no delegate's."""
    whole = len(data) + 2
    if whole < 38:
        return None
    first = int.from_bytes(data[-2:], "little")
    region = first if 32 <= first < whole - 2 else whole
    end = region - 2
    if region < 38 or data[end - 32 : end - 16] != DELEGATE:
        return None
    size = int.from_bytes(data[2:4], "little")
    return data[4 : 4 + size] if size <= region - 38 else b""


def _is(data: bytes, marks: dict[int, str]) -> bool:
    return all(data[i : i + 2] == c.encode("utf-16-le") for i, c in marks.items())


def signed_item(data: bytes, known: dict[str, str]) -> dict[str, Any] | None:
    """Items that a signature tells, whatever their class byte; None for others."""
    signature = int.from_bytes(data[4:8], "little") if len(data) >= 8 else None
    if signature == MTP_VOLUME and len(data) >= 48:
        name, _, _ = _counted(data, 52, *struct.unpack_from("<III", data, 36))
        return {"kind": "MtpVolume", "name": name}
    if signature == MTP_FILE and len(data) >= 72:
        name, second, _ = _counted(data, 72, *struct.unpack_from("<III", data, 60))
        return {"kind": "MtpFileEntry", "name": name or second}
    if signature in USERS_VIEWS and len(data) >= 12:
        size = int.from_bytes(data[10:12], "little")
        g = guid_text(data[12:28]) if signature == USERS_KNOWN_FOLDER and size == 16 and len(data) >= 28 else None
        return {"kind": "UsersPropertyView", "guid": g, "name": known.get(g) if g else None}
    old = len(data) >= 54 and _is(data, ZIP_OLD)
    if old or len(data) >= 76 and any(_is(data, m) for m in ZIP_NEW):
        at = 58 if old else 82
        if len(data) >= at + 8:
            first, second = _counted(data, at + 8, *struct.unpack_from("<II", data, at), gap=2)
            return {"kind": "CompressedFolder", "name": first or second, "size": None if old else min(int.from_bytes(data[6:14], "little"), (1 << 63) - 1)}
        return {"kind": "CompressedFolder"}
    return None


def properties(data: bytes) -> Iterator[dict[str, Any]]:
    """Values of a property store: storages of one format each, ended by a zero size."""
    at = 0
    while len(data) - at >= 4:
        size = int.from_bytes(data[at : at + 4], "little")
        if size == 0:
            return
        if size < 24 or at + size > len(data):
            raise Bad("BadLength", at)
        if data[at + 4 : at + 8] != b"1SPS":
            raise Bad("BadMagic", at + 4)
        form = data[at + 8 : at + 24]
        yield from _values(data[at : at + size], at, form)
        at += size


def _values(storage: bytes, base: int, form: bytes) -> Iterator[dict[str, Any]]:
    at = 24
    while len(storage) - at >= 4:
        size = int.from_bytes(storage[at : at + 4], "little")
        if size == 0:
            return
        if size < 9 or at + size > len(storage):
            raise Bad("BadLength", base + at)
        r = Reader(storage[: at + size], at + 4)
        key = r.u32()
        r.take(1)
        name = _wide(r.take(key)) if form == STRING_NAMED else None
        kind = r.u16()
        r.take(2)
        try:
            value = _typed(kind, r)
        except Bad:
            kind, value = -1, None
        yield {"format_id": guid_text(form), "id": None if name is not None else key, "name": name, "type": TYPES.get(kind, "Unsupported"), "value": value, "offset": base + at}
        at += size


def _typed(kind: int, r: Reader) -> str | None:
    if kind in (0, 1):
        return None
    if kind == 3:
        return str(r.i32())
    if kind == 19:
        return str(r.u32())
    if kind == 11:
        return "true" if r.u16() else "false"
    if kind == 64:
        return str(r.u64())
    if kind == 72:
        return guid_text(r.guid())
    if kind == 31:
        return _wide(r.take(2 * r.u32()))
    if kind == 8:
        return r.take(r.u32()).split(b"\0")[0].decode("cp1252", "replace")
    raise Bad("Unsupported", r.at)


PROPERTIES = "format_id string, id bigint, name string, type string, value string, offset int"


def property_value(data: bytes, form: bytes, key: int) -> str | None:
    """The first value of a format and number."""
    want = guid_text(form)
    try:
        return next((p["value"] for p in properties(data) if p["format_id"] == want and p["id"] == key), None)
    except Bad:
        return None


def write_properties(form: bytes, values: dict[int, str]) -> bytes:
    """A store of one storage with strings."""
    body = b""
    for key, text in values.items():
        raw = text.encode("utf-16-le", "surrogatepass") + b"\0\0"
        value = struct.pack("<IBHHI", key, 0, 31, 0, len(raw) // 2) + raw
        body += struct.pack("<I", len(value) + 4) + value
    storage = b"1SPS" + form + body + b"\0\0\0\0"
    return struct.pack("<I", len(storage) + 4) + storage + b"\0\0\0\0"


def console(data: bytes) -> dict[str, Any]:
    """Settings of a console block."""
    r = Reader(data)
    r.take(24)
    size, _, weight = r.u32(), r.u32(), r.u32()
    face = _wide(r.take(64))
    cursor = r.u32()
    full, quick, insert, auto = (r.u32() != 0 for _ in range(4))
    return {"font_size": size, "font_weight": weight, "face_name": face, "cursor_size": cursor, "full_screen": full, "quick_edit": quick, "insert_mode": insert, "auto_position": auto}


def tracker(data: bytes) -> dict[str, Any]:
    """Machine and identifiers of a tracker block."""
    r = Reader(data)
    r.take(8)
    machine = r.take(16).split(b"\0")[0].decode("cp1252", "replace")
    return {"machine_id": machine, "droid": [guid_text(r.guid()), guid_text(r.guid())], "droid_birth": [guid_text(r.guid()), guid_text(r.guid())]}
