"""Binary records: CF_HTML, drop lists, file descriptors, item lists, shortcuts, bookmarks, property lists."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import Any
from xml.sax.saxutils import unescape as xml_unescape

from . import shellitems
from .core import MAX_DEPTH, Bad, Reader, guid_text, utf8_strict, utf16_lossy
from .guids import CONTROL_PANEL, KNOWN_FOLDERS, network_name
from .text import decode_page_lossy

# -- CF_HTML -------------------------------------------------------------

_HEADER_LINE = re.compile(rb"([A-Za-z0-9_-]{1,64}):([^\r\n]*)(\r\n|\r|\n)")
_START = re.compile(rb"<!--[ \t\n\r\x0c]*StartFragment[ \t\n\r\x0c]*-->")
_END = re.compile(rb"<!--[ \t\n\r\x0c]*EndFragment[ \t\n\r\x0c]*-->")
_OFFSETS = ("starthtml", "endhtml", "startfragment", "endfragment", "startselection", "endselection")


def _offset(value: bytes, at: int) -> int:
    """A decimal offset; negative ones are all -1, which means there is none."""
    v = value.strip(b" \t\n\r\x0c")
    at += len(value) - len(value.lstrip(b" \t\n\r\x0c"))
    if re.fullmatch(rb"-[0-9]+", v):
        return -1
    if not re.fullmatch(rb"[0-9]+", v):
        raise Bad("Malformed", at)
    if int(v) >= 1 << 64:
        raise Bad("TooLarge", at)
    return int(v)


def cf_html(data: bytes) -> dict[str, Any]:
    """Version, context, fragment, selection and source of a CF_HTML blob; marker comments beat the offsets."""
    at = 3 if data.startswith(b"\xef\xbb\xbf") else 0
    held: dict[str, Any] = {}
    where: dict[str, int] = {}
    duplicate = False
    while (m := _HEADER_LINE.match(data, at)) is not None:
        key, value_at = m[1].decode().lower(), m.start(2)
        if key in _OFFSETS:
            value: Any = _offset(m[2], value_at)
        elif key in ("version", "sourceurl"):
            stripped = m[2].strip(b" \t\n\r\x0c")
            value = utf8_strict(stripped, value_at + len(m[2]) - len(m[2].lstrip(b" \t\n\r\x0c")))
        else:
            value = None
        if value is not None:
            duplicate |= key in held
            held.setdefault(key, value)
            where.setdefault(key, value_at)
        at = m.end()
        if held.get("starthtml", -1) >= 0 and at >= held["starthtml"]:
            break
    if "version" not in held:
        raise Bad("BadMagic", 0)
    if ("startselection" in held) != ("endselection" in held):
        raise Bad("Malformed", where.get("startselection", where.get("endselection", 0)))

    def cut(start: int, end: int) -> str:
        for x in (start, end):
            if x > len(data):
                raise Bad("BadOffset", x)
        if end < start:
            raise Bad("Malformed", end)
        start = min(max(start, at), end)
        return utf8_strict(data[start:end], start)

    get = lambda k: held.get(k)
    context = None
    if get("starthtml") is not None and get("starthtml") >= 0 and (get("endhtml") is None or get("endhtml") >= 0):
        context = cut(held["starthtml"], len(data) if get("endhtml") is None else held["endhtml"])
    marks = None
    if (a := _START.search(data, at)) and (b := _END.search(data, a.end())):
        marks = (a.end(), b.start())
    offsets = (held["startfragment"], held["endfragment"]) if min(held.get("startfragment", -1), held.get("endfragment", -1)) >= 0 else None
    if marks is None and offsets is None:
        raise Bad("Malformed", at)
    span = marks or offsets
    source = "OffsetsOnly" if marks is None else "CommentsOnly" if offsets is None else "Agreed" if marks == offsets else "CommentsOverrodeOffsets"
    selection, inside = None, None
    s, e = held.get("startselection", -1), held.get("endselection", -1)
    fragment = cut(*span)
    if s >= 0 and e >= 0:
        selection = cut(s, e)
        first = min(max(span[0], at), span[1])
        if s >= first and e <= span[1]:
            inside = {"start": s - first, "end": e - first}
    return {"version": held["version"], "context": context, "fragment": fragment, "selection": selection, "source_url": get("sourceurl"), "fragment_source": source, "selection_in_fragment": inside, "duplicate_keys": duplicate, "header_len": at}


CF_HTML = "struct<version:string,context:string,fragment:string,selection:string,source_url:string,fragment_source:string,selection_in_fragment:struct<start:int,end:int>,duplicate_keys:boolean,header_len:int>"


# -- drop lists ------------------------------------------------------------


def drop_list(data: bytes) -> dict[str, Any]:
    """Paths of a CF_HDROP payload: header, then names ended by NULs and by an empty one."""
    r = Reader(data)
    first, x, y = r.u32(), r.i32(), r.i32()
    non_client, wide = r.i32() != 0, r.i32() != 0
    if first < 20:
        raise Bad("BadOffset", 0)
    if first > len(data):
        raise Bad("BadOffset", first)
    r.at = first
    names = []
    while name := (r.wide_cstr() if wide else r.cstr()):
        names.append(name)
    return {"x": x, "y": y, "non_client": non_client, "wide": wide, "raw": names, "paths": [utf16_lossy(n) if wide else None for n in names]}


def drop_list_paths(data: bytes, page: int) -> list[str]:
    """Paths, names of the narrow form read under a code page."""
    got = drop_list(data)
    return [w if w is not None else decode_page_lossy(n, page) for w, n in zip(got["paths"], got["raw"], strict=True)]


def write_drop_list(paths: list[str], x: int = 0, y: int = 0, non_client: bool = False) -> bytes:
    at, body = 0, []
    for p in paths:
        if "\0" in p:
            raise Bad("Malformed", at)
        body.append(p.encode("utf-16-le", "surrogatepass") + b"\0\0")
        at += len(body[-1])
    return struct.pack("<IiiII", 20, x, y, non_client, 1) + b"".join(body) + b"\0\0"


def write_drop_list_narrow(paths: list[str], page: int) -> bytes:
    """The narrow form, under a code page."""
    from .text import encode_page

    return struct.pack("<IiiII", 20, 0, 0, 0, 0) + b"".join(encode_page(p, page) + b"\0" for p in paths) + b"\0"


DROP_LIST = "struct<x:int,y:int,non_client:boolean,wide:boolean,raw:array<binary>,paths:array<string>>"

# -- file descriptors --------------------------------------------------------

#: Flags that say which fields of a descriptor are stated.
FD = {"clsid": 1, "sizepoint": 2, "attributes": 4, "created": 8, "accessed": 16, "written": 32, "size": 64}


def file_descriptors(data: bytes, wide: bool = True) -> list[dict[str, Any]]:
    """Records of a file group descriptor: 592 bytes each with wide names, 332 with narrow ones."""
    r = Reader(data)
    n = r.u32()
    size = 592 if wide else 332
    r.count(n, size)
    out = []
    for _ in range(n):
        flags, clsid = r.u32(), r.guid()
        r.take(16)  # icon size and position
        attributes, created, accessed, written = r.u32(), r.u64(), r.u64(), r.u64()
        high, low = r.u32(), r.u32()
        name = r.take(size - 72)
        if wide:
            end = next((i for i in range(0, 520, 2) if name[i : i + 2] == b"\0\0"), 520)
            text = utf16_lossy(name[:end])
        else:
            text = decode_page_lossy(name.split(b"\0")[0], 1252)
        on = lambda k, v: v if flags & FD[k] else None  # noqa: E731, B023
        out.append(
            {
                "name": text,
                "flags": flags,
                "clsid": on("clsid", guid_text(clsid)),
                "attributes": on("attributes", attributes),
                "created": on("created", created),
                "accessed": on("accessed", accessed),
                "written": on("written", written),
                "size": on("size", high << 32 | low),
                "is_directory": bool(flags & FD["attributes"] and attributes & 0x10),
            }
        )
    return out


def write_file_descriptors(items: list[dict[str, Any]]) -> bytes:
    out = [struct.pack("<I", len(items))]
    for x in items:
        name = x["name"].encode("utf-16-le", "surrogatepass")
        if "\0" in x["name"] or len(name) > 518:
            raise Bad("TooLarge" if len(name) > 518 else "Malformed", sum(map(len, out)))
        flags = sum(FD[k] for k in ("attributes", "created", "accessed", "written", "size") if x.get(k) is not None)
        size = int(x.get("size") or 0)
        fixed = struct.pack("<I16s4iIQQQII", flags, b"", 0, 0, 0, 0, int(x.get("attributes") or 0), int(x.get("created") or 0), int(x.get("accessed") or 0), int(x.get("written") or 0), size >> 32, size & 0xFFFFFFFF)
        out.append(fixed + name.ljust(520, b"\0"))
    return b"".join(out)


DESCRIPTORS = "array<struct<name:string,flags:bigint,clsid:string,attributes:bigint,created:decimal(20,0),accessed:decimal(20,0),written:decimal(20,0),size:decimal(20,0),is_directory:boolean>>"

# -- item lists --------------------------------------------------------------

def items(data: bytes, base: int = 0) -> Iterator[tuple[bytes, int]]:
    """Items of a list: each begins with its own size; a size of 0 ends the list, and so does the end on a boundary."""
    at = 0
    while at < len(data):
        if len(data) - at < 2:
            raise Bad("UnexpectedEof", base + at)
        size = int.from_bytes(data[at : at + 2], "little")
        if size == 0:
            return
        if size < 2:
            raise Bad("BadLength", base + at)
        if at + size > len(data):
            raise Bad("UnexpectedEof", base + at)
        yield data[at + 2 : at + size], base + at
        at += size


def dos_time(b: bytes) -> dict[str, int] | None:
    date, time = struct.unpack("<HH", b)
    if not date and not time:
        return None
    return {"year": 1980 + (date >> 9), "month": date >> 5 & 15, "day": date & 31, "hour": time >> 11, "minute": time >> 5 & 63, "second": (time & 31) * 2}


def extension_blocks(data: bytes) -> Iterator[dict[str, Any]]:
    """Blocks with a 0xBEEFxxxx signature: size, version, signature."""
    at = data.find(b"\xef\xbe")
    while at >= 6:
        start = at - 6
        size, version, signature = struct.unpack_from("<HHI", data, start)
        if 8 <= size <= len(data) - start:
            yield {"signature": signature, "version": version, "data": data[start : start + size]}
            at = data.find(b"\xef\xbe", start + size)
        else:
            at = data.find(b"\xef\xbe", at + 2)


def _long_name(block: bytes, version: int) -> str | None:
    skip = {3: 20, 7: 38, 8: 42, 9: 46}.get(version, 46 if version > 9 else 20)
    text = block[skip:]
    end = next((i for i in range(0, len(text) - 1, 2) if text[i : i + 2] == b"\0\0"), None)
    return utf16_lossy(text[:end]) if end else None


def shell_item(data: bytes, wrapped: bool = False) -> dict[str, Any]:
    """What one item is: a delegate's inner item (one level), then signatures, then the class byte; an item that is
    not understood is Unknown, never an error.
    """
    out: dict[str, Any] = {"kind": "Unknown", "class": data[0] if data else None, "name": None, "guid": None, "size": None, "modified": None, "attributes": None, "ftp": None}
    if not data:
        return out
    if not wrapped and (inner := shellitems.delegate(data)) is not None:
        return out | {"kind": "DelegateFolder", "name": shell_item(inner, True)["name"]}
    if (told := shellitems.signed_item(data, KNOWN_FOLDERS)) is not None:
        return out | told
    kind = data[0]
    family = kind & 0x70
    try:
        if kind == 0x1F and len(data) >= 18:
            g = guid_text(data[2:18])
            return out | {"kind": "RootFolder", "guid": g, "name": KNOWN_FOLDERS.get(g)}
        if kind == 0x2E and len(data) >= 18:
            g = guid_text(data[2:18])
            return out | {"kind": "Volume", "guid": g, "name": KNOWN_FOLDERS.get(g)}
        if family == 0x20:
            return out | {"kind": "Volume", "name": data[1:].split(b"\0")[0].decode("cp1252", "replace") or None}
        if family == 0x30 and len(data) >= 12:
            size, when, attributes = struct.unpack("<I4sH", data[2:12])
            wide = bool(kind & 0x04) or data[-30:-23] == b"S.W.N.1"
            rest = data[12:]
            short = utf16_lossy(_until_nul(rest, 2)) if wide else decode_page_lossy(_until_nul(rest, 1), 1252)
            long = next((_long_name(b["data"], b["version"]) for b in extension_blocks(data) if b["signature"] == 0xBEEF0004), None)
            return out | {"kind": "Directory" if kind & 0x01 else "File", "name": long or short, "size": size, "modified": dos_time(when), "attributes": attributes}
        if family == 0x40 and len(data) >= 3:
            return out | {"kind": "NetworkLocation", "name": decode_page_lossy(_until_nul(data[3:], 1), 1252) or None}
        if kind == 0x61 and len(data) >= 4:
            stop, wide = 4 + int.from_bytes(data[2:4], "little"), bool(data[1] & 0x80)
            return out | {"kind": "Uri", "name": _words(data[stop:], wide), "ftp": _ftp(data[4:stop], wide)}
        if kind == 0x71 and len(data) >= 28:
            g = guid_text(data[12:28])
            return out | {"kind": "ControlPanelItem", "guid": g, "name": CONTROL_PANEL.get(g)}
    except (Bad, struct.error):
        pass
    return out


def _words(b: bytes, wide: bool) -> str | None:
    return (utf16_lossy(_until_nul(b, 2)) if wide else decode_page_lossy(_until_nul(b, 1), 1252)) or None


def _ftp(block: bytes, wide: bool) -> dict[str, Any] | None:
    """Time, host, user and password of a URI item's data; a count that runs past the block ends the strings."""
    if len(block) < 36:
        return None
    found, at = {"host": None, "user": None, "password": None}, 36
    for key in found:
        if at + 4 > len(block) or at + 4 + (n := int.from_bytes(block[at : at + 4], "little")) > len(block):
            break
        found[key] = _words(block[at + 4 : at + 4 + n], wide)
        at += 4 + n
    return {"timestamp": int.from_bytes(block[8:16], "little"), **found}


def _until_nul(b: bytes, unit: int) -> bytes:
    return next((b[:i] for i in range(0, len(b) - unit + 1, unit) if not any(b[i : i + unit])), b)


def display_path(data: bytes, separator: str = "\\") -> str:
    names = []
    try:
        for item, _ in items(data):
            name = shell_item(item)["name"]
            if name:
                names.append(name.rstrip("\\") if separator == "\\" else name)
    except Bad:
        pass
    return separator.join(names)


def item_rows(data: bytes) -> Iterator[dict[str, Any]]:
    for item, at in items(bytes(data)):
        yield {"offset": at, **shell_item(item)}


ITEM = "offset int, kind string, class int, name string, guid string, size bigint, modified struct<year:int,month:int,day:int,hour:int,minute:int,second:int>, attributes int, ftp struct<timestamp:decimal(20,0),host:string,user:string,password:string>"


def item_list(data: bytes) -> dict[str, Any]:
    found = list(items(data))
    return {"count": len(found), "path": display_path(data), "items": [x for x, _ in found]}


ITEM_LIST = "struct<count:int,path:string,items:array<binary>>"


def write_items(bodies: list[bytes]) -> bytes:
    out = []
    for b in bodies:
        if len(b) + 2 > 0xFFFF:
            raise Bad("TooLarge", sum(map(len, out)))
        out.append(struct.pack("<H", len(b) + 2) + b)
    return b"".join(out) + b"\0\0"


def root_folder(guid: bytes, sort_index: int = 0x50) -> bytes:
    return bytes((0x1F, sort_index)) + guid


def cida(data: bytes) -> dict[str, Any]:
    """A parent list and its children; a bad child is an error of its own."""
    r = Reader(data)
    n = r.u32()
    r.count(n + 1, 4)
    offsets = [r.u32() for _ in range(n + 1)]

    def one(at: int) -> dict[str, Any]:
        if at > len(data):
            return {"path": None, "error": {"kind": "BadOffset", "offset": at}}
        try:
            return {"path": item_list(data[at:])["path"], "error": None}
        except Bad as e:
            return {"path": None, "error": {"kind": e.kind, "offset": at + e.offset}}

    return {"parent": one(offsets[0]), "children": [one(x) for x in offsets[1:]]}


CIDA = "struct<parent:struct<path:string,error:struct<kind:string,offset:bigint>>,children:array<struct<path:string,error:struct<kind:string,offset:bigint>>>>"


def write_cida(parent: bytes, children: list[bytes]) -> bytes:
    bodies = [parent, *children]
    at = 4 + 4 * len(bodies)
    offsets = []
    for b in bodies:
        offsets.append(at)
        at += len(b)
    return struct.pack(f"<I{len(bodies)}I", len(children), *offsets) + b"".join(bodies)


# -- shell links -------------------------------------------------------------

LINK_CLSID = bytes.fromhex("0114020000000000c000000000000046")
HAS_ID_LIST, HAS_LINK_INFO, HAS_NAME, HAS_RELATIVE, HAS_WORKING, HAS_ARGUMENTS, HAS_ICON, IS_UNICODE = (1 << i for i in range(8))
_STRINGS = (("name", HAS_NAME), ("relative_path", HAS_RELATIVE), ("working_dir", HAS_WORKING), ("arguments", HAS_ARGUMENTS), ("icon_location", HAS_ICON))
# Signatures of extra blocks, drive types.
EXTRA = {
    0xA0000001: "Environment",
    0xA0000002: "Console",
    0xA0000003: "Tracker",
    0xA0000004: "ConsoleFE",
    0xA0000005: "SpecialFolder",
    0xA0000006: "Darwin",
    0xA0000007: "IconEnvironment",
    0xA0000008: "Shim",
    0xA0000009: "PropertyStore",
    0xA000000B: "KnownFolder",
    0xA000000C: "VistaAndAboveIDList",
}
DRIVES = ("Unknown", "NoRootDir", "Removable", "Fixed", "Remote", "CdRom", "RamDisk")


def _cstr_at(b: bytes, at: int, base: int, wide: bool = False) -> str:
    if at > len(b):
        raise Bad("BadOffset", base + at)
    r = Reader(b, at)
    try:
        return utf16_lossy(r.wide_cstr()) if wide else decode_page_lossy(r.cstr(), 1252)
    except Bad as e:
        raise Bad(e.kind, base + e.offset) from None


def link_info(b: bytes, base: int) -> dict[str, Any]:
    if len(b) < 28:
        raise Bad("BadLength", base)
    _, head, flags, volume, local, network, suffix = struct.unpack_from("<7I", b)
    wide = head >= 0x24 and len(b) >= 36
    wide_local, wide_suffix = struct.unpack_from("<II", b, 28) if wide else (0, 0)
    out: dict[str, Any] = {"local_base_path": None, "common_path_suffix": None, "net_name": None, "device_name": None, "provider": None, "drive_type": None, "drive_serial": None, "volume_label": None}
    if flags & 1:
        out["local_base_path"] = _cstr_at(b, wide_local, base, True) if wide_local else _cstr_at(b, local, base)
        if volume + 16 > len(b):
            raise Bad("BadOffset", base + volume)
        _, kind, serial, label = struct.unpack_from("<4I", b, volume)
        out |= {"drive_type": DRIVES[kind] if kind < len(DRIVES) else None, "drive_serial": serial}
        if label == 0x14:
            out["volume_label"] = _cstr_at(b, volume + struct.unpack_from("<I", b, volume + 16)[0], base, True)
        elif label:
            out["volume_label"] = _cstr_at(b, volume + label, base)
    if flags & 2:
        if network + 20 > len(b):
            raise Bad("BadOffset", base + network)
        size, valid, name, device, provider = struct.unpack_from("<5I", b, network)
        if size < 20 or network + size > len(b):
            raise Bad("BadLength", base + network)
        part, here = b[network : network + size], base + network
        wide_name, wide_device = struct.unpack_from("<II", part, 20) if name > 20 and size >= 28 else (0, 0)
        out["net_name"] = _cstr_at(part, wide_name, here, True) if wide_name else _cstr_at(part, name, here)
        if valid & 1:
            out["device_name"] = _cstr_at(part, wide_device, here, True) if wide_device else _cstr_at(part, device, here)
        if valid & 2:
            out["provider"] = network_name(provider)
    if suffix or wide_suffix:
        out["common_path_suffix"] = _cstr_at(b, wide_suffix, base, True) if wide_suffix else _cstr_at(b, suffix, base)
    return out


def extra_blocks(data: bytes, at: int) -> Iterator[dict[str, Any]]:
    """Blocks after the strings: a size under 4 ends them, 4 to 7 is BadLength."""
    while at < len(data):
        if len(data) - at < 4:
            raise Bad("UnexpectedEof", at)
        size = int.from_bytes(data[at : at + 4], "little")
        if size < 4:
            return
        if size < 8:
            raise Bad("BadLength", at)
        if at + size > len(data):
            raise Bad("UnexpectedEof", at)
        signature = int.from_bytes(data[at + 4 : at + 8], "little")
        yield {"signature": signature, "kind": EXTRA.get(signature, "Unknown"), "data": data[at + 8 : at + size], "offset": at}
        at += size


def shell_link(data: bytes) -> dict[str, Any]:
    """Header, target, link information, strings and extra blocks of a .lnk file, flat."""
    r = Reader(data)
    if r.u32() != 76:
        raise Bad("BadLength", 0)
    if r.guid() != LINK_CLSID:
        raise Bad("BadMagic", 4)
    flags, attributes, created, accessed, written, size = r.number("<I"), r.u32(), r.u64(), r.u64(), r.u64(), r.u32()
    icon, show, hot = r.i32(), r.u32(), r.u16()
    r.take(10)
    out: dict[str, Any] = {"flags": flags, "attributes": attributes, "created": created, "accessed": accessed, "written": written, "size": size, "icon_index": icon, "show_command": show, "hotkey": hot, "id_list_path": None}
    out |= {"local_base_path": None, "common_path_suffix": None, "net_name": None, "device_name": None, "provider": None, "drive_type": None, "drive_serial": None, "volume_label": None}
    if flags & HAS_ID_LIST:
        n = r.u16()
        out["id_list_path"] = display_path(r.take(n))
    if flags & HAS_LINK_INFO:
        start = r.at
        n = r.u32()
        if n < 28:
            raise Bad("BadLength", start)
        r.at = start
        out |= link_info(r.take(n), start)
    for key, flag in _STRINGS:
        out[key] = None
        if flags & flag:
            n = r.u16()
            out[key] = utf16_lossy(r.take(2 * n)) if flags & IS_UNICODE else decode_page_lossy(r.take(n), 1252)
    blocks, first = [], {}
    try:
        for b in extra_blocks(data, r.at):
            blocks.append({k: b[k] for k in ("signature", "kind", "offset")})
            first.setdefault(b["kind"], b["data"])
    except Bad:
        pass
    out["blocks"] = blocks
    env = first.get("Environment", b"")
    out["environment_path"] = (utf16_lossy(_until_nul(env[260:780], 2)) or decode_page_lossy(_until_nul(env[:260], 1), 1252) or None) if len(env) >= 780 else None
    out["app_user_model_id"] = shellitems.property_value(first.get("PropertyStore", b""), shellitems.APP_USER_MODEL, 5)
    page = first.get("ConsoleFE", b"")
    out["console_code_page"] = int.from_bytes(page[:4], "little") if len(page) >= 4 else None
    out["machine_id"] = decode_page_lossy(_until_nul(first["Tracker"][8:24], 1), 1252) if len(first.get("Tracker", b"")) >= 24 else None
    local, suffix = out["local_base_path"], out["common_path_suffix"]
    out["candidates"] = [x for x in (None if suffix else local, out["net_name"], out["environment_path"], out["relative_path"]) if x]
    return out


SHELL_LINK = (
    "struct<flags:bigint,attributes:bigint,created:decimal(20,0),accessed:decimal(20,0),written:decimal(20,0),size:bigint,icon_index:int,show_command:bigint,hotkey:int,"
    "id_list_path:string,local_base_path:string,common_path_suffix:string,net_name:string,device_name:string,provider:string,drive_type:string,drive_serial:bigint,volume_label:string,name:string,relative_path:string,"
    "working_dir:string,arguments:string,icon_location:string,environment_path:string,app_user_model_id:string,console_code_page:bigint,machine_id:string,blocks:array<struct<signature:bigint,kind:string,offset:int>>,candidates:array<string>>"
)


def write_network_link(share: bytes, device: bytes = b"Z:", provider: int = 0x002E0000) -> bytes:
    """A link into a share, mapped to a drive: a header and the network part of the link information alone."""
    names = share + b"\0" + device + b"\0"
    network = struct.pack("<5I", 20 + len(names), 3, 20, 20 + len(share) + 1, provider) + names
    info = struct.pack("<7I", 28 + len(network) + 1, 28, 2, 0, 0, 28, 28 + len(network)) + network + b"\0"
    return struct.pack("<I16sIIQQQIiIH10x", 76, LINK_CLSID, HAS_LINK_INFO | IS_UNICODE, 0, 0, 0, 0, 0, 0, 1, 0) + info


def write_shell_link(x: dict[str, Any]) -> bytes:
    """A .lnk file of strings and a local path; strings but the arguments have 260 characters at most."""
    flags, strings = IS_UNICODE, []
    for key, flag in _STRINGS:
        if x.get(key) is not None:
            raw = x[key].encode("utf-16-le", "surrogatepass")
            if key != "arguments" and len(raw) > 520:
                raise Bad("TooLarge", 0)
            flags |= flag
            strings.append(struct.pack("<H", len(raw) // 2) + raw)
    info = b""
    if x.get("local_base_path") is not None:
        flags |= HAS_LINK_INFO
        volume = struct.pack("<4I", 17, 3, 0, 16) + b"\0"
        narrow = x["local_base_path"].encode("cp1252", "replace") + b"\0"
        wide = x["local_base_path"].encode("utf-16-le", "surrogatepass") + b"\0\0"
        at = 36 + len(volume)
        local, suffix, wide_local = at, at + len(narrow), at + len(narrow) + 1
        wide_suffix = wide_local + len(wide)
        body = struct.pack("<8I", 36, 1, 36, local, 0, suffix, wide_local, wide_suffix) + volume + narrow + b"\0" + wide + b"\0\0"
        info = struct.pack("<I", len(body) + 4) + body
    head = struct.pack("<I16sIIQQQIiIH10x", 76, LINK_CLSID, flags, 0, 0, 0, 0, 0, int(x.get("icon_index") or 0), int(x.get("show_command") or 1), int(x.get("hotkey") or 0))
    return head + info + b"".join(strings) + b"\0\0\0\0"


# -- property lists ------------------------------------------------------------

NODE_BUDGET = 65_536


class BinaryPlist:
    """Objects of a binary property list, read when asked for, under a depth and a number of objects."""

    def __init__(self, data: bytes):
        if not data.startswith(b"bplist00"):
            raise Bad("BadMagic", 0)
        if len(data) < 40:
            raise Bad("UnexpectedEof", len(data))
        self.data = data
        tail = len(data) - 32
        self.offset_size, self.ref_size = data[tail + 6], data[tail + 7]
        self.count, self.top, self.table = struct.unpack(">QQQ", data[tail + 8 :])
        if not 1 <= self.offset_size <= 8 or not 1 <= self.ref_size <= 8:
            raise Bad("Malformed", tail + 6)
        if self.table > tail or self.count * self.offset_size > tail - self.table:
            raise Bad("Malformed", tail + 8)
        if self.top >= self.count:
            raise Bad("BadOffset", tail + 16)
        self.left = NODE_BUDGET

    def object(self, index: int, depth: int = 0) -> tuple[str, Any]:
        if depth > MAX_DEPTH:
            raise Bad("DepthLimit", index)
        self.left -= 1
        if self.left < 0:
            raise Bad("TooLarge", index)
        if index >= self.count:
            raise Bad("BadOffset", index)
        at = self.table + index * self.offset_size
        where = int.from_bytes(self.data[at : at + self.offset_size], "big")
        if where >= self.table:
            raise Bad("BadOffset", at)
        r = Reader(self.data[: self.table], where)
        mark = r.u8()
        kind, n = mark >> 4, mark & 15
        if kind == 0:
            return {0: ("null", None), 8: ("bool", False), 9: ("bool", True)}.get(n, ("fill", None))
        if kind == 1:
            return "int", int.from_bytes(r.take(1 << n), "big", signed=n >= 3)
        if kind == 2:
            return "real", struct.unpack(">f" if n == 2 else ">d", r.take(1 << n))[0] if n in (2, 3) else None
        if kind == 3:
            return "date", struct.unpack(">d", r.take(8))[0]
        if n == 15:
            size = r.u8()
            if size >> 4 != 1:
                raise Bad("Malformed", where)
            n = int.from_bytes(r.take(1 << (size & 15)), "big")
        if kind == 4:
            return "data", r.take(n)
        if kind == 5:
            return "string", r.take(n).decode("latin-1")
        if kind == 6:
            return "string", r.take(2 * n).decode("utf-16-be", "replace")
        if kind in (10, 12):
            return "array", self._refs(r, n)
        if kind == 13:
            keys, values = self._refs(r, n), self._refs(r, n)
            return "dict", list(zip(keys, values, strict=True))
        raise Bad("Unsupported", where)

    def _refs(self, r: Reader, n: int) -> list[int]:
        r.count(n, self.ref_size)
        return [int.from_bytes(r.take(self.ref_size), "big") for _ in range(n)]

    def rows(self, index: int | None = None, path: str = "", depth: int = 0) -> Iterator[dict[str, Any]]:
        """The whole graph as rows (path, depth, kind, value)."""
        kind, value = self.object(self.top if index is None else index, depth)
        plain = value.hex() if kind == "data" else None if value is None or kind in ("array", "dict") else str(value)
        yield {"path": path, "depth": depth, "kind": kind, "value": plain}
        if kind == "array":
            for i, ref in enumerate(value):
                yield from self.rows(ref, f"{path}/{i}", depth + 1)
        elif kind == "dict":
            for k, ref in value:
                yield from self.rows(ref, f"{path}/{self.object(k, depth + 1)[1]}", depth + 1)


PLIST_ROWS = "path string, depth int, kind string, value string"
_XML_TAG = re.compile(rb"<(!--.*?--|[!?][^>]*|/?[A-Za-z][^>]*)>", re.S)


def _xml_entries(data: bytes) -> Iterator[tuple[str, str]]:
    """Key and string pairs of the outer dictionary; a value of another kind drops its key."""
    depth, key, at, text_from = 0, None, 0, 0
    stack: list[str] = []
    for m in _XML_TAG.finditer(data):
        tag = m[1].decode("utf-8", "replace")
        if tag[0] in "!?":
            continue
        name = tag.strip("/").split()[0].lower()
        if tag.startswith("/"):
            if stack and stack[-1] == name:
                stack.pop()
                if depth == 1 and name in ("key", "string"):
                    text = xml_unescape(data[text_from : m.start()].decode("utf-8", "replace"), {"&quot;": '"', "&apos;": "'"})
                    text = re.sub("&#(x[0-9A-Fa-f]+|[0-9]+);", lambda x: chr(int(x[1][1:], 16) if x[1][0] == "x" else int(x[1])), text)
                    if name == "key":
                        key = text
                    elif key is not None:
                        yield key, text
                        key = None
            if name == "dict":
                depth -= 1
            continue
        if len(stack) > MAX_DEPTH:
            raise Bad("DepthLimit", m.start())
        if depth == 1 and name not in ("key", "string"):
            key = None
        if name == "dict" and not tag.endswith("/"):
            depth += 1
        if not tag.endswith("/"):
            stack.append(name)
            text_from = m.end()
    del at


def webloc(data: bytes) -> dict[str, Any]:
    """URL and name of a location file: binary or XML property list, or resource fork."""
    if data.startswith(b"bplist"):
        p = BinaryPlist(data)
        kind, pairs = p.object(p.top)
        if kind != "dict":
            raise Bad("Malformed", 0)
        found: dict[str, str] = {}
        for k, v in pairs:
            key, value = p.object(k, 1), p.object(v, 1)
            if key[0] == value[0] == "string":
                found.setdefault(key[1], value[1])
        encoding = "Binary"
    elif re.match(rb"(\xef\xbb\xbf)?[ \t\r\n]*<(\?xml|!DOCTYPE|plist|!--)", data):
        found = {}
        for k, v in _xml_entries(data):
            found.setdefault(k, v)
        encoding = "Xml"
    else:
        fork = resources(data, b"url ")
        if fork is None:
            raise Bad("BadMagic", 0)
        if not fork:
            raise Bad("Malformed", 0)
        named = resources(data, b"urln") or [b""]
        found, encoding = {"URL": fork[0].decode("utf-8", "replace"), "URLName": named[0].decode("utf-8", "replace") or None}, "ResourceFork"
    if "URL" not in found:
        raise Bad("Malformed", 0)
    return {"url": found["URL"], "url_name": found.get("URLName"), "encoding": encoding}


WEBLOC = "struct<url:string,url_name:string,encoding:string>"


def resources(data: bytes, code: bytes) -> list[bytes] | None:
    """Resources of a type in a resource fork; None if the bytes are no fork."""
    if len(data) < 16:
        return None
    body, table, body_size, table_size = struct.unpack(">4I", data[:16])
    if body < 16 or table < body or body + body_size > len(data) or table + table_size > len(data) or table_size < 28:
        return None
    m = data[table : table + table_size]
    types = int.from_bytes(m[24:26], "big")
    out = []
    n = int.from_bytes(m[types : types + 2], "big") + 1 & 0xFFFF
    for i in range(n):
        at = types + 2 + 8 * i
        if m[at : at + 4] != code:
            continue
        count, refs = struct.unpack(">HH", m[at + 4 : at + 8])
        for k in range(count + 1):
            ref = types + refs + 12 * k
            where = body + int.from_bytes(m[ref + 5 : ref + 8], "big")
            size = int.from_bytes(data[where : where + 4], "big")
            if m[ref + 4] & 1:
                raise Bad("Unsupported", table + ref)
            if where + 4 + size > len(data):
                raise Bad("UnexpectedEof", where)
            out.append(data[where + 4 : where + 4 + size])
    return out


# -- bookmarks -----------------------------------------------------------------

# Keys of a bookmark.
BOOKMARK_KEYS = {0x1003: "url", 0x1004: "path_components", 0x1005: "file_ids", 0x1010: "resource_props", 0x1020: "filename", 0x1040: "creation_date", 0x2002: "volume_path", 0x2005: "volume_url", 0x2010: "volume_name", 0x2011: "volume_uuid", 0x2012: "volume_size", 0x2013: "volume_creation_date", 0x2020: "volume_flags", 0xC001: "containing_folder", 0xC011: "user_name", 0xC012: "user_uid", 0xD001: "was_file_reference", 0xD010: "creation_options", 0xF017: "display_name", 0xF080: "sandbox_rw", 0xF081: "sandbox_ro"}


class Bookmark:
    """Tables of contents and typed records; every offset counts from the end of the header."""

    def __init__(self, data: bytes):
        if data[:4] not in (b"book", b"alis"):
            raise Bad("BadMagic", 0)
        r = Reader(data, 4)
        size = r.u32()
        r.u32()
        self.base = r.u32()
        if size > len(data):
            raise Bad("UnexpectedEof", len(data))
        if self.base < 16 or self.base > size:
            raise Bad("BadOffset", 12)
        self.data, self.left = data[:size], NODE_BUDGET

    def at(self, rel: int) -> Reader:
        if self.base + rel > len(self.data):
            raise Bad("BadOffset", self.base + rel)
        return Reader(self.data, self.base + rel)

    def entries(self) -> Iterator[tuple[int | str, int]]:
        """(key, record offset) over the chain of tables."""
        rel, seen = self.at(0).u32(), 0
        while rel:
            seen += 1
            if seen > MAX_DEPTH:
                raise Bad("DepthLimit", self.base + rel)
            r = self.at(rel)
            r.u32()
            if r.u32() != 0xFFFFFFFE:
                raise Bad("BadMagic", self.base + rel + 4)
            r.u32()
            following, n = r.u32(), r.u32()
            r.count(n, 12)
            for _ in range(n):
                key, record, _ = r.u32(), r.u32(), r.u32()
                yield (self.value(key & 0x7FFFFFFF)[1] if key >> 31 else key), record
            rel = following

    def value(self, rel: int, depth: int = 0) -> tuple[str, Any]:
        if depth > MAX_DEPTH:
            raise Bad("DepthLimit", self.base + rel)
        self.left -= 1
        if self.left < 0:
            raise Bad("TooLarge", self.base + rel)
        r = self.at(rel)
        size, kind = r.u32(), r.u32()
        start = r.at
        b = r.take(size)
        family, sub = kind & 0xFFFFFF00, kind & 0xFF
        if family == 0x0100:
            return "string", utf8_strict(b, start)
        if family == 0x0200:
            return "data", b
        if family == 0x0300:
            code = {1: "<b", 2: "<h", 3: "<i", 4: "<q", 5: "<f", 6: "<d"}.get(sub) or {1: "<b", 2: "<h", 4: "<i", 8: "<q"}.get(size)
            if code is None or struct.calcsize(code) != size:
                raise Bad("BadLength", start)
            return "number", struct.unpack(code, b)[0]
        if family == 0x0400:
            if size != 8:
                raise Bad("BadLength", start)
            return "date", struct.unpack(">d", b)[0] + 978307200
        if family == 0x0500:
            return "bool", bool(sub)
        if family == 0x0600:
            return "array", [self.value(x, depth + 1) for x in struct.unpack(f"<{size // 4}I", b[: size & ~3])]
        if family == 0x0700:
            refs = struct.unpack(f"<{size // 4}I", b[: size & ~3])
            return "dict", [(self.value(k, depth + 1), self.value(v, depth + 1)) for k, v in zip(refs[0::2], refs[1::2], strict=False)]
        if family == 0x0800:
            if size != 16:
                raise Bad("BadLength", start)
            return "uuid", b.hex()
        if family == 0x0900:
            if sub == 2:
                head, tail = self.value(struct.unpack("<II", b)[0], depth + 1), self.value(struct.unpack("<II", b)[1], depth + 1)
                return "url", f"{head[1]}{tail[1]}"
            return "url", utf8_strict(b, start)
        return "unknown", b

    def get(self, key: int | str) -> tuple[str, Any] | None:
        return next((self.value(record) for k, record in self.entries() if k == key), None)


def bookmark(data: bytes) -> dict[str, Any]:
    b = Bookmark(data)
    found: dict[str, Any] = {}
    for key, record in b.entries():
        name = BOOKMARK_KEYS.get(key) if isinstance(key, int) else None
        if name and name not in found:
            found[name] = b.value(record)
    pick = lambda name, kind: found[name][1] if name in found and found[name][0] in kind else None
    parts = pick("path_components", ("array",))
    names = None if parts is None else [v for k, v in parts if k == "string"]
    return {
        "url": pick("url", ("string", "url")),
        "path": None if names is None else "/" + "/".join(names),
        "filename": pick("filename", ("string",)),
        "display_name": pick("display_name", ("string",)),
        "volume_name": pick("volume_name", ("string",)),
        "volume_uuid": pick("volume_uuid", ("string",)),
        "creation_seconds": pick("creation_date", ("date",)),
        "has_sandbox_extension": "sandbox_rw" in found or "sandbox_ro" in found,
    }


BOOKMARK = "struct<url:string,path:string,filename:string,display_name:string,volume_name:string,volume_uuid:string,creation_seconds:double,has_sandbox_extension:boolean>"


def write_bookmark(url: str | None, components: list[str], extra: dict[int, str] | None = None) -> bytes:
    """A bookmark of strings and path components, one table of contents."""
    body, toc = bytearray(b"\0\0\0\0"), []

    def put(kind: int, raw: bytes) -> int:
        at = len(body)
        body.extend(struct.pack("<II", len(raw), kind) + raw + b"\0" * (-len(raw) % 4))
        return at

    refs = [put(0x0101, c.encode()) for c in components]
    toc.append((0x1004, put(0x0601, struct.pack(f"<{len(refs)}I", *refs))))
    if url is not None:
        toc.append((0x1003, put(0x0901, url.encode())))
    toc += [(k, put(0x0101, v.encode())) for k, v in (extra or {}).items()]
    at = len(body)
    body.extend(struct.pack("<5I", 20 + 12 * len(toc) - 8, 0xFFFFFFFE, 1, 0, len(toc)))
    for key, record in sorted(toc):
        body.extend(struct.pack("<3I", key, record, 0))
    body[:4] = struct.pack("<I", at)
    return b"book" + struct.pack("<III", 48 + len(body), 0x10040000, 48) + b"\0" * 32 + bytes(body)


# -- writers and checks beside the readers -------------------------------------


def build_cf_html(fragment: str, source_url: str | None = None, selection: tuple[int, int] | None = None, version: str = "0.9", context: tuple[str, str] | None = ("<html><body>", "</body></html>")) -> bytes:
    """A CF_HTML blob with checks: no marks inside the parts, no line ends in the URL, a selection on character bounds.

    Without a context the outer offsets are -1. ``selection`` counts bytes of the fragment.
    """
    if not version or any(c in "\r\n:" for c in version) or source_url is not None and any(c in "\r\n" for c in source_url):
        raise Bad("Malformed", 0)
    raw = fragment.encode()
    before, after = (x.encode() for x in context or ("", ""))
    for part in (raw, before, after):
        m = _START.search(part) or _END.search(part)
        if m:
            raise Bad("Malformed", m.start())
    if selection is not None:
        a, b = selection
        if a > b or b > len(raw):
            raise Bad("BadOffset", b)
        for x in (a, b):
            if x < len(raw) and raw[x] & 0xC0 == 0x80:
                raise Bad("BadOffset", x)
    names = ["StartHTML", "EndHTML", "StartFragment", "EndFragment"] + ["StartSelection", "EndSelection"] * (selection is not None)
    width = {n: 2 if context is None and n.endswith("HTML") else 10 for n in names}
    url = b"" if source_url is None else b"SourceURL:" + source_url.encode() + b"\r\n"
    start = len(f"Version:{version}\r\n".encode()) + sum(len(n) + 3 + width[n] for n in names) + len(url)
    first = start + len(before) + len(b"<!--StartFragment-->")
    last = first + len(raw)
    at = {"StartHTML": start, "EndHTML": last + len(b"<!--EndFragment-->") + len(after), "StartFragment": first, "EndFragment": last}
    if selection is not None:
        at |= {"StartSelection": first + selection[0], "EndSelection": first + selection[1]}
    head = "".join(f"{n}:{'-1' if width[n] == 2 else f'{at[n]:010d}'}\r\n" for n in names)
    return f"Version:{version}\r\n{head}".encode() + url + before + b"<!--StartFragment-->" + raw + b"<!--EndFragment-->" + after


def write_file_descriptors_narrow(items_: list[dict[str, Any]], page: int = 1252) -> bytes:
    """Records of 332 bytes, names under a code page."""
    from .text import encode_page

    out = [struct.pack("<I", len(items_))]
    for x in items_:
        name = encode_page(x["name"], page)
        if b"\0" in name or len(name) > 259:
            raise Bad("TooLarge" if len(name) > 259 else "Malformed", sum(map(len, out)))
        flags = sum(FD[k] for k in ("attributes", "size") if x.get(k) is not None)
        size = int(x.get("size") or 0)
        out.append(struct.pack("<I16s4iIQQQII", flags, b"", 0, 0, 0, 0, int(x.get("attributes") or 0), 0, 0, 0, size >> 32, size & 0xFFFFFFFF) + name.ljust(260, b"\0"))
    return b"".join(out)


def is_internet_location(finder_info: bytes) -> bool:
    """Whether the type begins with ``il`` and the creator is the system's."""
    return len(finder_info) >= 8 and finder_info[:2] == b"il" and finder_info[4:8] == b"MACS"


def bookmark_rows(data: bytes) -> Iterator[dict[str, Any]]:
    """Every entry of a bookmark: key, its name, the kind and text of its value."""
    b = Bookmark(bytes(data))
    for key, record in b.entries():
        kind, value = b.value(record)
        plain = value.hex() if isinstance(value, bytes) else "/".join(str(v) for _, v in value) if kind == "array" else str(value)
        yield {"key": None if isinstance(key, str) else key, "name": key if isinstance(key, str) else BOOKMARK_KEYS.get(key), "kind": kind, "value": plain}


def bookmark_check(data: bytes) -> int:
    """Walk the whole graph under the depth and the number of records; how many entries it has."""
    return sum(1 for _ in bookmark_rows(data))


# Resource flags from the lowest bit.
RESOURCE_FLAGS = "IsRegularFile IsDirectory IsSymbolicLink IsVolume IsPackage IsSystemImmutable IsUserImmutable IsHidden HasHiddenExtension IsApplication IsCompressed CanSetHiddenExtension IsReadable IsWriteable IsExecutable IsAliasFile IsMountTrigger".split()


def bookmark_flags(data: bytes) -> dict[str, Any] | None:
    """Resource flags that are set, and the mask of those that were asked for."""
    got = Bookmark(data).get(0x1010)
    if got is None or got[0] != "data":
        return None
    if len(got[1]) < 16:
        raise Bad("BadLength", 0)
    raw, asked = struct.unpack_from("<QQ", got[1])
    return {"raw": raw, "asked_for": asked, "set": [n for i, n in enumerate(RESOURCE_FLAGS) if raw >> i & 1]}


BOOKMARK_ROWS = "key bigint, name string, kind string, value string"
BOOKMARK_FLAGS = "struct<raw:decimal(20,0),asked_for:decimal(20,0),set:array<string>>"
