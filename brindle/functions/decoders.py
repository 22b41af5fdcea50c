"""The byte decoders and encoders as Arrow-batched column functions. Each decoder gives struct(value, error)."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column

from . import bitmap, html, lineformats, links, records, rtf, shellitems, text
from .core import arrow_function, decoder, utf16_lossy


def scalar(f: Callable[..., Any], kind: str) -> Callable[..., Column]:
    """A function that never fails, over columns; null in, null out."""
    column = arrow_function(lambda *row: None if row[0] is None else f(*row), kind)
    column.core = f  # type: ignore[attr-defined]
    return column


RICH = f"struct<text:string,runs:array<struct<start:int,end:int,style:{html.STYLE}>>,generator:string>"

html_document = decoder(html.document, html.DOCUMENT)
html_document_closed = decoder(lambda b: html.document(b, True), html.DOCUMENT)
rtf_document = decoder(rtf.document, RICH)
rtf_header = decoder(rtf.header, rtf.HEADER)


def rtf_from_runs(words: str, runs: list[dict]) -> bytes:
    raw = words.encode()
    return rtf.write([(raw[r["start"] : r["end"]].decode("utf-8", "replace"), r["style"]) for r in runs])


rtf_write = scalar(rtf_from_runs, "binary")
rtf_from_text = scalar(lambda t: rtf.write([(t, {})]), "binary")
utf16le_lossy = scalar(utf16_lossy, "string")
utf16le_char_count = scalar(text.utf16le_char_count, "long")
is_valid_utf16le = scalar(text.is_valid_utf16le, "boolean")
decode_plain = scalar(text.decode_plain, "string")
encode_plain = scalar(text.encode_plain, "binary")
decode_html_bytes = scalar(text.decode_html_bytes, "string")
html_unescape = scalar(lambda t: html.unescape(t.encode()), "string")
codepage_decode = decoder(text.decode_page, "string")
codepage_decode_lossy = scalar(text.decode_page_lossy, "string")
codepage_encode = decoder(text.encode_page, "binary")

cf_html = decoder(records.cf_html, records.CF_HTML)
drop_list = decoder(records.drop_list, records.DROP_LIST)
write_drop_list = decoder(lambda paths: records.write_drop_list(list(paths)), "binary")
file_descriptors = decoder(records.file_descriptors, records.DESCRIPTORS)
file_descriptors_narrow = decoder(lambda b: records.file_descriptors(b, False), records.DESCRIPTORS)
write_file_descriptors = decoder(lambda xs: records.write_file_descriptors([dict(x) if isinstance(x, dict) else x.asDict() for x in xs]), "binary")
item_list = decoder(records.item_list, records.ITEM_LIST)
write_items = scalar(lambda xs: records.write_items([bytes(x) for x in xs]), "binary")
cida = decoder(records.cida, records.CIDA)
write_cida = scalar(lambda parent, children: records.write_cida(bytes(parent), [bytes(c) for c in children]), "binary")
write_network_link = scalar(lambda share: records.write_network_link(bytes(share)), "binary")
shell_link = decoder(records.shell_link, records.SHELL_LINK)
write_shell_link = scalar(lambda path, args, name: records.write_shell_link({"local_base_path": path, "arguments": args, "name": name}), "binary")
webloc = decoder(records.webloc, records.WEBLOC)
bookmark = decoder(records.bookmark, records.BOOKMARK)
write_bookmark = scalar(lambda url, parts: records.write_bookmark(url, list(parts)), "binary")
property_store = decoder(lambda b: list(shellitems.properties(b)), f"array<struct<{shellitems.PROPERTIES.replace(' ', ':').replace(',:', ',')}>>")
link_from_file = decoder(links.link_from_file, links.LINK)
sniff_shortcut = scalar(links.sniff, "string")
dib_header = decoder(bitmap.header_row, bitmap.HEADER)
dib_decode = decoder(bitmap.decode, bitmap.IMAGE)
dib_encode_v5 = scalar(lambda w, h, px: bitmap.encode_v5(int(w), int(h), bytes(px)), "binary")
dib_encode = scalar(lambda w, h, px: bitmap.encode_dib(int(w), int(h), bytes(px)), "binary")
tiff_encode = scalar(lambda w, h, px: bitmap.encode_tiff(int(w), int(h), bytes(px)), "binary")
png_encode = scalar(lambda w, h, px: bitmap.encode_png(int(w), int(h), bytes(px)), "binary")

URL_FILE = "struct<url:string,working_directory:string,icon_file:string,icon_index:int,hotkey:struct<key:int,modifiers:int>,show_command:bigint,modified:decimal(20,0),id_list:binary>"
INI = "array<struct<section:string,key:string,value:string,offset:int>>"
DESKTOP = "array<struct<group:string,key:string,locale:string,value:string,offset:int>>"
DESKTOP_ENTRY = "struct<type:string,name:string,url:string,icon:string,exec:array<string>,actions:array<string>>"

uri_list = decoder(lineformats.uri_list, "array<struct<is_comment:boolean,value:string,offset:int>>")
copied_files = decoder(lineformats.copied_files, "struct<action:string,uris:array<string>>")
percent_decode = decoder(lineformats.percent_decode_text, "string")
url_file = decoder(lineformats.url_file, URL_FILE)
url_ansi = decoder(lineformats.url_ansi, "string")
ini_entries = decoder(lambda b: lineformats.ini(*lineformats.decoded(b)), INI)
desktop_entries = decoder(lineformats.desktop, DESKTOP)
desktop_entry = decoder(lineformats.desktop_entry, DESKTOP_ENTRY)
desktop_unescape = decoder(lineformats.unescape, "string")
desktop_list = scalar(lineformats.list_items, "array<string>")
desktop_bool = decoder(lineformats.as_bool, "boolean")
desktop_number = decoder(lineformats.as_number, "double")
desktop_actions = decoder(lineformats.actions, lineformats.ACTIONS)
exec_program = decoder(lineformats.program, "string")
exec_fields = decoder(lambda v: [lineformats.as_field(a) for a in lineformats.exec_args(v)], "array<string>")
exec_args = decoder(lineformats.exec_args, "array<struct<raw:string,quoted:boolean,offset:int>>")


def exec_valid(value: str) -> bool:
    lineformats.exec_check(value)
    return True


exec_check = decoder(exec_valid, "boolean")

build_cf_html = decoder(records.build_cf_html, "binary")
write_drop_list_narrow = decoder(lambda paths, page: records.write_drop_list_narrow(list(paths), int(page)), "binary")
drop_list_paths = decoder(lambda b, page: records.drop_list_paths(b, int(page)), "array<string>")
is_internet_location = scalar(lambda b: records.is_internet_location(bytes(b)), "boolean")
bookmark_check = decoder(records.bookmark_check, "int")
bookmark_flags = decoder(records.bookmark_flags, records.BOOKMARK_FLAGS)
