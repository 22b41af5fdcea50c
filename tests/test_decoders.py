"""The byte decoders on small inputs made for one claim each."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.functions import bitmap, html, lineformats, links, records, rtf, shellitems, text
from brindle.functions.core import Bad, utf16_lossy


def fails(kind, offset, f, *args):
    with pytest.raises(Bad) as e:
        f(*args)
    assert (e.value.kind, e.value.offset) == (kind, offset)


def html_text(markup: bytes) -> str:
    return html.document(markup)["text"]


def bold(markup: bytes) -> list[tuple[str, bool]]:
    d = html.document(markup)
    raw = d["text"].encode()
    return [(raw[r["start"] : r["end"]].decode(), r["style"]["bold"]) for r in d["runs"]]


def test_a_new_paragraph_ends_bold_without_reopening_it():
    assert bold(b"<p><b>one<br><p>two</p>") == [("one", True), ("\ntwo", False)]


def test_an_explicit_end_tag_reopens_formatting():
    assert bold(b"<i><b>both</i>still</b>off") == [("both", True), ("still", True), ("off", False)]


def test_breaks():
    assert html_text(b"<p>a<p>b") == "a\nb"
    assert html_text(b"a<br><br><br><br>b") == "a\n\nb"
    assert html_text(b"<br><br>a<br>") == "a"
    assert html_text(b"<td>a<td>b") == "a\tb"
    assert html_text(b"a   \n b <b> c</b>  ") == "a b c"


def test_references():
    assert html.unescape(b"&amp;&ltx &#65 &#x41; &nosuch; &#0; &#999999999;") == "&<x A A &nosuch; \ufffd \ufffd"
    assert html.unescape(b"&notit;") == "&notit;"
    assert html.unescape(b"&#150;") == "\u2013"


def test_references_without_semicolon():
    assert html.document(b"<h1>a&amp;b&amp</h1>&#65 &lt;")["text"] == "a&b&\nA <"
    assert html.document(b"<h1>a&amp;b&amp</h1>&#65 &lt;", closed=True)["text"] == "a&b&amp\n&#65 <"


def test_deep_markup_is_an_error():
    fails("DepthLimit", 5 * 64, html_text, b"<div>" * 65)
    assert html_text(b"<div>" * 64 + b"x") == "x"


def test_tokens_of_odd_markup():
    kinds = [(t.kind, t.raw or t.name) for t in html.tokens(b"a<3<!--c--><x y='>'>t</x z><![CDATA[d]]><?p?>")]
    assert kinds == [("text", b"a"), ("text", b"<3"), ("comment", b"c"), ("start", b" y='>'"), ("text", b"t"), ("end", "x"), ("text", b"d"), ("doctype", b"<?p?")]
    assert [t.kind for t in html.tokens(b"<script>a</b></script>b")] == ["start", "text", "end", "text"]


def test_css():
    assert html.colour(b"rgb(255, 0, 50%)") == "ff0080"
    assert html.colour(b"#abc0") == html.TRANSPARENT
    assert html.colour(b"#abcd") == "aabbcc"
    assert html.colour(b"Teal") == "008080"
    assert html.colour(b"#ab") is None
    assert html.font_size_pt(b"150%", 10.0) == 15.0
    assert html.font_size_pt(b"16px", None) == 12.0
    assert html.font_size_pt(b"0pt", None) is None
    assert html.font_attr_size_pt(b"+2") == 18.0
    assert html.font_weight_bold(b"600") is True
    assert html.text_decoration(b"none") == (False, False)
    assert list(html.declarations(b"a:b;c: url(x;y) ; :z; d")) == [("a", b"b"), ("c", b"url(x;y)")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"<b>", b"</b>", b"<p>", b"</p>", b"<br>", b"<i>", b"</i>", b"x ", b"&amp;", b"<pre>", b"\n", b"</pre>", b"<td>", b"\xff", b"<", b"<li>", b"<style>"]), max_size=40))
def test_runs_cover_the_text(parts):
    d = html.document(b"".join(parts))
    at = 0
    for r in d["runs"]:
        assert r["start"] == at < r["end"]
        at = r["end"]
    assert at == len(d["text"].encode())
    assert all(a["style"] != b["style"] for a, b in zip(d["runs"], d["runs"][1:], strict=False))
    assert not d["text"].endswith(" ")


def test_rtf_documents():
    d = rtf.document(rb"{\rtf1\ansi\ansicpg1251{\fonttbl{\f0 Arial;}}{\colortbl;\red255\green0\blue0;}\f0\cf1\b \'cf x\b0 y\par}")
    assert d["text"] == "\u041f xy\n"
    assert d["runs"][0]["style"]["font_family"] == "Arial"
    assert d["runs"][0]["style"]["color"] == "ff0000"
    assert [r["style"]["bold"] for r in d["runs"]] == [True, False]


def test_rtf_fallback_characters():
    assert rtf.document(rb"{\rtf1\uc2 a\u8364 ??b}")["text"] == "a\u20acb"
    assert rtf.document(rb"{\rtf1 \u-10179?\u-8702?}")["text"] == "\U0001f602"
    assert rtf.document(rb"{\rtf1 a\u-10179?b}")["text"] == "a\ufffdb"
    assert rtf.document(rb"{\rtf1{\*\nosuch gone{\b x}}kept}")["text"] == "kept"
    assert rtf.document(rb"{\rtf1 a\bin3 }}}b}")["text"] == "ab"


def test_rtf_errors():
    fails("BadMagic", 0, rtf.document, b"plain")
    fails("UnexpectedEof", 9, rtf.document, rb"{\rtf1 ab"[:9])
    fails("Malformed", 7, rtf.document, rb"{\rtf1}}")
    fails("Malformed", 7, rtf.document, rb"{\rtf1 \'zz}")
    fails("DepthLimit", 6 + 63, rtf.document, rb"{\rtf1" + b"{" * 70)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\r\0"), max_size=60))
def test_rtf_round_trip(s):
    assert rtf.document(rtf.write([(s, {})]))["text"] == s


def test_text():
    assert utf16_lossy("ab".encode("utf-16-le") + b"\x00\xdc" + "c".encode("utf-16-le")) == "ab\ufffd"
    assert text.decode_plain(b"a\0b\0\0\0", "Windows") == "ab"
    assert text.decode_plain(b"a\xc3(\0", "Unix") == "a\ufffd("
    assert text.decode_html_bytes(b"\xff\xfe<\0b\0") == "<b"
    assert text.decode_html_bytes("<html>".encode("utf-16-le")) == "<html>"
    assert text.decode_page(b"\x80", 1252) == "\u20ac"
    fails("Malformed", 1, text.decode_page, b"a\x81", 1252)
    fails("Malformed", 2, text.encode_page, "\u00e9\u0416", 1252)
    assert text.decode_byte_lenient(1252, 0x81) == "\x81"
    assert not text.has_gaps(437) and text.has_gaps(1253)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=40), st.sampled_from([437, 850, 10000, 28591, 819]))
def test_code_pages_without_gaps_round_trip(b, page):
    assert text.encode_page(text.decode_page(b, page), page) == b


def test_cf_html_marks_beat_offsets():
    body = b"<!--StartFragment-->x<!--EndFragment-->"
    blob = b"Version:0.9\r\nStartHTML:-1\r\nEndHTML:-1\r\nStartFragment:0000000000\r\nEndFragment:0000000005\r\n" + body
    got = records.cf_html(blob)
    assert (got["fragment"], got["context"], got["fragment_source"]) == ("x", None, "CommentsOverrodeOffsets")
    fails("BadMagic", 0, records.cf_html, b"<b>x</b>")


def test_drop_lists():
    assert records.drop_list(records.write_drop_list(["C:\\a", "D:\\\u00e9"]))["paths"] == ["C:\\a", "D:\\\u00e9"]
    with pytest.raises(Bad) as e:
        records.drop_list(records.write_drop_list(["C:\\a"])[:-2])
    assert e.value.kind == "UnexpectedEof"
    fails("Malformed", 0, records.write_drop_list, ["a\0b"])


def test_item_lists():
    raw = records.write_items([b"ab", b"c"])
    assert [x for x, _ in records.items(raw)] == [b"ab", b"c"]
    assert [x for x, _ in records.items(raw[:-2])] == [b"ab", b"c"]
    fails("BadLength", 4, lambda b: list(records.items(b)), raw[:4] + b"\x01\x00")
    fails("UnexpectedEof", 4, lambda b: list(records.items(b)), raw[:4] + b"\x01")
    got = records.cida(records.write_cida(raw, [raw]))
    assert len(got["children"]) == 1
    bad = bytearray(records.write_cida(raw, [raw, raw]))
    bad[8:12] = b"\xff\xff\0\0"
    assert [c["error"] is None for c in records.cida(bytes(bad))["children"]] == [False, True]


def test_shell_links_and_bookmarks():
    got = records.shell_link(records.write_shell_link({"local_base_path": "C:\\x", "arguments": "-a"}))
    assert (got["local_base_path"], got["arguments"], got["candidates"]) == ("C:\\x", "-a", ["C:\\x"])
    fails("BadMagic", 4, records.shell_link, b"\x4c\0\0\0" + b"\0" * 80)
    fails("TooLarge", 0, records.write_shell_link, {"name": "x" * 261})
    got = records.bookmark(records.write_bookmark("file:///a", ["a", "b"]))
    assert (got["url"], got["path"]) == ("file:///a", "/a/b")
    fails("BadMagic", 0, records.bookmark, b"nope")


def test_location_files():
    import plistlib

    got = records.webloc(plistlib.dumps({"URL": "https://e.org/\u00e9", "URLName": "n"}, fmt=plistlib.FMT_BINARY))
    assert (got["url"], got["url_name"], got["encoding"]) == ("https://e.org/\u00e9", "n", "Binary")
    assert records.webloc(plistlib.dumps({"URL": "https://e.org/?a&b"}))["url"] == "https://e.org/?a&b"
    fails("BadMagic", 0, records.webloc, b"nothing")


def test_line_formats():
    assert [x["value"] for x in lineformats.uri_list(b"#c\r\nfile:///a\n\n file:///b\r")] == ["#c", "file:///a", "file:///b"]
    assert lineformats.percent_decode_text("a%20%C3%A9") == "a \u00e9"
    fails("UnexpectedEof", 1, lineformats.percent_decode, "a%2")
    fails("Malformed", 1, lineformats.percent_decode, "a%zz")
    assert lineformats.copied_files(b"CUT\nfile:///a")["action"] == "Cut"
    fails("BadMagic", 0, lineformats.copied_files, b"move\nfile:///a")
    assert lineformats.list_items(r"a\;b;c;") == [r"a\;b", "c"]
    assert lineformats.list_items("a;b;;") == ["a", "b", ""]
    fails("UnexpectedEof", 1, lineformats.unescape, "a\\")
    e = lineformats.desktop(b"[Desktop Entry]\nName=a\nName[de]=b\nName[de_AT]=c\n")
    assert [lineformats.localized(e, "Desktop Entry", "Name", t) for t in (None, "de_AT.UTF-8", "de_CH", "fr")] == ["a", "c", "b", "a"]
    lineformats.exec_check('run "a b" %f')
    with pytest.raises(Bad):
        lineformats.exec_check("run %f %u")
    with pytest.raises(Bad):
        lineformats.exec_check('run "%f"')
    u = lineformats.url_file(b"; c\r\n[InternetShortcut]\r\nurl=\"https://e.org/\"\r\nHotKey=0x0341\r\nURL=second\r\n")
    assert (u["url"], u["hotkey"]) == ("https://e.org/", {"key": 65, "modifiers": 3})


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 6), st.integers(1, 5), st.data())
def test_bitmaps_round_trip(w, h, data):
    px = data.draw(st.binary(min_size=w * h * 4, max_size=w * h * 4))
    got = bitmap.decode(bitmap.encode_v5(w, h, px), "Straight")
    assert (got["width"], got["height"], got["pixels"]) == (w, h, px)


def test_bitmap_kinds():
    import struct

    head = lambda bits, comp, used=0: struct.pack("<IiiHHIIiiII", 40, 2, 1, 1, bits, comp, 0, 0, 0, used, 0)
    palette = b"\x01\x02\x03\0\x04\x05\x06\0"
    assert bitmap.decode(head(1, 0) + palette + b"\x40\0\0\0")["pixels"] == b"\x03\x02\x01\xff\x06\x05\x04\xff"
    assert bitmap.decode(head(16, 0) + b"\x1f\0\x00\x7c")["pixels"] == b"\0\0\xff\xff\xff\0\0\xff"
    assert bitmap.decode(head(32, 0) + b"\1\2\3\0\1\2\3\0")["pixels"] == b"\3\2\1\xff" * 2
    assert bitmap.decode(head(8, 1, 2) + palette + b"\x01\x01\x00\x01")["pixels"] == b"\x06\x05\x04\xff\0\0\0\0"
    fails("UnexpectedEof", 44, bitmap.decode, head(32, 0) + b"\0" * 4)
    fails("Unsupported", 0, bitmap.decode, b"\x0c\0\0\0" + b"\0" * 50)


def test_property_stores():
    raw = shellitems.write_properties(shellitems.APP_USER_MODEL, {5: "Vendor.App", 7: "x"})
    assert [(p["id"], p["type"], p["value"]) for p in shellitems.properties(raw)] == [(5, "Lpwstr", "Vendor.App"), (7, "Lpwstr", "x")]
    assert shellitems.property_value(raw, shellitems.APP_USER_MODEL, 5) == "Vendor.App"
    fails("BadMagic", 4, lambda b: list(shellitems.properties(b)), raw[:4] + b"2SPS" + raw[8:])
    link = records.write_shell_link({"name": "n"})[:-4]
    block = (len(raw) + 8).to_bytes(4, "little") + (0xA0000009).to_bytes(4, "little") + raw
    assert records.shell_link(link + block + b"\0\0\0\0")["app_user_model_id"] == "Vendor.App"


def test_shell_items():
    g = bytes.fromhex("e04fd020ea3a6910a2d808002b30309d")
    assert records.shell_item(records.root_folder(g))["name"] == "My Computer"
    assert records.shell_item(b"/C:\\\0")["name"] == "C:\\"
    entry = b"\x32\0" + (5).to_bytes(4, "little") + b"\x21\x5a\0\0" + b"\x20\0" + b"a.txt\0"
    got = records.shell_item(entry)
    assert (got["kind"], got["name"], got["size"], got["modified"]["year"]) == ("File", "a.txt", 5, 2025)
    wrapped = b"\x74\0" + len(entry).to_bytes(2, "little") + entry + shellitems.DELEGATE + g
    assert records.shell_item(wrapped)["kind"] == "DelegateFolder" and records.shell_item(wrapped)["name"] == "a.txt"
    assert records.shell_item(b"\x41\0\0\\\\srv\\s\0")["name"] == "\\\\srv\\s"
    assert records.shell_item(b"\xff")["kind"] == "Unknown"


def test_links_of_any_format():
    assert links.link_from_file(b"[InternetShortcut]\nURL=https://e.org/\n")["target_kind"] == "Url"
    got = links.link_from_file(b"[Desktop Entry]\nType=Link\nName=N\nURL=/a\\sb\n")
    assert (got["target_kind"], got["target"], got["title"]) == ("Path", "/a b", "N")
    assert links.link_from_file(records.write_bookmark("file:///a", ["a"]))["target"] == "file:///a"
    fails("Unsupported", 0, links.link_from_file, b"[Desktop Entry]\nType=Application\n")
    fails("BadMagic", 0, links.link_from_file, b"none")


def test_cf_html_builder():
    blob = records.build_cf_html("a\u00e9b", "https://e.org/", (1, 3))
    got = records.cf_html(blob)
    assert (got["fragment"], got["selection"], got["source_url"], got["fragment_source"]) == ("a\u00e9b", "\u00e9", "https://e.org/", "Agreed")
    assert got["selection_in_fragment"] == {"start": 1, "end": 3}
    assert records.cf_html(records.build_cf_html("x", context=None))["context"] is None
    fails("BadOffset", 2, records.build_cf_html, "a\u00e9b", None, (2, 3))
    fails("Malformed", 1, records.build_cf_html, "x<!-- EndFragment -->")
    fails("Malformed", 0, records.build_cf_html, "x", "a\nb")


def test_narrow_forms():
    raw = records.write_drop_list_narrow(["C:\\\u00e9"], 1252)
    assert records.drop_list(raw)["wide"] is False and records.drop_list_paths(raw, 1252) == ["C:\\\u00e9"]
    got = records.file_descriptors(records.write_file_descriptors_narrow([{"name": "\u00e9.txt", "size": 7}]), False)
    assert (got[0]["name"], got[0]["size"]) == ("\u00e9.txt", 7)


def test_bookmark_entries():
    raw = records.write_bookmark("file:///a", ["a"], {0xF017: "A"})
    rows = {r["name"]: (r["kind"], r["value"]) for r in records.bookmark_rows(raw)}
    assert rows == {"path_components": ("array", "a"), "url": ("url", "file:///a"), "display_name": ("string", "A")}
    assert records.bookmark_check(raw) == 3 and records.bookmark_flags(raw) is None
    looped = bytearray(raw)
    at = 48 + 4  # the first record becomes an array that holds itself
    looped[at : at + 12] = (4).to_bytes(4, "little") + (0x601).to_bytes(4, "little") + (4).to_bytes(4, "little")
    with pytest.raises(Bad) as e:
        records.bookmark_check(bytes(looped))
    assert e.value.kind == "DepthLimit"
    assert records.is_internet_location(b"ilhtMACS") and not records.is_internet_location(b"ilht")


def test_names_of_folders_panels_and_networks():
    from brindle.functions import guids

    assert guids.KNOWN_FOLDERS["{21EC2020-3AEA-1069-A2DD-08002B30309D}"] == "All Control Panel Items"
    assert guids.KNOWN_FOLDERS["{871C5380-42A0-1069-A2EA-08002B30309D}"] == "Internet Folder"
    assert guids.network_name(0x001A0000) == "AVID" and guids.network_name(0x00430000) == "GOOGLE"
    assert guids.network_name(0x00280000) is None and guids.network_name(0) is None and guids.network_name(0x00440000) is None


def test_ftp_block_of_a_uri_item():
    block = bytes(8) + (77).to_bytes(8, "little") + bytes(20) + b"\x04\0\0\0host\x02\0\0\0me\xff\0\0\0"
    item = b"\x61\0" + len(block).to_bytes(2, "little") + block + b"ftp://host/\0"
    got = records.shell_item(item)
    assert got["name"] == "ftp://host/" and got["ftp"] == {"timestamp": 77, "host": "host", "user": "me", "password": None}
    assert records.shell_item(b"\x61\0\0\0http://x\0")["ftp"] is None


def test_network_part_of_a_link():
    link = records.shell_link(records.write_network_link(b"\\\\srv\\share", b"D:", 0x00200000))
    assert (link["net_name"], link["device_name"], link["provider"]) == ("\\\\srv\\share", "D:", "DECORB")


def test_typed_values_of_desktop_entries():
    from brindle.functions import lineformats as lf

    assert lf.as_bool("true") is True and lf.as_number("-1.5e3") == -1500 and lf.as_number(".5") == 0.5
    for bad in ("1", "True", "yes", ""):
        with pytest.raises(Bad):
            lf.as_bool(bad)
    for bad in ("", "1_0", " 1", "0x1", "1,5"):
        with pytest.raises(Bad):
            lf.as_number(bad)
    args = lf.exec_args('run %f --x=%u "%%"')
    assert lf.program('"a b" c') == "a b" and lf.program(" ") is None and [lf.as_field(a) for a in args] == [None, "f", None, None]


def test_tiff_header():
    raw = bitmap.encode_tiff(2, 1, bytes(range(8)))
    assert raw[:8] == b"II*\0\x08\0\0\0" and raw[-8:] == bytes(range(8))
    tags = {int.from_bytes(raw[k : k + 2], "little"): int.from_bytes(raw[k + 8 : k + 12], "little") for k in range(10, 10 + 12 * 11, 12)}
    assert (tags[256], tags[257], tags[262], tags[277], tags[338]) == (2, 1, 2, 4, 2) and tags[273] == len(raw) - 8
    assert [int.from_bytes(raw[tags[258] + 2 * k : tags[258] + 2 * k + 2], "little") for k in range(4)] == [8] * 4


_RTF_PARTS = [b"{", b"}", b"\\u243?", b"\\u8201  ", b"\\u-10179?", b"\\u-8702?", b"\\u12345", b"\\u5 ", b"\\par", b"\\tab ", b"\\par-5 x", b"\\parx", b"\\b ", b"\\b0", b"\\uc2 ", b"\\uc0", b"\\\\", b"\\{", b"\\*", b"\\'e9", b"\n", b"abc", b" ", b"9", b"-", b"\xe9", b"\\fonttbl", b"\\bin3 abc", b"\\u", b"\\u-3", b"\\u54999?", b"\\u55296?", b"?"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(_RTF_PARTS), max_size=14))
def test_whole_spans_give_the_runs_of_single_tokens(parts):
    data = b"{\\rtf1 " + b"".join(parts) + b"}"

    def characters(whole):
        try:
            return [(c, r.props) for r in rtf.Machine(data).runs(whole) for c in r.text]
        except Bad as e:
            return e.kind, e.offset

    assert characters(True) == characters(False)


def test_long_rtf_takes_few_tokens():
    data = rtf.write([("häuser\n{x}\t\u4e2d " * 500, {})])
    assert sum(1 for _ in rtf.Machine(data).runs(whole=True)) == 1
    assert rtf.document(data)["text"] == "häuser\n{x}\t\u4e2d " * 500
