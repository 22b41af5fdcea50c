"""Shortcut targets, URIs and line-oriented payloads as native Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
PATH = r"^(/|\\\\|[A-Za-z]:[\\/])"
LINE_END = r"\r\n|\r|\n"
GNOME_MAGIC = "x-special/nautilus-clipboard"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def scheme(s: Column | str) -> Column:
    """The letters before the first colon if they form a URI scheme, else null."""
    got = F.regexp_extract(col(s), SCHEME, 1)
    return F.when(got != "", got)


def looks_like_path(s: Column | str) -> Column:
    """Rooted, UNC or drive path. False for an empty string."""
    return col(s).rlike(PATH)


def classify(s: Column | str) -> Column:
    """Path, Url or Unresolved; path shapes are tried before schemes, so ``C:\\x`` is a path."""
    c = col(s)
    return F.when(c == "", "Unresolved").when(looks_like_path(c), "Path").when(c.rlike(SCHEME), "Url").when(c.isNotNull(), "Unresolved")


def is_file(uri: Column | str) -> Column:
    return F.coalesce(F.lower(scheme(uri)) == "file", F.lit(False))


def file_host(uri: Column | str) -> Column:
    """Host of a file URI (empty if none), null for other URIs."""
    rest = F.regexp_replace(col(uri), "^[A-Za-z]+:", "")
    return F.when(is_file(uri), F.when(rest.startswith("//"), F.regexp_extract(rest, "^//([^/]*)", 1)).otherwise(""))


def file_path(uri: Column | str) -> Column:
    """Still-encoded path of a file URI."""
    rest = F.regexp_replace(col(uri), "^[A-Za-z]+:", "")
    return F.when(is_file(uri), F.when(rest.startswith("//"), F.regexp_replace(rest, "^//[^/]*", "")).otherwise(rest))


def is_local_file(uri: Column | str) -> Column:
    host = F.lower(file_host(uri))
    return F.coalesce((host == "") | (host == "localhost"), F.lit(False))


def percent_valid(uri: Column | str) -> Column:
    """Every % has two hex digits after it."""
    return ~col(uri).rlike(r"%(?![0-9A-Fa-f]{2})")


def bad_percent_offset(uri: Column | str) -> Column:
    """Byte offset of the first % without two hex digits, null if there is none."""
    head = F.regexp_extract(col(uri), r"^(?s)((?:[^%]|%[0-9A-Fa-f]{2})*)%", 1)
    return F.when(~percent_valid(uri), F.octet_length(head))


def percent_encode_unreserved(s: Column | str) -> Column:
    """RFC 3986: all bytes but ALPHA, DIGIT and ``-._~``, in upper-case hex. (``url_encode`` is form encoding.)"""
    c = F.url_encode(col(s))
    return F.replace(F.replace(F.replace(c, F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def percent_encode_segment(s: Column | str) -> Column:
    """As unreserved, but sub-delimiters, ``:`` and ``@`` stay."""
    c = percent_encode_unreserved(s)
    for ch in "!$&'()*+,;=:@":
        c = F.replace(c, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return c


def percent_encode_path(s: Column | str) -> Column:
    return F.replace(percent_encode_segment(s), F.lit("%2F"), F.lit("/"))


# Characters that each set leaves as they are, besides letters and digits.
KEPT = {"unreserved": "-._~", "segment": "-._~!$&'()*+,;=:@", "path": "-._~!$&'()*+,;=:@/"}


def encoded_len(s: Column | str, chars: str = "path") -> Column:
    """Bytes that percent-encoding with a set of ``KEPT`` makes, without encoding: one for each kept byte, else three."""
    kept = F.regexp_count(col(s), F.lit("[A-Za-z0-9" + re.sub(r"([^\w])", r"\\\1", KEPT[chars]) + "]"))
    return 3 * F.octet_length(col(s)) - 2 * kept


def percent_decode_lossy(s: Column | str) -> Column:
    """A stray % stays; bytes that are no UTF-8 become U+FFFD. Null-safe and never failing."""
    c = col(s)
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(%[0-9A-Fa-f]{2}|[^%]+|%)"), F.lit(1))
    byte = lambda p: F.when(p.rlike("^%[0-9A-Fa-f]{2}$"), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "UTF-8")))
    return F.make_valid_utf8(F.unhex(F.array_join(F.transform(parts, byte), "")).cast("string"))


def file_uri(path: Column | str) -> Column:
    p = percent_encode_path(path)
    return F.concat(F.lit("file://"), F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p)))


def lines(s: Column | str) -> Column:
    """Lines ended by CRLF, LF or a lone CR; no empty line after the last end."""
    c = F.split(col(s), LINE_END)
    return F.when(col(s) == "", F.array().cast("array<string>")).otherwise(F.when(F.element_at(c, -1) == "", F.slice(c, 1, F.size(c) - 1)).otherwise(c))


def uri_entries(s: Column | str) -> Column:
    """Trimmed, non-blank lines of a URI list (BOM and one trailing NUL gone): array of struct(is_comment, value)."""
    body = F.regexp_replace(F.regexp_replace(col(s), "^\ufeff", ""), "\\x00$", "")
    kept = F.filter(F.transform(lines(body), lambda x: F.trim(x, F.lit(" \t\n\r\x0c"))), lambda x: x != "")
    return F.transform(kept, lambda x: F.struct(x.startswith("#").alias("is_comment"), x.alias("value")))


def uris(s: Column | str) -> Column:
    return F.transform(F.filter(uri_entries(s), lambda e: ~e["is_comment"]), lambda e: e["value"])


def first_uri(s: Column | str) -> Column:
    return F.get(uris(s), F.lit(0))


def write_uri_list(array: Column | str) -> Column:
    """CRLF after every URI; one more BOM if the first begins with one."""
    a = col(array)
    body = F.array_join(F.transform(a, lambda u: F.concat(u, F.lit("\r\n"))), "")
    return F.concat(F.when(F.coalesce(F.get(a, F.lit(0)), F.lit("")).startswith("\ufeff"), "\ufeff").otherwise(""), body)


def copied_files_verb(s: Column | str) -> Column:
    """Cut or Copy by the first line of a copied-files payload (any case), else null: bad magic."""
    first = F.lower(F.trim(F.get(lines(col(s)), F.lit(0)), F.lit(" \t\r\n\x0c")))
    return F.when(first == "cut", "Cut").when(first == "copy", "Copy")


def copied_files_uris(s: Column | str) -> Column:
    rest = F.regexp_replace(col(s), r"^(?s)[^\r\n]*(\r\n|\r|\n|$)", "")
    return F.when(copied_files_verb(s).isNotNull(), uris(rest))


def write_copied_files(verb: Column | str, array: Column | str) -> Column:
    """The verb, then a line feed and a URI each; no line end after the last."""
    return F.concat_ws("\n", F.lower(col(verb)), col(array))


def is_nautilus_text(s: Column | str) -> Column:
    return col(s).startswith(GNOME_MAGIC)


def nautilus_text_verb(s: Column | str) -> Column:
    second = F.lower(F.trim(F.get(lines(col(s)), F.lit(1))))
    return F.when(F.trim(F.get(lines(col(s)), F.lit(0))) == GNOME_MAGIC, F.when(second == "cut", "Cut").when(second == "copy", "Copy"))


def nautilus_text_uris(s: Column | str) -> Column:
    all_lines = lines(col(s))
    rest = F.slice(all_lines, 3, F.greatest(F.size(all_lines) - 2, F.lit(0)))
    return F.when(nautilus_text_verb(s).isNotNull(), uris(F.array_join(rest, "\n")))


def kde_verb(payload: Column | str) -> Column:
    """``1`` means cut; all else, nothing included, copy."""
    return F.when(F.hex(F.substring(col(payload), 1, 1)) == "31", "Cut").otherwise("Copy")


def kde_payload(verb: Column | str) -> Column:
    return F.when(col(verb) == "Cut", F.unhex(F.lit("31"))).otherwise(F.unhex(F.lit("30")))


def drop_effect(payload: Column | str) -> Column:
    """Move before Copy before Link of a little-endian word; null under four bytes or without these bits."""
    b = col(payload)
    low = F.conv(F.hex(F.substring(b, 1, 1)), 16, 10).cast("int")
    bit = lambda n: F.bitwise_and(low, F.lit(n)) if hasattr(F, "bitwise_and") else low.bitwiseAND(n)
    return F.when(F.octet_length(b) >= 4, F.when(bit(2) != 0, "Move").when(bit(1) != 0, "Copy").when(bit(4) != 0, "Link"))


def drop_effect_bytes(action: Column | str) -> Column:
    c = col(action)
    return F.when(c == "Move", F.unhex(F.lit("02000000"))).when(c == "Link", F.unhex(F.lit("04000000"))).otherwise(F.unhex(F.lit("01000000")))


def html_escape(s: Column | str) -> Column:
    c = col(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def html_escape_lines(s: Column | str) -> Column:
    return F.replace(html_escape(s), F.lit("\n"), F.lit("<br>"))


def checksum(payload: Column | str) -> Column:
    """Sum of the bytes modulo 256."""
    pairs = F.regexp_extract_all(F.hex(col(payload)), F.lit("(..)"), F.lit(1))
    return F.aggregate(pairs, F.lit(0), lambda a, x: (a + F.conv(x, 16, 10).cast("int")) % 256)


def idlist_encode(payload: Column | str) -> Column:
    """Upper-case hex of the bytes and of their checksum; nothing for no bytes."""
    b = col(payload)
    return F.when(F.octet_length(b) == 0, "").otherwise(F.concat(F.hex(b), F.lpad(F.hex(checksum(b)), 2, "0")))


def idlist_decode(text: Column | str) -> Column:
    """struct(value, error): the bytes if the last one is the checksum of those before."""
    t = col(text)
    raw = F.unhex(t)
    body = F.substring(raw, F.lit(1), F.octet_length(raw) - 1)
    good = F.lpad(F.hex(checksum(body)), 2, "0") == F.upper(F.substring(t, -2, 2))
    even = t.rlike("^([0-9A-Fa-f]{2})*$")
    return F.struct(
        F.when(t == "", F.unhex(F.lit(""))).when(even & good, body).alias("value"),
        F.when(even & (good | (t == "")), F.lit(None).cast("string")).when(even, "Malformed").otherwise("Malformed").alias("error"),
    )


def filetime_unix_seconds(ticks: Column | str) -> Column:
    """Seconds since 1970 of 100 ns ticks since 1601, toward zero; null for 0, which means unset."""
    t = col(ticks).cast("decimal(20,0)")
    return F.when(t != 0, ((t - F.lit(116444736000000000).cast("decimal(20,0)")) / F.lit(10000000)).cast("bigint"))


def filetime_from_unix(seconds: Column | str) -> Column:
    return (col(seconds).cast("decimal(20,0)") * 10000000 + F.lit(116444736000000000).cast("decimal(20,0)")).cast("decimal(20,0)")


def dos_datetime(date: Column | str, time: Column | str) -> Column:
    """Fields of FAT date and time words, unchecked."""
    d, t = col(date), col(time)
    return F.struct(
        (F.shiftright(d, 9) + 1980).alias("year"),
        F.shiftright(d, 5).bitwiseAND(15).alias("month"),
        d.bitwiseAND(31).alias("day"),
        F.shiftright(t, 11).alias("hour"),
        F.shiftright(t, 5).bitwiseAND(63).alias("minute"),
        (t.bitwiseAND(31) * 2).alias("second"),
    )


def cf_html(fragment: Column | str, source_url: Column | None = None, before: str = "<html><body>", after: str = "</body></html>") -> Column:
    """A CF_HTML blob of a fragment in its context: ten-digit byte offsets, so the header has a fixed length."""
    names = ("StartHTML", "EndHTML", "StartFragment", "EndFragment")
    opening, closing = before + "<!--StartFragment-->", "<!--EndFragment-->" + after
    url = F.lit("") if source_url is None else F.coalesce(F.concat(F.lit("SourceURL:"), source_url, F.lit("\r\n")), F.lit(""))
    fixed = len("Version:0.9\r\n") + sum(len(n) + 13 for n in names)
    size = F.octet_length(col(fragment))
    start = F.lit(fixed) + F.octet_length(url)
    inside = start + len(opening.encode())
    at = {"StartHTML": start, "StartFragment": inside, "EndFragment": inside + size, "EndHTML": inside + size + len(closing.encode())}
    header = F.concat(F.lit("Version:0.9\r\n"), *[x for n in names for x in (F.lit(n + ":"), F.lpad(at[n].cast("string"), 10, "0"), F.lit("\r\n"))], url)
    return F.concat(header, F.lit(opening), col(fragment), F.lit(closing))


def cf_html_fragment(blob: Column | str) -> Column:
    """The text between the fragment comments, null without both."""
    got = F.regexp_extract(col(blob), r"(?s)<!--\s*StartFragment\s*-->(.*?)<!--\s*EndFragment\s*-->", 1)
    return F.when(col(blob).rlike(r"(?s)<!--\s*StartFragment\s*-->.*?<!--\s*EndFragment\s*-->"), got)


def safe_stem(native: Column | str) -> Column:
    """Identifier as a file stem."""
    c = F.regexp_replace(col(native), r"[^A-Za-z0-9.\-_+]", "_")
    c = F.regexp_replace(F.substring(c, 1, 96), r"\.+$", "")
    device = F.upper(F.split(c, r"\.")[0]).rlike(r"^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$")
    return F.when(c == "", "unnamed").when(c.startswith(".") | device, F.concat(F.lit("_"), c)).otherwise(c)


def windows_hotkey(word: Column | str) -> Column:
    w = col(word)
    mods = F.shiftright(w, 8)
    return F.struct(w.bitwiseAND(255).alias("key"), (mods.bitwiseAND(1) != 0).alias("shift"), (mods.bitwiseAND(2) != 0).alias("control"), (mods.bitwiseAND(4) != 0).alias("alt"))


def show_command(n: Column | str) -> Column:
    """Normal, maximised or minimised; other numbers count as normal."""
    return F.when(col(n) == 3, "Maximized").when(col(n) == 7, "MinNoActive").otherwise("Normal")


def over(c: Column | str, a: Column | str, bg: Column | str) -> Column:
    """A channel composited over a background, rounded."""
    return F.expr("0") + ((col(c) * col(a) + col(bg) * (255 - col(a)) + 127) / 255).cast("int")


def premultiply(c: Column | str, a: Column | str) -> Column:
    return ((col(c) * col(a) + 127) / 255).cast("int")


def locale_candidates(tag: Column | str) -> Column:
    """Up to four rungs of ``lang_COUNTRY.ENC@MOD``, most specific first, without the encoding."""
    t = col(tag)
    mod = F.regexp_extract(t, "@(.*)$", 1)
    base = F.regexp_replace(F.regexp_replace(t, "@.*$", ""), r"\..*$", "")
    lang = F.split(base, "_")[0]
    country = F.regexp_extract(base, "_(.*)$", 1)
    has_c, has_m = country != "", mod != ""
    return F.array_compact(
        F.array(
            F.when(has_c & has_m, F.concat(lang, F.lit("_"), country, F.lit("@"), mod)),
            F.when(has_c, F.concat(lang, F.lit("_"), country)),
            F.when(has_m, F.concat(lang, F.lit("@"), mod)),
            lang,
        )
    )


def canonical_kind(name: Column | str) -> Column:
    """An error kind by its name or its spelling in prose, in any case."""
    from ..plans.dims import ERROR_KINDS, ERROR_PROSE

    table = {k.lower(): k for k in ERROR_KINDS} | {k.lower(): v for k, v in ERROR_PROSE.items()}
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), F.lower(F.trim(col(name))))


def kind_from_notes(notes: Column | str) -> Column:
    """The one ErrorKind that prose names; null if none or several are."""
    found = F.array_distinct(F.regexp_extract_all(col(notes), F.lit(r"ErrorKind::([A-Za-z0-9]+)"), F.lit(1)))
    return F.when(F.size(found) == 1, found[0])
