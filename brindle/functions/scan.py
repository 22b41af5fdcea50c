"""Detectors of personal data in text and bytes, as native Column expressions.

A finding is struct(rule, offset, encoding, matched); the offset counts bytes of the view that was scanned, as the
rules are made of bytes. Bytes are viewed as Latin-1 text, so that a character is a byte.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names that stand for nobody, domains reserved for documentation, identifiers shared by all machines.
PLACEHOLDER_USERS = "me user username someone somebody anon anonymous example test tester testuser demo dev developer foo bar baz alice bob carol eve jdoe johndoe john jane nobody root runner ubuntu vagrant docker guest build ci".split()
GENERIC_LOGINS = "root runner ubuntu user admin administrator build builder ci docker vagrant jenkins nobody me test guest container codespace vscode app node".split()
RESERVED_DOMAINS = ["example.com", "example.net", "example.org", "example.edu", "localhost"]
RESERVED_TLDS = ["example", "test", "invalid", "localhost", "local"]
WELL_KNOWN_UUIDS = [
    "00021401-0000-0000-c000-000000000046",
    "20d04fe0-3aea-1069-a2d8-08002b30309d",
    "21ec2020-3aea-1069-a2dd-08002b30309d",
    "450d8fba-ad25-11d0-98a8-0800361b1103",
    "645ff040-5081-101b-9f08-00aa002f954e",
]
DEVICE_WORDS = "mac macbook imac iphone ipad ipod macintosh pc computer laptop desktop ssd drive disk volume backup time airport".split()
COMMON_POSSESSORS = "the a an user users it one system everyone someone anyone today apple microsoft windows finder nautilus explorer word excel chrome safari firefox qt gtk kde gnome office outlook author owner machine host client server parser reader writer caller".split()
HOME_PREFIXES = ["/Users/", "/home/", "\\Users\\", "\\home\\"]

UUID = r"(?<![0-9A-Fa-f-])[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f-])"
HEX_RUN = r"[0-9A-Fa-f]{32,}"
#: A word is tried from its first character only, or from where the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+"
HOME = r"(?i)(/Users/|/home/|\\Users\\|\\home\\)([A-Za-z0-9._-]+)"
#: In Latin-1 view the curly and acute apostrophes are three and two characters.
DEVICE = r"([A-Za-z0-9\x80-\xff]+)('|\xe2\x80\x99|\xc2\xb4)[sS] (?i:(" + "|".join(DEVICE_WORDS) + r"))(?![A-Za-z0-9])( [A-Z][A-Za-z0-9]*)?"


@dataclass(frozen=True)
class Identity:
    """Whose data must not be there: a login, a home folder and the folder's own name.

    Names under three characters and those that machines share are nobody's, and neither is ``/`` or ``/root``.
    """

    login: str | None = None
    home: str | None = None

    @property
    def home_base(self) -> str | None:
        return re.split(r"[/\\]", self.home.rstrip("/\\"))[-1] or None if self.home else None

    def patterns(self) -> list[tuple[str, str]]:
        """(what is reported, pattern over a Latin-1 view): the home anywhere, names between word borders, in any case."""
        out = []
        if self.home and len(self.home.encode()) >= 4 and self.home != "/root":
            out.append((self.home, "(?i)" + _literal(self.home)))
        for name in dict.fromkeys(filter(None, (self.login, self.home_base))):
            if len(name.encode()) >= 3 and name.lower() not in GENERIC_LOGINS:
                out.append((name, rf"(?i)(?<![A-Za-z0-9_]){_literal(name)}(?![A-Za-z0-9_])"))
        return out


def _literal(s: str) -> str:
    """A string as a pattern over its bytes."""
    return "".join(c if c.isascii() and c.isalnum() else "".join(f"\\x{b:02x}" for b in c.encode()) for c in s)


def latin1_view(payload: Column) -> Column:
    """Each byte as one character."""
    return F.decode(payload, "ISO-8859-1")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is made once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Sizes that are added up one by one; sums of so many are added up beyond.
BLOCK = 256


def running(sizes: Column) -> Column:
    """Sums of an array's first k elements, k from 1 on, by blocks: never the whole front again for each k."""
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    blocks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: add(F.slice(xs, b * BLOCK + 1, BLOCK)))
    front = lambda bs: F.transform(F.sequence(F.lit(0), F.size(bs) - 1), lambda b: add(F.slice(bs, 1, b)))
    each = lambda xs, fs: F.transform(xs, lambda _, k: F.element_at(fs, F.floor(k / BLOCK).cast("int") + 1) + add(F.slice(xs, F.floor(k / BLOCK).cast("int") * BLOCK + 1, F.pmod(k, F.lit(BLOCK)) + 1)))
    return let(sizes, lambda xs: F.when(F.size(xs) == 0, F.array().cast("array<int>")).otherwise(let(blocks(xs), lambda bs: let(front(bs), lambda fs: each(xs, fs)))))


def _offsets(view: Column, pattern: str, signs: tuple[str, ...] = ()) -> Column:
    """array of struct(offset, matched) of the pattern's matches, left to right.

    ``signs`` are strings of which every match has one, in lower case: a plain search for them spares most texts the
    pattern.
    """
    if signs:
        low = F.lower(view)
        any_ = low.contains(signs[0])
        for x in signs[1:]:
            any_ = any_ | low.contains(x)
        return F.when(any_, _offsets(view, pattern)).otherwise(F.array().cast("array<struct<offset:int,matched:string>>"))
    found, gaps = F.regexp_extract_all(view, F.lit(f"({pattern})"), F.lit(1)), F.split(view, pattern)
    none = F.array().cast("array<struct<offset:int,matched:string>>")

    def placed(hits: Column) -> Column:
        sizes = F.transform(F.arrays_zip(F.slice(gaps, 1, F.greatest(F.size(hits), F.lit(1))).alias("gap"), hits.alias("hit")), lambda x: F.length(F.coalesce(x["gap"], F.lit(""))) + F.length(F.coalesce(x["hit"], F.lit(""))))
        return F.transform(F.arrays_zip(running(sizes).alias("end"), hits.alias("hit")), lambda x: F.struct((x["end"] - F.length(x["hit"])).alias("offset"), x["hit"].alias("matched")))

    return let(found, lambda hits: F.when(F.size(hits) == 0, none).otherwise(placed(hits)))


def email_ok(address: Column) -> Column:
    """An address that is to be reported: real shape, no reserved domain."""
    local, domain = F.split_part(address, F.lit("@"), F.lit(1)), F.lower(F.split_part(address, F.lit("@"), F.lit(-1)))
    tld = F.split_part(domain, F.lit("."), F.lit(-1))
    shape = tld.rlike("^[a-z]{2,24}$") & domain.contains(".") & ~local.startswith(".") & ~local.endswith(".") & ~domain.startswith(".")
    return shape & ~domain.isin(RESERVED_DOMAINS) & ~tld.isin(RESERVED_TLDS)


def uuid_ok(text: Column) -> Column:
    low = F.lower(text)
    digits = F.replace(low, F.lit("-"), F.lit(""))
    rest = F.concat(F.substring(digits, 1, 12), F.substring(digits, 14, 3), F.substring(digits, 18, 15))
    return ~rest.rlike("^(0+|f+)$") & ~low.isin(WELL_KNOWN_UUIDS) & ~low.endswith("-c000-000000000046")


def findings(view: Column, encoding: str = "ASCII", who: Identity | None = None) -> Column:
    """All rules over a Latin-1 view: array of struct(rule, offset, encoding, matched)."""
    who = who or Identity()

    def tag(rule: Column | Callable[[Column], Column], hits: Column) -> Column:
        return F.transform(hits, lambda h: F.struct((rule if isinstance(rule, Column) else rule(h)).alias("rule"), h["offset"].alias("offset"), F.lit(encoding).alias("encoding"), h["matched"].alias("matched")))

    user = lambda h: F.regexp_extract(h["matched"], r"([^/\\]+)$", 1)
    homes = F.filter(_offsets(view, HOME.replace("(?i)", "(?i)(?:").replace(r"(/Users/|", r"(?:/Users/|").replace(r"([A-Za-z0-9._-]+)", r"[A-Za-z0-9._-]+)"), tuple(x.lower() for x in HOME_PREFIXES)), lambda h: ~F.lower(user(h)).isin(PLACEHOLDER_USERS))
    uuids = F.filter(_offsets(view, UUID, ("-",)), lambda h: uuid_ok(h["matched"]))
    runs = F.filter(_offsets(view, HEX_RUN), lambda h: ~h["matched"].rlike(r"^(.)\1*$"))
    shown = F.transform(runs, lambda h: F.struct(h["offset"].alias("offset"), F.concat(F.substring(h["matched"], 1, 8), F.lit("…"), F.substring(h["matched"], -8, 8)).alias("matched")))
    mails = F.filter(_offsets(view, EMAIL, ("@",)), lambda h: email_ok(h["matched"]))
    owner = lambda h: F.regexp_extract(h["matched"], "^([A-Za-z0-9\\x80-\\xff]+)", 1)
    device = DEVICE.replace("([A-Za-z0-9\\x80-\\xff]+)(", "[A-Za-z0-9\\x80-\\xff]+(?:").replace("(?i:(", "(?i:(?:").replace("( [A-Z]", "(?: [A-Z]")
    devices = F.filter(_offsets(view, device, ("'s ", "\xe2\x80\x99s ", "\xc2\xb4s ")), lambda h: (F.length(owner(h)) >= 2) & owner(h).rlike("^[A-Z\\xc3]") & ~F.lower(owner(h)).isin(COMMON_POSSESSORS))
    login = (who.login or "").lower()
    home_rule = (lambda h: F.when(F.lower(user(h)) == login, "CurrentUser").otherwise("HomePath")) if login else F.lit("HomePath")
    parts = [tag(home_rule, homes), tag(F.lit("Uuid"), uuids), tag(F.lit("HexRun"), shown), tag(F.lit("Email"), mails), tag(F.lit("PersonalDevice"), devices)]
    for said, pattern in who.patterns():
        parts.append(tag(F.lit("CurrentUser"), _said(_offsets(view, pattern), said)))
    return F.array_distinct(F.concat(*parts))


def _said(hits: Column, matched: str) -> Column:
    """Hits that report the same words, whatever their case was."""
    return F.transform(hits, lambda h: F.struct(h["offset"].alias("offset"), F.lit(matched).alias("matched")))


def _in_bytes(found: Column, align: int) -> Column:
    """Findings of a wide view with their offsets in bytes."""
    return F.transform(found, lambda f: F.struct(f["rule"].alias("rule"), (f["offset"] * 2 + align).alias("offset"), f["encoding"].alias("encoding"), f["matched"].alias("matched")))


def utf16_view(payload: Column, align: int) -> Column:
    """Printable UTF-16LE units as characters, others as NUL; unit k is at byte 2 * k + align."""
    hexed = F.hex(payload)
    units = F.regexp_extract_all(F.substring(hexed, F.lit(1 + 2 * align), F.length(hexed)), F.lit("(....)"), F.lit(1))
    lo, hi = (lambda u: F.conv(F.substring(u, 1, 2), 16, 10).cast("int")), (lambda u: F.substring(u, 3, 2))
    one = lambda u: F.when((hi(u) == "00") & lo(u).between(0x20, 0x7E), F.char(lo(u))).when(u == "1920", "'").otherwise("\x00")
    return F.array_join(F.transform(units, one), "")


def scan(df: DataFrame, id_col: str, payload_col: str, who: Identity | None = None) -> DataFrame:
    """One row a finding: the bytes as they are and as UTF-16LE at both alignments, distinct by rule, offset, match."""
    bytes_ = F.col(payload_col)
    # every match of the wide views needs a unit with a zero high byte, so payloads without a NUL skip them
    wide_text = latin1_view(bytes_).contains("\x00")
    none = F.array().cast("array<struct<rule:string,offset:int,encoding:string,matched:string>>")
    views = [let(latin1_view(bytes_), lambda v: findings(v, "ASCII", who))]
    for align in (0, 1):
        wide = let(utf16_view(bytes_, align), lambda v: findings(v, "UTF-16LE", who))
        views.append(F.when(wide_text, _in_bytes(wide, align)).otherwise(none))
    rows = df.select(F.col(id_col), F.explode(F.concat(*views)).alias("f")).select(id_col, "f.*")
    first = F.struct("encoding")
    return rows.groupBy(id_col, "rule", "offset", "matched").agg(F.min(first)["encoding"].alias("encoding"))
