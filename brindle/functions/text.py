"""Text encodings of payloads: plain text by platform, HTML bytes, UTF-16LE and single-byte code pages."""

from __future__ import annotations

import functools

from ..plans.dims import CODE_PAGES, WINDOWS
from .core import Bad, utf16_lossy


def trim_nuls(b: bytes) -> bytes:
    return b.rstrip(b"\0")


def trim_wide_nuls(b: bytes) -> bytes:
    """Without an odd byte at the end, then without 16-bit NULs."""
    b = b[: len(b) & ~1]
    while b.endswith(b"\0\0"):
        b = b[:-2]
    return b


def decode_plain(b: bytes, platform: str) -> str:
    """Windows text is UTF-16LE whatever its format says; elsewhere UTF-8 with repairs."""
    return utf16_lossy(trim_wide_nuls(b)) if platform == WINDOWS else trim_nuls(b).decode("utf-8", "replace")


def encode_plain(text: str, platform: str) -> bytes:
    return text.encode("utf-16-le", "surrogatepass") + b"\0\0" if platform == WINDOWS else text.encode()


def looks_utf16le(b: bytes) -> bool:
    """Even, four bytes or more, and a third of the high bytes zero."""
    if len(b) < 4 or len(b) % 2:
        return False
    return b[1::2].count(0) * 3 >= len(b) // 2


def decode_html_bytes(b: bytes) -> str:
    """A byte-order mark decides, then the look of UTF-16, else UTF-8 with repairs."""
    if b.startswith(b"\xef\xbb\xbf"):
        return b[3:].decode("utf-8", "replace")
    if b.startswith(b"\xff\xfe"):
        return utf16_lossy(trim_wide_nuls(b[2:]))
    if b.startswith(b"\xfe\xff"):
        even = b[2 : 2 + (len(b) - 2 & ~1)]
        swapped = bytearray(len(even))
        swapped[0::2], swapped[1::2] = even[1::2], even[0::2]
        return utf16_lossy(trim_wide_nuls(bytes(swapped)))
    if looks_utf16le(b):
        return utf16_lossy(trim_wide_nuls(b))
    return trim_nuls(b).decode("utf-8", "replace")


def is_valid_utf16le(b: bytes) -> bool:
    try:
        b.decode("utf-16-le")
    except UnicodeDecodeError:
        return False
    return True


def utf16le_char_count(b: bytes) -> int | None:
    return len(b.decode("utf-16-le")) if is_valid_utf16le(b) else None


def canonical_page(number: int) -> int | None:
    n = 28591 if number == 819 else number
    return n if n in CODE_PAGES else None


@functools.cache
def page_table(number: int) -> tuple[str | None, ...]:
    """The 256 characters of a page; None where it defines none."""
    codec = CODE_PAGES[number][1]
    out = []
    for b in range(256):
        try:
            out.append(bytes((b,)).decode(codec))
        except UnicodeDecodeError:
            out.append(None)
    return tuple(out)


def decode_byte(number: int, b: int) -> str:
    """Lossy: ASCII as it is, U+FFFD where the page is unknown or has a gap."""
    if b < 0x80:
        return chr(b)
    page = canonical_page(number)
    return (page_table(page)[b] if page else None) or "\ufffd"


def decode_byte_lenient(number: int, b: int) -> str | None:
    """Gaps from 0x80 to 0x9F are the control characters of that number."""
    page = canonical_page(number)
    c = page_table(page)[b] if page else None
    return c if c is not None else chr(b) if 0x80 <= b <= 0x9F else None


def has_gaps(number: int) -> bool:
    return None in page_table(canonical_page(number))


def decode_page(b: bytes, number: int) -> str:
    """Strict: Malformed at the first byte without a character."""
    page = canonical_page(number)
    if page is None:
        raise Bad("Unsupported", 0)
    table = page_table(page)
    out = [table[x] for x in b]
    if None in out:
        raise Bad("Malformed", out.index(None))
    return "".join(out)


def decode_page_lossy(b: bytes, number: int) -> str:
    return "".join(decode_byte(number, x) for x in b)


def encode_page(text: str, number: int) -> bytes:
    """Strict: Malformed at the byte offset of the first character that the page lacks."""
    page = canonical_page(number)
    if page is None:
        raise Bad("Unsupported", 0)
    back = {c: i for i, c in reversed(list(enumerate(page_table(page)))) if c is not None}
    out, at = bytearray(), 0
    for c in text:
        if c not in back:
            raise Bad("Malformed", at)
        out.append(back[c])
        at += len(c.encode())
    return bytes(out)
