"""Device-independent bitmaps: headers, pixels to RGBA and back, vectorised; and PNG files of RGBA."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from typing import Any

import numpy as np

from .core import Bad
from .limits import MAX_PIXELS

#: Header sizes that are read.
SIZES = (40, 52, 56, 108, 124)
RGB, RLE8, RLE4, FIELDS, JPEG, PNG_IN = 0, 1, 2, 3, 4, 5


@dataclass
class Header:
    size: int
    width: int
    height: int
    top_down: bool
    bits: int
    compression: int
    masks: tuple[int, int, int, int]
    colours: int
    palette_at: int
    pixels_at: int

    @property
    def stride(self) -> int:
        return (self.width * self.bits + 31) // 32 * 4


def header(b: bytes) -> Header:
    """Layout of a bitmap, checked once: sizes, planes, depth, masks, palette and the room for its pixels."""
    if len(b) < 4:
        raise Bad("UnexpectedEof", 0)
    size = int.from_bytes(b[:4], "little")
    if size not in SIZES:
        raise Bad("Unsupported", 0)
    if len(b) < size:
        raise Bad("UnexpectedEof", len(b))
    width, height, planes, bits, compression, _, _, _, used, _ = struct.unpack_from("<iiHHIIiiII", b, 4)
    top_down, height = height < 0, abs(height)
    if planes != 1:
        raise Bad("Malformed", 12)
    if width <= 0 or height == 0:
        raise Bad("Malformed", 4)
    if width * height > MAX_PIXELS:
        raise Bad("TooLarge", 4)
    if bits not in (1, 4, 8, 16, 24, 32):
        raise Bad("Unsupported", 14)
    if compression not in (RGB, RLE8, RLE4, FIELDS, 6):
        raise Bad("Unsupported", 16)
    if compression == RLE8 and bits != 8 or compression == RLE4 and bits != 4 or compression in (RLE8, RLE4) and top_down or compression in (FIELDS, 6) and bits not in (16, 32):
        raise Bad("Malformed", 16)
    at = size
    masks = {16: (0x7C00, 0x03E0, 0x001F, 0)}.get(bits, (0xFF0000, 0xFF00, 0xFF, 0))
    if compression in (FIELDS, 6):
        n = 4 if compression == 6 or size >= 56 else 3
        if size == 40:
            if len(b) < at + 4 * n:
                raise Bad("UnexpectedEof", len(b))
            masks = (*struct.unpack_from(f"<{n}I", b, at), 0)[:4]
            at += 4 * n
        else:
            masks = (*struct.unpack_from(f"<{min(n, 3 if size == 52 else 4)}I", b, 40), 0)[:4]
        for m in masks:
            if m >> bits or m and (m // (m & -m)) & (m // (m & -m)) + 1:
                raise Bad("Malformed", 40)
    elif size >= 56 and bits == 32:
        masks = (*masks[:3], struct.unpack_from("<I", b, 52)[0])
        if masks[3] & (masks[0] | masks[1] | masks[2]):
            masks = (*masks[:3], 0)
    colours = (used or 1 << bits) if bits <= 8 else used
    if bits <= 8 and colours > 1 << bits or colours * 4 > len(b) - at:
        raise Bad("BadLength", 32)
    out = Header(size, width, height, top_down, bits, compression, masks, colours, at, at + 4 * colours)
    if compression not in (RLE4, RLE8) and out.pixels_at + out.stride * height > len(b):
        raise Bad("UnexpectedEof", len(b))
    return out


def _channel(pixels: np.ndarray, mask: int) -> np.ndarray:
    """A channel as eight bits, rounded to the nearest."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    top = mask >> shift
    v = (pixels & np.uint32(mask)) >> np.uint32(shift)
    return ((v.astype(np.uint64) * 255 + top // 2) // top).astype(np.uint8)


def _rle(h: Header, b: bytes, palette: np.ndarray) -> np.ndarray:
    """Run lengths; pixels that nothing covers are transparent, and the end mark may be missing."""
    out = np.zeros((h.height, h.width, 4), np.uint8)
    x, y, at = 0, h.height - 1, h.pixels_at
    nibbles = h.compression == RLE4

    def put(values: list[int]) -> None:
        nonlocal x
        if y < 0:
            raise Bad("BadOffset", at)
        if x + len(values) > h.width:
            raise Bad("BadOffset", at)
        for v in values:
            if v >= len(palette):
                raise Bad("BadOffset", at)
            out[y, x] = palette[v]
            x += 1

    while at + 1 < len(b):
        n, v = b[at], b[at + 1]
        at += 2
        if n:
            put([(v >> 4 if k % 2 == 0 else v & 15) for k in range(n)] if nibbles else [v] * n)
        elif v == 0:
            x, y = 0, y - 1
        elif v == 1:
            return out
        elif v == 2:
            if at + 2 > len(b):
                raise Bad("UnexpectedEof", at)
            x, y = x + b[at], y - b[at + 1]
            at += 2
        else:
            size = (v + 1) // 2 if nibbles else v
            if at + size > len(b):
                raise Bad("UnexpectedEof", at)
            raw = b[at : at + size]
            put([(raw[k // 2] >> 4 if k % 2 == 0 else raw[k // 2] & 15) for k in range(v)] if nibbles else list(raw))
            at += size + (size & 1)
    return out


def decode(b: bytes, alpha: str = "Guess") -> dict[str, Any]:
    """RGBA, top row first. ``alpha``: Straight, Premultiplied, Ignore, or Guess.

    At 32 bits without an alpha mask the fourth byte counts as alpha only if it is set in every pixel. A guess takes
    alpha as premultiplied unless a channel exceeds it somewhere.
    """
    h = header(b)
    palette = np.zeros((0, 4), np.uint8)
    if h.bits <= 8:
        quads = np.frombuffer(b, np.uint8, 4 * h.colours, h.palette_at).reshape(-1, 4)
        palette = np.stack((quads[:, 2], quads[:, 1], quads[:, 0], np.full(h.colours, 255, np.uint8)), axis=1)
    if h.compression in (RLE4, RLE8):
        rgba = _rle(h, b, palette)
        return {"width": h.width, "height": h.height, "pixels": rgba.tobytes()}
    rows = np.frombuffer(b, np.uint8, h.stride * h.height, h.pixels_at).reshape(h.height, h.stride)
    if h.bits <= 8:
        if h.bits == 8:
            index = rows[:, : h.width]
        else:
            bits = np.unpackbits(rows, axis=1).reshape(h.height, -1, h.bits)
            index = np.packbits(np.concatenate((np.zeros((*bits.shape[:2], 8 - h.bits), np.uint8), bits), axis=2), axis=2)[:, : h.width, 0]
        if index.max(initial=0) >= h.colours:
            raise Bad("BadOffset", h.pixels_at)
        rgba = palette[index]
    elif h.bits == 24:
        bgr = rows[:, : 3 * h.width].reshape(h.height, h.width, 3)
        rgba = np.dstack((bgr[:, :, ::-1], np.full(bgr.shape[:2], 255, np.uint8)))
    else:
        kind = np.dtype("<u2") if h.bits == 16 else np.dtype("<u4")
        px = rows[:, : h.width * h.bits // 8].copy().view(kind).astype(np.uint32)
        mask = h.masks[3]
        if h.bits == 32 and not mask and h.compression == RGB and (px >> np.uint32(24)).all():
            mask = 0xFF000000
        a = _channel(px, mask) if mask and alpha != "Ignore" else np.full(px.shape, 255, np.uint8)
        rgba = np.dstack([*(_channel(px, m) for m in h.masks[:3]), a])
        if mask and alpha != "Ignore" and (alpha == "Premultiplied" or alpha == "Guess" and not (rgba[:, :, :3] > rgba[:, :, 3:]).any()):
            wide, over = rgba[:, :, :3].astype(np.uint32), np.maximum(rgba[:, :, 3:], 1).astype(np.uint32)
            rgba[:, :, :3] = np.where(rgba[:, :, 3:] > 0, np.minimum(255, (wide * 255 + over // 2) // over), 0)
    if not h.top_down:
        rgba = rgba[::-1]
    return {"width": h.width, "height": h.height, "pixels": np.ascontiguousarray(rgba).tobytes()}


def _pixels(width: int, height: int, rgba: bytes) -> np.ndarray:
    if width <= 0 or height <= 0 or len(rgba) != width * height * 4:
        raise Bad("BadLength", len(rgba))
    return np.frombuffer(rgba, np.uint8).reshape(height, width, 4)


def encode_v5(width: int, height: int, rgba: bytes, premultiplied: bool = False) -> bytes:
    """A 124-byte header and 32 bits a pixel, bottom row first."""
    px = _pixels(width, height, rgba)
    if premultiplied:
        c = px[:, :, :3].astype(np.uint32) * px[:, :, 3:].astype(np.uint32)
        px = np.dstack((((c + 127) // 255).astype(np.uint8), px[:, :, 3:]))
    body = px[::-1, :, [2, 1, 0, 3]].tobytes()
    head = struct.pack("<IiiHHIIiiII", 124, width, height, 1, 32, FIELDS, len(body), 0, 0, 0, 0)
    head += struct.pack("<4I", 0xFF0000, 0xFF00, 0xFF, 0xFF000000) + struct.pack("<I", 0x73524742) + b"\0" * 48 + struct.pack("<4I", 4, 0, 0, 0)
    return head + body


def encode_dib(width: int, height: int, rgba: bytes, background: tuple[int, int, int] = (255, 255, 255)) -> bytes:
    """A 40-byte header and 24 bits a pixel over a background, bottom row first."""
    px = _pixels(width, height, rgba).astype(np.uint32)
    a = px[:, :, 3:]
    flat = ((px[:, :, :3] * a + np.array(background, np.uint32) * (255 - a) + 127) // 255).astype(np.uint8)
    stride = (width * 24 + 31) // 32 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : 3 * width] = flat[::-1, :, ::-1].reshape(height, -1)
    return struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, RGB, rows.size, 0, 0, 0, 0) + rows.tobytes()


def encode_png(width: int, height: int, rgba: bytes) -> bytes:
    px = _pixels(width, height, rgba)
    raw = np.concatenate((np.zeros((height, 1), np.uint8), px.reshape(height, -1)), axis=1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def encode_tiff(width: int, height: int, rgba: bytes) -> bytes:
    """One uncompressed strip of eight-bit RGBA with straight alpha, little-endian."""
    body = _pixels(width, height, rgba).tobytes()
    short, long = 3, 4
    deep = 8 + 2 + 11 * 12 + 4  # the four sample depths follow the directory, the strip follows them
    tags = ((256, long, 1, width), (257, long, 1, height), (258, short, 4, deep), (259, short, 1, 1), (262, short, 1, 2), (273, long, 1, deep + 8), (277, short, 1, 4), (278, long, 1, height), (279, long, 1, len(body)), (284, short, 1, 1), (338, short, 1, 2))
    return struct.pack("<2sHI", b"II", 42, 8) + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I4H", 0, 8, 8, 8, 8) + body


def header_row(b: bytes) -> dict[str, Any]:
    h = header(b)
    return {"size": h.size, "width": h.width, "height": h.height, "top_down": h.top_down, "bits": h.bits, "compression": h.compression, "colours": h.colours}


HEADER = "struct<size:int,width:int,height:int,top_down:boolean,bits:int,compression:int,colours:int>"
IMAGE = "struct<width:int,height:int,pixels:binary>"
