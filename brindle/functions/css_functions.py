"""Functions of CSS values and character references for columns and SQL."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from . import html


def declaration_rows(style: str) -> Iterator[dict[str, Any]]:
    for name, value in html.declarations(style.encode()):
        yield {"name": name, "value": html.unescape(value)}


def decoration(v: str) -> str | None:
    got = html.text_decoration(v.encode())
    return None if got is None else " ".join(w for w, on in zip(("underline", "line-through"), got, strict=True) if on) or "none"


SCALARS = {
    "css_color": (lambda v: html.colour(v.encode()), "string"),
    "css_bold": (lambda v: html.font_weight_bold(v.encode()), "boolean"),
    "css_italic": (lambda v: html.font_style_italic(v.encode()), "boolean"),
    "css_decoration": (decoration, "string"),
    "css_size_pt": (lambda v: html.font_size_pt(v.encode(), None), "double"),
    "font_attr_size_pt": (lambda v: html.font_attr_size_pt(v.encode()), "double"),
    "html_unescape": (lambda v: html.unescape(v.encode()), "string"),
}
