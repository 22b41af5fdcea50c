"""SQL names: ``register(spark)`` makes the decoders callable as functions and the row generators as table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import css_functions, decoders, html, records, rtf, shellitems
from .functions.core import Bad, registrable
from .shipping import ensure_importable

DECODERS = "html_document rtf_document rtf_header cf_html drop_list file_descriptors item_list cida shell_link webloc bookmark dib_header dib_decode uri_list copied_files percent_decode url_file ini_entries desktop_entries desktop_unescape exec_args exec_check codepage_decode codepage_encode build_cf_html bookmark_check bookmark_flags link_from_file property_store drop_list_paths".split()

#: name: (generator of rows, result schema)
TABLES: dict[str, tuple[Callable[[Any], Iterator[dict[str, Any]]], str]] = {
    "html_tokens": (html.token_rows, html.TOKENS),
    "html_runs": (html.run_rows, html.RUNS),
    "rtf_tokens": (rtf.token_rows, rtf.TOKENS),
    "rtf_runs": (rtf.run_rows, rtf.RUNS),
    "rtf_colors": (lambda b: rtf.colors(bytes(b)), "color string"),
    "rtf_fonts": (lambda b: rtf.fonts(bytes(b)), "id int, family string, charset int, name string"),
    "idlist_items": (records.item_rows, records.ITEM),
    "bplist_objects": (lambda b: records.BinaryPlist(bytes(b)).rows(), records.PLIST_ROWS),
    "bookmark_entries": (records.bookmark_rows, records.BOOKMARK_ROWS),
    "property_store_values": (lambda b: shellitems.properties(bytes(b)), shellitems.PROPERTIES),
    "css_declarations": (css_functions.declaration_rows, "name string, value string"),
}


def _table(f: Callable[[Any], Iterator[dict[str, Any]]], schema: str) -> type:
    names = [x.split()[0] for x in _top_level(schema)]

    class Rows:
        def eval(self, data: Any) -> Iterator[tuple]:
            if data is None:
                return
            try:
                for x in f(data):
                    yield tuple(x[n] for n in names) + (None,)
            except Bad as e:
                yield (*([None] * len(names)), e.kind)

    return Rows


def _top_level(schema: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(schema + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[start:i].strip())
            start = i + 1
    return out


def register(spark: SparkSession) -> None:
    """Every decoder under its own name, and each table function with a last column ``error``."""
    ensure_importable(spark)
    for name in DECODERS:
        d = getattr(decoders, name)
        spark.udf.register(name, registrable(d.one, d.schema))
    for name, (f, schema) in TABLES.items():
        spark.udtf.register(name, F.udtf(_table(f, schema), returnType=f"{schema}, error string"))
    for name, (f, kind) in css_functions.SCALARS.items():
        spark.udf.register(name, F.pandas_udf(_series(f), kind))


def _series(f: Callable[[Any], Any]) -> Callable[[pd.Series], pd.Series]:
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else f(x) for x in s], dtype=object)

    return run
