"""Payloads decoded to their richest item and items encoded to the flavors a platform wants.

Decoding one representation is an Arrow function; choosing among those of a payload is relational: rank, decode,
first success, enrichment from siblings. So Spark deals payloads over tasks and a payload's rows meet once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions import bitmap, html, limits, lineformats, records, rtf, text
from ..functions.core import Bad, records_of, utf8_strict
from ..functions.links import classify
from ..functions.targets import html_escape_lines
from ..plans import dims
from .payload import item_action, native_name, resolve

STYLE = html.STYLE
RICH = f"struct<text:string,runs:array<struct<start:int,end:int,style:{STYLE}>>>"
ITEM = (
    f"kind string, text string, rich {RICH}, html struct<markup:string,plain:string>, image struct<width:int,height:int,pixels:binary,format:string>, "
    "files struct<entries:array<struct<kind:string,value:string>>,action:string>, promised array<struct<name:string,size:decimal(20,0),attributes:bigint,is_directory:boolean>>, "
    "link struct<target_kind:string,target:string,title:string>, shortcut struct<target_path:string,arguments:string,working_dir:string,name:string,icon_location:string,relative_path:string>, "
    "shell struct<display_paths:array<string>,parent:string>, unknown struct<native:string,bytes:binary>"
)
ARMS = ("text", "rich", "html", "image", "files", "promised", "link", "shortcut", "shell", "unknown")
FAILURE = "failure struct<variant:string,kind:string,offset:bigint>"


class Refused(Exception):
    """A representation that no decoder takes: NotContent or Unsupported."""


def file_entry(uri: str) -> dict[str, str] | None:
    """A local file URI as a path, percent escapes decoded with repairs; another URI as it is; blank as nothing."""
    u = uri.strip()
    if not u:
        return None
    m = re.match(r"(?i)file://(localhost)?(/.*)$", u, re.S)
    if not m:
        return {"kind": "Uri", "value": u}
    raw = re.sub(rb"%([0-9A-Fa-f]{2})", lambda x: bytes((int(x[1], 16),)), m[2].encode())
    return {"kind": "Path", "value": raw.decode("utf-8", "replace")}


#: The decoder that each flavor needs, for switching decoders off.
FEATURES = {"Rtf": "rtf", "Html": "html", "Dib": "dib", "DibV5": "dib", "FileDescriptor": "file-desc", "ShellIdList": "idlist", "ShellLink": "shell-link"}


def decode_item(data: bytes, native: str, platform: str, flavor: str, keep_markup: bool = False, alpha: str = "Guess", disabled: frozenset[str] = frozenset()) -> dict[str, Any]:
    """One representation as an item; unknown identifiers, web archives and UTF-16 text are Unknown, which succeeds.

    ``keep_markup`` returns HTML as it came instead of styled text; ``alpha`` says how bitmaps read theirs; a flavor
    whose feature is ``disabled`` fails with FeatureDisabled.
    """
    if FEATURES.get(flavor) in disabled:
        raise Refused("FeatureDisabled")
    if flavor == "PlainText":
        return {"kind": "Text", "text": text.decode_plain(data, platform)}
    if flavor == "Rtf":
        doc = rtf.document(data)
        return {"kind": "RichText", "rich": {k: doc[k] for k in ("text", "runs")}}
    if flavor == "Html":
        markup = records.cf_html(data)["fragment"] if platform == dims.WINDOWS else text.decode_html_bytes(data)
        if keep_markup:
            return {"kind": "Html", "html": {"markup": markup, "plain": None}}
        return {"kind": "RichText", "rich": html.document(markup.encode())}
    if flavor in ("Dib", "DibV5"):
        return {"kind": "Image", "image": {**bitmap.decode(data, alpha), "format": "Rgba"}}
    if flavor in ("Png", "Tiff", "Jpeg", "Gif"):
        return {"kind": "Image", "image": {"width": None, "height": None, "pixels": data, "format": flavor}}
    if flavor == "FileList":
        if platform == dims.WINDOWS:
            got = records.drop_list(data)
            names = [w if w is not None else n.decode("utf-8", "replace") for w, n in zip(got["paths"], got["raw"], strict=True)]
            entries = [{"kind": "Path", "value": n} for n in names]
        elif platform == dims.MACOS:
            entries = [e for e in [file_entry(text.trim_nuls(data).decode("utf-8", "replace"))] if e]
        else:
            entries = [e for x in lineformats.uri_list(data) if not x["is_comment"] and (e := file_entry(x["value"]))]
        return {"kind": "Files", "files": {"entries": entries, "action": "Copy"}}
    if flavor == "FileDescriptor":
        found = records.file_descriptors(data, native != "FileGroupDescriptor")
        return {"kind": "PromisedFiles", "promised": [{k: x[k] for k in ("name", "size", "attributes", "is_directory")} for x in found]}
    if flavor == "ShellIdList":
        got = records.cida(data)
        return {"kind": "ShellItems", "shell": {"display_paths": [c["path"] for c in got["children"] if c["error"] is None], "parent": got["parent"]["path"]}}
    if flavor == "ShellLink":
        got = records.shell_link(data)
        return {"kind": "Shortcut", "shortcut": {"target_path": got["local_base_path"] or got["net_name"], **{k: got[k] for k in ("arguments", "working_dir", "name", "icon_location", "relative_path")}}}
    if flavor == "Url":
        wide = platform == dims.WINDOWS and native == "UniformResourceLocatorW"
        url = text.decode_plain(data, dims.WINDOWS) if wide else utf8_strict(text.trim_nuls(data))
        url = url.strip()
        return {"kind": "Link", "link": {"target_kind": classify(url), "target": url, "title": None}}
    if flavor in ("DropEffect", "UrlName"):
        raise Refused("NotContent")
    if flavor == "FileContents":
        raise Refused("Unsupported")
    return {"kind": "Unknown", "unknown": {"native": native, "bytes": data}}


def decode_rows(rows: DataFrame, **options: Any) -> DataFrame:
    """``rows`` (resolved items) with the item's arms and a failure; each row on its own, nothing raises."""
    keep = ["payload_id", "platform", "ordinal", "item", "native", "flavor", "read_rank"]
    schema = ", ".join(f"{c} {dict(rows.dtypes)[c]}" for c in keep) + f", {ITEM}, {FAILURE}"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in records_of(batches):
            out = []
            for x in part:
                base = {c: x[c] for c in keep}
                try:
                    got = decode_item(x["bytes"] or b"", x["native"], x["platform"], x["flavor"], **options)
                    out.append({**base, **got, "failure": None})
                except Bad as e:
                    out.append({**base, "failure": {"variant": "Codec", "kind": e.kind, "offset": e.offset}})
                except Refused as e:
                    out.append({**base, "failure": {"variant": str(e), "kind": None, "offset": None}})
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.select(*keep, "bytes").mapInArrow(run, schema)


def decode_all(items: DataFrame, **options: Any) -> DataFrame:
    """Every content representation that decodes, with its place in the ranking; caps do not apply."""
    return decode_rows(resolve(items).where("is_content"), **options).where("failure IS NULL")


ENTRIES = "array<struct<kind:string,value:string>>"


def decode_payload(items: DataFrame, max_flavor_bytes: int | None = limits.MAX_FLAVOR_BYTES, policy: Column | None = None, strict_rank: bool = True, **options: Any) -> DataFrame:
    """The richest representation of each payload that decodes, enriched from its siblings: one row a payload.

    Representations are tried by (rank, ordinal), and none after the first that succeeds is decoded: the rows of a
    payload meet once, sorted, and stream by with one open payload a task. One over the byte cap is skipped, or
    treated as ``policy`` (a column of Accept, Skip or Abort) says; Abort ends the search there. Types that no decoder
    exists for still succeed as Unknown and so win by rank; ``strict_rank=False`` sets them last. If nothing succeeds
    the row carries the failure: a decoder's error before others, else TooLarge with the greatest size, else none.
    Further options are those of ``decode_item``; markup that is kept gets the payload's plain text beside it.
    """
    rank = F.col("read_rank") if strict_rank else F.when(F.col("flavor").isin("WebArchive", "PlainTextUtf16"), 254).otherwise(F.col("read_rank"))
    size = F.octet_length("bytes").cast("long")
    over = limits.rejects(size, max_flavor_bytes)
    verdict = F.when(over, F.lit("Skip") if policy is None else policy).otherwise("Accept")
    # what is neither content nor a name is settled by its own row; its bytes stay behind
    used = F.col("is_content") | (F.col("flavor") == "UrlName")
    verb = F.when(~F.col("is_content") | F.col("flavor").startswith("x-special/") | F.col("flavor").isin("Other", "DropEffect"), item_action(F.col("native"), F.col("bytes")))
    rows = resolve(items).select("payload_id", "platform", "ordinal", "item", "native", "flavor", "is_content", F.coalesce(rank, F.lit(255)).cast("int").alias("rank"), size.alias("size"), verdict.alias("verdict"), verb.alias("verb"), F.when(used, F.col("bytes")).alias("bytes"))
    ordered = rows.repartition("payload_id").sortWithinPartitions("payload_id", "rank", "ordinal")
    schema = f"payload_id {dict(items.dtypes)['payload_id']}, platform string, flavor string, native string, {ITEM}, {FAILURE}, action string, title string, entries {ENTRIES}, plain string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for part in records_of(batches):
            for x in part:
                if now is None or x["payload_id"] != now.id:
                    done += [] if now is None else [now.row()]
                    now = Search(x, options)
                now.look(x)
            if len(done) > 256:
                yield pa.RecordBatch.from_pylist(done, arrow)
                done = []
        if now is not None:
            done.append(now.row())
        yield pa.RecordBatch.from_pylist(done, arrow)

    return enriched(ordered.mapInArrow(run, schema))


class Search:
    """One payload's representations as they come by rank: the first success, or what failed, and what enriches it."""

    def __init__(self, x: dict[str, Any], options: dict[str, Any]):
        self.id, self.options = x["payload_id"], options
        self.first: tuple[int, str | None] = (x["ordinal"], x["platform"])
        self.won: dict[str, Any] | None = None
        self.lost: dict[str, Any] | None = None
        self.refused: int | None = None
        self.ended = False
        self.verb: tuple[int, str] | None = None
        self.title: tuple[int, str] | None = None
        self.plain: dict[str, Any] | None = None
        self.files: list[tuple[int, int, list]] = []

    def look(self, x: dict[str, Any]) -> None:
        self.first = min(self.first, (x["ordinal"], x["platform"]), key=lambda f: f[0])
        if x["verb"] is not None and (self.verb is None or x["ordinal"] < self.verb[0]):
            self.verb = (x["ordinal"], x["verb"])
        if x["flavor"] == "UrlName" and (self.title is None or x["ordinal"] < self.title[0]):
            self.title = (x["ordinal"], (x["bytes"] or b"").decode("utf-8", "replace"))
        if x["flavor"] == "PlainText" and (self.plain is None or x["ordinal"] < self.plain["ordinal"]):
            self.plain = x
        if not x["is_content"] or self.ended:
            return
        if x["verdict"] != "Accept":
            self.refused = max(self.refused or 0, x["size"] or 0)
            self.ended = self.won is None and x["verdict"] == "Abort"
            return
        more = self.won is not None and x["flavor"] == "FileList" and x["platform"] == dims.MACOS and self.won["kind"] == "Files"
        if self.won is not None and not more:
            return
        keep = {"flavor": x["flavor"], "native": x["native"]}
        try:
            got = decode_item(x["bytes"] or b"", x["native"], x["platform"], x["flavor"], **self.options)
        except (Bad, Refused) as e:
            if self.won is None:
                bad = isinstance(e, Bad)
                failure = {"variant": "Codec", "kind": e.kind, "offset": e.offset} if bad else {"variant": str(e), "kind": None, "offset": None}
                if self.lost is None or bad and self.lost["failure"]["variant"] != "Codec":
                    self.lost = {**keep, "failure": failure}
            return
        if x["flavor"] == "FileList" and x["platform"] == dims.MACOS:
            self.files.append((x["item"] or 0, x["ordinal"], got["files"]["entries"]))
        if self.won is None:
            self.won = {**keep, **got}

    def row(self) -> dict[str, Any]:
        out = {"payload_id": self.id, "platform": self.first[1], "action": self.verb and self.verb[1], "title": self.title and self.title[1]}
        if self.won is None:
            refused = None if self.refused is None else {"failure": {"variant": "TooLarge", "kind": None, "offset": self.refused}}
            return out | (self.lost or refused or {})
        if self.won["kind"] == "Html" and self.plain is not None:
            out["plain"] = text.decode_plain(self.plain["bytes"] or b"", self.plain["platform"])
        if self.files:
            out["entries"] = [e for _, _, found in sorted(self.files, key=lambda f: f[:2]) for e in found]
        return out | self.won


def enriched(found: DataFrame) -> DataFrame:
    """Transfer action for files, title for links, plain text beside kept markup, and all files of a macOS payload in
    the order of its items, from the columns action, title, plain and entries.
    """
    markup = F.when(F.col("html").isNotNull(), F.struct(F.col("html.markup").alias("markup"), F.coalesce("html.plain", "plain").alias("plain")))
    entries = F.when(F.size("entries") > F.size("files.entries"), F.col("entries")).otherwise(F.col("files.entries"))
    files = F.when(F.col("files").isNotNull(), F.struct(entries.alias("entries"), F.coalesce("action", F.lit("Copy")).alias("action")))
    link = F.when(F.col("link").isNotNull(), F.struct(F.col("link.target_kind").alias("target_kind"), F.col("link.target").alias("target"), F.coalesce("link.title", "title").alias("title")))
    return found.withColumns({"files": files, "link": link, "html": markup}).drop("action", "title", "entries", "plain")


def files_of_paths(paths: Column) -> Column:
    """A file list that copies these paths."""
    return F.struct(F.transform(paths, lambda p: F.struct(F.lit("Path").alias("kind"), p.alias("value"))).alias("entries"), F.lit("Copy").alias("action"))


def is_default(style: Column) -> Column:
    """Whether a style says nothing."""
    on = F.coalesce(style["bold"] | style["italic"] | style["underline"] | style["strike"], F.lit(False))
    return ~on & style["size_pt"].isNull() & style["font_family"].isNull() & style["color"].isNull() & style["background"].isNull()


def is_plain(rich: Column) -> Column:
    """Whether nothing of a rich text is styled."""
    return F.forall(rich["runs"], lambda r: is_default(r["style"]))


def spans(rich: Column) -> Column:
    """array of struct(text, style): the runs with their characters."""
    raw = F.encode(rich["text"], "UTF-8")
    return F.transform(rich["runs"], lambda r: F.struct(F.decode(F.substring(raw, r["start"] + 1, r["end"] - r["start"]), "UTF-8").alias("text"), r["style"].alias("style")))


def plain_text() -> Column:
    """Text that an item stands for, by its arms."""
    return F.coalesce("text", "rich.text", "html.plain", "link.target")


def html_fragment(rich: Column) -> Column:
    """Styled runs as markup: a span with a style for each styled run, bare text otherwise. Native."""

    def css(s: Column) -> Column:
        part = lambda cond, value: F.when(cond, value)
        lines = F.concat_ws(" ", F.when(s["underline"], F.lit("underline")), F.when(s["strike"], F.lit("line-through")))
        return F.array_join(
            F.array_compact(
                F.array(
                    part(s["bold"], F.lit("font-weight:bold")),
                    part(s["italic"], F.lit("font-style:italic")),
                    part(s["underline"] | s["strike"], F.concat(F.lit("text-decoration:"), lines)),
                    part(s["size_pt"].isNotNull(), F.concat(F.lit("font-size:"), F.format_string("%.1f", s["size_pt"]), F.lit("pt"))),
                    part(s["font_family"].isNotNull(), F.concat(F.lit("font-family:'"), s["font_family"], F.lit("'"))),
                    part(s["color"].isNotNull(), F.concat(F.lit("color:#"), s["color"])),
                    part(s["background"].isNotNull(), F.concat(F.lit("background-color:#"), s["background"])),
                )
            ),
            ";",
        )

    def one(r: Column) -> Column:
        piece = F.decode(F.substring(F.encode(rich["text"], "UTF-8"), r["start"] + 1, r["end"] - r["start"]), "UTF-8")
        style = css(r["style"])
        body = html_escape_lines(piece)
        return F.when(style == "", body).otherwise(F.concat(F.lit('<span style="'), F.replace(style, F.lit('"'), F.lit("&quot;")), F.lit('">'), body, F.lit("</span>")))

    return F.array_join(F.transform(rich["runs"], one), "")


def encode_flavor(x: dict[str, Any], flavor: str, platform: str) -> list[bytes]:
    """Bytes of an item in one flavor, one blob a file on macOS; none if the item has nothing for it."""
    kind = x["kind"]
    words = x["text"] if kind == "Text" else x["rich"]["text"] if kind == "RichText" else x["html"]["plain"] if kind == "Html" else x["link"]["target"] if kind == "Link" else None
    if flavor == "PlainText":
        return [] if words is None else [text.encode_plain(words, platform)]
    if flavor == "Rtf" and kind == "RichText":
        raw = x["rich"]["text"].encode()
        return [rtf.write([(raw[r["start"] : r["end"]].decode("utf-8", "replace"), r["style"]) for r in x["rich"]["runs"]])]
    if flavor == "Html" and x.get("_markup") is not None:
        markup = x["_markup"]
        if platform != dims.WINDOWS:
            return [markup.encode()]
        return [_cf_html(markup)]
    if flavor in ("DibV5", "Dib", "Png", "Tiff") and kind == "Image":
        img = x["image"]
        if img["format"] == flavor:
            return [img["pixels"]]
        if img["format"] != "Rgba":
            return []
        f = {"DibV5": bitmap.encode_v5, "Dib": bitmap.encode_dib, "Png": bitmap.encode_png, "Tiff": bitmap.encode_tiff}[flavor]
        return [f(img["width"], img["height"], img["pixels"])]
    if kind == "Files":
        entries, action = x["files"]["entries"], x["files"]["action"]
        uris = [_uri(e) for e in entries]
        verb = "cut" if action == "Move" else "copy"
        if flavor == "FileList":
            if platform == dims.WINDOWS:
                return [records.write_drop_list([e["value"] for e in entries if e["kind"] == "Path"])]
            return [u.encode() for u in uris] if platform == dims.MACOS else ["".join(u + "\r\n" for u in uris).encode()]
        if flavor == "DropEffect":
            return [{"Move": 2, "Link": 4}.get(action, 1).to_bytes(4, "little")]
        if flavor.startswith("x-special/"):
            return ["\n".join([verb, *uris]).encode()]
        if flavor == "application/x-kde-cutselection":
            return [b"1" if verb == "cut" else b"0"]
    if flavor == "FileDescriptor" and kind == "PromisedFiles":
        return [records.write_file_descriptors(x["promised"])]
    if kind == "Link":
        if flavor == "Url":
            return [text.encode_plain(words, platform) if platform == dims.WINDOWS else words.encode() if platform == dims.MACOS else (words + "\r\n").encode()]
        if flavor == "UrlName" and x["link"]["title"]:
            return [x["link"]["title"].encode()]
    return []


def _uri(e: dict[str, str]) -> str:
    from urllib.parse import quote

    if e["kind"] != "Path":
        return e["value"]
    path = quote(e["value"], safe="/!$&'()*+,;=:@-._~")
    return "file://" + (path if path.startswith("/") else "/" + path)


def _cf_html(fragment: str) -> bytes:
    before, after = b"<html><body><!--StartFragment-->", b"<!--EndFragment--></body></html>"
    raw = fragment.encode()
    names = ("StartHTML", "EndHTML", "StartFragment", "EndFragment")
    start = 13 + sum(len(n) + 13 for n in names)
    first = start + len(before)
    at = (start, first + len(raw) + len(after), first, first + len(raw))
    return b"Version:0.9\r\n" + b"".join(f"{n}:{v:010d}\r\n".encode() for n, v in zip(names, at, strict=True)) + before + raw + after


def encode(items: DataFrame, *platforms: str) -> DataFrame:
    """Representations of each item (payload_id and ``ITEM`` columns) for the platforms, in the order of the write plan.

    payload_id, platform, ordinal, item, flavor, native, bytes, fidelity, failure. Unknown items are published as
    they came; an item with an empty plan has a NotPublishable row, one for which nothing could be made
    NothingEncodable. The plan is a small dimension in a broadcast join; the rest is one map over the items.
    """
    spark = items.sparkSession
    plan = dims.write_plan(spark).groupBy("kind", "platform").agg(F.array_sort(F.collect_list(F.struct("position", "flavor", "fidelity"))).alias("plan"))
    markup = F.when(F.col("kind") == "RichText", html_fragment(F.col("rich"))).when(F.col("kind") == "Html", F.col("html.markup"))
    each = items.withColumn("_markup", markup).withColumn("platform", F.explode(F.array(*[F.lit(p) for p in platforms])))
    joined = each.join(F.broadcast(plan), ["kind", "platform"], "left")
    kind = dict(items.dtypes)["payload_id"]
    schema = f"payload_id {kind}, platform string, ordinal int, item int, flavor string, native string, bytes binary, fidelity string, failure string"
    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in records_of(batches):
            yield pa.RecordBatch.from_pylist([r for x in part for r in encoded(x)], arrow)

    rows = joined.select("payload_id", "platform", "kind", *ARMS, "plan", "_markup").mapInArrow(run, schema)
    return rows.withColumn("native", F.coalesce("native", native_name(F.col("flavor"), F.col("platform"))))


def encoded(x: dict[str, Any]) -> list[dict[str, Any]]:
    """Rows of one item for one platform."""
    base = {"payload_id": x["payload_id"], "platform": x["platform"]}
    if x["kind"] == "Unknown":
        return [{**base, "ordinal": 0, "item": 0, "native": x["unknown"]["native"], "bytes": x["unknown"]["bytes"], "fidelity": "Full"}]
    made: list[dict[str, Any]] = []
    for p in x["plan"] or []:
        try:
            blobs = encode_flavor(x, p["flavor"], x["platform"])
        except Bad:
            blobs = []
        many = x["platform"] == dims.MACOS and p["flavor"] == "FileList"
        made += [{**base, "ordinal": len(made) + i, "item": i if many else 0, "flavor": p["flavor"], "bytes": v, "fidelity": p["fidelity"]} for i, v in enumerate(blobs)]
    return made or [{**base, "failure": "NothingEncodable" if x["plan"] else "NotPublishable"}]
