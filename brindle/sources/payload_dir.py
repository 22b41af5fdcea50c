"""Folders of captured payloads: a ``.bin`` file with the bytes beside a ``.json`` file that describes it.

Tasks list large folders and read the files, so the driver never holds the names of many; what lacks its partner is
reported, not lost. The description is checked as data: every problem of it, not the first.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import nullcontext
from itertools import islice
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.core import PIECE_BYTES, PIECE_ROWS, Bad, decoder, spread
from ..functions.targets import canonical_kind, kind_from_notes, safe_stem
from ..operators.payload import resolve

MAX_PAYLOAD, MAX_SIDECAR = 256 << 10, 64 << 10
# Keys that a description may have, besides those beginning with ``expect_``.
KEYS = "format origin description expect notes error_kind os os_version app app_version how captured_at flavor bytes item redacted leak_allow leak_allow_reason".split()
REQUIRED = ("format", "origin", "description", "expect")


#: Levels of folders whose contents are dealt over tasks; a deeper folder is walked by the task that has it. Names a batch has.
LEVELS, NAMES = 2, 10_000
#: Files that the driver lists at most, for Spark's reader.
MOST_LISTED = 10_000


def stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def pairs(spark: SparkSession, root: str, most_listed: int = MOST_LISTED) -> DataFrame:
    """stem, bytes, sidecar, size, state: paired, no_sidecar or no_payload. Hidden files and readmes are passed over.

    Of a folder with more than ``most_listed`` files tasks list the names and deal them by stem; each pair is then read
    where its stem is, so no content moves. Spark's reader, which lists on the driver, reads smaller ones, and also
    stores that Arrow can't open, patterns and single files, whatever their number.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    path = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path)
    uri = path.toUri().toString()
    large = _is_folder(path) and (most_listed <= 0 or _listed(spark, uri).limit(most_listed + 1).count() > most_listed)
    both = _read(spark, uri, path.toString()) if large else _scanned(spark, root)
    state = F.when(F.col("sidecar").isNull(), "no_sidecar").when(F.col("bytes").isNull(), "no_payload").otherwise("paired")
    return both.select("stem", "bytes", "sidecar", F.octet_length("bytes").cast("long").alias("size"), state.alias("state"))


def _is_folder(path: Any) -> bool:
    """Whether a Hadoop path is a folder that Arrow can open."""
    if re.search(r"[*?{\[]", path.toString()):
        return False
    try:
        fs, top = filesystem(path.toUri().toString())
        return fs.get_file_info(top).type == pafs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def _short(path: str) -> str:
    return re.sub("^([A-Za-z0-9]+):/+", r"\1:/", path)


def _inside(fs: pafs.FileSystem, top: str, name: str) -> Iterator[tuple[str, bool]]:
    """(name, whether it is a folder) of what a folder below ``top`` has, without what Spark's readers pass over."""
    for x in fs.get_file_info(pafs.FileSelector(top + name)):
        base, folder = x.base_name, x.type == pafs.FileType.Directory
        if base.startswith(".") or base.startswith("_") and "=" not in base and not base.startswith(("_metadata", "_common_metadata")) or base.endswith("._COPYING_"):
            continue
        if folder or base.endswith((".bin", ".json")):
            yield f"{name}/{base}", folder


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """name, folder (false) of every file below ``root`` that may be of a pair."""

    def level(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def found(fs: pafs.FileSystem, top: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bool]]:
            for b in batches:
                for name, folder in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if not folder:
                        yield name, False
                        continue
                    todo = [name]
                    while todo:
                        for x in _inside(fs, top, todo.pop()):
                            if whole and x[1]:
                                todo.append(x[0])
                            else:
                                yield x

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, top = filesystem(root)
            names = found(fs, top.rstrip("/"), batches)
            while part := list(islice(names, NAMES)):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], t) for k, t in enumerate((pa.string(), pa.bool_()))], ["name", "folder"])

        return run

    out = spark.range(0, 1, 1, 1).select(F.lit("").alias("name"), F.lit(True).alias("folder"))
    for _ in range(LEVELS):
        out = spread(out.mapInArrow(level(False), "name string, folder boolean"), "name")
    return out.mapInArrow(level(True), "name string, folder boolean")


def _read(spark: SparkSession, root: str, shown: str) -> DataFrame:
    """stem, bytes, sidecar of the files below ``root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(root)
        top, prefix = top.rstrip("/"), _short(shown).rstrip("/")
        for b in batches:
            done: list[tuple] = []
            size = 0
            for name, *there in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = []
                for kind, has in zip(("bin", "json"), there, strict=True):
                    with fs.open_input_file(f"{top}{name}.{kind}") if has else nullcontext() as f:
                        got.append(f.read() if has else None)
                done.append((prefix + name, *got))
                size += sum(len(x) for x in got if x)
                if len(done) == PIECE_ROWS or size > PIECE_BYTES:
                    yield batch(done)
                    done, size = [], 0
            yield batch(done)

    def batch(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.binary(), pa.binary()))], ["stem", "bytes", "sidecar"])

    names = _listed(spark, root).select("name", stem(F.col("name")).alias("stem"))
    has = lambda suffix: F.bool_or(F.col("name").endswith(suffix))
    held = spread(names, "stem").groupBy("stem").agg(has(".bin").alias("bin"), has(".json").alias("json"))
    return held.mapInArrow(run, "stem string, bytes binary, sidecar binary").withColumn("sidecar", F.col("sidecar").cast("string"))


def _scanned(spark: SparkSession, root: str) -> DataFrame:
    """stem, bytes, sidecar by Spark's reader."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{bin,json}").load(root)
    short = F.regexp_replace("path", "^([A-Za-z0-9]+):/+", "$1:/").alias("path")
    # a scan passes over empty files, so every file also comes, empty, from the listing that it was planned with; the
    # names go from the index to rows inside the JVM
    jvm = spark.sparkContext._jvm
    names = spark._jsparkSession.createDataset(jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(d._jdf.inputFiles()), jvm.org.apache.spark.sql.Encoders.STRING())
    listed = DataFrame(names.toDF(), spark).select(F.url_decode(F.replace("value", F.lit("+"), F.lit("%2B"))).alias("path"))
    found = d.select(short, "content").unionByName(listed.select(short, F.lit(b"").alias("content")))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    found = found.where(~name.startswith(".") & (F.lower(name) != "readme.md"))
    of = lambda suffix: F.max(F.when(F.col("path").endswith(suffix), F.col("content")))
    return found.groupBy(stem(F.col("path")).alias("stem")).agg(of(".bin").alias("bytes"), of(".json").cast("string").alias("sidecar"))


def strict_object(source: str) -> list[dict[str, str]]:
    """A flat JSON object as (key, value, kind) in order: no nesting but flat lists, no duplicate keys, no lone
    surrogates, no raw control characters. Numbers keep their spelling.
    """

    def members(found: list[tuple[str, Any]]) -> dict[str, Any]:
        keys = [k for k, _ in found]
        if len(set(keys)) < len(keys):
            raise Bad("Malformed", 0)
        return dict(found)

    class Number(str):
        __slots__ = ()

    try:
        got = json.loads(source, object_pairs_hook=members, parse_int=Number, parse_float=Number, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except json.JSONDecodeError as e:
        raise Bad("Malformed", len(source[: e.pos].encode("utf-8", "surrogatepass"))) from None
    except (ValueError, RecursionError):
        raise Bad("Malformed", 0) from None
    if not isinstance(got, dict):
        raise Bad("Malformed", 0)
    out = []
    for k, v in got.items():
        flat = v if isinstance(v, list) else [v]
        if any(isinstance(x, (dict, list)) for x in flat):
            raise Bad("Unsupported", 0)
        for x in (k, *flat):
            if isinstance(x, str) and re.search("[\ud800-\udfff]", x):
                raise Bad("InvalidUtf16", 0)
        kind = "list" if isinstance(v, list) else "null" if v is None else "bool" if isinstance(v, bool) else "number" if isinstance(v, Number) else "string"
        text = None if v is None else ("true" if v else "false") if isinstance(v, bool) else json.dumps([str(x) for x in v], ensure_ascii=False) if isinstance(v, list) else str(v)
        out.append({"key": k, "value": text, "kind": kind})
    return out


sidecar_object = decoder(strict_object, "array<struct<key:string,value:string,kind:string>>")


def judged(paired: DataFrame) -> DataFrame:
    """``paired`` with every problem of its description in ``problems``."""
    p = paired.withColumn("o", sidecar_object("sidecar")).withColumn("m", F.map_from_entries(F.transform(F.coalesce("o.value", F.array().cast("array<struct<key:string,value:string,kind:string>>")), lambda e: F.struct(e["key"], e["value"]))))
    get = lambda k: F.element_at("m", k)
    unknown = F.filter(F.map_keys("m"), lambda k: ~k.isin(KEYS) & ~k.startswith("expect_"))
    captured = get("origin") == "captured"
    say = lambda cond, text: F.when(F.coalesce(cond, F.lit(False)), F.lit(text))
    found = F.array(
        say(F.col("o.error").isNotNull(), "not a flat object"),
        *[say(F.col("o.error").isNull() & get(k).isNull(), f"missing {k}") for k in REQUIRED],
        F.when(F.size(unknown) > 0, F.concat(F.lit("unknown key "), F.array_join(unknown, ", "))),
        say(~get("origin").isin("synthetic", "captured"), "origin is neither synthetic nor captured"),
        say(~get("expect").isin("ok", "error"), "expect is neither ok nor error"),
        *[say(captured & get(k).isNull(), f"captured without {k}") for k in ("os", "app", "how")],
        say(get("leak_allow").isNull() != get("leak_allow_reason").isNull(), "leak_allow and its reason go together"),
        say(get("error_kind").isNotNull() & canonical_kind(get("error_kind")).isNull(), "unknown error kind"),
        say(F.size(F.array_distinct(F.regexp_extract_all(get("notes"), F.lit("ErrorKind::([A-Za-z0-9]+)"), F.lit(1)))) > 1, "notes name several error kinds"),
        say(get("bytes").try_cast("bigint") != F.col("size"), "bytes differs from the payload's length"),
        say(F.col("size") > MAX_PAYLOAD, "payload too large"),
        say(F.octet_length("sidecar") > MAX_SIDECAR, "description too large"),
    )
    return p.select(*paired.columns, F.array_compact(found).alias("problems"))


def problems(paired: DataFrame) -> DataFrame:
    """stem and every problem of its description, one row each."""
    return judged(paired).select("stem", F.explode("problems").alias("problem"))


def expected_kind(sidecar: Column) -> Column:
    """The error kind that a description promises: stated, or the one its notes name."""
    get = lambda k: F.get_json_object(sidecar, f"$.{k}")
    return F.coalesce(canonical_kind(get("error_kind")), canonical_kind(get("expect_error_kind")), kind_from_notes(get("notes")))


def stems(items: DataFrame) -> DataFrame:
    """``items`` with a file stem each, unique in its payload whatever the case: later ones get -2, -3 and so on."""
    base = items.withColumn("_stem", safe_stem("native"))
    w = Window.partitionBy("payload_id", F.lower("_stem")).orderBy("ordinal")
    n = F.row_number().over(w)
    return base.withColumn("stem", F.when(n == 1, F.col("_stem")).otherwise(F.concat("_stem", F.lit("-"), n.cast("string")))).drop("_stem")


def described(items: DataFrame, origin: str = "captured", source: str = "", os: str = "", app: str = "", app_version: str = "", how: str = "", notes: str = "") -> DataFrame:
    """``items`` with stem and sidecar, a description with its keys in a fixed order; unknown fields stay as blanks."""
    rows = resolve(stems(items))
    flavor = F.when(F.col("flavor") != "Other", F.col("flavor"))
    fields = F.struct(
        F.col("native").alias("format"),
        flavor.alias("flavor"),
        F.lit(origin).alias("origin"),
        F.concat("native", F.lit(" from "), F.lit(source) if source else F.col("platform")).alias("description"),
        F.lit("ok").alias("expect"),
        *[F.lit(v).alias(k) for k, v in (("os", os), ("app", app), ("app_version", app_version), ("how", how))],
        F.octet_length("bytes").alias("bytes"),
        F.col("item"),
        F.lit(False).alias("redacted"),
        F.lit(notes).alias("notes"),
    )
    return rows.select(*items.columns, "stem", F.to_json(fields, {"ignoreNullFields": "false"}).alias("sidecar"))


def write(items: DataFrame, root: str, force: bool = False, **about: str) -> int:
    """Sink: ``root/payload_id/stem.bin`` and ``.json`` for each representation with bytes; the number of pairs.

    Every task writes its own rows' files. Unless ``force`` is set nothing is written if any of the files is there
    already: a capture that half replaces another is worse than none. Files are written whole under another name and
    then renamed, so a task that is run again does no harm.
    """
    rows = described(spread(items, "payload_id"), **about).where("bytes IS NOT NULL").select(F.concat_ws("/", F.col("payload_id").cast("string"), "stem").alias("name"), "bytes", "sidecar")

    def there(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(root)
        if fs.get_file_info(top).type == pafs.FileType.NotFound:
            return
        for b in batches:
            paths = [f"{n}.{kind}" for n in b.column(0).to_pylist() for kind in ("bin", "json")]
            infos = fs.get_file_info([f"{top}/{p}" for p in paths])
            yield pa.RecordBatch.from_arrays([pa.array([p for p, i in zip(paths, infos, strict=True) if i.type != pafs.FileType.NotFound], pa.string())], ["name"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(root)
        for b in batches:
            for x in b.to_pylist():
                fs.create_dir(f"{top}/{x['name'].rpartition('/')[0]}", recursive=True)
                for kind, data in (("bin", bytes(x["bytes"])), ("json", x["sidecar"].encode())):
                    new = f"{top}/{x['name']}.{kind}.{uuid.uuid4().hex}.new"
                    with fs.open_output_stream(new, compression=None) as f:
                        f.write(data)
                    fs.move(new, f"{top}/{x['name']}.{kind}")
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    if not force:
        clash = rows.select("name").mapInArrow(there, "name string").limit(10).collect()
        if clash:
            raise FileExistsError("would overwrite " + ", ".join(r.name for r in clash))
    return rows.mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if ":/" in root else (pafs.LocalFileSystem(), root)
