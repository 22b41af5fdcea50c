"""Selection over payloads: resolve identifiers, rank representations, pick, group, and read transfer actions.

``items`` is (payload_id, platform, ordinal, item, native, bytes): one row a representation. The order of a payload
is ``ordinal``; wherever the first one wins, ``ordinal`` says which that is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.targets import copied_files_verb, drop_effect, kde_verb
from ..plans import dims


def native_key(platform: Column, native: Column) -> Column:
    """The identifier to look up: a MIME type goes without parameters."""
    mime = F.trim(F.split(native, ";")[0], F.lit(" \t\r\n"))
    return F.when(platform == dims.UNIX, mime).otherwise(native)


def ostype(native: Column) -> Column:
    """Four-character code behind ``CorePasteboardFlavorType 0x``, else null."""
    code = F.regexp_extract(native, "^CorePasteboardFlavorType 0x([0-9A-Fa-f]{8})$", 1)
    return F.when(code != "", F.decode(F.unhex(code), "ISO-8859-1"))


def flavor_of(platform: Column, native: Column) -> Column:
    """The flavor of an identifier, as one expression over constant maps: no join, no shuffle. Unknown ones are Other."""
    table = F.create_map(*[F.lit(x) for (p, n), f in dims.NATIVE.items() for x in (f"{p}\n{n}", f)])
    codes = F.create_map(*[F.lit(x) for k, f in dims.OSTYPES.items() for x in (k, f)])
    by_name = F.element_at(table, F.concat(platform, F.lit("\n"), native_key(platform, native)))
    by_code = F.when(platform == dims.MACOS, F.element_at(codes, ostype(native)))
    return F.coalesce(by_name, by_code, F.lit("Other"))


def read_rank(flavor: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, v in dims.FLAVORS.items() for x in (k, v[0])]), flavor)


def is_content(flavor: Column) -> Column:
    return ~flavor.isin([k for k, v in dims.FLAVORS.items() if not v[1]])


def native_name(flavor: Column, platform: Column) -> Column:
    """Identifier under which a flavor is published; an unknown flavor is its own identifier."""
    table = [F.lit(x) for k, v in dims.FLAVORS.items() for p, n in zip(dims.PLATFORMS, v[2:], strict=True) if n for x in (f"{p}\n{k}", n)]
    return F.when(flavor.isin(list(dims.FLAVORS)), F.element_at(F.create_map(*table), F.concat(platform, F.lit("\n"), flavor))).otherwise(flavor)


def resolve(items: DataFrame) -> DataFrame:
    """``items`` with flavor, other_name, read_rank and is_content."""
    flavor = flavor_of(F.col("platform"), F.col("native"))
    out = items.withColumn("flavor", flavor)
    return out.withColumns({"other_name": F.when(F.col("flavor") == "Other", F.col("native")), "read_rank": read_rank(F.col("flavor")), "is_content": is_content(F.col("flavor"))})


def first_of(items: DataFrame, flavor: str) -> DataFrame:
    """The first representation with a flavor of each payload."""
    return _top(resolve(items).where(F.col("flavor") == flavor), "ordinal")


def all_of(items: DataFrame, flavor: str) -> DataFrame:
    """payload_id and the natives with a flavor, in order."""
    rows = resolve(items).where(F.col("flavor") == flavor)
    held = F.array_sort(F.collect_list(F.struct("ordinal", "native", "item")))
    return rows.groupBy("payload_id").agg(held.alias("found"))


def group(items: DataFrame, item: int) -> DataFrame:
    return items.where(F.col("item") == item)


def item_count(items: DataFrame) -> DataFrame:
    """payload_id, item_count: the greatest item plus one."""
    return items.groupBy("payload_id").agg(F.coalesce(F.max("item") + 1, F.lit(0)).cast("long").alias("item_count"))


def best(items: DataFrame) -> DataFrame:
    """The content representation of least rank of each payload, the first among equals.

    A minimum over structs, combined before the shuffle: no sort, and only the winners' keys travel.
    """
    rows = resolve(items).where("is_content")
    won = rows.groupBy("payload_id").agg(F.min(F.struct("read_rank", "ordinal", "native", "flavor", "item")).alias("w"))
    return won.select("payload_id", "w.ordinal", "w.item", "w.native", "w.flavor", "w.read_rank")


def push(items: DataFrame, more: DataFrame) -> DataFrame:
    """Append representations; their ordinals must follow."""
    return items.unionByName(more)


def _top(df: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("payload_id").orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def item_action(native: Column, payload: Column) -> Column:
    """The transfer verb that one representation carries, else null."""
    text = F.make_valid_utf8(payload.cast("string"))
    return (
        F.when(native == "Preferred DropEffect", drop_effect(payload))
        .when(native == "application/x-kde-cutselection", F.when(F.hex(F.substring(payload, 1, 1)) == "31", "Move"))
        .when(native.isin("x-special/gnome-copied-files", "x-special/mate-copied-files"), F.element_at(F.create_map(F.lit("Cut"), F.lit("Move"), F.lit("Copy"), F.lit("Copy")), copied_files_verb(text)))
    )


def transfer_action(items: DataFrame) -> DataFrame:
    """payload_id, action: the first verb in order, Copy if there is none."""
    verb = items.withColumn("_verb", item_action(F.col("native"), F.col("bytes")))
    first = F.min(F.when(F.col("_verb").isNotNull(), F.struct("ordinal", "_verb")))
    return verb.groupBy("payload_id").agg(F.coalesce(first["_verb"], F.lit("Copy")).alias("action"))


def targets_to_request(targets: DataFrame, spark: SparkSession) -> DataFrame:
    """Offered targets without those that list, take parameters or have side effects."""
    deny = spark.createDataFrame([(t,) for t in dims.DENIED_TARGETS], "native string")
    return targets.join(F.broadcast(deny), "native", "left_anti")


def gaps_and_islands(runs: DataFrame, key: str, order: str, style: str, start: str, end: str) -> DataFrame:
    """Merge neighbours of one style: (key, style, start, end) of each maximal run."""
    w = Window.partitionBy(key).orderBy(order)
    change = F.when(F.col(style).eqNullSafe(F.lag(style).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    island = runs.withColumn("_c", change).withColumn("_island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(key, "_island").agg(F.first(style).alias(style), F.min(start).alias(start), F.max(end).alias(end)).drop("_island")
