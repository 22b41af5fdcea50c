"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, stored
from .prefix import offsets, ranges

WORD = r"[^\x20\x09-\x0D]+"
#: Weight of a document's expected copies: this plus the bits of its size, so longer texts are taken more often.
BASE = 8


def words(text_col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def levels(rows: DataFrame, within: list[str], weight: str, limit: str, budget: str, tie: str) -> DataFrame:
    """``rows`` with ``_level``: min(limit, _level * weight) adds up to the budget in each group; null if all are full.

    The rows of a group are few (sources, or size classes of a source). The level comes from one pass over them in
    the order in which they fill up: at the first that does not, the budget left over is dealt by weight.
    """
    full = F.col(limit) / F.col(weight)
    rows = rows.withColumn("_full", full)
    fill = Window.partitionBy(*within).orderBy("_full", F.col(tie).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*within)
    spare = F.col(budget) - F.coalesce(F.sum(limit).over(fill), F.lit(0.0))
    open_ = F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(fill), F.lit(0.0))
    rows = rows.withColumn("_try", spare / open_)
    first = F.min(F.when(F.col("_try") <= F.col("_full"), F.struct("_full", "_try"))).over(whole)
    return rows.withColumn("_level", first["_try"]).drop("_try", "_full")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, source_size, target: weights dealt by code point order (null last), filled up to ``cap`` sizes."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("_w", F.element_at(w, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(cap))).withColumn("_budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
    s = levels(s, [], "_w", "_cap", "_budget", "source")
    return s.select("source", "source_size", F.coalesce(F.least("_cap", F.col("_level") * F.col("_w")), "_cap").alias("target"))


def size_class(size: Column) -> Column:
    """Bits of the size: 64 classes at most."""
    return F.length(F.bin(size))


def drawn(id_: Column, text: Column, seed: int) -> Column:
    """The document's uniform number, as 52 bits of a digest of id and text: reruns agree in any layout of the rows."""
    name = F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.lit(str(seed)))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("long")


def rank_odds(mark: Column, p: Column) -> Column:
    """Pareto's rank: the odds of the uniform number over the odds of inclusion; null if nothing is left to chance."""
    u = (mark + F.lit(0.5)) / F.lit(float(1 << 52))
    return F.when(p > 0, (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p)))


def plan(rows: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """source, class, source_size, target, whole, p and the cut of each source, from rows of source, size and mark.

    One row for each source and class of sizes, 64 a source at most. ``rows`` must be cheap to read again. The order
    of all ranks is cut into ranges (``prefix.ranges``) and added up by range; only the range in which a source's
    words run out is looked at row by row.
    """
    rows = rows.withColumn("class", size_class(F.col("size")))
    classes = stored(rows.groupBy("source", "class").agg(F.sum("size").cast("double").alias("words")), "mix-classes")
    goal = targets(classes.groupBy("source").agg(F.sum("words").cast("long").alias("source_size")), weights, share, cap)
    c = classes.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.*", "source_size", "target")
    c = c.withColumns({"_w": (F.col("class") + BASE) * F.col("words"), "_cap": F.col("words") * F.lit(float(cap))})
    filled = levels(c.where("words > 0"), ["source"], "_w", "_cap", "target", "class")
    each = F.coalesce(F.least(F.lit(float(cap)), F.col("_level") * (F.col("class") + BASE)), F.lit(float(cap)))
    filled = filled.withColumn("_each", each).withColumn("whole", F.floor("_each").cast("long")).withColumn("p", F.col("_each") - F.col("whole"))
    left = F.col("target") - F.sum(F.col("whole") * F.col("words")).over(Window.partitionBy("source"))
    none = c.where("words = 0").select("source", "class", "source_size", "target", F.lit(0).cast("long").alias("whole"), F.lit(0.0).alias("p"), F.lit(0.0).alias("left"))
    shares = stored(filled.select("source", "class", "source_size", "target", "whole", "p", left.alias("left")).unionByName(none), "mix-shares")
    few = shares.count()
    # equal marks of a source and size are rows alike: one entry with a number
    same = [F.col("r.source").eqNullSafe(F.col("s.source")), F.col("r.class") == F.col("s.class")]
    ranked = rows.alias("r").join(sized(shares.where("p > 0").alias("s"), few), same).select("r.source", rank_odds(F.col("mark"), F.col("p")).alias("odds"), "mark", "size", "left")
    entries = ranked.groupBy("source", "odds", "mark", "size").agg(F.count(F.lit(1)).alias("n"), F.first("left").alias("left"))
    entries = entries.withColumn("words", F.col("n") * F.col("size")).withColumn("key", F.struct("odds", "mark", "size"))
    ordered = stored(ranges(entries, rows.count(), ["source", "key"], "block"), "mix-order")
    sums = ordered.groupBy("source", "block").agg(F.sum("words").alias("sum"), F.max("key").alias("last"), F.first("left").alias("left"))
    sums = sums.withColumn("_before_last", F.lag("last").over(Window.partitionBy("source").orderBy("block")))
    at = [F.col("a.source").eqNullSafe(F.col("b.source")), F.col("a.block") == F.col("b.block")]
    sums = sums.alias("a").join(offsets(sums, ["source"], "block", "sum", "before").alias("b"), at).select("a.*", "b.before").where("before <= left")
    cut = sums.groupBy("source").agg(F.max_by(F.struct("block", "before", "_before_last"), "block").alias("c")).select("source", "c.*")
    near = ordered.alias("a").join(sized(cut.alias("b"), few), at).select("a.*", "before", "_before_last")
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    # of an entry's rows, as many are in as have half of themselves before the end
    taken = F.least(F.floor((F.col("left") - (upto - F.col("words"))) / F.col("size") + F.lit(0.5)), F.col("n"))
    near = near.withColumn("taken", taken)
    last = near.groupBy("source").agg(F.max_by(F.struct("key", F.col("taken").alias("most"), F.lit(False).alias("all")), F.when(F.col("taken") > 0, F.col("key"))).alias("got"), F.max("_before_last").alias("prior"))
    prior = F.when(F.col("prior").isNotNull(), F.struct(F.col("prior").alias("key"), F.lit(0).cast("long").alias("most"), F.lit(True).alias("all")))
    last = last.select("source", F.coalesce("got", prior).alias("cut"))
    on = F.col("s.source").eqNullSafe(F.col("l.source"))
    return stored(shares.alias("s").join(last.alias("l"), on, "left").select("s.source", "class", "source_size", "target", "whole", "p", "cut"), "mix-plan")


def apply(rows: DataFrame, made: DataFrame, source_col: str, keep: list[str]) -> DataFrame:
    """``keep`` of ``rows`` (with _size and _mark), source_size, target, copies, rank_odds by the plan ``made``.

    A row is in by comparing its rank with its source's cut, so nothing but the plan moves. Only rows that equal the
    cut, which are rows alike, are numbered to take as many of them as there is room for.
    """
    on = [F.col(f"d.`{source_col}`").eqNullSafe(F.col("_m.source")), size_class(F.col("_size")) == F.col("_m.class")]
    odds = rank_odds(F.col("_mark"), F.col("_m.p"))
    cols = [F.col(f"d.`{c}`").alias(c) for c in keep]
    key = F.struct(F.col("_odds").alias("odds"), F.col("_mark").alias("mark"), F.col("_size").alias("size"))
    out = rows.alias("d").join(sized(made.alias("_m"), made.count()), on).select(*cols, F.col(f"d.`{source_col}`").alias("_source"), "_size", "_mark", F.col("_m.source_size").alias("_total"), F.col("_m.target").alias("_target"), F.col("_m.whole").alias("_whole"), F.col("_m.cut").alias("_cut"), odds.alias("_odds"))
    out = out.withColumn("_in", F.coalesce(F.when(F.col("_odds").isNull() | (F.col("_size") == 0), F.lit(0)).when(key < F.col("_cut.key"), 1).when(key > F.col("_cut.key"), 0).when(F.col("_cut.all"), 1), F.when(F.col("_cut").isNull(), 0)))
    tied = out.where("_in IS NULL")
    number = F.row_number().over(Window.partitionBy("_source").orderBy("_mark"))
    tied = tied.withColumn("_in", (number <= F.col("_cut.most")).cast("int"))
    return out.where("_in IS NOT NULL").unionByName(tied).withColumn("_copies", F.when(F.col("_size") > 0, F.col("_whole") + F.col("_in")).otherwise(0).cast("long"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    size: Column | None = None,
) -> DataFrame:
    """How many words of each document the mix takes: ``id_col``, source, size, source_size, target, copies, taken,
    rank_odds.

    A document's expected copies are level * (8 + bits of its size), ``cap`` at most, with the level of its source
    at which the expected words add up to the source's target. The whole part of them it gets for certain; the rest
    p is its inclusion probability, different by size and by source. The documents of a source are ranked by
    Pareto's order, the odds of a uniform number over the odds of p, and the first ones are taken up to the fixed
    size that is left, counted in words: a document is in if at most half of it lies beyond. So the words of a
    source differ from its target by half a document at most. The uniform number is made of id and text, so reruns
    agree whatever the layout; rows with equal id and text are alike, and as many of them are taken as fit.

    Null texts and empty ones have size 0 and take 0; null ids are ids; a null source is a source like others; an
    empty table gives an empty result; other columns are not read.
    """
    n = words(text_col) if size is None else size
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n.alias("size"), drawn(F.col(id_col), F.col(text_col), seed).alias("mark"))
    rows = stored(rows, "mix-sizes")
    out = apply(rows.withColumns({"_size": F.col("size"), "_mark": F.col("mark")}), plan(rows.select("source", "size", "mark"), weights, share, cap), "source", ["id"])
    return out.select(F.col("id").alias(id_col), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"), F.col("_odds").alias("rank_odds"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, each as often as ``mix_sources`` takes it. Texts are read twice but never shuffled."""
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"), words(text_col).alias("_size"), drawn(F.col(id_col), F.col(text_col), seed).alias("_mark")
    )
    sizes = stored(own.select("source", F.col("_size").alias("size"), F.col("_mark").alias("mark")), "mix-sizes")
    out = apply(own, plan(sizes, weights, share, cap), "source", ["row"]).where("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) || ':17'), 1, 13))::BIGINT AS mark FROM documents),
e AS (SELECT *, length(bin(size)) AS class FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS wt FROM s),
c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / wt AS lim FROM w),
f AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER p, 0)) / (sum(wt) OVER () - coalesce(sum(wt) OVER p, 0)) AS lvl
  FROM c WINDOW p AS (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(lvl, lim) AS lvl FROM f WHERE lvl <= lim),
g AS (SELECT source, source_size, coalesce(least(cap, l.lvl * wt), cap)::DOUBLE AS target FROM c, l),
k AS (SELECT e.source, class, any_value(target) AS target, any_value(source_size) AS source_size, sum(size)::DOUBLE AS words FROM e JOIN g ON e.source IS NOT DISTINCT FROM g.source GROUP BY e.source, class HAVING sum(size) > 0),
kw AS (SELECT *, (class + 8) * words AS w, words * 2.0::DOUBLE AS cap FROM k),
kf AS (SELECT *, cap / w AS lim, (target - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER q - coalesce(sum(w) OVER p, 0)) AS lvl
  FROM kw WINDOW p AS (PARTITION BY source ORDER BY cap / w, class ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (PARTITION BY source)),
kl AS (SELECT source, arg_min(lvl, lim) FILTER (lvl <= lim) AS lvl FROM kf GROUP BY source),
h AS (SELECT kf.*, coalesce(least(2.0::DOUBLE, kl.lvl * (class + 8)), 2.0::DOUBLE) AS expected FROM kf JOIN kl ON kf.source IS NOT DISTINCT FROM kl.source),
i AS (SELECT *, floor(expected) AS whole, expected - floor(expected) AS p FROM h),
j AS (SELECT *, target - sum(whole * words) OVER (PARTITION BY source) AS rest FROM i),
o AS (SELECT e.*, j.whole, j.rest, j.p, ((mark + 0.5::DOUBLE) / 4503599627370496::DOUBLE) AS u FROM e JOIN j ON e.source IS NOT DISTINCT FROM j.source AND e.class = j.class WHERE size > 0),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY (u / (1.0::DOUBLE - u)) / (p / (1.0::DOUBLE - p)), mark, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM o WHERE p > 0)
SELECT d.doc_id, d.size, g.source_size, g.target,
       (coalesce(o.whole, 0) * d.size + CASE WHEN 2 * r.upto - d.size <= 2 * r.rest THEN d.size ELSE 0 END)::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source LEFT JOIN o ON o.doc_id = d.doc_id LEFT JOIN r ON r.doc_id = d.doc_id
"""
