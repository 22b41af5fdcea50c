"""Queries that SQL can say too: each has its DataFrame form and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import limits, scan, targets
from ..functions.core import spread
from ..operators import payload
from . import dims


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", targets.scheme("url").alias("scheme"))


def url_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(targets.classify("url").alias("target")).agg(F.count(F.lit(1)).alias("n"))


def path_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    shape = F.element_at(F.array(*[F.lit(x) for x in ("/", "\\\\srv\\", "C:\\", "x:", "mailto:", "")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    return p.select("p_partkey", targets.classify(F.concat(shape, F.col("p_name"))).alias("target"))


def url_is_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", targets.is_file("url").alias("is_file"), targets.is_local_file(F.concat(F.lit("FILE://localhost/"), F.col("page_id").cast("string"))).alias("local"))


def url_percent_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.concat(F.col("url"), F.element_at(F.array(F.lit("%41"), F.lit("%4"), F.lit("%zz"), F.lit("")), (F.col("page_id") % 4 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", targets.percent_valid(u).alias("valid"))


def url_percent_encode_unreserved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", targets.percent_encode_unreserved("url").alias("encoded"))


def text_percent_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = targets.percent_encode_unreserved("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(c.cast("binary")).alias("md5"), F.octet_length(c).cast("long").alias("n"))


def percent_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = targets.percent_decode_lossy(targets.percent_encode_path("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("path"))


def file_uri(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", targets.file_uri("p_name").alias("uri"))


def line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(targets.lines("text")).cast("long").alias("n"))


def line_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(targets.lines("text")).alias("at", "line"))
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("at").cast("long").alias("last"), F.sum(F.length("line")).cast("long").alias("chars"))


def urilist_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).alias("list")).agg(F.array_sort(F.collect_list(targets.file_uri("p_name"))).alias("u"))
    back = targets.uris(targets.write_uri_list("u"))
    return lists.select("list", F.size(back).cast("long").alias("n"), (back == F.col("u")).alias("same"), F.octet_length(targets.write_uri_list("u")).cast("long").alias("bytes"))


def gnome_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "part").groupBy((F.col("p_partkey") % 50).alias("list")).agg(F.array_sort(F.collect_list(targets.file_uri("p_name"))).alias("u"))
    verb = F.when(F.col("list") % 2 == 0, "Cut").otherwise("Copy")
    blob = targets.write_copied_files(verb, "u")
    return lists.select("list", targets.copied_files_verb(blob).alias("verb"), (targets.copied_files_uris(blob) == F.col("u")).alias("same"))


def kde_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", targets.kde_verb((F.col("n_nationkey") % 3).cast("string").cast("binary")).alias("verb"))


def drop_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.unhex(F.concat(F.lpad(F.hex(F.col("n_nationkey").cast("long") % 8), 2, "0"), F.lit("000000")))
    return table(spark, sf_dir, "nation").select("n_nationkey", targets.drop_effect(word).alias("action"))


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(targets.html_escape_lines("text").cast("binary")).alias("md5"))


def cf_html_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    blob = targets.cf_html("html")
    at = lambda n: F.regexp_extract(blob, n + ":([0-9]{10})", 1).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", at("StartHTML").alias("start_html"), at("EndHTML").alias("end_html"), at("StartFragment").alias("start_fragment"), at("EndFragment").alias("end_fragment"), F.octet_length(blob).cast("long").alias("bytes"))


def cf_html_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(targets.cf_html_fragment(targets.cf_html("html")).cast("binary")).alias("md5"))


def idlist_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode("n_name", "UTF-8")
    text = targets.idlist_encode(raw)
    back = targets.idlist_decode(text)
    return table(spark, sf_dir, "nation").select("n_nationkey", text.alias("text"), targets.checksum(raw).cast("long").alias("checksum"), F.decode(back["value"], "UTF-8").alias("back"), back["error"].isNull().alias("ok"))


def filetime_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = targets.filetime_from_unix(F.unix_timestamp("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", ticks.cast("long").alias("ticks"), targets.filetime_unix_seconds(ticks).alias("seconds"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of five representations each, for customers: the identifiers turn with the key."""
    names = [(p, n) for p, n in dims.NATIVE] + [(p, "application/x-unheard") for p in dims.PLATFORMS]
    c = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("payload_id")), "payload_id").select("payload_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("ordinal"))
    c = c.withColumn("k", ((F.col("payload_id") * 7 + F.col("ordinal") * 11) % len(names)).cast("int"))
    pairs = F.array(*[F.struct(F.lit(p).alias("platform"), F.lit(n).alias("native")) for p, n in names])
    c = c.withColumn("x", F.get(pairs, "k"))
    return c.select("payload_id", "x.platform", "ordinal", F.lit(0).alias("item"), "x.native", F.encode(F.col("x.native"), "UTF-8").alias("bytes"))


_NAMES = [(i, p, n, f, *dims.FLAVORS[f][:2]) for i, (p, n, f) in enumerate([(p, n, f) for (p, n), f in dims.NATIVE.items()] + [(p, "application/x-unheard", "Other") for p in dims.PLATFORMS])]
_ITEMS_SQL = f"""WITH names AS {dims.values_sql(_NAMES, "k, platform, native, flavor, read_rank, is_content")},
items AS (SELECT c_custkey AS payload_id, o.ordinal, n.* FROM customer, (SELECT unnest([0,1,2,3,4]) AS ordinal) o JOIN names n ON n.k = (c_custkey * 7 + o.ordinal * 11) % {len(_NAMES)})
"""


def flavor_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = payload.resolve(_items(spark, sf_dir))
    return r.select("payload_id", F.col("ordinal").cast("long").alias("ordinal"), "flavor", "is_content")


def flavor_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = payload.resolve(_items(spark, sf_dir))
    return r.groupBy("flavor").agg(F.count(F.lit(1)).alias("n"), F.max("read_rank").cast("long").alias("read_rank"))


def payload_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.best(_items(spark, sf_dir)).select("payload_id", F.col("ordinal").cast("long").alias("ordinal"), "native", "flavor")


def payload_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.first_of(_items(spark, sf_dir), "PlainText").select("payload_id", F.col("ordinal").cast("long").alias("ordinal"), "native")


def payload_item_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("payload_id"), (F.col("l_linenumber") - 1).alias("item"))
    return payload.item_count(i)


def transfer_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    kinds = F.array(*[F.struct(F.lit(a).alias("native"), F.unhex(F.lit(b)).alias("bytes")) for a, b in _ACTIONS])
    rows = n.select(F.col("n_nationkey").alias("payload_id"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("ordinal"))
    rows = rows.withColumn("x", F.get(kinds, ((F.col("payload_id") * 5 + F.col("ordinal") * 3) % len(_ACTIONS)).cast("int"))).select("payload_id", "ordinal", "x.*")
    return payload.transfer_action(rows)


_ACTIONS = [
    ("text/plain", "78"),
    ("Preferred DropEffect", "03000000"),
    ("Preferred DropEffect", "01000000"),
    ("application/x-kde-cutselection", "31"),
    ("application/x-kde-cutselection", "30"),
    ("x-special/gnome-copied-files", b"cut\nfile:///a".hex()),
    ("x-special/gnome-copied-files", b"COPY\nfile:///a".hex()),
    ("Preferred DropEffect", "04000000"),
]
_VERBS = [None, "Move", "Copy", "Move", None, "Move", "Copy", "Link"]


def write_plan_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in dims.KINDS])
    who = F.array(*[F.lit(p) for p in dims.PLATFORMS])
    c = table(spark, sf_dir, "supplier").select("s_suppkey", F.get(kinds, (F.col("s_suppkey") % len(dims.KINDS)).cast("int")).alias("kind"), F.get(who, (F.col("s_suppkey") % 3).cast("int")).alias("platform"))
    plan = dims.write_plan(spark)
    return c.join(F.broadcast(plan), ["kind", "platform"]).select("s_suppkey", "kind", "platform", F.col("position").cast("long").alias("position"), "flavor", "fidelity", payload.native_name(F.col("flavor"), F.col("platform")).alias("native"))


def leak_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.filter(F.regexp_extract_all(F.col("text"), F.lit(f"({scan.EMAIL})"), F.lit(1)), scan.email_ok)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(hits).cast("long").alias("n"))


def leak_hexrun(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.regexp_extract_all(F.col("text"), F.lit(f"({scan.HEX_RUN})"), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(hits).cast("long").alias("n"), F.array_join(hits, "|").alias("hits"))


def leak_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("id "), F.regexp_replace(F.md5(F.col("o_orderkey").cast("string").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(" end"))
    hits = F.filter(F.regexp_extract_all(made, F.lit(f"({scan.UUID})"), F.lit(1)), scan.uuid_ok)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(hits, F.lit(0)).alias("uuid"))


def leak_homepath(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.get(F.array(*[F.lit(x) for x in ("alice", "mrossi", "root", "k.tanaka")]), (F.col("c_custkey") % 4).cast("int"))
    text = F.concat(F.lit("see /Users/"), who, F.lit("/x and C:\\Users\\"), who, F.lit("\\y"))
    found = scan.findings(scan.latin1_view(F.encode(text, "UTF-8")))
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(F.filter(found, lambda f: f["rule"] == "HomePath")).cast("long").alias("n"))


def encoded_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a percent-encoded text, told without encoding it."""
    return table(spark, sf_dir, "documents").select("doc_id", targets.encoded_len("text", "unreserved").cast("long").alias("n"))


def limits_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").groupBy(limits.rejects(size, 4096).alias("refused")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).cast("long").alias("bytes"))


def budget_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.octet_length("props").cast("long").alias("n"))
    return limits.budget(e, ["user_id"], ["event_id"], "n", 100).select("user_id", "event_id", "spent", "accepted", "is_exhausted")


def runs_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring events of one type, by user."""
    r = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.col("event_id").alias("s"), (F.col("event_id") + 1).alias("e"))
    return payload.gaps_and_islands(r, "user_id", "event_id", "event_type", "s", "e")


def locale_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array(*[F.lit(x) for x in ("de", "de_AT", "de_AT.UTF-8", "sr_YU@Latn", "sr@Latn", "pt_BR.UTF-8@x")])
    c = table(spark, sf_dir, "customer").select("c_custkey", F.get(tags, (F.col("c_custkey") % 6).cast("int")).alias("tag"))
    return c.select("c_custkey", "tag", F.array_join(targets.locale_candidates("tag"), ",").alias("rungs"))


def ini_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first value of a key under the section that a line is in: every third event of a user opens a section."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), F.col("event_type"), F.lit("]"))).otherwise(F.concat(F.lit("k="), F.col("event_id").cast("string"))).alias("line"))
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    name = F.regexp_extract("line", r"^\[(.*)\]$", 1)
    s = e.withColumn("section", F.last(F.when(name != "", name), True).over(w)).where(F.col("line").startswith("k="))
    return s.groupBy("user_id", "section").agg(F.min_by(F.substring_index("line", "=", -1), "event_id").alias("value"))


def text_utf8_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.make_valid_utf8(raw.cast("string")).cast("binary")).alias("md5"))


def dos_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    date = ((F.year("o_orderdate") - 1980) * 512 + F.month("o_orderdate") * 32 + F.dayofmonth("o_orderdate")).cast("int")
    d = targets.dos_datetime(date, F.lit(0))
    return o.select("o_orderkey", d["year"].cast("long").alias("y"), d["month"].cast("long").alias("m"), d["day"].cast("long").alias("d"))


def side_effecting_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    offered = table(spark, sf_dir, "supplier").select("s_suppkey", F.get(F.array(*[F.lit(x) for x in (*dims.DENIED_TARGETS, "text/html", "text/plain")]), (F.col("s_suppkey") % 8).cast("int")).alias("native"))
    return payload.targets_to_request(offered, spark).select("s_suppkey", "native")


QUERIES = {
    f.__name__: f
    for f in (
        url_scheme, url_classify, path_classify, url_is_file, url_percent_valid, url_percent_encode_unreserved, text_percent_encode, percent_roundtrip, file_uri, line_count, line_split,
        urilist_roundtrip, gnome_roundtrip, kde_verbs, drop_effects, html_escape, cf_html_offsets, cf_html_roundtrip, idlist_roundtrip, filetime_roundtrip, flavor_resolve, flavor_rank,
        payload_best, payload_get, payload_item_count, transfer_action, write_plan_fanout, leak_email, leak_hexrun, leak_uuid, leak_homepath, limits_reject, budget_running, runs_merge, encoded_lengths,
        locale_fallback, ini_lookup, text_utf8_roundtrip, dos_dates, side_effecting_targets,
    )
}

_CLASS = r"CASE WHEN {0} = '' THEN 'Unresolved' WHEN regexp_matches({0}, '^(/|\\\\|[A-Za-z]:[\\/])') THEN 'Path' WHEN regexp_matches({0}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'Url' ELSE 'Unresolved' END"
_LINES = r"(CASE WHEN text = '' THEN [] WHEN list_last(regexp_split_to_array(text, '\r\n|\r|\n')) = '' THEN regexp_split_to_array(text, '\r\n|\r|\n')[:-2] ELSE regexp_split_to_array(text, '\r\n|\r|\n') END)"
_URI = "'file:///' || replace(replace(url_encode(p_name), '%2F', '/'), '%3A', ':')"
_PLAN = [(k, p, i, f, dims.FIDELITY[x], dict(zip(dims.PLATFORMS, dims.FLAVORS[f][2:], strict=True)).get(p) if f in dims.FLAVORS else f) for (k, p), plan in dims.WRITE_PLAN.items() for i, (f, x) in enumerate(plan)]

ORACLES = {
    "url_scheme": "SELECT page_id, nullif(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1), '') AS scheme FROM pages",
    "url_classify": f"SELECT {_CLASS.format('url')} AS target, count(*) AS n FROM pages GROUP BY 1",
    "path_classify": f"SELECT p_partkey, {_CLASS.format('s')} AS target FROM (SELECT p_partkey, ['/', '\\\\srv\\', 'C:\\', 'x:', 'mailto:', ''][p_partkey % 6 + 1] || p_name AS s FROM part)",
    "url_is_file": "SELECT page_id, starts_with(lower(url), 'file:') AS is_file, TRUE AS local FROM pages",
    "url_percent_valid": "SELECT page_id, length(replace(u, '%', '')) + 3 * len(regexp_extract_all(u, '%[0-9A-Fa-f][0-9A-Fa-f]')) - 2 * len(regexp_extract_all(u, '%[0-9A-Fa-f][0-9A-Fa-f]')) = length(u) AS valid FROM (SELECT page_id, url || ['%41', '%4', '%zz', ''][page_id % 4 + 1] AS u FROM pages)",
    "url_percent_encode_unreserved": "SELECT page_id, url_encode(url) AS encoded FROM pages",
    "text_percent_encode": "SELECT doc_id, md5(url_encode(text)) AS md5, length(url_encode(text)) AS n FROM documents",
    "percent_roundtrip": "SELECT p_partkey, p_name AS path FROM part",
    "file_uri": f"SELECT p_partkey, {_URI} AS uri FROM part",
    "line_count": f"SELECT doc_id, len({_LINES}) AS n FROM documents",
    "line_split": f"SELECT doc_id, count(*) AS n, max(pos)::BIGINT AS last, sum(length(line))::BIGINT AS chars FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM (SELECT doc_id, {_LINES} AS l FROM documents)) GROUP BY doc_id",
    "urilist_roundtrip": f"SELECT p_partkey % 50 AS list, count(*) AS n, TRUE AS same, sum(length({_URI}) + 2)::BIGINT AS bytes FROM part GROUP BY 1",
    "gnome_roundtrip": "SELECT p_partkey % 50 AS list, CASE WHEN (p_partkey % 50) % 2 = 0 THEN 'Cut' ELSE 'Copy' END AS verb, TRUE AS same FROM part GROUP BY 1, 2",
    "kde_verbs": "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 1 THEN 'Cut' ELSE 'Copy' END AS verb FROM nation",
    "drop_effects": "SELECT n_nationkey, CASE WHEN (n_nationkey % 8) & 2 <> 0 THEN 'Move' WHEN (n_nationkey % 8) & 1 <> 0 THEN 'Copy' WHEN (n_nationkey % 8) & 4 <> 0 THEN 'Link' END AS action FROM nation",
    "html_escape": "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(10), '<br>')) AS md5 FROM documents",
    "cf_html_offsets": "SELECT page_id, 105::BIGINT AS start_html, (169 + n)::BIGINT AS end_html, 137::BIGINT AS start_fragment, (137 + n)::BIGINT AS end_fragment, (169 + n)::BIGINT AS bytes FROM (SELECT page_id, octet_length(encode(html)) AS n FROM pages)",
    "cf_html_roundtrip": "SELECT page_id, md5(html) AS md5 FROM pages",
    "idlist_roundtrip": "SELECT n_nationkey, hex(n_name) || upper(printf('%02x', c)) AS text, c AS checksum, n_name AS back, TRUE AS ok FROM (SELECT *, (list_sum(list_transform(string_split(n_name, ''), lambda x: ord(x))) % 256)::BIGINT AS c FROM nation)",
    "filetime_roundtrip": "SELECT o_orderkey, (epoch(o_orderdate)::BIGINT * 10000000 + 116444736000000000)::BIGINT AS ticks, epoch(o_orderdate)::BIGINT AS seconds FROM orders",
    "flavor_resolve": _ITEMS_SQL + "SELECT payload_id, ordinal::BIGINT AS ordinal, flavor, is_content FROM items",
    "flavor_rank": _ITEMS_SQL + "SELECT flavor, count(*) AS n, max(read_rank)::BIGINT AS read_rank FROM items GROUP BY flavor",
    "payload_best": _ITEMS_SQL + "SELECT payload_id, ordinal::BIGINT AS ordinal, native, flavor FROM (SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY read_rank, ordinal) AS r FROM items WHERE is_content) WHERE r = 1",
    "payload_get": _ITEMS_SQL + "SELECT payload_id, ordinal::BIGINT AS ordinal, native FROM (SELECT *, row_number() OVER (PARTITION BY payload_id ORDER BY ordinal) AS r FROM items WHERE flavor = 'PlainText') WHERE r = 1",
    "payload_item_count": "SELECT l_orderkey AS payload_id, max(l_linenumber)::BIGINT AS item_count FROM lineitem GROUP BY 1",
    "transfer_action": f"WITH a AS {dims.values_sql([(i, v) for i, v in enumerate(_VERBS)], 'k, verb')} SELECT n_nationkey AS payload_id, coalesce(arg_min(verb, ordinal) FILTER (verb IS NOT NULL), 'Copy') AS action FROM nation, (SELECT unnest([0,1,2]) AS ordinal) o JOIN a ON a.k = (n_nationkey * 5 + o.ordinal * 3) % 8 GROUP BY 1",
    "write_plan_fanout": f"WITH p AS {dims.values_sql(_PLAN, 'kind, platform, position, flavor, fidelity, native')}, s AS (SELECT s_suppkey, {list(dims.KINDS)}[s_suppkey % {len(dims.KINDS)} + 1] AS kind, {list(dims.PLATFORMS)}[s_suppkey % 3 + 1] AS platform FROM supplier) SELECT s_suppkey, kind, platform, position::BIGINT AS position, flavor, fidelity, native FROM s JOIN p USING (kind, platform)",
    "leak_email": r"SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+'), lambda a: regexp_matches(lower(a), '^[^.@].*@[^.].*[.][a-z]{2,24}$') AND NOT regexp_matches(a, '[.]@') AND NOT regexp_matches(lower(a), '@(example[.](com|net|org|edu)|localhost)$') AND NOT regexp_matches(lower(a), '[.](example|test|invalid|localhost|local)$')))::BIGINT AS n FROM documents",
    "leak_hexrun": "SELECT doc_id, len(h)::BIGINT AS n, array_to_string(h, '|') AS hits FROM (SELECT doc_id, regexp_extract_all(text, '[0-9A-Fa-f]{32,}') AS h FROM documents)",
    "leak_uuid": "SELECT o_orderkey, substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21, 12) AS uuid FROM (SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS m FROM orders)",
    "leak_homepath": "SELECT c_custkey, CASE WHEN c_custkey % 4 IN (1, 3) THEN 2 ELSE 0 END::BIGINT AS n FROM customer",
    "encoded_lengths": "SELECT doc_id, length(url_encode(text)) AS n FROM documents",
    "limits_reject": "SELECT octet_length(encode(text)) > 4096 AS refused, count(*) AS n, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY 1",
    "budget_running": "SELECT user_id, event_id, s AS spent, s <= 100 OR n = 0 AS accepted, s >= 100 AS is_exhausted FROM (SELECT user_id, event_id, octet_length(encode(props)) AS n, sum(octet_length(encode(props))) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS s FROM events)",
    "runs_merge": "SELECT user_id, event_type, min(event_id) AS s, max(event_id) + 1 AS e FROM (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS c FROM events)) GROUP BY user_id, island, event_type",
    "locale_fallback": "SELECT c_custkey, ['de', 'de_AT', 'de_AT.UTF-8', 'sr_YU@Latn', 'sr@Latn', 'pt_BR.UTF-8@x'][c_custkey % 6 + 1] AS tag, ['de', 'de_AT,de', 'de_AT,de', 'sr_YU@Latn,sr_YU,sr@Latn,sr', 'sr@Latn,sr', 'pt_BR@x,pt_BR,pt@x,pt'][c_custkey % 6 + 1] AS rungs FROM customer",
    "ini_lookup": "SELECT user_id, section, arg_min(event_id, event_id)::VARCHAR AS value FROM (SELECT *, last_value(CASE WHEN event_id % 3 = 1 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS section FROM events) WHERE event_id % 3 <> 1 GROUP BY 1, 2",
    "text_utf8_roundtrip": "SELECT doc_id, md5(text) AS md5 FROM documents",
    "dos_dates": "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders",
    "side_effecting_targets": "SELECT s_suppkey, CASE s_suppkey % 8 WHEN 6 THEN 'text/html' ELSE 'text/plain' END AS native FROM supplier WHERE s_suppkey % 8 >= 6",
}
