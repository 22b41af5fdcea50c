"""Payload selection, the facade, the scanner, sources and streaming."""

import json

import pytest
from pyspark.sql import functions as F

from brindle.functions import limits, scan, targets
from brindle.operators import facade, payload

ITEMS = "payload_id long, platform string, ordinal int, item int, native string, bytes binary"


def frame(spark, *rows):
    return spark.createDataFrame([(i, p, o, it, n, bytearray(b)) for i, p, o, it, n, b in rows], ITEMS)


def one(df, **where):
    rows = [r.asDict() for r in df.collect()]
    return next(r for r in rows if all(r[k] == v for k, v in where.items()))


def test_identifiers(spark):
    names = [("Unix", "text/plain; charset=x"), ("Unix", "text/plainer"), ("MacOs", "CorePasteboardFlavorType 0x75726C20"), ("MacOs", "CorePasteboardFlavorType 0x7572"), ("Windows", "html format")]
    df = spark.createDataFrame(names, "platform string, native string")
    got = [r[0] for r in df.select(payload.flavor_of(F.col("platform"), F.col("native"))).collect()]
    assert got == ["PlainText", "Other", "Url", "Other", "Other"]


def test_best_takes_rank_then_order(spark):
    items = frame(spark, (1, "Unix", 0, 0, "text/plain", b"a"), (1, "Unix", 1, 0, "text/html", b"b"), (1, "Unix", 2, 0, "text/rtf", b"c"), (2, "MacOs", 0, 0, "public.url-name", b"x"))
    got = payload.best(items).collect()
    assert [(r.payload_id, r.flavor) for r in got] == [(1, "Rtf")]
    assert payload.item_count(items).count() == 2


def test_decode_takes_the_first_that_works(spark):
    items = frame(
        spark,
        (1, "Unix", 0, 0, "text/rtf", b"broken"),
        (1, "Unix", 1, 0, "text/html", b"<b>x</b>"),
        (2, "MacOs", 0, 0, "com.apple.webarchive", b"w"),
        (2, "MacOs", 1, 0, "public.rtf", rb"{\rtf1 x}"),
        (3, "Unix", 0, 0, "text/rtf", b"broken"),
        (4, "Unix", 0, 0, "text/rtf", b"broken"),
        (4, "Unix", 1, 0, "application/x-odd", b"?"),
        (5, "Windows", 0, 0, "Preferred DropEffect", b"\2\0\0\0"),
    )
    out = facade.decode_payload(items)
    assert one(out, payload_id=1)["rich"]["text"] == "x"
    assert one(out, payload_id=2)["kind"] == "Unknown"  # the archive outranks what could be decoded
    assert one(out, payload_id=3)["failure"]["kind"] == "BadMagic"
    assert one(out, payload_id=4)["unknown"]["native"] == "application/x-odd"
    assert one(out, payload_id=5)["kind"] is None
    assert one(facade.decode_payload(items, strict_rank=False), payload_id=2)["rich"]["text"] == "x"


def test_caps_and_policy(spark):
    items = frame(spark, (1, "Unix", 0, 0, "text/html", b"<p>" + b"x" * 99), (1, "Unix", 1, 0, "text/plain", b"t"))
    assert one(facade.decode_payload(items, max_flavor_bytes=10), payload_id=1)["text"] == "t"
    assert one(facade.decode_payload(items, max_flavor_bytes=10, policy=F.lit("Accept")), payload_id=1)["kind"] == "RichText"
    stopped = one(facade.decode_payload(items, max_flavor_bytes=10, policy=F.lit("Abort")), payload_id=1)
    assert stopped["kind"] is None


def test_options(spark):
    items = frame(spark, (1, "Unix", 0, 0, "text/html", b"<b>x</b>"), (1, "Unix", 1, 0, "text/plain", b"x"), (2, "Unix", 0, 0, "text/rtf", rb"{\rtf1 x}"))
    kept = one(facade.decode_payload(items, keep_markup=True), payload_id=1)
    assert (kept["kind"], kept["html"]["markup"], kept["html"]["plain"]) == ("Html", "<b>x</b>", "x")
    off = one(facade.decode_payload(items, disabled=frozenset({"rtf"})), payload_id=2)
    assert off["failure"]["variant"] == "FeatureDisabled"


def test_files_are_enriched(spark):
    items = frame(
        spark,
        (1, "MacOs", 0, 1, "public.file-url", b"file:///b%20c"),
        (1, "MacOs", 1, 0, "public.file-url", b"file:///a"),
        (2, "Unix", 0, 0, "text/uri-list", b"file:///a\r\n"),
        (2, "Unix", 1, 0, "x-special/gnome-copied-files", b"cut\nfile:///a"),
        (3, "MacOs", 0, 0, "public.url", b"https://e.org/"),
        (3, "MacOs", 1, 0, "public.url-name", b"Title"),
    )
    out = facade.decode_payload(items)
    assert [e["value"] for e in one(out, payload_id=1)["files"]["entries"]] == ["/a", "/b c"]
    assert one(out, payload_id=2)["files"]["action"] == "Move"
    assert one(out, payload_id=3)["link"]["title"] == "Title"


def test_encode_plans(spark):
    items = frame(spark, (1, "Unix", 0, 0, "text/uri-list", b"file:///a\r\nfile:///b\r\n"), (2, "Unix", 0, 0, "application/x-odd", b"?"))
    item = facade.decode_payload(items).drop("platform", "native", "flavor", "failure")
    out = facade.encode(item, "Windows", "MacOs", "Unix")
    mac = out.where("payload_id = 1 AND platform = 'MacOs'").orderBy("ordinal").collect()
    assert [(r["item"], bytes(r.bytes)) for r in mac] == [(0, b"file:///a"), (1, b"file:///b")]
    unix = out.where("payload_id = 1 AND platform = 'Unix'").orderBy("ordinal").collect()
    assert [r.native for r in unix] == ["text/uri-list", "x-special/gnome-copied-files", "x-special/mate-copied-files", "application/x-kde-cutselection"]
    assert bytes(out.where("payload_id = 2").first().bytes) == b"?"


def test_rich_text_as_markup(spark):
    item = facade.decode_payload(frame(spark, (1, "Unix", 0, 0, "text/html", b"a<b>b &lt; \xc3\xa9</b>")))
    got = item.select(facade.html_fragment(F.col("rich"))).first()[0]
    assert got == 'a<span style="font-weight:bold">b &lt; \u00e9</span>'


def test_scanner(spark):
    text = "mail a.b@corp.org, x@example.com; /Users/mrossi/f /home/me/g 3f2504e0-4f89-11d3-9a0c-0305e82c3301 00000000-0000-4000-8000-000000000000 Maria's MacBook Pro " + "ab" * 16
    df = spark.createDataFrame([(1, bytearray(text.encode())), (2, bytearray("x /Users/mrossi/f".encode("utf-16-le"))), (3, bytearray(b"q" + "a@corp.org".encode("utf-16-le")))], "id long, b binary")
    got = {(r.id, r.rule, r.matched) for r in scan.scan(df, "id", "b").collect()}
    assert (1, "Email", "a.b@corp.org") in got and (1, "HomePath", "/Users/mrossi") in got
    assert (1, "Uuid", "3f2504e0-4f89-11d3-9a0c-0305e82c3301") in got
    assert (1, "PersonalDevice", "Maria's MacBook Pro") in got
    assert (2, "HomePath", "/Users/mrossi") in got and (3, "Email", "a@corp.org") in got
    assert not any("example.com" in m or "4000-8000" in m or m == "/home/me" for _, _, m in got)
    at = {r.rule: r.offset for r in scan.scan(df.where("id = 1"), "id", "b").collect()}
    assert at["Email"] == 5 and at["HomePath"] == text.index("/Users")


def test_limits(spark):
    df = spark.createDataFrame([("Exact", 5), ("AtLeast", 11), ("Unknown", 99)], "k string, n long")
    assert [r[0] for r in df.select(limits.definitely_exceeds(F.col("k"), F.col("n"), 10)).collect()] == [False, True, False]


def test_targets(spark):
    cases = {"": "Unresolved", "/a": "Path", "\\\\s": "Path", "C:\\x": "Path", "c:/x": "Path", "c:x": "Url", "mailto:a": "Url", "1a:b": "Unresolved", "a b:c": "Unresolved"}
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    assert {r.s: r.t for r in df.select("s", targets.classify("s").alias("t")).collect()} == cases
    df = spark.createDataFrame([("a%2",), ("%zz%41",), ("\u00e9 ~*/",)], "s string")
    assert [r[0] for r in df.select(targets.percent_decode_lossy("s")).collect()] == ["a%2", "%zzA", "\u00e9 ~*/"]
    assert df.select(targets.percent_encode_path("s")).collect()[2][0] == "%C3%A9%20~*/"
    assert [r[0] for r in df.select(targets.bad_percent_offset("s")).collect()] == [1, 0, None]


def test_payload_folder(spark, tmp_path):
    from brindle.sources import payload_dir

    (tmp_path / "a").mkdir()
    good = {"format": "x", "origin": "synthetic", "description": "d", "expect": "error", "error_kind": "bad magic", "bytes": 3}
    (tmp_path / "a/ok.bin").write_bytes(b"abc")
    (tmp_path / "a/ok.json").write_text(json.dumps(good))
    (tmp_path / "a/alone.bin").write_bytes(b"z")
    (tmp_path / "a/bad.bin").write_bytes(b"zz")
    (tmp_path / "a/bad.json").write_text('{"format": "x", "format": "y", "odd": {}}')
    found = payload_dir.pairs(spark, str(tmp_path))
    assert {r.stem.rsplit("/", 1)[1]: r.state for r in found.collect()} == {"ok": "paired", "alone": "no_sidecar", "bad": "paired"}
    told = {r.stem.rsplit("/", 1)[1] for r in payload_dir.problems(found.where("state = 'paired'")).collect()}
    assert told == {"bad"}
    assert found.where("stem LIKE '%ok'").select(payload_dir.expected_kind(F.col("sidecar"))).first()[0] == "BadMagic"


def test_budget_over_micro_batches(spark, tmp_path):
    from brindle.streaming.budget import budget_stream

    chunks = lambda rows: spark.createDataFrame(rows, "stream string, seq long, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    chunks([("a", 0, 60), ("b", 0, 10)])
    stream = spark.readStream.schema("stream string, seq long, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = budget_stream(stream, 100).writeStream.format("memory").queryName("budget_out").outputMode("append").start()
    q.processAllAvailable()
    chunks([("a", 1, 50), ("a", 2, 5), ("a", 3, 0), ("b", 1, 90), ("b", 2, (1 << 63) - 1), ("b", 3, 1)])
    q.processAllAvailable()
    q.stop()
    got = {(r.stream, r.seq): (r.spent, r.accepted, r.is_exhausted) for r in spark.table("budget_out").collect()}
    most = (1 << 63) - 1
    assert got == {("a", 0): (60, True, False), ("b", 0): (10, True, False), ("a", 1): (110, False, True), ("a", 2): (115, False, True), ("a", 3): (115, True, True), ("b", 1): (100, True, True), ("b", 2): (most, False, True), ("b", 3): (most, False, True)}
    from brindle.functions.limits import budget

    rows = spark.createDataFrame([("x", k, n) for k, n in enumerate((8, 5, 0))], "stream string, seq long, n long")
    assert [(r.spent, r.accepted) for r in budget(rows, ["stream"], ["seq"], "n", 10).orderBy("seq").collect()] == [(8, True), (13, False), (13, True)]


def test_sql_names(spark):
    from brindle.register import register

    register(spark)
    row = spark.sql("SELECT css_color('rgb(1,2,3)') c, html_document(cast('<b>x' as binary)).value.text t").first()
    assert (row.c, row.t) == ("010203", "x")
    assert spark.sql("SELECT count(*) FROM html_tokens(cast('<a>b</a>' as binary))").first()[0] == 3


def test_nothing_is_decoded_after_the_first_success(monkeypatch):
    from brindle.operators import facade

    tried = []
    plain = facade.decode_item
    monkeypatch.setattr(facade, "decode_item", lambda data, native, platform, flavor, **k: tried.append(flavor) or plain(data, native, platform, flavor, **k))
    rep = lambda ordinal, flavor, data, **k: {"payload_id": 1, "platform": "Unix", "ordinal": ordinal, "item": 0, "native": flavor, "flavor": flavor, "is_content": True, "rank": ordinal, "size": len(data), "verdict": "Accept", "verb": None, "bytes": data, **k}
    s = facade.Search(rep(0, "Rtf", b"no rtf"), {})
    for x in (rep(0, "Rtf", b"no rtf"), rep(1, "Html", b"<b>x"), rep(2, "DibV5", b"broken"), rep(3, "PlainText", b"x")):
        s.look(x)
    assert tried == ["Rtf", "Html"] and s.row()["kind"] == "RichText" and "failure" not in s.row()
    s = facade.Search(rep(0, "DibV5", b"broken"), {})
    for x in (rep(0, "DibV5", b"broken"), rep(1, "FileContents", b""), rep(2, "Html", b"<b>", verdict="Skip", size=99)):
        s.look(x)
    assert s.row()["failure"]["variant"] == "Codec" and s.row()["flavor"] == "DibV5"
    s = facade.Search(rep(0, "Html", b"x", verdict="Abort", size=7), {})
    for x in (rep(0, "Html", b"x", verdict="Abort", size=7), rep(1, "PlainText", b"y")):
        s.look(x)
    assert s.row()["failure"] == {"variant": "TooLarge", "kind": None, "offset": 7} and len(tried) == 4


def test_native_helpers_of_items(spark):
    from brindle.functions import decoders as d
    from brindle.functions.targets import encoded_len, percent_encode_path, percent_encode_unreserved
    from brindle.operators.facade import files_of_paths, is_plain, spans

    words = spark.createDataFrame([("a b/é~!",), ("",), ("%+*",)], "s string")
    for r in words.select(encoded_len("s", "path"), F.length(percent_encode_path("s")), encoded_len("s", "unreserved"), F.length(percent_encode_unreserved("s"))).collect():
        assert r[0] == r[1] and r[2] == r[3]
    rich = spark.createDataFrame([(b"a <b>\xc3\xa9</b> c",), (b"plain only",)], "b binary").select(d.html_document("b")["value"].alias("rich"))
    got = rich.select(is_plain(F.col("rich")).alias("plain"), spans(F.col("rich")).alias("s")).collect()
    assert [r.plain for r in got] == [False, True] and [(x.text, x.style.bold) for x in got[0].s] == [("a ", False), ("é", True), (" c", False)]
    files = spark.range(1).select(files_of_paths(F.array(F.lit("/a"), F.lit("/b"))).alias("f")).first().f
    assert files.action == "Copy" and [(e.kind, e.value) for e in files.entries] == [("Path", "/a"), ("Path", "/b")]


def test_payload_sink_refuses_to_overwrite(spark, tmp_path):
    from brindle.sources import payload_dir

    rows = [(1, "Unix", 0, "text/html", 0, b"<p>"), (1, "Unix", 1, "TEXT/html", 0, b"x"), (2, "MacOs", 0, "public.rtf", 1, b""), (3, "Unix", 0, "text/plain", 0, None)]
    items = spark.createDataFrame(rows, "payload_id long, platform string, ordinal int, native string, item int, bytes binary")
    about = {"os": "x", "app": "y", "how": "z", "notes": "n"}
    assert payload_dir.write(items, str(tmp_path), **about) == 3
    assert sorted(p.name for p in (tmp_path / "1").iterdir()) == ["TEXT_html-2.bin", "TEXT_html-2.json", "text_html.bin", "text_html.json"]
    side = json.loads((tmp_path / "2" / "public.rtf.json").read_text())
    assert list(side) == ["format", "flavor", "origin", "description", "expect", "os", "app", "app_version", "how", "bytes", "item", "redacted", "notes"]
    assert (side["flavor"], side["bytes"], side["item"], side["redacted"]) == ("Rtf", 0, 1, False)
    with pytest.raises(FileExistsError):
        payload_dir.write(items, str(tmp_path), **about)
    assert payload_dir.write(items.where("payload_id = 2"), str(tmp_path), force=True, **about) == 1
    found = payload_dir.pairs(spark, str(tmp_path))
    assert found.where("state = 'paired'").count() == 3 and payload_dir.problems(found).count() == 0


def test_identity_of_a_scan(spark):
    from brindle.functions import scan

    text = "see /USERS/Mrossi/x, mrossi1 and Mrossi. Ann's iPhone"
    df = spark.createDataFrame([(1, text.encode()), (2, b"z" + "mrossi at /home/ann".encode("utf-16-le"))], "id int, b binary")
    got = {tuple(r) for r in scan.scan(df, "id", "b", scan.Identity("mrossi", "/Users/mrossi")).select("id", "rule", "offset", "matched", "encoding").collect()}
    assert got == {
        (1, "CurrentUser", 4, "/Users/mrossi", "ASCII"),
        (1, "CurrentUser", 4, "/USERS/Mrossi", "ASCII"),
        (1, "CurrentUser", 11, "mrossi", "ASCII"),
        (1, "CurrentUser", 33, "mrossi", "ASCII"),
        (1, "PersonalDevice", 41, "Ann's iPhone", "ASCII"),
        (2, "CurrentUser", 1, "mrossi", "UTF-16LE"),
        (2, "HomePath", 21, "/home/ann", "UTF-16LE"),
    }
    nobody = scan.Identity("root", "/root")
    assert nobody.patterns() == [] and scan.Identity(None, "C:\\Users\\Zed\\").home_base == "Zed"


def test_decoders_hold_a_piece_of_a_batch(spark):
    from brindle.functions import core

    assert [n for _, n in core.pieces(1000, 1000)] == [256, 256, 256, 232]
    assert [n for _, n in core.pieces(3, 9 << 20)] == [1, 1, 1]
    assert list(core.pieces(0, 0)) == []
    held, most = 0, 0

    class Value(str):
        def __new__(cls, s):
            nonlocal held, most
            held, most = held + 1, max(most, held + 1)
            return super().__new__(cls, s)

        def __del__(self):
            nonlocal held
            held -= 1

    import pyarrow as pa

    got = core.by_pieces(lambda x: Value(x), pa.string(), (pa.array([str(i) for i in range(5000)]),))
    assert got.to_pylist() == [str(i) for i in range(5000)]
    assert most <= 2 * core.PIECE_ROWS


def test_decoders_give_back_the_memory_of_a_batch(monkeypatch):
    import pyarrow as pa

    from brindle.functions import core

    column, left = pa.array(["x" * 4000] * 2000), []
    start = pa.total_allocated_bytes()

    class Pool:
        def release_unused(self):
            left.append(pa.total_allocated_bytes() - start)

    monkeypatch.setattr(core.pa, "default_memory_pool", Pool)
    got = core.by_pieces(lambda x: x, pa.string(), (column,))
    assert got.equals(column)
    assert len(left) == 1 and left[0] < 1.5 * got.nbytes


def test_small_files_are_dealt_over_tasks(spark, tmp_path):
    from brindle import catalog

    rows = [(i, f"Customer#{i}", "BUILDING") for i in range(400)]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("rich_text_roundtrip", "payload_best", "codepage_roundtrip"):
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan, name
    counts = catalog.QUERIES["rich_text_roundtrip"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(counts) > 1 and sum(r[1] for r in counts) == 400


def test_folder_scan_reads_every_file_once(spark, tmp_path):
    from brindle.sources import payload_dir

    for name, data in (("a/x.bin", b"1"), ("a/x.json", b"{}"), ("a/empty.bin", b""), ("a/b c+d%20.bin", b""), ("a/b c+d%20.json", b"{}"), ("a/lone.json", b""), ("a/.hid.bin", b"1"), ("readme.md", b"x")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = payload_dir.pairs(spark, str(tmp_path))
    got = {r.stem.rpartition("/")[2]: (r.bytes and bytes(r.bytes), r.sidecar, r.size, r.state) for r in found.collect()}
    assert got == {"x": (b"1", "{}", 1, "paired"), "empty": (b"", None, 0, "no_sidecar"), "b c+d%20": (b"", "{}", 0, "paired"), "lone": (None, "", None, "no_payload")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("] binaryFile") == 1


def test_payload_folders_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    from brindle.sources import payload_dir

    top = tmp_path / "a b%20"
    names = ["x.bin", "x.json", "1/p.bin", "1/p.json", "1/2/3/4/deep é.bin", "1/2/3/4/deep é.json", "1/2/3/b+c.d.json", "d.bin/q.bin", "k=v/_m=1.bin"]
    passed = ["_hid/x.bin", ".git/x.json", "1/_x.bin", "1/x.txt", "1/X.BIN", "1/x.bin._COPYING_", "1/2/README.md"]
    for n in [*names, *passed]:
        (top / n).parent.mkdir(parents=True, exist_ok=True)
        (top / n).write_bytes(b"\xff" + n.encode() if n.endswith("bin") else b"{}")
    (top / "1/none").mkdir()
    (top / "1/none.bin").write_bytes(b"")
    rows = lambda df: sorted((r.stem, r.bytes and bytes(r.bytes), r.sidecar) for r in df.collect())
    for root, most in ((str(top), 0), (f"file://{top}/", 9)):
        found = payload_dir.pairs(spark, root, most)
        assert not found.inputFiles() and "LocalTableScan" not in found._jdf.queryExecution().executedPlan().toString()  # the driver has no names
        assert rows(found) == rows(payload_dir._scanned(spark, str(top)))
        assert {r.stem[len(f"file:{top}/") :]: r.state for r in found.collect()} == {"x": "paired", "1/p": "paired", "1/2/3/4/deep é": "paired", "1/2/3/b+c.d": "no_payload", "d.bin/q": "no_sidecar", "k=v/_m=1": "no_sidecar", "1/none": "no_sidecar"}
    assert payload_dir.pairs(spark, str(top / "1/none"), 0).count() == 0
    monkeypatch.setattr(payload_dir, "NAMES", 2)
    monkeypatch.setattr(payload_dir, "PIECE_ROWS", 1)
    assert rows(payload_dir.pairs(spark, str(top), 0)) == rows(found)
    # by Spark's reader: few files, a pattern, a file
    assert payload_dir.pairs(spark, str(top), 10).inputFiles() and rows(payload_dir.pairs(spark, str(top), 10)) == rows(found)
    assert payload_dir.pairs(spark, f"{tmp_path}/a*", 0).count() == payload_dir.pairs(spark, str(top / "x.bin"), 0).count() + 6


def test_folder_query_keeps_no_names_on_the_driver(spark):
    from brindle import catalog

    # the smallest tables are enough to see what plans hold
    got = catalog.QUERIES["payload_folder_roundtrip"](spark, "/root/testdata/sf0.001")
    assert not got.inputFiles() and "LocalTableScan" not in got._jdf.queryExecution().executedPlan().toString()
    assert got.where("sound AND state = 'paired'").count() == got.count() > 0
