"""Every query with SQL gives the rows of that SQL, on the smallest tables; the others give rows."""

from pathlib import Path

import duckdb
import pytest

from brindle import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(df):
    columns = sorted(df.columns)
    return columns, df[columns].astype(str).sort_values(columns).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    if name not in catalog.ORACLES:
        assert len(got) or name.startswith("leak")
        return
    want = duck.sql(catalog.ORACLES[name]).df()
    assert plain(got)[0] == plain(want)[0]
    assert len(got) == len(want)
    assert (plain(got)[1] == plain(want)[1]).all().all()


def test_html_text_with_cut_references(spark, tmp_path):
    cut = ["<h1>and&amp</h1><p>&amp;&amp;&amp x</p>", "<p>a&amp;lt;b &lt</p>", "<p>&quot;&#39;&#39 c</p>"]
    spark.createDataFrame(list(enumerate(cut)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.QUERIES["html_text"](spark, str(tmp_path)).toPandas()
    assert (plain(got)[1] == plain(con.sql(catalog.ORACLES["html_text"]).df())[1]).all().all()


def test_style_stats_decode_a_page_once(spark, tmp_path):
    pages = ["<p>a <b>bc</b></p>", None, "", "<i>é</i>", "<div>" * 70, "x"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = catalog.QUERIES["html_style_stats"](spark, str(tmp_path))
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert got.columns == ["bold", "runs", "bytes"]
    assert sorted(map(tuple, got.collect())) == [(False, 3, 5), (True, 1, 2)]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
