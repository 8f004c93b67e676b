"""Registered queries of matching on rows that the given tables seldom hold."""

import duckdb
import pyarrow as pa

from granary.plans import catalog
from granary.sources import lockgraphs


def test_titles_with_other_entities(spark, tmp_path):
    titles = ["token = &quot;04dbebab91", "a &lt; b", "the &amp;&quot;", "&amp;quot;", "plain $1 \\2", "cut &quo", ""]
    html = "<!DOCTYPE html><html lang='en'><head><meta><title>{}</title></head><body><p>x</body></html>"
    rows = [(6 * i + k, "http://x", html.format(t)) for i, t in enumerate(titles) for k in range(6)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = catalog.queries()["xml_structural_paths"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()['xml_structural_paths']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_first_version_of_one_walk_order_is_that_of_the_first_row(spark, tmp_path):
    items = [(1, 1, 1, 3), (1, 2, 1, 1), (1, 3, 1, 1), (1, 2, 2, 3), (2, 1, 1, 5), (1, 4, 1, 2), (1, 5, 1, 2)]
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"""COPY (SELECT o::BIGINT AS l_orderkey, p::BIGINT AS l_partkey, s::BIGINT AS l_suppkey, n::INT AS l_linenumber, 'R' AS l_returnflag, 'O' AS l_linestatus
      FROM (VALUES {", ".join(map(str, items))}) v(o, p, s, n)) TO '{tmp_path}/lineitem.parquet'""")
    con.execute(f"COPY (SELECT k::BIGINT AS p_partkey, 'Brand#' || (k // 4) AS p_brand, z::INT AS p_size FROM (VALUES (1, 30), (2, 20), (3, 10), (4, 9), (5, 10)) v(k, z)) TO '{tmp_path}/part.parquet'")
    for t in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = catalog.queries()["version_propagation"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.oracle_sql()['version_propagation']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert {r["version"] for r in got.where("walk_order = 25").collect()} == {"20.1.1"}


def test_edges_leave_a_task_before_they_pile_up():
    text = "\n".join(f"a.org/x b.org/y{k}@v1.0" for k in range(1000))
    rows = [(f"/c{k}/go.mod.graph", text, None) for k in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["path", "text", "manifest"])
    sizes = [x.num_rows for x in lockgraphs.edge_batches(iter([batch]), "full")]
    assert sum(sizes) == 50_000 and max(sizes) < lockgraphs.EDGE_ROWS + 1000
