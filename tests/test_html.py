"""HTML blocks: worked pages, malformed ones, and the data source's partitions."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lectern.operators import layout
from lectern.plans import queries as Q
from lectern.sources import html_blocks as H

SF = "/root/testdata/sf0.001"


def texts(html):
    return [b[6] for b in H.page_blocks(html)]


def test_blocks_of_odd_pages():
    assert H.page_blocks(None) == [] == H.page_blocks("") == H.page_blocks("<p> </p><div></div>")
    assert texts("lone &amp; <b>bold</b> text") == ["lone & bold text"]
    assert texts("<p>one<p>two<br/>three</div></ul></p><li>four") == ["one", "two", "three", "four"]
    assert texts("<head><title>t</title><p>x<body><p>y") == ["y"]
    assert texts("a<script>var t='</p>';</script>b<style>p{}</style><!-- c -->d <template><p>no</p></template>e") == ["a", "b", "d", "e"]
    assert texts("<p>kept<!-- never ends <p>gone") == ["kept"] and texts("<p>x</p><a href='") == ["x"]
    assert texts("<p>\n many \t\xa0 blanks\n</p>&copy;&#233;") == ["many blanks", "©é"]


def test_positions():
    rows = H.page_blocks("<h1>Title</h1><ul><li>in</li><ul><li>deeper</li></ul></ul><p>" + "w " * 400 + "</p><table><tr><td>left</td><td>right</td></tr></table>")
    by = {b[6][:5]: b for b in rows}
    assert by["Title"][2:6] == (36.0, 36.0, 36.0 + 5 * 12, 36.0 + 28.8)
    assert by["in"][2] == 54.0 and by["deepe"][2] == 72.0
    assert by["w w w"][4] - by["w w w"][2] == 540.0 and by["left"][3] == by["right"][3] and by["right"][2] == 306.0
    assert all(a[5] <= b[3] or a[3] == b[3] for a, b in zip(rows, rows[1:], strict=False))
    many = H.page_blocks("<p>line</p>" * 200)
    assert [b[0] for b in many] == sorted(b[0] for b in many) and many[-1][0] > 3 and max(b[5] for b in many) <= 792 - 36
    assert [b[1] for b in many] == list(range(200))


def test_columns_are_read_one_after_the_other(spark):
    cells = "".join(f"<tr><td>left {k} {'w' * 24}</td><td>right {k} {'w' * 24}</td></tr>" for k in range(4))
    df = spark.createDataFrame([(1, f"<h1>{'wide ' * 20}</h1><table>{cells}</table>"), (None, "<p>no id</p>"), (2, None)], "page_id long, html string").withColumn("text", F.lit("x"))
    got = H.page_texts(df).collect()
    assert [r.doc for r in got] == ["1"]
    assert got[0].text.split("\n")[1:] == [f"{side} {k} {'w' * 24}" for side in ("left", "right") for k in range(4)]
    assert H.html_blocks(df).where("doc is null").count() == 1 and H.html_blocks(df.where("false")).count() == 0


def test_data_source_has_a_partition_for_each_row_group(spark, tmp_path):
    H.register(spark)
    table = pq.read_table(f"{SF}/pages.parquet").slice(0, 50)
    (tmp_path / "pages").mkdir()
    pq.write_table(table.slice(0, 40), tmp_path / "pages/a.parquet", row_group_size=10)
    pq.write_table(table.slice(40), tmp_path / "pages/b.parquet", row_group_size=1000)
    df = spark.read.format("html_blocks").option("path", f"file://{tmp_path}/pages").load()
    assert df.rdd.getNumPartitions() == 5
    want = H.html_blocks(spark.read.parquet(f"{SF}/pages.parquet"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))
    pq.write_table(pa.table({"u": pa.array([7], pa.int64()), "h": ["<p>x"]}), tmp_path / "one.parquet")
    other = spark.read.format("html_blocks").options(path=f"file://{tmp_path}/one.parquet", id="u", html="h").load()
    assert [(r.doc, r.text) for r in layout.reading_order(other).collect()] == [("7", "x")]


def test_query_reads_references_as_its_sql_does(spark, tmp_path):
    import duckdb

    bodies = ["<h1>a &amp;&amp</h1>", "<p>a&ampb; &amp;amp &am</p>", "x &lt;i&gt; &quot;&copy &copy;&middot;", "&amp;lt; &#3 && &"]
    spark.createDataFrame(list(enumerate(bodies)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = db.execute(Q.ORACLE_SQL["html_blocks"]).fetchall()
    assert sorted(map(tuple, Q.html_blocks(spark, str(tmp_path)).collect())) == sorted(want)
    assert H.page_blocks(bodies[0])[0][6] == "a &&" and H.page_blocks(bodies[0], ended=True)[0][6] == "a &&amp"
