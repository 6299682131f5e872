"""What Spark may gather in the driver: plans of joins on tables whose compressed files are far smaller than their rows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagelens import catalog, catalog_measured, catalog_roles
from pagelens.operators import structure, tables
from pagelens.plans.store import CLEANUP, MOST_ROWS, beside, stored
from pagelens.sources import files, html_nodes


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_with_small_files_are_not_broadcast(spark):
    wide = F.array_repeat(F.lit("<div class=repeated>"), 20)
    large = stored(spark.range(MOST_ROWS + 1).select("id", wide.alias("text")))
    other = stored(spark.range(MOST_ROWS + 1).select("id", F.lit(1).alias("one")))
    assert "Broadcast" not in plan(large.filter("id > 5").join(other, "id"))
    assert "Broadcast" not in plan(large.join(other.groupBy("id").agg(F.max("one").alias("one")), "id", "left"))
    small = stored(spark.range(10).select("id"))
    assert "BroadcastHashJoin" in plan(large.join(F.broadcast(small), "id"))
    assert large.join(other, "id").count() == MOST_ROWS + 1


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Orders and lines of more than MOST_ROWS rows in small files."""
    folder = tmp_path_factory.mktemp("orders")
    keys = spark.range(MOST_ROWS + 1).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey"), F.lit("F").alias("o_orderstatus"))
    keys.write.parquet(f"{folder}/orders.parquet")
    lines = keys.select(F.col("o_orderkey").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.lit(7).alias("l_partkey"), F.lit(3).cast("decimal(15,2)").alias("l_quantity"), F.lit(0.05).cast("decimal(15,2)").alias("l_discount"), F.lit("R").alias("l_returnflag"), F.lit("O").alias("l_linestatus"))
    lines.write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_read_tables(spark, orders):
    o, l = catalog.read(spark, orders, "orders"), catalog.read(spark, orders, "lineitem")  # noqa: E741
    assert "Broadcast" not in plan(o.join(l, F.col("o_orderkey") == F.col("l_orderkey")))


def test_order_tables(spark, orders):
    assert "Broadcast" not in plan(catalog_roles._order_tables(spark, orders))


def test_lines(spark, orders):
    rows = catalog_measured.lines(spark, orders)
    assert "Broadcast" not in plan(rows.join(rows.select("page_id", F.col("name").alias("other")), "page_id"))


def test_styled_pages_are_parsed_once(spark, monkeypatch):
    parsed = []
    for module in (catalog, catalog.cascade):
        monkeypatch.setattr(module, "stored", lambda df: parsed.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")) or stored(df))
    catalog._styled(spark, "/root/testdata/sf0.001")
    assert sum(parsed) == 1


def test_small_pages_share_a_batch_of_rows():
    assert list(html_nodes.slices(["<p>x"] * 40 + [None])) == [(0, 41)]
    assert list(html_nodes.slices(["x" * html_nodes.CHARACTERS, "y", "z" * html_nodes.CHARACTERS, "w"])) == [(0, 1), (1, 3), (3, 4)]
    assert html_nodes._rows([None, 7], ["<p a>x</p>", "<br>"]).to_pylist()[2]["page_id"] == 7


def test_imports_are_read_once_for_each_file(spark, monkeypatch):
    """Two levels of imports, a cycle and a file that isn't there; the text of a sheet isn't taken apart again in each level."""
    calls = []
    plain = files.imports
    monkeypatch.setattr(files, "imports", lambda css: calls.append(1) or plain(css))
    sheets = spark.createDataFrame([(1, 0, "@import 'a' screen; @import 'none';"), (1, 1, "p{}"), (2, 0, None)], "page_id long, place int, css string")
    texts = spark.createDataFrame([("a", "@import 'b';"), ("b", "@import 'a'; @import 'b'; i{}")], "href string, css string")
    found = {(r.page_id, tuple(r.path), tuple(r.chain), r.css, r.media) for r in files.expanded(sheets, texts).collect()}
    assert found == {(1, (0,), (), "@import 'a' screen; @import 'none';", ""), (1, (1,), (), "p{}", ""), (2, (0,), (), None, ""), (1, (0, 0), ("a",), "@import 'b';", "screen"), (1, (0, 0, 0), ("a", "b"), "@import 'a'; @import 'b'; i{}", "")}
    assert len(calls) == 2


def test_beside_is_one_join(spark):
    """Sides of several columns, one of them a list, and a row that no side has; one join takes the place of one for each side."""
    rows = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "page_id long, pre int")
    sides = [spark.createDataFrame([(1, 0, "a")], "page_id long, pre int, x string"), spark.createDataFrame([(1, 1, [7]), (1, 0, None)], "page_id long, pre int, y array<int>"), spark.createDataFrame([(1, 0, True)], "page_id long, pre int, z boolean")]
    found = beside(rows, sides)
    assert plan(found).count("Join") == 1
    assert sorted((r.page_id, r.pre, r.x, r.y, r.z) for r in found.collect()) == [(1, 0, "a", None, True), (1, 1, None, [7], None), (2, 0, None, None, None)]


def test_elements_with_relations_are_no_plan_of_all_joins(spark):
    nodes = stored(html_nodes.html_nodes(spark.createDataFrame([(1, "<html lang=en><body><p>x</p>")], "page_id long, html string")))
    assert plan(structure.with_relations(nodes)).count("Join") <= 4


def test_header_cells_are_found_in_parts(spark):
    """What header cells come from is written in parts: one plan of all took more of the driver's memory than it has."""
    nodes = stored(html_nodes.html_nodes(spark.createDataFrame([(1, "<table><tr><th id=a>x<th>y<tr><td>1<td headers=a>2</table>")], "page_id long, html string")))
    found = tables.header_cells(stored(tables.placed(stored(tables.table_parts(nodes)[1]))))
    assert sorted((r.pre, r.header) for r in found.collect()) == [(7, 2), (9, 2)]
    assert plan(found).count("Exchange hashpartitioning") <= 12


def test_stored_tables_leave_no_shuffles(spark):
    """What was shuffled to write a table goes when it is written, and the setting stays as it was."""
    numbers = spark.range(100_000).groupBy((F.col("id") % 50_000).alias("k")).agg(F.max("id").alias("id"))
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {p for d in folders for p in Path(d).rglob("shuffle_*.data") if p.stat().st_size > 10_000}
    before, setting = shuffles(), spark.conf.get(CLEANUP)
    large = stored(numbers)
    assert large.count() == 50_000 and spark.conf.get(CLEANUP) == setting
    assert shuffles() <= before


def test_header_findings_mark_elements_once(spark, monkeypatch):
    """A table within a row, and a header that labels nothing on either side of it; the last plan joins only what was written."""
    marked, mark = [], tables._marked
    monkeypatch.setattr(tables, "_marked", lambda nodes: marked.append(1) or mark(nodes))
    html = "<table><tr><th id=a scope=col>x<td><table><tbody></tbody><tr><th id=b>x<tr><th id=c>y</table><tr><td>1<td>2</table>"
    nodes = stored(html_nodes.html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")))
    found = tables.header_findings(nodes)
    assert len(marked) == 1
    names = {r.pre: r.attrs.get("id") for r in nodes.filter("kind = 'element'").collect()}
    assert sorted((r.rule_id, names[r.pre]) for r in found.collect()) == [("tables/data-undetermined", None)]
    assert plan(found).count("Exchange hashpartitioning") <= 8
