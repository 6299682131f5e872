"""Every query of the audit engine against its SQL, over the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from pagelens import catalog
from pagelens.operators import structure, web
from pagelens.plans.store import stored

DATA = Path("/root/testdata/sf0.001")


def rows(names, values):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(round(v[k], 5) if isinstance(v[k], float) else v[k] for k in order) for v in values), key=repr)


# Their fragments are what test_assertions.py and test_rules.py run.
ELSEWHERE = {"assertion_examples", "structure_examples", "semantic_examples"}


@pytest.mark.parametrize("name", sorted(set(catalog.oracles()) - ELSEWHERE))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = catalog.queries()[name](spark, str(DATA))
    want = con.execute(catalog.oracles()[name])
    columns = [c[0] for c in want.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(columns, want.fetchall())


def test_nodes(spark):
    pages = spark.createDataFrame([(1, "<ul><li>a<li>b</ul><p>x<p>y"), (2, None), (3, "")], "page_id long, html string")
    nodes = catalog.html_nodes(pages)
    found = [(r.tag, r.depth, r.pre, r.post) for r in nodes.filter("page_id = 1 and kind = 'element'").orderBy("pre").collect()]
    assert found == [("ul", 0, 0, 4), ("li", 1, 1, 2), ("li", 1, 3, 4), ("p", 0, 5, 6), ("p", 0, 7, 8)]
    assert nodes.filter("page_id > 1").count() == 0


BAD = """<html lang="??"><head><meta name="viewport" content="width=1, maximum-scale=1.5"></head><body><h1>a</h1><h3> </h3><h1><img src=x alt="b"></h1>
<img src=y><img src=z alt=""><p role="widget" aria-foo="1" tabindex="3" aria-controls="">t</p><label for="i">l</label><input id="i"><b id="i"></b><i aria-describedby="i nowhere"></i></body></html>"""
GOOD = """<html lang="en"><head><title>t</title><meta name="viewport" content="width=device-width"></head><body><main><h1>a</h1><h2>b</h2></main></body></html>"""


def test_structure_rules(spark):
    pages = spark.createDataFrame([(1, BAD), (2, GOOD), (3, None)], "page_id long, html string")
    found = {(r.page_id, r.rule_id, r.outcome, r.severity, r.pre) for r in structure.structure_findings(stored(catalog.html_nodes(pages))).collect()}
    assert {x[1:] for x in found if x[0] == 1} >= {("headings/h1-multiple", "review", "low", 8), ("aria/reference-missing", "fail", "high", 19), ("ids/duplicate", "review", "medium", 18), ("document/title-missing", "fail", "high", None), ("landmarks/main-missing", "best_practice", "high", None)}
    assert {x[1] for x in found if x[0] == 2 and not x[1].startswith("manual/")} == {"landmarks/navigation-missing", "landmarks/banner-missing", "landmarks/contentinfo-missing"}
    assert {x for x in found if x[0] == 3} == set()


def test_addresses_and_codes(spark):
    urls = [("http://a/x?u=/b/", "http://a/x?u=/b/"), (" HTTP://A/x/#f ", "http://a/x"), ("http://a/x?", "http://a/x"), ("http://a", "http://a"), ("/p/", "/p")]
    assert [r.k for r in spark.createDataFrame(urls, "u string, w string").select(web.page_key(F.col("u")).alias("k")).collect()] == [w for _, w in urls]
    codes = {"x-default": True, " de ": True, "X-Default": True, "zh-Hant-TW": True, "de-de": True, "deutsch": False, "d": False, "en-1": False, "de-AT-x": False}
    assert {r.c: r.v for r in spark.createDataFrame([(c,) for c in codes], "c string").select("c", web.language_code_is_valid(F.col("c")).alias("v")).collect()} == codes
    cases = [(["/"], [], "/x", True), (["/a*b"], [], "/a--b/c", True), (["/a$"], [], "/ab", False), ([""], [], "/x", False), (["/x"], ["/x"], "/x/y", False), (["/x.y"], [], "/xzy", False), (["/*.php$"], ["/index.p"], "/index.php", False), (["/*.php$"], ["/i"], "/index.php", True)]
    found = spark.createDataFrame(cases, "d array<string>, a array<string>, p string, w boolean").select(web.path_is_disallowed(F.col("d"), F.col("a"), F.col("p")).alias("g")).collect()
    assert [r.g for r in found] == [c[3] for c in cases]


def test_visible_text_length_of_references_without_semicolon(spark, tmp_path):
    html = "<html><head><title>t</title></head><body><h1>a &amp&amp;&amp</h1><p>&copy &quot;&quot &middot</p><p>&amp;copy;</p></body></html>"
    spark.createDataFrame([(1, html)], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    found = [tuple(r) for r in catalog.queries()["visible_text_length"](spark, str(tmp_path)).collect()]
    assert found == con.execute(catalog.oracles()["visible_text_length"]).fetchall() == [(1, 5 + 8 + 6)]


def test_axes_are_counted_one_after_the_other(spark):
    """No task of the last step holds the joins of all axes."""
    found = catalog.queries()["tree_axes"](spark, "/root/testdata/sf0.001")
    assert "Join " not in found._jdf.queryExecution().optimizedPlan().toString()
