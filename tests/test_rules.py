"""Every rule on structure, roles and names on markup that breaks it; datatypes on values; what the rules leave alone."""

import pytest
from pyspark.sql import functions as F

from pagelens.functions import datatypes
from pagelens.operators import semantics, structure
from pagelens.plans.examples import SEMANTICS, STRUCTURE, VALUES, whole_page
from pagelens.plans.store import stored
from pagelens.sources.html_nodes import html_nodes

CLEAN = """<html lang=en><head><title>t</title><meta name=viewport content='width=device-width'></head><body><a href='#m'>skip</a><header>x</header><nav aria-label=site><ul><li><a href=/x aria-current=page>first words</a></li></ul></nav>
<main id=m><h1>a</h1><h2>b</h2><img src=x alt='A red barn'><label for=i>Name</label><input id=i><table><caption>c</caption><tr><th>x<td>y</table></main><footer>z</footer></body></html>"""


def run(spark, rules, findings):
    pages = [(k, whole_page(x[0])) for k, x in enumerate(rules.values())] + [(5000, CLEAN), (5001, None), (5002, "")]
    out = {}
    for r in findings(stored(html_nodes(spark.createDataFrame(pages, "page_id long, html string")))).collect():
        out.setdefault(r.page_id, set()).add((r.rule_id, r.outcome, r.severity))
    return out


@pytest.mark.parametrize("rules, findings", [(STRUCTURE, structure.structure_findings), (SEMANTICS, semantics.semantic_findings)], ids=["structure", "semantics"])
def test_rules(spark, rules, findings):
    found = run(spark, rules, findings)
    lost = [(name, outcome, severity, sorted(x for x in found.get(k, ()) if x[0] == name)) for k, (name, (_, outcome, severity)) in enumerate(rules.items()) if (name, outcome, severity) not in found.get(k, ())]
    assert lost == []
    assert {x for x in found.get(5000, ()) if not x[0].startswith("manual/")} == set()
    assert 5001 not in found and 5002 not in found


def test_datatypes(spark):
    rows = [(name, value, ok) for name, (good, bad) in VALUES.items() for values, ok in ((good, True), (bad, False)) for value in values]
    assert set(VALUES) == set(datatypes.NAMES) and len(datatypes.NAMES) == 53
    df = spark.createDataFrame(rows, "name string, value string, want boolean")
    checked = F.coalesce(*(F.when(F.col("name") == n, datatypes.is_valid(F.col("value"), n)) for n in datatypes.NAMES))
    assert [tuple(r) for r in df.withColumn("got", checked).filter("not (want <=> got)").collect()] == []


def test_autofocus_is_found_once(spark):
    pages = spark.createDataFrame([(1, "<html lang=en><body><button autofocus>x</button>"), (2, "<html lang=en><body><label>x<input autofocus></label>"), (3, "<html lang=en><body><div role=searchbox contenteditable=true autofocus aria-label=S></div>")], "page_id long, html string")
    found = structure.structure_findings(stored(html_nodes(pages))).filter("rule_id = 'context/autofocus'").select("page_id", "outcome", "severity").collect()
    assert [tuple(r) for r in found] == [(1, "review", "medium")]


def test_content_and_what_is_shown_of_it_come_from_one_grouping(spark):
    from pagelens.operators import names

    up = "array<struct<pre:int,tag:string,names:string>>"
    over = [(1, "a", " "), (0, "p", " ")]
    parts = spark.createDataFrame([(1, 4, "c ", over, False), (1, 2, " a\n", over, False), (1, 3, "b", over, True), (2, 1, "x", [(0, "p", " ")], True)], f"page_id long, at int, text string, anc {up}, hidden boolean")
    found = names._content(parts)
    assert {(r.page_id, r.pre): (r.content, r.shown) for r in found.collect()} == {(1, 0): ("a b c", "a c"), (1, 1): ("a b c", "a c"), (2, 0): ("x", None)}
