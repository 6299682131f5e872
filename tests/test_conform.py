"""Scripts as data, table grids, policies in meta elements, normal forms, imports, and pages as a stream."""

from pagelens.operators import conform, perception, policies
from pagelens.plans.store import stored
from pagelens.sources.html_nodes import html_nodes
from pagelens.streaming import audits

PAGES = [
    "<script type=importmap>{\"imports\": {\"a/\": \"/b/\"}}</script>", "<script type=importmap>{\"imports\": {\"a/\": \"/b\"}}</script>", "<script type=importmap>[]</script>", "<script type=importmap>{</script>", "<script type=importmap>{\"x\": 1}</script>",
    "<script type=speculationrules>{\"prefetch\": [{\"source\": \"list\", \"urls\": [\"/a\"]}]}</script>", "<script type=speculationrules>{\"prefetch\": [{\"eagerness\": \"never\"}]}</script>",
    "<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "<table><tr><td rowspan=3>a<tr><td>b</table>", "<table><tr><td colspan=2>a<tr><td colspan=2>b</table>", "<table><tr><td>a<td rowspan=2>b<tr><td colspan=2>c</table>",
    "<meta http-equiv=Content-Security-Policy content=\"script-src 'self'; style-src 'unsafe-inline'\"><script>1</script><style>x</style><p onclick=x() style=y>z</p>", "<meta http-equiv=Content-Security-Policy content=\"default-src 'nonce-abc' 'sha256-x='\"><script nonce=abc>1</script><script>2</script><script src=x></script>",
    "<p>é</p><p>é</p>",
]


def nodes(spark):
    return stored(html_nodes(spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")))


def test_scripts_tables_and_text(spark):
    n = nodes(spark)
    assert {(r.page_id, r.message) for r in conform.import_map_findings(n).collect()} == {(1, "imports has an invalid entry"), (2, "not an object"), (3, "not JSON"), (4, "unknown key")}
    assert {(r.page_id, r.message) for r in conform.speculation_rule_findings(n).collect()} == {(6, "invalid rule")}
    assert {(r.page_id, r.message) for r in conform.table_findings(n).collect()} == {(8, "rowspan reaches below the table"), (9, "a column has no cell that begins in it"), (10, "cells overlap")}
    assert {r.page_id for r in conform.unnormalized(n).collect()} == {13}
    found = {(r.page_id, r.construct, r.verdict) for r in policies.enforcement_findings(n).collect()}
    assert found == {(11, "script", "blocked"), (11, "handler", "blocked"), (12, "script", "hash")}


def test_streams(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "<html><body><img src=x>"), (2, "<html lang=en><body>x")], "page_id long, html string").write.parquet(source)
    stream = spark.readStream.schema("page_id long, html string").parquet(source)
    from pagelens.operators.structure import document_findings

    audits.audit(stream, target, str(tmp_path / "state"), document_findings).awaitTermination(120)
    assert {(r.page_id, r.rule_id) for r in spark.read.parquet(target).collect()} == {(1, "document/lang-missing"), (1, "zoom/viewport-missing"), (2, "zoom/viewport-missing")}
    steps = spark.createDataFrame([(1, 1, "a", "u", "f"), (1, 2, "b", "u", None), (2, 1, "a", "u", "f"), (2, 2, "a", "u", "f")], "journey_id long, step long, title string, url string, focus string")
    steps.write.parquet(str(tmp_path / "steps"))
    changes = audits.latest_changes(spark.readStream.schema(steps.schema).parquet(str(tmp_path / "steps")))
    changes.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "s2")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert {tuple(r) for r in spark.table("changes").collect()} == {(1, 2, "title,focus"), (2, 2, "")}


def test_journeys(spark):
    snapshots = spark.createDataFrame([(1, 1, "s1", "t", "u", "a"), (1, 2, "s2", "t2", "u", "b")], "journey_id long, step long, snapshot_id string, title string, url string, focus string")
    tree = spark.createDataFrame([("s1", "1", False, {"expanded": "false"}, 7), ("s2", "9", False, {"expanded": "true"}, 7), ("s1", "2", True, {}, 8), ("s2", "8", False, {}, 8), ("s1", "3", False, {}, None)], "snapshot_id string, node_id string, ignored boolean, properties map<string,string>, backend_id long")
    found = {(r.node_id, r.change, r.property, r.before, r.after, r.title_changed, r.focus_moved) for r in perception.journey(snapshots, tree).collect()}
    assert found == {("9", "property", "expanded", "false", "true", True, True), ("8", "added", None, None, None, True, True), ("3", "removed", None, None, None, True, True)}
