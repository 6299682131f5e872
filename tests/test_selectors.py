"""Selectors of several compounds against a plain matcher that tries every way, on random trees."""

import random
import re

from pyspark.sql import functions as F

from pagelens.operators import cascade
from pagelens.plans.store import stored
from pagelens.sources.html_nodes import html_nodes

RULES = "page_id long, rule_no int, selector string, property string, value string, important boolean, origin string, layer int"


def tree(r, depth=0):
    """Nested (tag, classes, children)."""
    return r.choice(["div", "p-q", "b", "i"]), [c for c in "xyz" if r.random() < 0.4], [tree(r, depth + 1) for _ in range(r.randint(0, 3 if depth < 4 else 0))]


def html(t):
    return f"<{t[0]} class='{' '.join(t[1])}'>{''.join(map(html, t[2]))}</{t[0]}>"


def flat(t, parent=None, before=(), out=None):
    """Nodes in document order, each with its parent and the siblings before it."""
    out = [] if out is None else out
    node = {"tag": t[0], "classes": t[1], "parent": parent, "before": list(before)}
    out.append(node)
    seen = []
    for child in t[2]:
        seen.append(flat(child, node, seen, out))
    return out if parent is None else node


def one(text, node):
    return all(p[1:] in node["classes"] if p[0] == "." else p == "*" or p == node["tag"] for p in re.findall(r"\.\w+|[\w-]+|\*", text))


def plain(chain, node):
    """chain: compounds and combinators, ending in a compound."""
    if not one(chain[-1], node):
        return False
    if len(chain) == 1:
        return True
    rest, how = chain[:-2], chain[-2]
    up = []
    while how == " " and node["parent"]:
        node = node["parent"]
        up.append(node)
    where = {" ": up, ">": [node["parent"]] if node["parent"] else [], "+": node["before"][-1:], "~": node["before"]}[how]
    return any(plain(rest, n) for n in where)


def test_chains(spark):
    r = random.Random(2)
    trees = [tree(r) for _ in range(25)]
    chains = []
    for _ in range(60):
        n = r.randint(1, 5)
        chains.append([x for k in range(n) for x in ([r.choice([" ", ">", "+", "~", " "])] if k else []) + [r.choice(["div", "p-q", "b", ".x", ".y", "div.x", "*", "i.z"])]])
    texts = ["".join(x if len(x) > 1 or x == "*" else (x if x in "bi" else f" {x} " if r.random() < 0.5 or x == " " else x) for x in c) for c in chains]
    rows = [(None if k % 3 else k % 25, k, re.sub(r" +", " ", s), "color", "red", False, "author", None) for k, s in enumerate(texts)]
    nodes = stored(html_nodes(spark.createDataFrame([(k, html(t)) for k, t in enumerate(trees)], "page_id long, html string")))
    elements = stored(cascade.placed(nodes))
    got = {(m.page_id, m.pre, m.rule_no) for m in cascade.matched(elements, spark.createDataFrame(rows, RULES)).filter("sure").collect()}
    want = {(p, k, n) for p, t in enumerate(trees) for k, node in enumerate(flat(t)) for n, c in enumerate(chains) if (rows[n][0] is None or rows[n][0] == p) and plain(c, node)}
    assert len(want) > 300
    assert got == want


def test_unknown_steps(spark):
    """A step that only a browser knows makes the match unsure, unless there is another way."""
    page = "<ul class=a><li class=b><p>x</p></li></ul>"
    elements = stored(cascade.placed(html_nodes(spark.createDataFrame([(1, page)], "page_id long, html string"))))
    selectors = ["ul:hover p", "ul li:hover > p", "ul > p", ".a .b p", "li[class='b > c'] p", "ul li p:hover", "ul :is(li, p) p", "*:hover li p"]
    rows = [(None, k, s, "color", "red", False, "author", None) for k, s in enumerate(selectors)]
    found = cascade.matched(elements, spark.createDataFrame(rows, RULES)).join(elements.select("page_id", "pre", "tag"), ["page_id", "pre"]).filter(F.col("tag") == "p").collect()
    assert {(m.rule_no, m.sure) for m in found} == {(0, False), (1, False), (3, True), (5, False), (6, True), (7, False)}


def test_variables(spark):
    elements = spark.createDataFrame([(1, k, [(p,) for p in range(k - 1, -1, -1)]) for k in range(3)], "page_id long, pre int, anc array<struct<pre:int>>")
    rows = [
        (0, "--a", "var(--b)", True), (0, "--b", "outer", True), (1, "--b", "inner", True), (0, "--unsure", "x", False), (1, "--inherits", "var(--none)", True), (0, "--inherits", "kept", True), (1, "--gone", "initial", True),
        (0, "--self", "var(--self, x)", True), (0, "--far", "var(--self, y)", True), (0, "--k0", "end", True), *((0, f"--k{k}", f"var(--k{k - 1})", True) for k in range(1, 400)), *((1, f"--r{k}", f"var(--r{(k + 1) % 3})", True) for k in range(3)),
        *((2, f"p{k}", v, True) for k, v in enumerate(["var(--a)", "var(--b)", "var(--unsure, x)", "var(--inherits)", "var(--gone, spare)", "var(--self)", "var(--far)", "var(--k399) !", "var(--r1, x)", "a var(--none, b var(--none, c)) d", "rgb(var(--none, 1, 2, 3))", "var(--none", None, "plain"])),
    ]
    won = spark.createDataFrame([(1, *r) for r in rows] + [(2, 0, "color", "var(--x)", True)], "page_id long, pre int, property string, value string, certain boolean")
    found = {r.property: r.value for r in cascade.with_variables(elements.unionByName(elements.limit(1).selectExpr("2L AS page_id", "0 AS pre", "array() AS anc")), won).filter("pre = 2 or page_id = 2").collect()}
    assert found == dict(zip((f"p{k}" for k in range(14)), ["outer", "inner", None, "kept", "spare", None, None, "end !", None, "a b c d", "rgb(1, 2, 3)", None, None, "plain"], strict=True)) | {"color": "unset"}


def test_nested_layers(spark):
    """Against a tree of layers that is walked: layers in the order of their first names, each one's own styles after its layers."""
    r = random.Random(6)
    statements = [(page, k, ".".join(r.choice("abc") for _ in range(r.randint(1, 4))) if r.random() < 0.9 else None) for page in range(20) for k in range(r.randint(1, 12))]
    found = {}
    for row in sorted(cascade.layer_order(spark.createDataFrame(statements, "page_id long, place int, name string")).collect(), key=lambda x: x.layer):
        found.setdefault(row.page_id, []).append(row.name)

    def walk(node, path):
        return [x for name, inner in node.items() for x in [*walk(inner, [*path, name]), ".".join([*path, name])]]

    for page in range(20):
        root = {}
        for _, k, name in (s for s in statements if s[0] == page):
            node = root
            for part in (name or f"#{k}").split("."):
                node = node.setdefault(part, {})
        assert found[page] == walk(root, [])


def test_important_reverses_layers(spark):
    rows = [(1, 1, k, "p", "color", f"{k}{important}", important, "author", layer, True) for k, layer in enumerate([1, 2, None]) for important in (False, True)]
    won = lambda important: cascade.winners(spark.createDataFrame([x for x in rows if x[6] == important or not important], "page_id long, pre int, rule_no int, selector string, property string, value string, important boolean, origin string, layer int, sure boolean")).collect()[0].value
    assert won(True) == "0True"
    assert [cascade.winners(spark.createDataFrame([x for x in rows if not x[6]], "page_id long, pre int, rule_no int, selector string, property string, value string, important boolean, origin string, layer int, sure boolean")).collect()[0].value] == ["2False"]


def test_variables_of_pages_that_reach_over_batches(spark):
    """Pages share tasks, not a group in pandas each, and a page may lie in several batches."""
    pages = range(30)
    elements = spark.createDataFrame([(p, 0, []) for p in pages], "page_id long, pre int, anc array<struct<pre:int>>")
    rows = [(p, 0, f"--v{k}", f"v{p}" if k == 0 else f"var(--v{k - 1})", True) for p in pages for k in range(p % 7 + 1)] + [(p, 0, "color", f"var(--v{p % 7})", True) for p in pages] + [(99, 0, "color", "var(--v0)", True)]
    won = spark.createDataFrame(rows, "page_id long, pre int, property string, value string, certain boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = cascade.with_variables(elements, won)
        assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
        assert {r.page_id: r.value for r in found.filter("property = 'color'").collect()} == {p: f"v{p}" for p in pages} | {99: None}
        assert found.count() == len(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_backgrounds_need_one_join(spark):
    """Layers by layers: solid ones hide what isn't known, an unknown one above hides all; elements without colours are white; one join and one grouping do it."""
    up = "array<struct<pre:int>>"
    elements = spark.createDataFrame([(1, k, [(p,) for p in range(k - 1, -1, -1)]) for k in range(5)] + [(2, 0, [])], f"page_id long, pre int, anc {up}")
    half, solid = (0.0, 100.0, 0.0, 0.5), (10.0, 20.0, 30.0, 1.0)
    colours = spark.createDataFrame([(1, 0, half), (1, 1, None), (1, 2, solid), (1, 3, half), (3, 0, solid)], "page_id long, pre int, colour struct<r:double,g:double,b:double,a:double>")
    seen = cascade.effective_background(elements, colours)
    found = {(r.page_id, r.pre): r.background and tuple(r.background) for r in seen.collect()}
    over = (5.0, 60.0, 15.0, 1.0)
    assert found == {(1, 0): (127.5, 177.5, 127.5, 1.0), (1, 1): None, (1, 2): solid, (1, 3): over, (1, 4): over, (2, 0): (255.0, 255.0, 255.0, 1.0)}
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_places_against_each_node(spark):
    """Places of random trees with languages, texts and empty elements, against the node table itself; nodes are dealt out once, and none is joined without a language."""
    r = random.Random(4)

    def grown(depth):
        attributes = r.choice(["", "", "", " lang=EN", " lang=de-AT", " lang=''", " data-lang=fr"])
        return f"<{(t := r.choice(['div', 'b', 'i']))}{attributes}>" + "".join(grown(depth + 1) if r.random() < 0.6 else r.choice(["x", " ", "<!-- x -->"]) for _ in range(r.randint(0, 3) if depth < 5 else 0)) + f"</{t}>"

    nodes = stored(html_nodes(spark.createDataFrame([(k, "".join(grown(0) for _ in range(3))) for k in range(40)], "page_id long, html string")))
    rows = nodes.collect()
    kids, by = {}, {(n.page_id, n.pre): n for n in rows}
    for n in rows:
        kids.setdefault((n.page_id, n.parent_id), []).append(n)
    want = {}
    for n in rows:
        if n.kind != "element":
            continue
        beside = [k for k in kids[n.page_id, n.parent_id] if k.kind == "element"]
        alike, at = [k for k in beside if k.tag == n.tag], n
        while at and at.attrs.get("lang") is None:
            at = by.get((n.page_id, at.parent_id))
        want[n.page_id, n.pre] = (beside.index(n) + 1, len(beside), alike.index(n) + 1, len(alike), not [k for k in kids.get((n.page_id, n.pre), []) if k.kind == "element" or k.text], n.depth == 0, at.attrs["lang"].lower() if at else "", False)
    found = cascade.placed(nodes)
    assert found.columns == [*nodes.columns, "place"]
    assert {(e.page_id, e.pre): tuple(e.place) for e in found.collect()} == want
    assert len({w[6] for w in want.values()}) == 3 and len({w[4] for w in want.values()}) == 2
    assert cascade.placed(nodes)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 3


def test_rules_of_all_pages_move_no_element(spark):
    """Elements are only dealt out by page and key where a page has rules of its own."""
    elements = stored(cascade.placed(html_nodes(spark.createDataFrame([(1, "<p class=a>x</p>")], "page_id long, html string"))))
    rows = [(page, k, s, "color", "red", False, "author", None) for k, (page, s) in enumerate([(None, "p"), (None, ".a"), (1, "*")])]
    plans = []
    for some in (rows[:2], rows):
        found = cascade.candidates(elements, cascade.taken_apart(spark.createDataFrame(some, RULES))[1])
        assert found.count() == len(some)
        plans.append(found._jdf.queryExecution().optimizedPlan().toString().count("Join "))
    assert plans == [1, 2]
