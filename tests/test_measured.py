"""Rules on boxes, header cells and roles against plain versions that compare everything with everything."""

import itertools
import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pagelens import catalog_measured, catalog_roles
from pagelens.operators import aria, geometry, names, tables
from pagelens.plans.store import stored
from pagelens.sources.html_nodes import html_nodes

BOX = "page_id long, pre int, x double, y double, width double, height double, paint int"


def boxes(seed, pages, n, side, sizes):
    r = random.Random(seed)
    rows = [(p, k, float(r.randint(-50, side)), float(r.randint(-50, side)), float(r.choice(sizes)), float(r.choice(sizes)), r.randint(0, 5)) for p in range(pages) for k in range(n)]
    return rows + [(0, 900, None, 1.0, 5.0, 5.0, 9), (0, 901, 1.0, 1.0, None, 5.0, 9), (0, 902, 1.0, 1.0, 5.0, 5.0, None)]


def whole(rows):
    return [b for b in rows if None not in b[2:6] and b[4] > 0 and b[5] > 0]


def test_inversions(spark):
    rows = boxes(1, 6, 70, 40, [0, 1, 5, 9]) + [(50, 1, 0.0, 0.0, 1.0, 1.0, 0)]
    got = {(r.page_id, r.pre): r.seen_after for r in geometry.visual_inversions(spark.createDataFrame(rows, BOX)).collect()}
    assert got == {a[:2]: sum(b[0] == a[0] and b[1] < a[1] and (b[3], b[2]) > (a[3], a[2]) for b in whole(rows)) for a in whole(rows)}


@pytest.mark.parametrize("side, sizes", [(250, [1, 5, 20, 23, 24, 30, 100, 400]), (3000, [5, 20, 23, 24, 60, 900])])
def test_crowded_targets(spark, side, sizes):
    rows = whole(boxes(2, 6, 60, side, sizes)) + [(70, k, 10.0, 10.0, 3.0, 3.0, 0) for k in range(40)] + [(71, 1, 0.0, 0.0, 10.0, 10.0, 0), (71, 2, 24.0, 0.0, 10.0, 10.0, 0), (72, 1, 0.0, 0.0, 10.0, 10.0, 0), (72, 2, 23.9, 0.0, 10.0, 10.0, 0)]
    small, middle = (lambda b: b[4] < 24 or b[5] < 24), (lambda b: (b[2] + b[4] / 2, b[3] + b[5] / 2))

    def near(a, b):
        m = middle(a)
        gap = math.hypot(max(b[2] - m[0], m[0] - b[2] - b[4], 0), max(b[3] - m[1], m[1] - b[3] - b[5], 0))
        return math.dist(m, middle(b)) < 24 if small(b) else gap < 12

    df = geometry.crowded(spark.createDataFrame(rows, BOX))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert sorted(map(tuple, df.collect())) == sorted(a[:2] for a in rows if small(a) and any(b[0] == a[0] and b[1] != a[1] and near(a, b) for b in rows))


def test_covered_area(spark):
    rows = boxes(3, 6, 16, 60, range(1, 31)) + [(60, 1, 0.0, 0.0, 9.0, 9.0, 0), (60, 2, 0.0, 0.0, 9.0, 9.0, 1), (60, 3, 9.0, 0.0, 9.0, 9.0, 1), (61, 1, 0.0, 0.0, 9.0, 9.0, 1)]
    whole_rows = [b for b in whole(rows) if b[6] is not None]
    want = {}
    for a in whole_rows:
        points = itertools.product(range(int(a[2]), int(a[2] + a[4])), range(int(a[3]), int(a[3] + a[5])))
        over = [b for b in whole_rows if b[0] == a[0] and b[1] != a[1] and b[6] > a[6]]
        want[a[:2]] = (a[4] * a[5], float(sum(any(b[2] <= x < b[2] + b[4] and b[3] <= y < b[3] + b[5] for b in over) for x, y in points)))
    df = spark.createDataFrame(rows, BOX)
    assert {(r.page_id, r.pre): (r.area, r.covered) for r in geometry.covered_area(df, df).collect()} == want


MEASURED = "page_id long, id string, x double, y double, width double, height double, display string, position string, paint int, `order` int, flex_reversed boolean, pointer_events_none boolean, animating boolean, visually_hidden boolean, obscured boolean, hides_focus boolean, points int, covered int"
FIELDS = [f.split()[0].strip("`") for f in MEASURED.split(", ")]


def measured(spark, html, **marks):
    """Findings of all rules on boxes for one page, with what is measured of its elements by id."""
    nodes = stored(html_nodes(spark.createDataFrame([(1, html)], "page_id long, html string")))
    rows = [tuple({"page_id": 1, "id": i, **m}.get(f) for f in FIELDS) for i, m in marks.items()]
    ids = nodes.filter("kind = 'element'").selectExpr("page_id", "pre", "attrs['id'] AS id")
    box = stored(spark.createDataFrame(rows, MEASURED).join(ids, ["page_id", "id"]).drop("id"))
    found = geometry.target_findings(nodes, box).drop("width", "height").unionByName(geometry.order_findings(nodes, box)).unionByName(geometry.cover_findings(nodes, geometry.with_cover(nodes, box)))
    return {(r.rule_id, r.id, r.outcome) for r in found.join(ids, ["page_id", "pre"]).collect()}


def at(x, y, w, h, **more):
    return {"x": float(x), "y": float(y), "width": float(w), "height": float(h), **more}


def test_rules_on_targets(spark):
    two = "<div><a id=a href=/x#1>a</a></div><div><button id=b>b</button></div>"
    near, far = {"a": at(10, 10, 10, 10), "b": at(25, 10, 10, 10)}, {"a": at(10, 10, 10, 10), "b": at(90, 10, 50, 50)}
    assert measured(spark, two, **near) == {("targets/size", "a", "review"), ("targets/size", "b", "review")}
    assert measured(spark, two, **far) == {("targets/size-enhanced", "a", "review")}
    assert measured(spark, two, a=near["a"], b=near["b"] | {"pointer_events_none": True}) == {("targets/size-enhanced", "a", "review")}
    assert measured(spark, two, a=near["a"] | {"animating": True}, b=near["b"]) == {("targets/size", "a", "untested"), ("targets/size", "b", "review")}
    assert measured(spark, two.replace("<div><a", "<div>words <a"), **near) == {("targets/size", "b", "review")}
    other = two + "<p><a id=c href=/x>c</a></p>"
    assert ("targets/size", "a", "review") not in measured(spark, other, **near, c=at(200, 200, 30, 30))
    assert ("targets/size", "a", "review") in measured(spark, other.replace("<p>", "<p aria-hidden=true>"), **near, c=at(200, 200, 30, 30))
    image = "<div><a id=a href=/x><img id=i></a></div>"
    assert measured(spark, image, a=at(10, 10, 10, 10, display="inline"), i=at(0, 0, 60, 60)) == set()
    assert measured(spark, image, a=at(10, 10, 10, 10, display="block"), i=at(0, 0, 60, 60)) == {("targets/size-enhanced", "a", "review")}
    assert measured(spark, two, a=at(-99, 10, 10, 10), b=near["b"] | {"visually_hidden": True}) == set()


def test_rules_on_order(spark):
    row = "<div id=r><p id=k>one</p><p id=l><button>two</button></p><p> </p></div>"
    assert measured(spark, row, r={"flex_reversed": True}) == {("order/visual-mismatch", "r", "review")}
    assert measured(spark, row, l={"order": -1}) == {("order/visual-mismatch", "r", "review")}
    assert measured(spark, row, l={"order": 0}, r={"flex_reversed": False}) == set()
    assert measured(spark, "<div id=r><p>one</p><p> </p></div>", r={"flex_reversed": True}) == set()
    assert measured(spark, "<div id=r><a href=x><img></a><h2><a href=x>x</a></h2></div>", r={"flex_reversed": True}) == set()
    assert measured(spark, "<div id=r><a href=x><img></a><h2><a href=y>x</a></h2></div>", r={"flex_reversed": True}) == {("order/visual-mismatch", "r", "review")}


def test_rules_on_cover(spark):
    page = "<div id=f>bar<button id=g>x</button></div><div><button id=b>y</button></div>"
    bar = at(0, 0, 500, 100, position="fixed", paint=9)
    large = lambda *place: at(*place, 50, 50, paint=1)
    covered = {("focus/obscured", "b", "review"), ("focus/obscured-enhanced", "b", "review")}
    assert measured(spark, page, f=bar, g=large(10, 10), b=large(100, 20)) == covered
    assert measured(spark, page, f=bar, g=large(10, 10), b=large(100, 70)) == {("focus/obscured-enhanced", "b", "review")}
    assert measured(spark, page, f=bar, g=large(10, 10), b=large(100, 100)) == set()
    assert measured(spark, page, f=bar | {"paint": 0}, b=large(100, 20)) == set()
    assert measured(spark, page, b={"points": 9, "covered": 9}) == covered
    assert measured(spark, page, b={"points": 9, "covered": 0, "obscured": True}) == set()
    assert measured(spark, page, b={"obscured": True}) == {("focus/obscured", "b", "review")}
    assert measured(spark, page, b={"obscured": True, "visually_hidden": True}, f={"hides_focus": True}) == {("focus/obscured", "f", "review")}


def plain_headers(rows):
    """HTML's rules, cell by cell, for rows of (group, cells); a cell is (id, header, scope, colspan, rowspan, headers)."""
    ends = {g: y + 1 for y, (g, _) in enumerate(rows)}
    slots, grid = [], {}
    for y, (g, cells) in enumerate(rows):
        x = 0
        for c in cells:
            while (x, y) in grid:
                x += 1
            h = ends[g] - y if c[4] == 0 else min(c[4], len(rows) - y)
            for a, b in itertools.product(range(x, x + c[3]), range(y, y + h)):
                grid.setdefault((a, b), len(slots))
            slots.append((c, x, y, c[3], h, g))
            x += c[3]
    data = lambda places: any(not slots[i][0][1] for p, i in grid.items() if places(p))
    column, row = [], []
    for c, x, y, w, h, _ in slots:
        column.append(c[1] and (c[2] == "col" or (c[2] is None and not data(lambda p, y=y, h=h: y <= p[1] < y + h))))
        row.append(c[1] and (c[2] == "row" or (c[2] is None and not column[-1] and not data(lambda p, x=x, w=w: x <= p[0] < x + w))))
    out = set()
    for p, (c, x, y, w, h, g) in enumerate(slots):
        if c[5] is not None:
            first = {}
            for i, s in enumerate(slots):
                first.setdefault(s[0][0], i)
            out |= {(p, first[t]) for t in c[5].split() if t in first}
            continue
        for left in (True, False):
            for k in range(y, y + h) if left else range(x, x + w):
                opaque, block, at_header = set(), [p] if c[1] else [], c[1]
                for s in range((x if left else y) - 1, -1, -1):
                    i = grid.get((s, k) if left else (k, s))
                    if i is None:
                        continue
                    extent = (lambda j: slots[j][2::2][:2]) if left else (lambda j: slots[j][1::2][:2])
                    if slots[i][0][1]:
                        at_header = True
                        if (row if left else column)[i] and extent(i) not in {extent(o) for o in opaque}:
                            out.add((p, i))
                        block.append(i)
                    elif at_header:
                        at_header = False
                        opaque |= set(block)
                        block = []
        out |= {(p, i) for i, s in enumerate(slots) if s[0][1] and s[0][2] == "rowgroup" and s[5] == g and s[1] < x + w and s[2] < y + h}
    return {(slots[a][0][0], slots[b][0][0]) for a, b in out if a != b}


def test_header_cells(spark):
    r = random.Random(5)
    pages, want = [], {}
    for page in range(150):
        rows, html, k = [], "<table>", 0
        for g in range(r.randint(1, 3)):
            html += "<tbody>"
            for _ in range(r.randint(1, 4)):
                cells = []
                for _ in range(r.randint(1, 5)):
                    header = r.random() < 0.45
                    scope = r.choice([None, None, "row", "col", "rowgroup", "colgroup"]) if header else None
                    cells.append((f"c{k}", header, scope, r.choice([1, 1, 1, 2]), r.choice([1, 1, 1, 2, 0]) if page % 2 else 1, r.choice([None] * 9 + [f"c{r.randint(0, 12)} c0"])))
                    k += 1
                rows.append((g, cells))
                html += "<tr>" + "".join(f"<{'th' if c[1] else 'td'} id={c[0]}" + (f" scope={c[2]}" if c[2] else "") + f" colspan={c[3]} rowspan={c[4]}" + (f" headers='{c[5]}'" if c[5] else "") + ">x" for c in cells) + "</tr>"
            html += "</tbody>"
        pages.append((page, html + "</table>"))
        want[page] = plain_headers(rows)
    nodes = stored(html_nodes(spark.createDataFrame(pages, "page_id long, html string")))
    ids = {(n.page_id, n.pre): n.id for n in nodes.selectExpr("page_id", "pre", "attrs['id'] AS id").collect()}
    got = {p: set() for p in want}
    for x in tables.header_cells(stored(tables.placed(stored(tables.table_parts(nodes)[1])))).collect():
        got[x.page_id].add((ids[x.page_id, x.pre], ids[x.page_id, x.header]))
    assert sum(map(len, want.values())) > 500
    assert [p for p in want if got[p] != want[p]] == []


def test_header_findings(spark):
    cases = {
        "<table><tr><th id=a>x<td>y</table>": set(), "<table><tr><th id=a>x</table>": {("tables/header-without-data", "a")}, "<table id=t><thead><tr><th>x</thead><tbody></tbody></table>": {("tables/data-undetermined", "t")},
        "<table><tr><th id=a>x<th id=b>y<tr><td>1</table>": {("tables/header-without-data", "b")}, "<table><tr><th><th id=b>y<tr><td>1<td>2</table>": set(), "<table><tr><th id=a>x<th id=b>y<tr><td>1<td headers=a>2</table>": {("tables/header-without-data", "b")},
        "<div role=table><div role=row><p role=columnheader id=a>x</p></div><div role=row><p role=cell>y</p></div></div>": set(), "<table role=none><tr><th>x</table>": set(), "<table><tfoot><tr><td>1</tfoot><tbody><tr><th id=a>x</table>": set(),
        "<table><tr><th scope=col id=a>x<td><table><tr><td>y</table></table>": {("tables/header-without-data", "a")},
    }
    nodes = stored(html_nodes(spark.createDataFrame([(k, h) for k, h in enumerate(cases)] + [(99, None)], "page_id long, html string")))
    found = tables.header_findings(nodes).join(nodes.selectExpr("page_id", "pre", "attrs['id'] AS id"), ["page_id", "pre"]).collect()
    assert [{(r.rule_id, r.id) for r in found if r.page_id == k} for k in range(len(cases))] == list(cases.values())


def test_attributes_of_roles(spark):
    cases = {
        "<div role=img aria-label=x aria-checked=true></div>": {"aria-checked:not-allowed"}, "<div role=switch aria-label=x aria-checked=true aria-required=true></div>": set(), "<span aria-label=x>y</span>": {"aria-label:prohibited"}, "<span aria-label=''>y</span>": set(),
        "<video aria-expanded=x></video>": {"aria-expanded:not-allowed"}, "<video aria-label=x aria-hidden=false></video>": {"aria-label:not-allowed"}, "<input type=checkbox aria-checked=true>": {"aria-checked:not-allowed"}, "<input type=text disabled aria-disabled=false>": {"aria-disabled:not-allowed"},
        "<input type=text disabled aria-disabled=true>": set(), "<td colspan=2 aria-colspan=3>x</td>": {"aria-colspan:not-allowed"}, "<td colspan=2 aria-colspan=2>x</td>": set(), "<mark aria-checked=true>x</mark>": set(), "<p aria-nonsense=1 hidden aria-checked=1>x</p>": set(),
        "<ul role=tree aria-label=x><li role=treeitem aria-level=1 aria-checked=true aria-sort=x>y</li></ul>": {"aria-sort:not-allowed"}, "<button aria-pressed=true aria-selected=true>x</button>": {"aria-selected:not-allowed"},
    }
    nodes = stored(html_nodes(spark.createDataFrame([(k, f"<main>{h}</main>") for k, h in enumerate(cases)], "page_id long, html string")))
    found = aria.attribute_findings(names.with_names(nodes)).collect()
    assert [{f"{r.attribute}:{r.rule_id.removeprefix('aria/attribute-')}" for r in found if r.page_id == k} for k in range(len(cases))] == list(cases.values())


def test_closure(spark):
    edges = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(40)] + [("a", "b"), ("b", "c"), ("c", "a")], "role string, parent string")
    got = {tuple(r) for r in aria.closure(edges).collect()}
    assert got == {(f"n{a}", f"n{b}") for a in range(41) for b in range(a + 1, 41)} | set(itertools.product("abc", repeat=2))


def test_registered():
    from pagelens import catalog

    assert {*catalog_measured.QUERIES, *catalog_roles.QUERIES} <= set(catalog.queries()) and {*catalog_measured.ORACLES, *catalog_roles.ORACLES} <= set(catalog.oracles())


def test_inversions_over_batches(spark):
    """Pages that reach over Arrow batches, against each pair; items aren't multiplied on the way."""
    r = random.Random(9)
    rows = [(page if page else None, k, r.randint(0, 5), r.randint(0, 3)) for page in range(6) for k in range(r.choice([1, 2, 9, 17]))]
    items = spark.createDataFrame(rows, "page_id long, pre int, y int, x int")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = geometry.inversions(items, ["page_id"], ["pre"], ["y", "x"])
        assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(f.page_id, f.pre): f.seen_after for f in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(p, k): sum(q == p and j < k and (b, a) > (y, x) for q, j, b, a in rows) for p, k, y, x in rows}


def test_boxes_are_placed_only_in_levels_of_the_others(spark):
    """Page 1 has one large box on the other side, page 2 a small one, page 3 none."""
    columns = "page_id long, x0 double, y0 double, x1 double, y1 double"
    left = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0), (2, 1.0, 1.0, 2.0, 2.0), (3, 1.0, 1.0, 2.0, 2.0)], columns)
    right = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0), (2, 2.0, 2.0, 3.0, 3.0)], columns)
    upward = F.sequence("_level", F.lit(geometry.LEVELS[1]))
    assert sorted((r._by, r.level) for r in geometry.placed(left, "l", "page_id", upward, right).collect()) == [(1, 7), (2, 4)]
    for a, b in ((left, right), (right, left)):
        assert sorted((r.l.page_id, r.r.page_id) for r in geometry.overlapping(a, b).collect()) == [(1, 1), (2, 2)]


def test_larger_boxes_are_placed_only_above_smaller_ones(spark):
    """Of the boxes on one side, only those meet smaller ones at their own level that have some on the other side of their page."""
    columns = "page_id long, x0 double, y0 double, x1 double, y1 double"
    left = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 100.0), (2, 1.0, 1.0, 2.0, 2.0), (3, 1.0, 1.0, 2.0, 2.0)], columns)
    right = spark.createDataFrame([(1, 1.0, 1.0, 2.0, 2.0), (2, 0.0, 0.0, 100.0, 100.0), (3, 2.0, 2.0, 3.0, 3.0)], columns)
    assert [(r._by, r.level) for r in geometry.placed(left, "l", "page_id", F.array("_level"), right, True).collect()] == [(1, 7)]
    assert sorted((r.l.page_id, r.l.x1, r.r.page_id, r.r.x0) for r in geometry.overlapping(left, right).collect()) == [(1, 100.0, 1, 1.0), (2, 2.0, 2, 0.0), (3, 2.0, 3, 2.0)]


def test_covers_leave_little_on_disk(spark):
    """What covers are made of goes when it is used up: of what was written, the nodes, what was measured and the areas stay."""
    folder = Path(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir"))
    folder = Path(str(folder).removeprefix("file:"))
    before = set(folder.glob("nodes-*"))
    assert catalog_measured._cover(spark, "/root/testdata/sf0.001").count() > 0
    left = [spark.read.parquet(str(p)).columns for p in set(folder.glob("nodes-*")) - before]
    assert any("attrs" in c for c in left) and not [c for c in left if "l_linenumber" in c]
