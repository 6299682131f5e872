"""Queries on measured boxes: pages made of orders and their lines, whose numbers are the boxes' places and sizes, and the SQL that compares each box with each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.operators import geometry
from pagelens.plans.store import by_rows, released, stored
from pagelens.sources.files import with_rendering
from pagelens.sources.html_nodes import html_nodes

#: Orders on a page; a line is a box, so a page has few hundred.
ORDERS = 64
#: What a line is on its page, by turns: a button, a link, a link in running text, a checkbox in its label, a radio button, an empty bar.
KINDS = ["<div id=w{0}><button id=b{0}>x</button></div>", '<div id=w{0}><a id=b{0} href="{1}#s">x</a></div>', '<p id=w{0}>words <a id=b{0} href="{1}">x</a></p>', "<div id=w{0}><label><input type=checkbox id=b{0}></label></div>", "<div id=w{0}><input type=Radio id=b{0}></div>", "<div id=w{0}><span id=b{0}></span></div>"]


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line: its page, its name there, kind, link and box. Lines with one key are one."""
    rows = by_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q"), F.round(F.col("l_discount") * 100).cast("int").alias("d"), "l_returnflag")
    rows = rows.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "q", "d", "l_returnflag")).alias("r")).select("l_orderkey", "l_linenumber", "r.*")
    kind = (F.col("l_orderkey") + F.col("l_linenumber")) % len(KINDS)
    href = F.when(F.col("l_orderkey") % 3 == 0, "/same").otherwise(F.concat(F.lit("/p"), (F.col("l_partkey") % 40).cast("string")))
    bar = kind == 5
    return rows.withColumns({
        "page_id": F.floor(F.col("l_orderkey") / ORDERS).cast("long"), "name": F.concat("l_orderkey", F.lit("-"), "l_linenumber"), "kind": kind, "href": href,
        "x": (F.col("l_partkey") * 13 % 1500).cast("double"), "y": (F.col("l_orderkey") * 7 % 2000).cast("double"), "width": F.when(bar, F.col("q") + 100).otherwise(F.col("q")).cast("double"), "height": F.when(bar, F.col("d") + 30).otherwise(F.col("d") * 5).cast("double"),
    })


def page_nodes(rows: DataFrame) -> DataFrame:
    """The node table of the pages: orders one after the other, each a box around its lines."""
    line = F.coalesce(*(F.when(F.col("kind") == k, F.concat(*_filled(x))) for k, x in enumerate(KINDS)))
    orders = rows.groupBy("page_id", "l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", line.alias("h")))), lambda s: s["h"]), "").alias("h"))
    whole = orders.select("page_id", "l_orderkey", F.concat(F.lit("<div id=o"), "l_orderkey", F.lit(">"), "h", F.lit("</div>")).alias("h"))
    pages = whole.groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "h"))), lambda s: s["h"]), "").alias("html"))
    return html_nodes(pages)


def _filled(template: str) -> list:
    parts = []
    for k, piece in enumerate(template.replace("{1}", "\0{1}\0").replace("{0}", "\0{0}\0").split("\0")):
        parts.append(F.col("name") if piece == "{0}" else F.col("href") if piece == "{1}" else F.lit(piece))
    return parts


def measured(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """What a browser would have measured, by page and node: the lines' boxes, the order of their wrappers, the direction of their orders."""
    null = lambda kind: F.lit(None).cast(kind)
    boxes = rows.select("page_id", F.concat(F.lit("b"), "name").alias("id"), "x", "y", "width", "height", F.when(F.col("l_linenumber") == 7, True).alias("pointer_events_none"), (F.col("l_returnflag") == "R").alias("animating"), F.when(F.col("kind") == 5, "fixed").alias("position"), F.col("l_linenumber").alias("paint"), null("int").alias("order"), null("boolean").alias("flex_reversed"))
    wraps = rows.select("page_id", F.concat(F.lit("w"), "name").alias("id"), F.when((F.col("l_orderkey") % 7 == 0) & (F.col("l_linenumber") % 3 == 0), 1).otherwise(0).alias("order"))
    orders = rows.select("page_id", F.concat(F.lit("o"), "l_orderkey").alias("id"), (F.col("l_orderkey") % 5 == 0).alias("flex_reversed")).distinct()
    every = boxes.unionByName(wraps, True).unionByName(orders, True)
    named = nodes.filter("kind = 'element'").select("page_id", "node_id", F.col("attrs")["id"].alias("id")).filter("id is not null").join(every, ["page_id", "id"]).withColumn("display", F.lit("block"))
    kept = ["x", "y", "width", "height", "display", "position", "paint", "order", "flex_reversed", "pointer_events_none", "animating"]
    never = [null(kind).alias(c) for c, kind in (("visually_hidden", "boolean"), ("obscured", "boolean"), ("hides_focus", "boolean"), ("points", "int"), ("covered", "int"))]
    # Written between the joins, else the first one's shuffles lie beside the second one's.
    named = stored(named.select("page_id", "node_id", *kept))
    return with_rendering(nodes.select("page_id", "node_id", "pre", "kind"), named).filter("kind = 'element'").select("page_id", "pre", *kept, *never)


def _site(spark: SparkSession, sf_dir: str, *columns: str | Column) -> tuple[DataFrame, DataFrame]:
    """The nodes, all of them or some columns, and what was measured."""
    rows = stored(lines(spark, sf_dir))
    nodes = stored(page_nodes(rows).select(*columns or "*"))
    boxes = stored(measured(nodes, rows))
    released(rows)
    return nodes, boxes


def _by_name(found: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    return found.join(nodes.select("page_id", "pre", F.substring(F.col("attrs")["id"], 2, 40).alias("name")), ["page_id", "pre"]).select("page_id", "name", *columns)


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, boxes = _site(spark, sf_dir)
    return _by_name(geometry.target_findings(nodes, boxes), nodes, "rule_id", "outcome", "severity", "width", "height")


def _order(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, boxes = _site(spark, sf_dir)
    return _by_name(geometry.order_findings(nodes, boxes), nodes, "rule_id", "outcome", "severity")


def _inversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).withColumn("pre", F.col("l_orderkey") * 16 + F.col("l_linenumber"))
    return geometry.visual_inversions(rows).select("page_id", "pre", "seen_after")


def _cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, boxes = _site(spark, sf_dir, "page_id", "node_id", "pre", "kind", "tag", "attrs", F.transform("anc", lambda a: F.struct(a["pre"].alias("pre"))).alias("anc"))
    return _by_name(geometry.cover_findings(nodes, geometry.with_cover(nodes, boxes)), nodes, "rule_id", "outcome", "severity")


def _cover_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(lines(spark, sf_dir).select("page_id", (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("pre"), F.col("l_linenumber").alias("paint"), "x", "y", "width", "height", "kind"))
    return geometry.covered_area(rows.filter("kind <> 5"), rows.filter("kind = 5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "target_sizes": _targets,
    "order_mismatches": _order,
    "visual_inversions": _inversions,
    "focus_covers": _cover,
    "covered_areas": _cover_area,
}

_ROWS = f"""r AS (SELECT l_orderkey AS k, l_linenumber AS n, min((l_partkey, l_quantity::INT, round(l_discount * 100)::INT, l_returnflag)) AS r FROM lineitem GROUP BY 1, 2),
l AS (SELECT k, n, (k + n) % 6 AS kind, k // {ORDERS} AS page_id, k || '-' || n AS name, CASE WHEN k % 3 = 0 THEN '/same' ELSE '/p' || (r[1] % 40) END AS href, (r[1] * 13 % 1500)::DOUBLE AS x, (k * 7 % 2000)::DOUBLE AS y,
  (CASE WHEN (k + n) % 6 = 5 THEN r[2] + 100 ELSE r[2] END)::DOUBLE AS w, (CASE WHEN (k + n) % 6 = 5 THEN r[3] + 30 ELSE r[3] * 5 END)::DOUBLE AS h, r[4] = 'R' AS moving FROM r)"""
_CUTS = """c AS (SELECT a.page_id, a.k, a.n, greatest(a.x, b.x) AS x0, greatest(a.y, b.y) AS y0, least(a.x + a.w, b.x + b.w) AS x1, least(a.y + a.h, b.y + b.h) AS y1 FROM l a JOIN l b ON a.page_id = b.page_id AND a.kind <> 5 AND b.kind = 5 AND b.n > a.n AND a.w > 0 AND a.h > 0
  AND greatest(a.x, b.x) < least(a.x + a.w, b.x + b.w) AND greatest(a.y, b.y) < least(a.y + a.h, b.y + b.h)),
ex AS (SELECT k, n, e, lead(e) OVER (PARTITION BY k, n ORDER BY e) AS f FROM (SELECT k, n, x0 AS e FROM c UNION SELECT k, n, x1 FROM c)), ey AS (SELECT k, n, e, lead(e) OVER (PARTITION BY k, n ORDER BY e) AS f FROM (SELECT k, n, y0 AS e FROM c UNION SELECT k, n, y1 FROM c)),
v AS (SELECT k, n, sum((a.f - a.e) * (b.f - b.e)) AS covered FROM ex a JOIN ey b USING (k, n) WHERE EXISTS (SELECT 1 FROM c WHERE c.k = a.k AND c.n = a.n AND c.x0 <= a.e AND c.x1 >= a.f AND c.y0 <= b.e AND c.y1 >= b.f) GROUP BY 1, 2)"""

ORACLES: dict[str, str] = {
    "visual_inversions": f"WITH {_ROWS}, s AS (SELECT page_id, k * 16 + n AS pre, x, y FROM l WHERE w > 0 AND h > 0) SELECT a.page_id, a.pre, count(b.pre) AS seen_after FROM s a LEFT JOIN s b ON a.page_id = b.page_id AND b.pre < a.pre AND (b.y, b.x) > (a.y, a.x) GROUP BY 1, 2",
    "target_sizes": f"""WITH {_ROWS}, t AS (SELECT *, w < 24 OR h < 24 AS small, x + w / 2 AS mx, y + h / 2 AS my, kind IN (2, 3) AS exempt, CASE WHEN kind IN (1, 2) THEN href END AS doc FROM l WHERE kind <> 5 AND n <> 7 AND w > 0 AND h > 0),
        near AS (SELECT DISTINCT a.name FROM t a JOIN t b ON a.page_id = b.page_id AND a.name <> b.name AND a.small AND CASE WHEN b.small THEN pow(a.mx - b.mx, 2) + pow(a.my - b.my, 2) < 576 ELSE pow(greatest(b.x - a.mx, a.mx - b.x - b.w, 0), 2) + pow(greatest(b.y - a.my, a.my - b.y - b.h, 0), 2) < 144 END),
        f AS (SELECT * FROM t WHERE NOT exempt AND name IN (FROM near) AND NOT EXISTS (SELECT 1 FROM t b WHERE b.page_id = t.page_id AND b.doc = t.doc AND b.w >= 24 AND b.h >= 24)),
        g AS (SELECT * FROM t WHERE NOT exempt AND (w < 44 OR h < 44) AND name NOT IN (SELECT name FROM f) AND NOT EXISTS (SELECT 1 FROM t b WHERE b.page_id = t.page_id AND b.doc = t.doc AND b.w >= 44 AND b.h >= 44))
        SELECT page_id, name, 'targets/size' AS rule_id, CASE WHEN moving THEN 'untested' ELSE 'review' END AS outcome, 'medium' AS severity, w AS width, h AS height FROM f UNION ALL SELECT page_id, name, 'targets/size-enhanced', CASE WHEN moving THEN 'untested' ELSE 'review' END, 'low', w, h FROM g""",
    "order_mismatches": f"""WITH {_ROWS}, o AS (SELECT page_id, k, count(*) FILTER (kind <> 5) AS kids, bool_or(kind <> 5 AND k % 7 = 0 AND n % 3 = 0) AS moved, count(*) FILTER (kind < 5) > 1 AND bool_and(kind IN (1, 2)) FILTER (kind < 5) AND count(DISTINCT CASE kind WHEN 1 THEN href || '#s' WHEN 2 THEN href END) = 1 AS one FROM l GROUP BY 1, 2)
        SELECT page_id, k::VARCHAR AS name, 'order/visual-mismatch' AS rule_id, 'review' AS outcome, 'medium' AS severity FROM o WHERE NOT one AND (moved OR k % 5 = 0 AND kids > 1)""",
    "covered_areas": f"WITH {_ROWS}, {_CUTS} SELECT l.page_id, l.k * 16 + l.n AS pre, w * h AS area, coalesce(covered, 0) AS covered FROM l LEFT JOIN v USING (k, n) WHERE kind <> 5 AND w > 0 AND h > 0",
    "focus_covers": f"""WITH {_ROWS}, {_CUTS}, a AS (SELECT l.*, covered FROM l JOIN v USING (k, n)) SELECT page_id, name, 'focus/obscured' AS rule_id, 'review' AS outcome, 'medium' AS severity FROM a WHERE covered >= w * h UNION ALL SELECT page_id, name, 'focus/obscured-enhanced', 'review', 'low' FROM a WHERE covered > 0""",
}
