"""Axes of a node table as joins: rows (page_id, node_id, parent_id, pre, post, sib, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _interval(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("page_id").alias("_p"), F.col("pre").alias("_pre"), F.col("post").alias("_post"))


def having_ancestor(nodes: DataFrame, ancestors: DataFrame, how: str = "left_semi") -> DataFrame:
    """The nodes below one of `ancestors` (left_semi), or below none (left_anti)."""
    a = _interval(ancestors)
    return nodes.join(a, (F.col("page_id") == F.col("_p")) & (F.col("_pre") < F.col("pre")) & (F.col("pre") <= F.col("_post")), how)


def having_descendant(nodes: DataFrame, descendants: DataFrame, how: str = "left_semi") -> DataFrame:
    """The nodes above one of `descendants`, or above none."""
    d = _interval(descendants)
    return nodes.join(d, (F.col("page_id") == F.col("_p")) & (F.col("pre") < F.col("_pre")) & (F.col("_pre") <= F.col("post")), how)


def children(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    return nodes.join(parents.select("page_id", F.col("node_id").alias("parent_id")), ["page_id", "parent_id"], "left_semi")


def parents(nodes: DataFrame, every: DataFrame) -> DataFrame:
    """The parents of `nodes`, each once."""
    return every.join(nodes.select("page_id", F.col("parent_id").alias("node_id")), ["page_id", "node_id"], "left_semi")


def siblings(nodes: DataFrame, every: DataFrame, after: bool = True) -> DataFrame:
    """The siblings after (or before) one of `nodes`: those after the first, or before the last, of a parent."""
    edge = (F.min if after else F.max)("sib").alias("_edge")
    bounds = nodes.groupBy("page_id", "parent_id").agg(edge)
    there = F.col("sib") > F.col("_edge") if after else F.col("sib") < F.col("_edge")
    return every.join(bounds, ["page_id", "parent_id"]).filter(there).drop("_edge")


def following(nodes: DataFrame, every: DataFrame) -> DataFrame:
    """The nodes that begin after one of `nodes` has ended: the earliest end of a page decides, so no pair is made."""
    return every.join(nodes.groupBy("page_id").agg(F.min("post").alias("_end")), "page_id").filter("pre > _end").drop("_end")


def preceding(nodes: DataFrame, every: DataFrame) -> DataFrame:
    """The nodes that have ended before one of `nodes` begins: the latest begin of a page decides."""
    return every.join(nodes.groupBy("page_id").agg(F.max("pre").alias("_begin")), "page_id").filter("post < _begin").drop("_begin")


def attributes(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, name, value of every attribute."""
    return nodes.filter("attrs is not null").select("page_id", "node_id", F.explode("attrs").alias("name", "value"))


def sets_equal(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key: where some value of `left` is one of `right` (equality of node sets is existential)."""
    return left.select(key, value).distinct().join(right.select(key, value).distinct(), [key, value], "left_semi").select(key).distinct()


def sets_less(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key: where some number of `left` is smaller than some number of `right`: the least against the greatest, not all pairs."""
    low, high = left.groupBy(key).agg(F.min(value).alias("_low")), right.groupBy(key).agg(F.max(value).alias("_high"))
    return low.join(high, key).filter("_low < _high").select(key)


def in_document_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("page_id", "pre")


def positions(rows: DataFrame, context: list[str], order: list[Column]) -> DataFrame:
    """position and last of each row among those of its context."""
    w = Window.partitionBy(*context)
    return rows.withColumns({"position": F.row_number().over(w.orderBy(*order)), "last": F.count("*").over(w)})


def inherited(nodes: DataFrame, values: DataFrame, name: str) -> DataFrame:
    """Each node's own value, or that of the nearest ancestor with one (values: page_id, pre, `name`): a structural join and the innermost of what it finds."""
    up = nodes.select("page_id", "pre", F.explode(F.concat(F.array("pre"), "anc.pre")).alias("_at"))
    found = up.join(values.select("page_id", F.col("pre").alias("_at"), F.col(name)), ["page_id", "_at"])
    return nodes.join(found.groupBy("page_id", "pre").agg(F.max_by(name, "_at").alias(name)), ["page_id", "pre"], "left")


def element_paths(nodes: DataFrame) -> DataFrame:
    """page_id, pre, path: tag:nth-child(k) of each element and those above it, outermost first."""
    e = nodes.filter("kind = 'element'")
    k = F.row_number().over(Window.partitionBy("page_id", "parent_id").orderBy("pre"))
    step = e.select("page_id", F.col("pre").alias("_at"), F.concat("tag", F.lit(":nth-child("), k.cast("string"), F.lit(")")).alias("_step"))
    up = e.select("page_id", "pre", F.explode(F.concat(F.array("pre"), "anc.pre")).alias("_at")).join(step, ["page_id", "_at"])
    return up.groupBy("page_id", "pre").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_at", "_step"))), lambda s: s["_step"]), " > ").alias("path"))
