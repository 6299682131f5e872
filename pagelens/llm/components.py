"""Connected components by repeated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """node, label: the smallest label (of any ordered type; a null one last) that each of `nodes` (node, label; each node once) reaches over `links` (a, b).

    The links are contracted: in each round every node points to the smallest neighbour (its own
    id included), large-star and small-star by turns, until stars are all that is left; the number of rounds
    grows with the logarithm of the longest path. Nodes without links keep their label and take no part.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct()
    edges = written(edges)  # a checkpoint of these can keep constraints on columns that are no more, which later unions fail on
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u != v").distinct()
        last, edges = edges, written(small)
        forget(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.unionByName(edges.select(F.col("v").alias("u"), "v")).distinct()
    joined = nodes.join(stars.withColumnRenamed("u", "node"), "node", "left").withColumn("root", F.coalesce("v", "node"))
    best = joined.filter("v is not null").groupBy("root").agg(F.min("label").alias("best"))
    return joined.join(best, "root", "left").select("node", F.coalesce("best", "label").alias("label"))
