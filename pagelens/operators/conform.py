"""Conformance checks beyond elements and attributes: scripts as data, the grid of tables, normalised text, what can't be checked here."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import attr

SPECULATION_KEYS = "source where urls requires eagerness referrer_policy relative_to expects_no_vary_search target_hint tag".split()
EAGERNESS = "immediate eager moderate conservative".split()


def script_texts(nodes: DataFrame, kind: str) -> DataFrame:
    """page_id, pre, json: the content of inline scripts of a type."""
    scripts = nodes.filter((F.col("tag") == "script") & (F.lower(F.trim(attr("type"))) == kind) & attr("src").isNull()).select("page_id", "pre")
    texts = nodes.filter("kind = 'text'").select("page_id", F.col("parent_id").alias("pre"), F.col("text").alias("json"))
    return scripts.join(texts, ["page_id", "pre"], "left").withColumn("json", F.coalesce("json", F.lit("")))



def import_map_findings(nodes: DataFrame) -> DataFrame:
    """page_id, pre, rule_id, message of import maps that aren't JSON objects, have other keys than imports, scopes and integrity, or values of other types than strings and null."""
    rows = script_texts(nodes, "importmap").withColumn("v", F.try_parse_json("json"))
    entries = lambda path: F.from_json(F.get_json_object("json", path), "map<string,string>")
    scopes = F.from_json(F.get_json_object("json", "$.scopes"), "map<string,map<string,string>>")
    bad = lambda m: F.exists(F.map_entries(m), lambda e: (e["key"] == "") | F.rlike(F.coalesce(e["value"], F.lit("")), F.lit(r"^[\[{]")) | (F.endswith(e["key"], F.lit("/")) & ~F.endswith(F.coalesce(e["value"], F.lit("/")), F.lit("/"))))
    other = F.exists(F.json_object_keys("json"), lambda k: ~k.isin("imports", "scopes", "integrity"))
    messages = F.array_compact(F.array(
        F.when(F.col("v").isNull(), F.lit("not JSON")), F.when(F.col("v").isNotNull() & ~F.startswith(F.trim("json"), F.lit("{")), F.lit("not an object")), F.when(F.coalesce(other, F.lit(False)), F.lit("unknown key")),
        F.when(F.coalesce(bad(entries("$.imports")), F.lit(False)), F.lit("imports has an invalid entry")), F.when(F.coalesce(F.exists(F.map_values(scopes), bad), F.lit(False)), F.lit("scopes has an invalid entry")),
    ))
    return rows.select("page_id", "pre", F.lit("scripts.import-map").alias("rule_id"), F.explode(messages).alias("message"))


def speculation_rule_findings(nodes: DataFrame) -> DataFrame:
    """page_id, pre, rule_id, message of speculation rules that aren't JSON objects of prefetch and prerender lists of rules with known keys, sources and eagerness."""
    rows = script_texts(nodes, "speculationrules").withColumn("v", F.try_parse_json("json"))
    lists = F.concat(*(F.coalesce(F.from_json(F.get_json_object("json", f"$.{k}"), "array<map<string,string>>"), F.array().cast("array<map<string,string>>")) for k in ("prefetch", "prerender")))
    other = F.exists(F.json_object_keys("json"), lambda k: ~k.isin("prefetch", "prerender", "tag"))
    odd = lambda r: F.exists(F.map_keys(r), lambda k: ~k.isin(SPECULATION_KEYS)) | (r["source"].isNotNull() & ~r["source"].isin("list", "document")) | (r["eagerness"].isNotNull() & ~r["eagerness"].isin(EAGERNESS)) | ((r["source"] == "list") & r["urls"].isNull()) | (r["urls"].isNotNull() & r["where"].isNotNull())
    messages = F.array_compact(F.array(
        F.when(F.col("v").isNull(), F.lit("not JSON")), F.when(F.col("v").isNotNull() & ~F.startswith(F.trim("json"), F.lit("{")), F.lit("not an object")), F.when(F.coalesce(other, F.lit(False)), F.lit("unknown key")),
        F.when(F.coalesce(F.exists(lists, odd), F.lit(False)), F.lit("invalid rule")),
    ))
    return rows.select("page_id", "pre", F.lit("scripts.speculation-rules").alias("rule_id"), F.explode(messages).alias("message"))


def table_grid(nodes: DataFrame) -> DataFrame:
    """page_id, table, pre, row, column, rows, columns, overlaps of every cell: where it comes to lie when cells above reach down with rowspan. Spans carry from row to row, so a table is laid out as a whole, in one group; row groups end spans."""
    cells = nodes.filter(F.col("tag").isin("td", "th")).withColumns({"row_at": F.get("anc", F.lit(0))["pre"], "group_at": F.get("anc", F.lit(1))["pre"], "table": F.get(F.filter("anc", lambda a: a["tag"] == "table"), F.lit(0))["pre"]}).filter("table is not null")
    span = lambda name, most: F.least(F.greatest(F.coalesce(F.trim(attr(name)).try_cast("int"), F.lit(1)), F.lit(0 if name == "rowspan" else 1)), F.lit(most))
    rows = cells.select("page_id", "table", "group_at", "row_at", "pre", span("rowspan", 65534).alias("rows"), span("colspan", 1000).alias("columns"))

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        out, number = [], 0
        for _, group in pdf.sort_values("pre").groupby("group_at", sort=False):
            reach: dict[int, int] = {}
            for _, row in group.groupby("row_at", sort=False):
                at = 0
                for c in row.itertuples():
                    while reach.get(at, -1) >= number:
                        at += 1
                    taken = range(at, at + c.columns)
                    overlaps = any(reach.get(k, -1) >= number for k in taken)
                    last = number + c.rows - 1 if c.rows else 10**6
                    reach.update({k: max(last, reach.get(k, -1)) for k in taken})
                    out.append((c.page_id, c.table, c.pre, number, at, c.rows, c.columns, overlaps))
                    at += c.columns
                number += 1
        return pd.DataFrame(out, columns=["page_id", "table", "pre", "row", "column", "rows", "columns", "overlaps"])

    return rows.groupBy("page_id", "table").applyInPandas(lay, "page_id long, table int, pre int, row int, column int, rows int, columns int, overlaps boolean")


def table_findings(nodes: DataFrame) -> DataFrame:
    """page_id, pre, rule_id, message: cells that lie on others, rows below the last one that rowspan asks for, columns no cell begins in."""
    grid = table_grid(nodes)
    size = grid.groupBy("page_id", "table").agg((F.max("row") + 1).alias("height"), F.max(F.col("column") + F.col("columns")).alias("width"), F.countDistinct("column").alias("begun"))
    cells = grid.join(size, ["page_id", "table"])
    over = cells.filter("overlaps").select("page_id", "pre", F.lit("cells overlap").alias("message"))
    deep = cells.filter("rows > 0 and row + rows > height").select("page_id", "pre", F.lit("rowspan reaches below the table").alias("message"))
    thin = size.filter("begun < width").select("page_id", F.col("table").alias("pre"), F.lit("a column has no cell that begins in it").alias("message"))
    return over.unionByName(deep).unionByName(thin).select("page_id", "pre", F.lit("tables.integrity").alias("rule_id"), "message")


def unnormalized(nodes: DataFrame) -> DataFrame:
    """page_id, pre: texts that aren't in Unicode's composed normal form. Texts of ASCII alone are; the others go to Python in Arrow batches, as Spark has no such function."""

    @F.pandas_udf("boolean")
    def composed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield part.map(lambda t: unicodedata.is_normalized("NFC", t))

    some = nodes.filter("kind = 'text'").filter(F.rlike("text", F.lit(r"[^\x00-\x{2FF}]")))
    return some.filter(~composed(F.col("text"))).select("page_id", "pre", F.lit("text.normalization").alias("rule_id"))


def skipped(nodes: DataFrame) -> DataFrame:
    """page_id, reason: what of a page isn't checked: styles in elements, scripts of unknown types, frames, foreign content."""
    reason = F.when(F.col("tag") == "style", "css").when(F.col("tag").isin("iframe", "object", "embed"), "embedded documents").when(F.col("ns").isin("svg", "math"), "foreign content").when((F.col("tag") == "script") & attr("src").isNotNull(), "external scripts")
    return nodes.filter("kind = 'element'").select("page_id", reason.alias("reason")).filter("reason is not null").distinct()


def catalogue(spark) -> DataFrame:
    """rule_id, layer, severity of every conformance rule."""
    from .assertions import patterns

    rows = [(f"assertion.{name}", "assertion", severity) for p in patterns() for _, checks in p for name, severity, _ in checks]
    rows += [("scripts.import-map", "scripts", "error"), ("scripts.speculation-rules", "scripts", "error"), ("csp.meta-enforcement", "csp", "warning"), ("tables.integrity", "tables", "error"), ("text.normalization", "text", "warning")]
    return spark.createDataFrame(rows, "rule_id string, layer string, severity string")


def all_findings(nodes: DataFrame) -> DataFrame:
    """page_id, pre, rule_id, severity of every conformance check, from one stored node table."""
    from .assertions import assertion_findings
    from .policies import enforcement_findings

    severe = lambda df, s: df.select("page_id", "pre", "rule_id", F.lit(s).alias("severity"))
    policy = enforcement_findings(nodes).select("page_id", "pre", F.lit("csp.meta-enforcement").alias("rule_id"), F.when(F.col("verdict") == "blocked", "warning").otherwise("info").alias("severity"))
    parts = [assertion_findings(nodes).select("page_id", "pre", "rule_id", "severity"), severe(import_map_findings(nodes), "error"), severe(speculation_rule_findings(nodes), "error"), policy, severe(table_findings(nodes), "error"), severe(unnormalized(nodes), "warning")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
