"""What rules know of an element beyond its own row: children, siblings, what lies below and before it, its text, and what its ids refer to.

All of it comes from joins, groupings and windows by page (and parent), each no larger than the page; ancestors are in the row already.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.plans.store import beside, stored

# Fixed values of HTML.
LABELABLE = "button input meter output progress select textarea".split()
HEADINGS = [f"h{k}" for k in range(1, 7)]
#: Elements whose whole text a rule reads, and attributes whose ids rules look up.
WITH_TEXT = [*HEADINGS, "dt", "option", "title"]
LOOKED_UP = "for form commandfor aria-activedescendant list headers aria-controls usemap".split()
SPACES = r"[\t\n\f\r ]+"


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda t: t != "")


def squeezed(text: Column) -> Column:
    """White space as in normalize-space(): trimmed, and runs as one blank."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def named(names: Column, *wanted: str) -> Column:
    """Whether a list of attribute names (blank-separated, as ancestors and children carry them) has one of `wanted`."""
    return reduce(lambda a, b: a | b, (F.contains(names, F.lit(f" {w} ")) for w in wanted))


def join_parts(at: str, text: str) -> Column:
    """The texts in order, a blank between them, white space squeezed."""
    return squeezed(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, text))), lambda p: p[text]), " "))


def html(tag: Column, ns: Column, *tags: str) -> Column:
    return (ns == "html") & tag.isin(*tags)


def names_of(attrs: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(F.map_keys(attrs), " "), F.lit(" "))


def with_context(nodes: DataFrame) -> DataFrame:
    """The elements of html_nodes(), with the columns
    kids (pre, tag, ns, role, names, span, value, type of child elements in order), before (tag of the element sibling before), later_srcset (whether a source or img with srcset
    follows among the siblings), txt (whole text, for WITH_TEXT), counts of what lies below, earlier (what stands before it on the page), scope and scope_others (for autofocus), same_dt,
    and found (by attribute name: what the first id that it refers to belongs to)."""
    e = nodes.filter("kind = 'element'").withColumn("names", names_of(F.col("attrs")))
    tag, ns, role = F.col("tag"), F.col("ns"), attr("role")
    span = F.coalesce(attr("colspan").try_cast("double"), F.when(attr("colspan").isNull(), F.lit(1.0)), F.lit(float("nan")))
    kid = F.struct("pre", "tag", "ns", role.alias("role"), "names", span.alias("span"), attr("value").alias("value"), attr("type").alias("type"), attr("loading").alias("loading"), attr("src").alias("src"), attr("kind").alias("kind"))
    kids = e.filter("parent_id >= 0").groupBy("page_id", F.col("parent_id").alias("pre")).agg(F.sort_array(F.collect_list(kid)).alias("kids"))

    is_ = lambda *tags: html(tag, ns, *tags)
    visible = ~named(F.col("names"), "hidden")
    marks = {
        "labelable": is_(*LABELABLE), "live_labelable": is_(*LABELABLE) & ~(is_("input") & F.coalesce(attr("type") == "hidden", F.lit(False))), "headings": is_(*HEADINGS), "h1s": is_("h1"), "lower_headings": is_(*HEADINGS[1:]),
        "mains": is_("main") & visible, "any_mains": (is_("main") | F.coalesce(role == "main", F.lit(False))) & visible, "selected": is_("option") & named(F.col("names"), "selected"),
    }
    marked = e.filter(reduce(lambda a, b: a | b, marks.values())).select("page_id", F.explode("anc.pre").alias("pre"), *(c.cast("int").alias(n) for n, c in marks.items()))
    below = marked.groupBy("page_id", "pre").agg(*(F.sum(n).alias(n) for n in marks))

    texts = nodes.filter("kind = 'text'").select("page_id", "text", F.col("pre").alias("at"), F.explode(F.filter("anc", lambda a: html(a["tag"], a["ns"], *WITH_TEXT))).alias("a"))
    texts = texts.groupBy("page_id", F.col("a.pre").alias("pre")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda t: t["text"]), "").alias("txt"))

    page = Window.partitionBy("page_id")
    so_far = page.orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    siblings = Window.partitionBy("page_id", "parent_id").orderBy("pre")
    seen = lambda c: F.coalesce(F.max(c).over(so_far), F.lit(False))
    lower = lambda c: F.lower(F.coalesce(c, F.lit("")))
    charset, typed = is_("meta") & named(F.col("names"), "charset"), is_("meta") & (lower(attr("http-equiv")) == "content-type")
    e = e.withColumns({
        "before": F.lag("tag").over(siblings), "sib_element": F.row_number().over(siblings),
        "later_srcset": F.coalesce(F.max(is_("source", "img") & named(F.col("names"), "srcset")).over(siblings.rowsBetween(1, Window.unboundedFollowing)), F.lit(False)),
        "first_summary": is_("summary") & (F.count_if(is_("summary")).over(siblings.rowsBetween(Window.unboundedPreceding, 0)) == 1),
        "earlier": F.struct(seen(is_("h1")).alias("h1"), seen(is_("h2")).alias("h2"), seen(is_("link", "script")).alias("loads"), seen(is_("meta") & F.coalesce(attr("name") == "description", F.lit(False))).alias("description")),
        "charsets": F.count_if(charset).over(page), "content_types": F.count_if(typed).over(page),
    })
    # The element whose own table, list, or focus scope this one is in; 0 is no element that could be one of them above another.
    nearest = lambda test: F.coalesce(F.get(F.filter("anc", test), F.lit(0))["pre"], F.lit(-1))
    e = e.withColumns({"table": nearest(lambda a: html(a["tag"], a["ns"], "table")), "dl": nearest(lambda a: html(a["tag"], a["ns"], "dl")), "scope": nearest(lambda a: html(a["tag"], a["ns"], "dialog") | named(a["names"], "popover"))})
    focused = named(F.col("names"), "autofocus")
    others = e.filter(focused).groupBy("page_id", "scope").agg(F.count("*").alias("scope_others"))
    e = e.join(others, ["page_id", "scope"], "left")
    e = beside(e, [kids, below, texts])
    e = e.withColumns({"kids": F.coalesce("kids", F.array().cast(kids.schema["kids"].dataType)), "txt": F.coalesce(squeezed(F.col("txt")), F.lit("")), **{n: F.coalesce(n, F.lit(0)) for n in marks}})
    width = F.aggregate(F.filter("kids", lambda k: html(k["tag"], k["ns"], "td", "th")), F.lit(0.0), lambda acc, k: acc + k["span"])
    e = stored(e.withColumn("row_width", F.when(is_("tr"), width)))
    terms = Window.partitionBy("page_id", "dl", "txt").orderBy("pre")
    same = e.filter(html(tag, ns, "dt") & (F.col("dl") >= 0) & (F.col("txt") != "")).select("page_id", "pre", (F.row_number().over(terms) > 1).alias("same_dt")).filter("same_dt")
    more = beside(e, [same, labelled_words(e, nodes), *references(e)])
    return beside(more, table_widths(e), ["page_id", "table"]).withColumn("same_dt", F.coalesce("same_dt", F.lit(False)))


def labelled_words(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """page_id, pre, labelled_words: whether an element that aria-labelledby names has text or a label; no row where there is none."""
    words = nodes.filter("kind = 'text'").filter(F.rlike("text", F.lit(r"\S"))).select("page_id", F.explode("anc.pre").alias("pre")).unionByName(e.filter(F.trim(attr("aria-label")) != "").select("page_id", "pre")).distinct()
    target = e.filter(attr("id").isNotNull()).select("page_id", "pre", attr("id").alias("target")).join(words, ["page_id", "pre"], "left_semi").select("page_id", "target").distinct()
    asked = e.filter(attr("aria-labelledby").isNotNull()).select("page_id", "pre", F.explode(tokens(attr("aria-labelledby"))).alias("target"))
    return asked.join(target, ["page_id", "target"]).select("page_id", "pre", F.lit(True).alias("labelled_words")).distinct()


def table_widths(e: DataFrame) -> list[DataFrame]:
    """By page_id and table: from_markup (columns by col and colgroup, no row without colgroup), and first_width (of its first row)."""
    tag, ns = F.col("tag"), F.col("ns")
    spans = F.coalesce(attr("span").try_cast("double"), F.when(attr("span").isNull(), F.lit(1.0)), F.lit(float("nan")))
    up = F.get("anc", F.lit(0))
    columns = e.filter(html(tag, ns, "col") & html(up["tag"], up["ns"], "colgroup") | html(tag, ns, "colgroup") & ~F.exists("kids", lambda k: k["tag"] == "col"))
    columns = columns.filter(F.when(tag == "col", F.get("anc", F.lit(1))["pre"]).otherwise(up["pre"]) == F.col("table")).groupBy("page_id", "table").agg(F.sum(spans).alias("from_markup"))
    over = F.get("anc", F.lit(1))
    rows = e.filter(html(tag, ns, "tr") & ((up["pre"] == F.col("table")) | html(up["tag"], up["ns"], "thead", "tbody", "tfoot") & (over["pre"] == F.col("table"))))
    rows = rows.groupBy("page_id", "table").agg(F.min_by("row_width", "pre").alias("first_width"))
    return [columns, rows]


def references(e: DataFrame) -> list[DataFrame]:
    """By page_id and pre: ids (how often its own id is on the page), owned (roles of elements that aria-owns it), panels (whether a tabpanel's aria-labelledby is its id); and found (map from an attribute
    of LOOKED_UP to what has that id), only where there is any."""
    tag, ns = F.col("tag"), F.col("ns")
    role_tokens = tokens(attr("role"))
    ids = e.filter(attr("id").isNotNull()).groupBy("page_id", attr("id").alias("target")).agg(
        F.count("*").alias("n"), F.bool_or(html(tag, ns, *LABELABLE) & ~(html(tag, ns, "input") & F.coalesce(attr("type") == "hidden", F.lit(False)))).alias("labelable"), F.bool_or(html(tag, ns, "form")).alias("form"),
        F.bool_or(F.array_contains(role_tokens, "tabpanel")).alias("panel"), F.min_by(F.struct(tag.alias("tag"), ns.alias("ns"), F.col("table").alias("table")), "pre").alias("first"),
    )
    wanted = F.explode(F.array_compact(F.array(*(F.when(attr(a).isNotNull(), F.struct(F.lit(a).alias("name"), attr(a).alias("target"))) for a in LOOKED_UP if a != "usemap"))))
    asked = e.select("page_id", "pre", wanted.alias("w")).select("page_id", "pre", "w.name", F.explode(F.when(F.col("w.name").isin("headers", "list"), tokens(F.col("w.target"))).otherwise(F.array("w.target"))).alias("target"))
    hit = asked.join(ids, ["page_id", "target"]).select("page_id", "pre", "name", F.struct("labelable", "form", "panel", "first").alias("what"))
    maps = e.filter(html(tag, ns, "map")).select("page_id", attr("name").alias("target")).distinct()
    none = F.lit(None).cast(hit.schema["what"].dataType)
    used = e.filter(attr("usemap").isNotNull()).select("page_id", "pre", F.lit("usemap").alias("name"), map_name().alias("target")).join(maps, ["page_id", "target"]).select("page_id", "pre", "name", none.alias("what"))
    found = hit.unionByName(used).groupBy("page_id", "pre", "name").agg(F.collect_list("what").alias("what")).groupBy("page_id", "pre").agg(F.map_from_entries(F.collect_list(F.struct("name", "what"))).alias("found"))
    owners = e.filter(attr("aria-owns").isNotNull()).select("page_id", F.explode(tokens(attr("aria-owns"))).alias("target"), attr("role").alias("role")).groupBy("page_id", "target").agg(F.collect_set("role").alias("owned"))
    labelled = e.filter(F.array_contains(role_tokens, "tabpanel") & attr("aria-labelledby").isNotNull()).select("page_id", attr("aria-labelledby").alias("target"), F.lit(True).alias("panels")).distinct()
    own = e.filter(attr("id").isNotNull()).select("page_id", "pre", attr("id").alias("target")).join(ids.select("page_id", "target", F.col("n").alias("ids")), ["page_id", "target"]).join(owners, ["page_id", "target"], "left").join(labelled, ["page_id", "target"], "left").drop("target")
    return [own, found]


def map_name() -> Column:
    """What follows the first # of usemap; empty without one."""
    return F.regexp_extract(attr("usemap"), r"(?s)^[^#]*#(.*)$", 1)
