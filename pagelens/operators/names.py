"""Roles and accessible names of elements, on the node table.

Names from content are a structural aggregation: every text, and every element whose name doesn't come from its content (aria-label, alt, a
control's value), is a part of all elements above it up to the nearest one that is named otherwise. One explode over the ancestors and one grouping gives all
of them; references (aria-labelledby, label for) are joins by page and id. A reference from within referenced content isn't followed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.plans.store import stored

from .context import attr, join_parts, named, names_of, squeezed, tokens

# Fixed values of WAI-ARIA: roles, those named from their content, those that mustn't be named, attributes that keep an element from being presentational.
ROLES = """alert alertdialog application article banner blockquote button caption cell checkbox code columnheader combobox complementary contentinfo definition deletion dialog directory document emphasis feed
figure form generic grid gridcell group heading img insertion link list listbox listitem log main mark marquee math menu menubar menuitem menuitemcheckbox menuitemradio meter navigation none note option
paragraph presentation progressbar radio radiogroup region row rowgroup rowheader scrollbar search searchbox separator slider spinbutton status strong subscript superscript switch tab table tablist tabpanel
term textbox time timer toolbar tooltip tree treegrid treeitem""".split()
FROM_CONTENT = "button cell checkbox columnheader gridcell heading link menuitem menuitemcheckbox menuitemradio option radio row rowheader sectionhead switch tab tooltip treeitem".split()
PROHIBITED = "caption code deletion emphasis generic insertion paragraph presentation none strong subscript superscript term time".split()
GLOBAL = "atomic busy controls current describedby details dropeffect errormessage flowto grabbed haspopup invalid keyshortcuts label labelledby live owns relevant roledescription".split()
EMBEDDED = "textbox searchbox combobox listbox slider spinbutton progressbar scrollbar checkbox radio switch".split()
IMPLICIT = {
    "article": "article", "aside": "complementary", "blockquote": "blockquote", "button": "button", "caption": "caption", "code": "code", "datalist": "listbox", "dd": "definition", "del": "deletion", "details": "group", "dfn": "term",
    "dialog": "dialog", "dt": "term", "em": "emphasis", "fieldset": "group", "figure": "figure", "form": "form", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "hr": "separator",
    "html": "document", "ins": "insertion", "li": "listitem", "main": "main", "mark": "mark", "menu": "list", "ul": "list", "ol": "list", "meter": "meter", "nav": "navigation", "optgroup": "group", "option": "option", "output": "status",
    "p": "paragraph", "progress": "progressbar", "search": "search", "strong": "strong", "sub": "subscript", "summary": "button", "sup": "superscript", "table": "table", "tbody": "rowgroup", "tfoot": "rowgroup", "thead": "rowgroup",
    "td": "cell", "textarea": "textbox", "time": "time", "tr": "row", "div": "generic", "span": "generic",
}
INPUTS = {"button": "button", "image": "button", "reset": "button", "submit": "button", "checkbox": "checkbox", "number": "spinbutton", "radio": "radio", "range": "slider"}


def table_of(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def has(*names: str) -> Column:
    return named(names_of(F.col("attrs")), *names)


def input_type() -> Column:
    return F.lower(F.trim(F.coalesce(attr("type"), F.lit("text"))))


def implicit_role() -> Column:
    """The role that an element has by its name and attributes, or null."""
    tag, kind = F.col("tag"), input_type()
    inside = F.exists("anc", lambda a: a["tag"].isin("article", "aside", "nav", "section"))
    listed = has("multiple") | F.coalesce(F.trim(attr("size")).try_cast("int") > 1, F.lit(False))
    field = F.when(kind.isin("email", "tel", "text", "url"), F.when(has("list"), "combobox").otherwise("textbox")).when(kind == "search", F.when(has("list"), "combobox").otherwise("searchbox")).otherwise(table_of(INPUTS)[kind])
    return (
        F.when(tag.isin("a", "area"), F.when(has("href"), "link").otherwise("generic")).when(tag == "img", F.when(attr("alt") == "", "presentation").otherwise("img")).when(tag == "input", field)
        .when(tag == "select", F.when(listed, "listbox").otherwise("combobox")).when(tag == "th", F.when(attr("scope").isin("row", "rowgroup"), "rowheader").otherwise("columnheader"))
        .when(tag == "header", F.when(inside, "generic").otherwise("banner")).when(tag == "footer", F.when(inside, "generic").otherwise("contentinfo"))
        .when(tag == "section", F.when(has("aria-label", "aria-labelledby"), "region").otherwise("generic")).otherwise(table_of(IMPLICIT)[tag])
    )


def focusable() -> Column:
    control = F.col("tag").isin("button", "input", "select", "textarea")
    off = control & (has("disabled") | F.exists("anc", lambda a: (a["tag"] == "fieldset") & named(a["names"], "disabled")))
    other = (F.col("tag").isin("a", "area") & has("href")) | F.trim(attr("tabindex")).try_cast("int").isNotNull() | F.coalesce(F.lower(F.trim(attr("contenteditable"))) != "false", F.lit(False))
    return ~off & ((control & ~F.coalesce(F.lower(F.trim(attr("type"))) == "hidden", F.lit(False))) | other)


def role() -> Column:
    """The first known role that the element names, unless it is presentational on something focusable or globally described; else the implicit one."""
    first = F.get(F.filter(tokens(attr("role")), lambda t: t.isin(ROLES)), F.lit(0))
    kept = first.isNotNull() & ~(first.isin("none", "presentation") & (focusable() | has(*(f"aria-{g}" for g in GLOBAL))))
    return F.when(kept, first).otherwise(implicit_role())


def hidden() -> Column:
    return has("hidden") | F.coalesce(attr("aria-hidden") == "true", F.lit(False)) | F.exists("anc", lambda a: a["hidden"])


def _named_above(a: Column) -> Column:
    """Whether an ancestor takes its name from elsewhere, so that what is in it is no part of names further up."""
    return named(a["names"], "aria-label", "aria-labelledby") | a["tag"].isin("select", "textarea", "svg")


def _content(parts: DataFrame) -> DataFrame:
    """page_id, pre, content, shown: parts (page_id, at, text, anc, hidden) put together for every element that they belong to, all of them and those that aren't hidden (null without one)."""
    reach = F.coalesce(F.nullif(F.array_position(F.transform("anc", _named_above), True), F.lit(0)), F.size("anc"))
    above = parts.select("page_id", "at", "text", "hidden", F.explode(F.slice("anc", F.lit(1), reach.cast("int"))["pre"]).alias("pre"))
    grouped = above.groupBy("page_id", "pre").agg(F.sort_array(F.collect_list(F.struct("at", "text", "hidden"))).alias("parts"))
    texts = lambda kept: squeezed(F.array_join(F.transform(kept, lambda p: p["text"]), " "))
    shown = F.filter("parts", lambda p: ~p["hidden"])
    return grouped.select("page_id", "pre", texts(F.col("parts")).alias("content"), F.when(F.size(shown) > 0, texts(shown)).alias("shown"))


def _subtree(nodes: DataFrame, *tags: str) -> DataFrame:
    """page_id, tag, pre, parent, plain: the whole text of elements with such names, without that of controls in them."""
    texts = nodes.filter("kind = 'text'").filter(~F.exists("anc", lambda a: a["tag"].isin("select", "textarea") & ~F.lit("textarea" in tags or "option" in tags)))
    found = texts.select("page_id", F.col("pre").alias("at"), "text", F.explode(F.filter("anc", lambda a: a["tag"].isin(*tags))).alias("a"))
    return found.groupBy("page_id", F.col("a.tag").alias("tag"), F.col("a.pre").alias("pre")).agg(join_parts("at", "text").alias("plain"))


def with_names(nodes: DataFrame) -> DataFrame:
    """The elements of html_nodes() with role, hidden, focusable, native (the host language's label), name and description; null for none."""
    e = nodes.filter("kind = 'element'").withColumns({"role": role(), "hidden": hidden(), "focusable": focusable()})
    first_id = e.filter(attr("id").isNotNull()).groupBy("page_id", attr("id").alias("target")).agg(F.min_by(F.struct("pre", "tag"), "pre").alias("first")).select("page_id", "target", F.col("first.pre").alias("pre"), F.col("first.tag").alias("tag"))
    plain = _subtree(nodes, "label", "legend", "figcaption", "caption", "title")
    parented = plain.join(e.select("page_id", "pre", F.col("parent_id").alias("parent")), ["page_id", "pre"])
    child = lambda tag, name: parented.filter(F.col("tag") == tag).groupBy("page_id", F.col("parent").alias("pre")).agg(F.min_by("plain", "pre").alias(name))

    labels = e.filter("tag = 'label'").select("page_id", F.col("pre").alias("label"), attr("for").alias("target"), "anc", "post")
    worded = plain.filter("tag = 'label' and plain != ''").select("page_id", F.col("pre").alias("label"), "plain")
    by_for = labels.filter("target is not null").join(worded, ["page_id", "label"]).join(first_id.select("page_id", "target", "pre"), ["page_id", "target"]).groupBy("page_id", "pre").agg(join_parts("label", "plain").alias("for_label"))
    around = e.select("page_id", "pre", F.get(F.filter("anc", lambda a: a["tag"] == "label"), F.lit(0))["pre"].alias("label")).filter("label is not null").join(worded, ["page_id", "label"]).select("page_id", "pre", F.col("plain").alias("own_label"))
    caption = nodes.filter("kind = 'text'").select("page_id", F.col("pre").alias("at"), "text", F.filter("anc", lambda a: a["tag"] == "figcaption").alias("c"), "anc").filter("size(c) > 0")
    caption = caption.select("page_id", "at", "text", F.explode(F.filter("anc", lambda a: a["tag"] == "figure")).alias("f")).groupBy("page_id", F.col("f.pre").alias("pre")).agg(join_parts("at", "text").alias("figure_caption"))
    options = nodes.filter("kind = 'text'").select("page_id", "text", F.col("pre").alias("at"), F.get(F.filter("anc", lambda a: a["tag"] == "option"), F.lit(0)).alias("o"), F.get(F.filter("anc", lambda a: a["tag"].isin("select", "datalist")), F.lit(0)).alias("s")).filter("o is not null and s is not null")
    options = options.groupBy("page_id", "s.pre", F.col("o.pre").alias("option"), F.contains("o.names", F.lit(" selected ")).alias("chosen")).agg(join_parts("at", "text").alias("t")).groupBy("page_id", "pre").agg(F.min_by("t", F.struct(~F.col("chosen"), "option")).alias("chosen"))
    area = nodes.filter("kind = 'text'").select("page_id", "text", F.col("pre").alias("at"), F.get(F.filter("anc", lambda a: a["tag"] == "textarea"), F.lit(0))["pre"].alias("pre")).filter("pre is not null").groupBy("page_id", "pre").agg(join_parts("at", "text").alias("typed"))
    for side in (by_for, around, caption, options, area, child("legend", "legend"), child("caption", "table_caption"), child("title", "svg_title")):
        e = e.join(side, ["page_id", "pre"], "left")

    tag, kind, label = F.col("tag"), input_type(), F.coalesce("for_label", "own_label")
    native = (
        F.when(tag.isin("img", "area"), attr("alt"))
        .when(tag == "input", F.when(kind == "button", attr("value")).when(kind == "submit", F.coalesce(attr("value"), F.lit("Submit"))).when(kind == "reset", F.coalesce(attr("value"), F.lit("Reset"))).when(kind == "image", F.coalesce(attr("alt"), label, F.lit("Submit Query"))).otherwise(F.coalesce(label, attr("placeholder"))))
        .when(tag.isin("select", "textarea", "meter", "progress", "output"), label).when(tag == "fieldset", F.col("legend")).when(tag == "figure", F.col("figure_caption")).when(tag == "table", F.col("table_caption"))
        .when(tag == "svg", F.col("svg_title")).when(tag == "iframe", attr("title"))
    )
    filled = lambda c: F.nullif(squeezed(c), F.lit(""))
    may = ~F.coalesce(F.col("role").isin(PROHIBITED), F.lit(False))
    value = F.when(F.col("role").isin("textbox", "searchbox"), F.coalesce(attr("value"), F.col("typed"))).when(F.col("role").isin("combobox", "listbox"), F.col("chosen")).when(F.col("role").isin("slider", "spinbutton", "progressbar", "scrollbar"), F.coalesce(attr("aria-valuetext"), attr("aria-valuenow"), attr("value")))
    e = stored(e.withColumns({"native": filled(native), "own": F.when(may, filled(attr("aria-label")))}))
    embedded = F.coalesce(F.col("role").isin(EMBEDDED), F.lit(False))
    part = F.coalesce(F.when(~embedded, F.col("own")), F.when(may, F.col("native")), filled(value))
    parts = nodes.filter("kind = 'text'").select("page_id", F.col("pre").alias("at"), "text", "anc", F.exists("anc", lambda a: a["hidden"]).alias("hidden"))
    parts = parts.unionByName(e.filter(part.isNotNull()).select("page_id", F.col("pre").alias("at"), part.alias("text"), "anc", "hidden"))
    bare = e.select("page_id", "pre", "anc", "hidden", attr("title").alias("text")).filter((F.trim("text") != "") & F.lit(True)).join(parts.select("page_id", F.explode("anc.pre").alias("pre")).distinct(), ["page_id", "pre"], "left_anti").join(e.filter(part.isNotNull()).select("page_id", "pre"), ["page_id", "pre"], "left_anti")
    parts = parts.unionByName(bare.select("page_id", F.col("pre").alias("at"), "text", "anc", "hidden"))
    e = stored(e.join(_content(parts), ["page_id", "pre"], "left"))

    target = e.select("page_id", "pre", F.coalesce("own", F.when(may, F.col("native")), filled(value), filled(F.col("content")), filled(attr("title"))).alias("words")).join(first_id.select("page_id", "pre", "target"), ["page_id", "pre"]).select("page_id", "target", "words")

    def referred(name: str) -> DataFrame:
        asked = e.filter(attr(name).isNotNull()).select("page_id", "pre", F.posexplode(tokens(attr(name))).alias("k", "target"))
        return asked.join(target, ["page_id", "target"]).groupBy("page_id", "pre").agg(join_parts("k", "words").alias(name))

    e = e.join(referred("aria-labelledby"), ["page_id", "pre"], "left").join(referred("aria-describedby"), ["page_id", "pre"], "left")
    content = F.when(F.col("role").isin(FROM_CONTENT), filled(F.col("shown")))
    name = F.when(~F.col("hidden"), F.coalesce(filled(F.col("`aria-labelledby`")), "own", F.when(may, F.col("native")), content, filled(attr("title"))))
    otherwise = F.when(has("aria-label", "aria-labelledby") | F.col("native").isNotNull(), filled(attr("title")))
    dropped = ["for_label", "own_label", "figure_caption", "chosen", "typed", "legend", "table_caption", "svg_title", "own", "content", "shown", "aria-labelledby", "aria-describedby"]
    return e.withColumns({"name": name, "description": F.coalesce(filled(F.col("`aria-describedby`")), otherwise), "visible_text": filled(F.col("shown"))}).drop(*dropped)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
