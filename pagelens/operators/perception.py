"""What assistive technology perceives: the accessibility tree in reading order, how its nodes are announced, and what an interaction changes.

Snapshots are rows (snapshot_id, node_id, ord, parent_id, ignored, role, name, properties map, backend_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .context import squeezed

# The states that differences track, how roles and states are announced, roles that imply that they can be focused.
TRACKED = "expanded hidden selected invalid modal checked pressed".split()
ANNOUNCED = {"button": "button", "link": "link", "textbox": "text_box", "searchbox": "text_box", "checkbox": "check_box", "radio": "radio", "combobox": "combo_box", "listbox": "list_box", "slider": "slider", "spinbutton": "spin_button", "tab": "tab", "navigation": "navigation", "main": "main", "banner": "banner", "contentinfo": "content_info"}
STATES = {
    "expanded": ("collapsed", "expanded"), "checked": ("unchecked", "checked"), "selected": ("not_selected", "selected"), "pressed": ("not_pressed", "pressed"), "required": (None, "required"), "invalid": (None, "invalid"), "disabled": (None, "disabled"),
}
SELF_FOCUSED = "button link textbox searchbox checkbox radio combobox listbox slider spinbutton tab".split()


def from_names(named: DataFrame) -> DataFrame:
    """The accessibility tree of with_names(): ignored where hidden or without role and name; properties are the states that attributes give."""
    attrs = F.col("attrs")
    states = F.map_filter(F.map_from_arrays(F.array(*(F.lit(s) for s in (*TRACKED, "required", "disabled", "level"))), F.array(*(attrs[f"aria-{s}"] for s in (*TRACKED, "required", "disabled", "level")))), lambda k, v: v.isNotNull())
    return named.select("page_id", F.col("pre").cast("string").alias("node_id"), F.col("pre").alias("ord"), F.col("parent_id").cast("string").alias("parent_id"), (F.col("hidden") | F.col("role").isNull()).alias("ignored"), "role", "name", "description", states.alias("properties"), "focusable", F.col("pre").cast("long").alias("backend_id"))


def with_derived(tree: DataFrame, by: str) -> DataFrame:
    """Flags of each node: interactive, heading with its level, landmark, labelled."""
    role = F.col("role")
    return tree.withColumns({
        "interactive": role.isin(SELF_FOCUSED), "heading_level": F.when(role == "heading", F.coalesce(F.col("properties")["level"].try_cast("int"), F.lit(2))), "is_landmark": role.isin("banner", "complementary", "contentinfo", "form", "main", "navigation", "region", "search"),
        "labelled": F.coalesce(F.trim("name") != "", F.lit(False)),
    }).withColumn("children", F.count("parent_id").over(Window.partitionBy(by, "parent_id")))


def linearized(tree: DataFrame, by: str) -> DataFrame:
    """seq from 1 of the nodes that are perceived, in reading order."""
    seen = tree.filter("not ignored and (coalesce(trim(name), '') != '' or role not in ('generic', 'none', 'presentation'))")
    return seen.withColumn("seq", F.row_number().over(Window.partitionBy(by).orderBy("ord")))


def announced_states(role: Column, properties: Column, tab_stop: Column) -> Column:
    """States in the words they are announced with, in their order; negative ones only where they tell something, and focusable only where the role doesn't imply it."""
    said = lambda name, value: F.when(value == "mixed", "mixed" if name == "checked" else STATES[name][1]).when(F.lower(value) == "false", F.lit(STATES[name][0])).otherwise(STATES[name][1])
    words = F.array_compact(F.array(*(F.when(properties[name].isNotNull(), said(name, properties[name])) for name in STATES)))
    return F.when(tab_stop & ~F.coalesce(role.isin(SELF_FOCUSED), F.lit(False)), F.concat(words, F.array(F.lit("focusable")))).otherwise(words)


def announced(items: DataFrame) -> DataFrame:
    """items with said_name (trimmed, null if blank), said_role (heading with its level, other roles as they are, generic for none), said_states."""
    role = F.coalesce("role", F.lit("generic"))
    known = F.create_map(*(F.lit(x) for pair in ANNOUNCED.items() for x in pair))[role]
    heading = F.concat(F.lit("heading"), F.coalesce(F.concat(F.lit(" "), F.col("properties")["level"].try_cast("int").cast("string")), F.lit("")))
    return items.withColumns({"said_name": F.nullif(F.trim("name"), F.lit("")), "said_role": F.when(role == "heading", heading).otherwise(F.coalesce(known, role)), "said_states": announced_states(F.col("role"), F.col("properties"), F.col("focusable"))})


def _keyed(tree: DataFrame, suffix: str, keys: list[str]) -> DataFrame:
    """Nodes by what stays the same between two snapshots: the backend's number, or the node's own id where there is none."""
    key = F.when(F.col("backend_id").isNotNull(), F.concat(F.lit("b"), F.col("backend_id").cast("string"))).otherwise(F.concat(F.lit("n"), F.col("node_id")))
    return tree.select(*keys, key.alias("key"), F.col("ignored").alias(f"ignored_{suffix}"), F.col("properties").alias(f"properties_{suffix}"), F.col("node_id").alias(f"node_{suffix}"), "backend_id")


def tree_diff(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """by, node_id, backend_id, change (added, removed, property), property, before, after: nodes that became perceivable or ceased to be, and tracked states that differ. Being there isn't enough: a hidden node that is shown keeps its id."""
    both = _keyed(before, "a", [by]).drop("backend_id").join(_keyed(after, "b", [by]), [by, "key"], "full_outer")
    seen = lambda s: ~F.coalesce(F.col(f"ignored_{s}"), F.lit(True))
    none = F.lit(None).cast("string")
    change = lambda kind, prop, x, y: F.struct(F.lit(kind).alias("change"), prop.alias("property"), x.alias("before"), y.alias("after"))
    value = lambda s, p: F.col(f"properties_{s}")[p]
    there = F.col("node_a").isNotNull() & F.col("node_b").isNotNull()
    differs = lambda p: F.when(there & ~value("a", p).eqNullSafe(value("b", p)), change("property", F.lit(p), F.coalesce(value("a", p), F.lit("")), F.coalesce(value("b", p), F.lit(""))))
    found = F.array_compact(F.array(F.when(seen("b") & ~seen("a"), change("added", none, none, none)), F.when(seen("a") & ~seen("b"), change("removed", none, none, none)), *map(differs, TRACKED)))
    return both.select(by, F.coalesce("node_b", "node_a").alias("node_id"), "backend_id", F.explode(found).alias("c")).select(by, "node_id", "backend_id", "c.*")


def journey(snapshots: DataFrame, nodes: DataFrame) -> DataFrame:
    """The differences of each snapshot to the one before it on its journey (snapshots: journey_id, step, snapshot_id, title, url, focus): steps are paired by a window, nodes by a join."""
    w = Window.partitionBy("journey_id").orderBy("step")
    pairs = snapshots.withColumns({"earlier": F.lag("snapshot_id").over(w), "title_changed": ~F.lag("title").over(w).eqNullSafe(F.col("title")), "url_changed": ~F.lag("url").over(w).eqNullSafe(F.col("url")), "focus_moved": ~F.lag("focus").over(w).eqNullSafe(F.col("focus"))}).filter("earlier is not null")
    pairs = pairs.withColumn("pair", F.concat_ws(">", "earlier", "snapshot_id"))
    side = lambda name: nodes.join(pairs.select("pair", F.col(name).alias("snapshot_id")), "snapshot_id")
    return pairs.select("journey_id", "step", "pair", "title_changed", "url_changed", "focus_moved").join(tree_diff(side("earlier"), side("snapshot_id"), "pair"), "pair", "left")


def property_change(diff: DataFrame, backend_id: int, name: str) -> DataFrame:
    return diff.filter((F.col("change") == "property") & (F.col("backend_id") == backend_id) & (F.col("property") == name))


def viewport_overlap(box: Column, view: Column) -> Column:
    """The share of a box struct(x, y, w, h) that lies in the viewport; null for an empty box."""
    side = lambda p, s: F.greatest(F.lit(0.0), F.least(box[p] + box[s], view[p] + view[s]) - F.greatest(box[p], view[p]))
    area = box["w"] * box["h"]
    return F.when(area > 0, side("x", "w") * side("y", "h") / area)


def visible_text_length(nodes: DataFrame) -> DataFrame:
    """page_id, chars: the bytes of all texts perceived on each page, each with its white space squeezed."""
    shown = nodes.filter("kind = 'text'").filter(~F.exists("anc", lambda a: a["hidden"] | a["tag"].isin("script", "style", "template", "noscript", "head")))
    return shown.groupBy("page_id").agg(F.sum(F.octet_length(squeezed(F.col("text")))).cast("long").alias("chars"))
