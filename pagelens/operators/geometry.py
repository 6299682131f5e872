"""Rules on measured boxes: order on the screen, size and spacing of targets, what covers a focused control.

A browser's measurements come as a table (page_id, pre, x, y, width, height and what else was measured; null is "not measured"). Boxes meet by grid
cells, never each with each: a box is put into cells about as large as itself, so it lies in four at most, and is looked for in the cells of its own
size and above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pagelens.plans.store import released, stored

from .context import attr
from .names import has

# Fixed values of WCAG: least sizes of targets in CSS pixels, and what may be a target by its role.
TARGET, TARGET_ENHANCED = 24.0, 44.0
POINTER_ROLES = "button link checkbox radio switch tab menuitem menuitemcheckbox menuitemradio option slider spinbutton treeitem".split()
REPLACED = "img svg video canvas picture object embed".split()
#: Cells of these sizes: 2^4 to 2^20 pixels.
LEVELS = (4, 20)
#: Targets whose centres lie in one cell of this size are less than TARGET apart.
NEAR = 16.0


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def tab_reachable() -> Column:
    """Whether the tab key reaches an element, by its markup."""
    tabindex = F.trim(attr("tabindex")).try_cast("int")
    tag = F.col("tag")
    native = (tag.isin("a", "area") & has("href")) | ((tag == "input") & ~_false(F.lower(F.trim(attr("type"))) == "hidden")) | tag.isin("button", "select", "textarea", "summary", "iframe")
    off = has("disabled") & tag.isin("button", "input", "select", "textarea")
    return F.when(tabindex.isNotNull(), tabindex >= 0).otherwise(native & ~off)


def first_role() -> Column:
    return F.lower(F.get(F.filter(F.split(F.coalesce(attr("role"), F.lit("")), r"\s+"), lambda t: t != ""), F.lit(0)))


def inversions(items: DataFrame, group: list[str], first: list, second: list) -> DataFrame:
    """items with `seen_after`: how many items of the same group stand before this one by `first` and after it by `second`.

    Ties in `second` keep the order of `first`, so they count nothing. Spark ranks the items and sorts them by `second`; tasks then count, in whole groups, the later items of a lower place by `first`. Nothing is joined and no row is doubled.
    """
    whole = Window.partitionBy(*group)
    ranked = items.withColumn("_d", F.row_number().over(whole.orderBy(*first)))
    ranked = ranked.withColumn("_v", F.row_number().over(whole.orderBy(*second, "_d"))).sortWithinPartitions(*group, *second, "_d")
    return ranked.mapInArrow(_inversions, StructType([*items.schema.fields, StructField("seen_after", LongType())]))


def _inversions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items without _d and _v, with seen_after. A group, which begins where _v is 1, may reach over batches; it is kept until the next one begins."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("_v").to_numpy() == 1)
        if len(starts):
            last = int(starts[-1])
            done = [x for x in (*kept, batch.slice(0, last)) if x.num_rows]
            if done:
                yield _counted(done)
            kept = []
            batch = batch.slice(last)
        if batch.num_rows:
            kept.append(batch)
    if kept:
        yield _counted(kept)


def _counted(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    # Groups one after the other are one permutation: no item of a group stands before one of an earlier group.
    v = whole.column("_v").to_numpy().astype(np.int64)
    base = np.arange(len(v)) - (v - 1)
    seen = later_smaller(whole.column("_d").to_numpy().astype(np.int64) - 1 + base)
    return pa.RecordBatch.from_pydict({n: whole.column(n) for n in whole.schema.names if n not in ("_d", "_v")} | {"seen_after": pa.array(seen, pa.int64())})


def later_smaller(places: np.ndarray) -> np.ndarray:
    """For each item of a permutation of 0 to n - 1, how many later ones are smaller: places are compared bit by bit from the highest; two that differ first in one bit are counted in that bit's group."""
    out, order = np.zeros(len(places), np.int64), np.arange(len(places))
    for level in reversed(range((len(places) - 1).bit_length())):
        value = places[order]
        key, low = value >> (level + 1), (value >> level) & 1 == 0
        lows = np.cumsum(low)
        ends = np.searchsorted(key, key, "right") - 1
        out[order] += np.where(low, 0, lows[ends] - lows)
        order = order[np.argsort(value >> level, kind="stable")]
    return out


def visual_inversions(boxes: DataFrame) -> DataFrame:
    """page_id, pre, seen_after of measured boxes: how many boxes earlier in the document are seen later, read line by line from the top and left.

    Boxes without a place or size (null or zero) aren't seen and are left out; boxes at one place keep the document's order.
    """
    seen = boxes.filter("x is not null and y is not null and width > 0 and height > 0")
    return inversions(seen.select("page_id", "pre", "y", "x"), ["page_id"], ["pre"], ["y", "x"]).select("page_id", "pre", "seen_after")


def order_findings(nodes: DataFrame, measured: DataFrame) -> DataFrame:
    """order/visual-mismatch: flex containers that run backwards with two or more children that matter, and parents of children moved by `order`.

    A child matters if the tab key reaches something in it or it has text. Containers whose controls all lead to one address are left alone. `measured`
    has flex_reversed and order; where both are null nothing is known and nothing is found.
    """
    e = nodes.filter("kind = 'element'")
    reach = e.filter(tab_reachable()).select("page_id", "pre", F.col("anc.pre").alias("up"), F.when(F.col("tag") == "a", attr("href")).alias("href"))
    texts = nodes.filter("kind = 'text'").filter(F.rlike("text", F.lit(r"\S"))).select("page_id", F.explode("anc.pre").alias("pre"))
    content = texts.unionByName(reach.select("page_id", F.explode(F.concat(F.array("pre"), "up")).alias("pre"))).distinct()
    one_target = reach.select("page_id", F.explode("up").alias("pre"), "href").groupBy("page_id", "pre").agg((((F.count("*") > 1) & (F.count("href") == F.count("*")) & (F.min("href") == F.max("href")))).alias("one_target")).filter("one_target")
    kids = e.filter("parent_id >= 0").join(content, ["page_id", "pre"], "left_semi").select("page_id", "pre", F.col("parent_id").alias("at"))
    moved = measured.select("page_id", "pre", _false(F.col("order") != 0).alias("moved"))
    kids = kids.join(moved, ["page_id", "pre"], "left").groupBy("page_id", F.col("at").alias("pre")).agg(F.count("*").alias("kids"), F.bool_or(_false(F.col("moved"))).alias("moved"))
    found = e.select("page_id", "pre").join(kids, ["page_id", "pre"]).join(measured.select("page_id", "pre", "flex_reversed"), ["page_id", "pre"], "left").filter((_false(F.col("flex_reversed")) & (F.col("kids") > 1)) | F.col("moved"))
    return _finding(found.join(one_target, ["page_id", "pre"], "left_anti"), "order/visual-mismatch", "review", "medium")


def _finding(rows: DataFrame, rule: str, outcome: str | Column, severity: str) -> DataFrame:
    return rows.select("page_id", F.lit(rule).alias("rule_id"), (F.lit(outcome) if isinstance(outcome, str) else outcome).alias("outcome"), F.lit(severity).alias("severity"), "pre")


def _cells(x0: Column, y0: Column, x1: Column, y1: Column, levels: Column) -> Column:
    """(level, cx, cy) of every cell of the levels that a box touches."""
    at = lambda v, level: F.floor(v / F.pow(F.lit(2.0), level)).cast("long")
    columns = lambda level: F.transform(F.sequence(at(x0, level), at(x1, level)), lambda cx: F.struct(level.alias("level"), cx.alias("cx")))
    of_level = lambda level: F.flatten(F.transform(columns(level), lambda c: F.transform(F.sequence(at(y0, level), at(y1, level)), lambda cy: F.struct(c["level"].alias("level"), c["cx"].alias("cx"), cy.alias("cy")))))
    return F.flatten(F.transform(levels, of_level))


def _level(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The smallest level whose cells are as large as the box."""
    size = F.greatest(x1 - x0, y1 - y0, F.lit(1.0))
    return F.least(F.greatest(F.ceil(F.log2(size)), F.lit(LEVELS[0])), F.lit(LEVELS[1])).cast("int")


def placed(df: DataFrame, name: str, by: str, levels: Column, other: DataFrame | None = None, beyond: bool = False) -> DataFrame:
    """_by, `name` (a struct of the row without `by`), level, cx, cy of every cell of `levels` (an expression over _level, the row's own) that a row touches; with `other` only of levels that are own ones of its rows with the same `by`, or, `beyond`, that lie above one of these."""
    box = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    rows = df.withColumn("_level", _level(*box))
    if other is not None:
        bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k - F.lit(LEVELS[0]))
        there = other.groupBy(F.col(by).alias("_other")).agg(F.bit_or(bit(_level(*box))).alias("_there"))
        rows = rows.join(there, F.col(by) == F.col("_other"))
        levels = F.filter(levels, lambda k: (bit(k) - 1 if beyond else bit(k)).bitwiseAND(F.col("_there")) != 0)
    return rows.select(F.col(by).alias("_by"), F.struct(*(c for c in df.columns if c != by)).alias(name), F.explode(_cells(*box, levels)).alias("_c")).select("_by", name, "_c.level", "_c.cx", "_c.cy")


def overlapping(left: DataFrame, right: DataFrame, by: str = "page_id") -> DataFrame:
    """Pairs of rows whose closed boxes (x0, y0, x1, y1) touch, with columns l and r (structs of the rows); `by` is what both must share.

    Each pair meets at the larger box's level; of the cells where it meets, the one with the larger low corner counts. A box is put only into cells of levels that boxes of the other side with the same `by` have, or, where it is the larger one, if there are smaller ones.
    """
    own, upward = F.array("_level"), F.sequence("_level", F.lit(LEVELS[1]))
    above = F.filter(upward, lambda k: k > F.col("_level"))
    pairs = placed(left, "l", by, upward, right).join(placed(right, "r", by, own), ["_by", "level", "cx", "cy"]).unionByName(placed(left, "l", by, own, right, True).join(placed(right, "r", by, above, left), ["_by", "level", "cx", "cy"]))
    width = F.pow(F.lit(2.0), F.col("level"))
    low_x, low_y = F.greatest("l.x0", "r.x0"), F.greatest("l.y0", "r.y0")
    meet = (low_x <= F.least("l.x1", "r.x1")) & (low_y <= F.least("l.y1", "r.y1"))
    return pairs.filter(meet & (F.floor(low_x / width) == F.col("cx")) & (F.floor(low_y / width) == F.col("cy"))).select(*(F.struct(F.col("_by").alias(by), f"{side}.*").alias(side) for side in "lr"))


def pointer_targets(nodes: DataFrame, measured: DataFrame) -> DataFrame:
    """page_id, pre, x, y, width, height of every visible target of a pointer, with exempt (in running text, or part of its label), document (where a link leads), hidden_from_tree and animating.

    A link that is an inline box reaches over the replaced elements in it. Targets that are inert, let clicks through, are visually hidden or lie outside aren't any.
    """
    e = nodes.filter("kind = 'element'")
    tag, kind = F.col("tag"), F.lower(F.trim(attr("type")))
    native = (tag.isin("a", "area") & has("href")) | (tag.isin("button", "select", "textarea", "summary") & ~has("disabled")) | ((tag == "input") & ~has("disabled") & ~_false(kind == "hidden"))
    target = ~tag.isin("iframe", "frame", "object", "embed") & (native | _false(first_role().isin(POINTER_ROLES)) | tab_reachable())
    inert = has("inert") | F.exists("anc", lambda a: F.contains(a["names"], F.lit(" inert ")))
    unseen = _false(F.trim(attr("aria-hidden")) == "true") | F.exists("anc", lambda a: a["hidden"] & F.contains(a["names"], F.lit(" aria-hidden ")))
    shown = measured.filter("width > 0 and height > 0")
    found = e.filter(target & ~inert).withColumns({"unseen": unseen, "document": F.nullif(F.when(tag == "a", F.regexp_extract(F.trim(attr("href")), r"(?s)^([^#]*)", 1)), F.lit("")), "check": (tag == "input") & _false(kind.isin("checkbox", "radio"))})
    found = found.join(shown, ["page_id", "pre"]).filter(~_false(F.col("pointer_events_none")) & ~_false(F.col("visually_hidden")))
    inner = e.filter(tag.isin(REPLACED)).select("page_id", F.col("pre").alias("at"), F.explode("anc.pre").alias("pre")).join(shown.filter("display is null or display <> 'none'").select("page_id", F.col("pre").alias("at"), "x", "y", "width", "height"), ["page_id", "at"])
    inner = inner.groupBy("page_id", "pre").agg(F.min("x").alias("ix0"), F.min("y").alias("iy0"), F.max(F.col("x") + F.col("width")).alias("ix1"), F.max(F.col("y") + F.col("height")).alias("iy1"))
    found = found.join(inner, ["page_id", "pre"], "left")
    wide = F.col("display") == "inline"
    low = lambda own, other: F.when(wide & F.col(other).isNotNull(), F.least(own, other)).otherwise(F.col(own))
    high = lambda own, size, other: F.when(wide & F.col(other).isNotNull(), F.greatest(F.col(own) + F.col(size), other)).otherwise(F.col(own) + F.col(size))
    found = found.withColumns({"x0": low("x", "ix0"), "y0": low("y", "iy0"), "x1": high("x", "width", "ix1"), "y1": high("y", "height", "iy1")}).filter("x1 > 0 and y1 > 0")

    beside = nodes.filter("kind = 'text'").filter(F.rlike("text", F.lit(r"\S"))).select("page_id", "parent_id").distinct().withColumn("beside_text", F.lit(True))
    labels = e.filter((tag == "label") & attr("for").isNotNull()).select("page_id", attr("for").alias("id")).distinct().withColumn("labelled", F.lit(True))
    found = found.join(beside, ["page_id", "parent_id"], "left").withColumn("id", attr("id")).join(labels, ["page_id", "id"], "left")
    exempt = ((tag == "a") & _false(F.col("beside_text"))) | (F.col("check") & (F.exists("anc", lambda a: a["tag"] == "label") | _false(F.col("labelled"))))
    return found.select("page_id", "pre", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), exempt.alias("exempt"), "document", F.col("unseen").alias("hidden_from_tree"), _false(F.col("animating")).alias("animating"))


def crowded(targets: DataFrame, least: float = TARGET) -> DataFrame:
    """page_id, pre of targets under the least size whose circle of that diameter touches another target, or the circle of another small one.

    Small targets whose centres share a cell of NEAR pixels are crowded without being compared; only those alone in theirs are compared with what lies near.
    """
    small = (F.col("width") < least) | (F.col("height") < least)
    cx, cy = F.col("x") + F.col("width") / 2, F.col("y") + F.col("height") / 2
    placed = targets.withColumns({"small": small, "mx": cx, "my": cy})
    near = least * (NEAR / TARGET)
    cell = Window.partitionBy("page_id", F.floor(F.col("mx") / near), F.floor(F.col("my") / near))
    few = placed.filter("small").withColumn("n", F.count("*").over(cell))
    point = [F.col("mx").alias("x0"), F.col("my").alias("y0"), F.col("mx").alias("x1"), F.col("my").alias("y1")]
    alone = few.filter("n = 1").select("page_id", "pre", *point)
    reach = F.when(F.col("small"), F.lit(least)).otherwise(F.lit(least / 2))
    x0, y0 = F.when(F.col("small"), F.col("mx")).otherwise(F.col("x")), F.when(F.col("small"), F.col("my")).otherwise(F.col("y"))
    x1, y1 = F.when(F.col("small"), F.col("mx")).otherwise(F.col("x") + F.col("width")), F.when(F.col("small"), F.col("my")).otherwise(F.col("y") + F.col("height"))
    around = placed.select("page_id", "pre", reach.alias("reach"), (x0 - reach).alias("x0"), (y0 - reach).alias("y0"), (x1 + reach).alias("x1"), (y1 + reach).alias("y1"))
    pairs = overlapping(alone, around).filter("l.pre <> r.pre")
    dx = F.greatest(F.col("r.x0") + F.col("r.reach") - F.col("l.x0"), F.col("l.x0") - F.col("r.x1") + F.col("r.reach"), F.lit(0.0))
    dy = F.greatest(F.col("r.y0") + F.col("r.reach") - F.col("l.y0"), F.col("l.y0") - F.col("r.y1") + F.col("r.reach"), F.lit(0.0))
    close = pairs.filter(dx * dx + dy * dy < F.col("r.reach") * F.col("r.reach")).select("l.page_id", "l.pre").distinct()
    return few.filter("n > 1").select("page_id", "pre").unionByName(close)


def target_findings(nodes: DataFrame, measured: DataFrame) -> DataFrame:
    """targets/size and targets/size-enhanced, with width and height.

    targets/size: under 24 pixels, too near to another target, not in running text, not part of a label, and no visible link of that size leads to the same document. Enhanced: under 44 pixels,
    with the same exceptions but no spacing, unless targets/size finds it already. What still moves is untested. `measured` has x, y, width, height, display, pointer_events_none, visually_hidden, animating.
    """
    targets = stored(pointer_targets(nodes, measured))
    open_ones = targets.filter("not exempt")

    def without_equal(rows: DataFrame, least: float) -> DataFrame:
        large = targets.filter((F.col("width") >= least) & (F.col("height") >= least) & ~F.col("hidden_from_tree")).select("page_id", "document").filter("document is not null").distinct()
        return rows.join(large, ["page_id", "document"], "left_anti")

    small = stored(without_equal(open_ones.join(crowded(targets), ["page_id", "pre"], "left_semi"), TARGET))
    moving = F.when(F.col("animating"), "untested").otherwise("review")
    tagged = lambda rows, rule, severity: rows.select("page_id", F.lit(rule).alias("rule_id"), moving.alias("outcome"), F.lit(severity).alias("severity"), "pre", "width", "height")
    wider = without_equal(open_ones.filter((F.col("width") < TARGET_ENHANCED) | (F.col("height") < TARGET_ENHANCED)), TARGET_ENHANCED).join(small.select("page_id", "pre"), ["page_id", "pre"], "left_anti")
    return tagged(small, "targets/size", "medium").unionByName(tagged(wider, "targets/size-enhanced", "low"))


def covered_area(boxes: DataFrame, covers: DataFrame) -> DataFrame:
    """page_id, pre, area, covered of boxes: how much of each lies under the union of the covers painted above it.

    boxes: page_id, pre, paint, x, y, width, height; covers likewise. A cover counts if its paint is greater and it isn't the box itself. A box's covers are cut to it; the edges of the cuts part it into
    upright strips, and in each strip a sweep from the top adds up what the covers take (the running end of those before is a window, so overlaps count once). Null or empty boxes have no row,
    null or empty covers cover nothing.
    """
    edges = lambda df: df.filter("width > 0 and height > 0 and x is not null and y is not null and paint is not null").select("page_id", "pre", "paint", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("width")).alias("x1"), (F.col("y") + F.col("height")).alias("y1"))
    own = edges(boxes)
    pairs = overlapping(own, edges(covers)).filter("r.paint > l.paint and r.pre <> l.pre")
    cuts = stored(pairs.select("l.page_id", "l.pre", *(f("l." + c, "r." + c).alias(c) for f, c in ((F.greatest, "x0"), (F.greatest, "y0"), (F.least, "x1"), (F.least, "y1")))).filter("x0 < x1 and y0 < y1"))
    # The strips between neighbouring edges; a cut is put into those that it spans by the places of its edges among all.
    ends = cuts.select("page_id", "pre", F.explode(F.array("x0", "x1")).alias("edge")).distinct()
    by_edge = Window.partitionBy("page_id", "pre").orderBy("edge")
    ends = ends.withColumns({"k": F.row_number().over(by_edge), "next": F.lead("edge").over(by_edge)})
    begins, stops = ends.select("page_id", "pre", F.col("edge").alias("x0"), F.col("k").alias("a")), ends.select("page_id", "pre", F.col("edge").alias("x1"), F.col("k").alias("b"))
    strips = cuts.join(begins, ["page_id", "pre", "x0"]).join(stops, ["page_id", "pre", "x1"]).select("page_id", "pre", "y0", "y1", F.explode(F.sequence("a", F.col("b") - 1)).alias("k"))
    sweep = Window.partitionBy("page_id", "pre", "k").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    taken = strips.withColumn("done", F.max("y1").over(sweep)).withColumn("new", F.greatest(F.col("y1") - F.greatest("y0", F.coalesce("done", "y0")), F.lit(0.0)))
    taken = taken.groupBy("page_id", "pre", "k").agg(F.sum("new").alias("tall")).join(ends.select("page_id", "pre", "k", (F.col("next") - F.col("edge")).alias("wide")), ["page_id", "pre", "k"])
    taken = taken.groupBy("page_id", "pre").agg(F.sum(F.col("tall") * F.col("wide")).alias("covered"))
    return own.select("page_id", "pre", ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))).alias("area")).join(taken, ["page_id", "pre"], "left").withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def cover_findings(nodes: DataFrame, measured: DataFrame) -> DataFrame:
    """focus/obscured and focus/obscured-enhanced.

    Where the browser tried points after focusing (points, covered), they decide: all covered is obscured, any covered is obscured at the enhanced level. Otherwise a bar that hides what is
    focused (hides_focus), or a reachable, visible control that something covers (obscured), is found. `measured` has these columns, visually_hidden too; with_cover() fills points and covered from boxes.
    """
    may = measured.filter("points > 0 and covered >= points or covered > 0 or hides_focus or obscured")
    e = nodes.filter("kind = 'element'").select("page_id", "pre", tab_reachable().alias("reach")).join(may.select("page_id", "pre", "points", "covered", "hides_focus", "obscured", "visually_hidden"), ["page_id", "pre"])
    tried = F.col("covered").isNotNull()
    shown = F.col("reach") & ~_false(F.col("visually_hidden"))
    whole = _false((F.col("points") > 0) & (F.col("covered") >= F.col("points")))
    bits = ~whole & (_false(F.col("hides_focus")) | (_false(F.col("obscured")) & ~tried & shown))
    each = F.array(F.when(whole | bits, F.struct(F.lit("focus/obscured").alias("rule_id"), F.lit("medium").alias("severity"))), F.when(shown & _false(F.col("covered") > 0), F.struct(F.lit("focus/obscured-enhanced").alias("rule_id"), F.lit("low").alias("severity"))))
    return e.select("page_id", "pre", F.explode(F.array_compact(each)).alias("f")).select("page_id", "f.rule_id", F.lit("review").alias("outcome"), "f.severity", "pre")


def with_cover(nodes: DataFrame, measured: DataFrame) -> DataFrame:
    """measured with points (the area of a control's box) and covered (what fixed and sticky boxes painted above it take of that), where neither was measured.

    Boxes that a control lies in, and boxes within the control, don't cover it. `measured` has x, y, width, height, paint (later is above) and position.
    """
    e = nodes.filter("kind = 'element'").select("page_id", "pre", tab_reachable().alias("reach"), F.col("anc.pre").alias("up"))
    bar = _false(F.col("position").isin("fixed", "sticky"))
    things = stored(measured.select("page_id", "pre", "paint", "x", "y", "width", "height", bar.alias("bar")).join(e, ["page_id", "pre"], "left").withColumn("reach", _false(F.col("reach"))).filter("reach or bar"))
    boxes, bars = (things.filter(kind).drop("reach", "bar", "up") for kind in ("reach", "bar"))
    # A bar around or within the control is a cover of a copy of it that is left out, by control: rare, so those controls are measured apart.
    above = things.select("page_id", F.col("pre").alias("at"), F.col("reach").alias("control"), F.col("bar").alias("cover"))
    pairs = things.select("page_id", "pre", "reach", "bar", F.explode("up").alias("at")).join(above, ["page_id", "at"]).filter("reach and cover or bar and control")
    each = F.array(F.when(F.col("reach") & F.col("cover"), F.struct(F.col("pre").alias("pre"), F.col("at").alias("bar"))), F.when(F.col("bar") & F.col("control"), F.struct(F.col("at").alias("pre"), F.col("pre").alias("bar"))))
    related = stored(pairs.select("page_id", F.explode(F.array_compact(each)).alias("p")).select("page_id", "p.*"))
    areas = stored(_covered_without(boxes, bars, related))
    released(things, related)
    rows = measured.join(areas, ["page_id", "pre"], "left")
    return rows.withColumns({"points": F.coalesce(F.col("points").cast("double"), "_area"), "covered": F.coalesce(F.col("covered").cast("double"), "_covered")}).drop("_area", "_covered")


def _covered_without(boxes: DataFrame, bars: DataFrame, related: DataFrame) -> DataFrame:
    """Covered area of boxes by bars, without the pairs in `related`: a box with such a pair is measured on a page of its own, with the other bars of its page."""
    if not related.limit(1).count():
        return covered_area(boxes, bars).select("page_id", "pre", F.col("area").alias("_area"), F.col("covered").alias("_covered"))
    apart = related.groupBy("page_id", "pre").agg(F.collect_set("bar").alias("not"))
    key = lambda c: F.concat(F.col("page_id").cast("string"), F.lit("/"), c)
    plain = covered_area(boxes.join(apart, ["page_id", "pre"], "left_anti"), bars)
    own = boxes.join(apart, ["page_id", "pre"]).withColumns({"page": F.col("page_id"), "page_id": key(F.col("pre").cast("string"))})
    theirs = bars.join(apart.select("page_id", F.col("pre").alias("box"), "not"), "page_id").filter(~F.array_contains("not", F.col("pre"))).withColumn("page_id", key(F.col("box").cast("string")))
    others = covered_area(own, theirs).join(own.select("page_id", "pre", "page"), ["page_id", "pre"]).select(F.col("page").alias("page_id"), "pre", "area", "covered")
    return plain.unionByName(others).select("page_id", "pre", F.col("area").alias("_area"), F.col("covered").alias("_covered"))


