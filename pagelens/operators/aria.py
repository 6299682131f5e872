"""Which ARIA attributes a role supports: the taxonomy of roles as a graph, closed by joins, against the attributes that elements have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.plans.store import stored

from .context import attr
from .names import has

# Fixed values of WAI-ARIA 1.2: each role's superclasses, and after / the attributes that it adds to theirs (without "aria-").
TAXONOMY = """
structure: / label labelledby roledescription
section: structure /
sectionhead: structure /
landmark: section /
window: structure /
widget: structure /
input: widget /
command: widget /
composite: widget / activedescendant
range: structure / valuemax valuemin valuenow valuetext
select: composite group / orientation
alert: section /
alertdialog: alert dialog /
application: structure / activedescendant expanded
article: document / posinset setsize
banner: landmark /
blockquote: section /
button: command / expanded pressed
caption: / roledescription
cell: section / colindex colspan rowindex rowspan
checkbox: input / checked expanded readonly required
code: / roledescription
columnheader: gridcell sectionhead / sort
combobox: input / activedescendant autocomplete expanded readonly required
complementary: landmark /
contentinfo: landmark /
definition: section /
deletion: / roledescription
dialog: window / modal
directory: list /
document: structure /
emphasis: / roledescription
feed: list /
figure: section /
form: landmark /
generic: /
grid: composite table / multiselectable readonly
gridcell: cell widget / expanded readonly required selected
group: section / activedescendant
heading: sectionhead / level
img: section /
insertion: / roledescription
link: command / expanded
list: section /
listbox: select / expanded multiselectable readonly required
listitem: section / level posinset setsize
log: section /
main: landmark /
marquee: section /
math: section /
menu: select /
menubar: menu /
menuitem: command / expanded posinset setsize
menuitemcheckbox: menuitem / checked
menuitemradio: menuitem / checked
meter: range /
navigation: landmark /
none: / roledescription
note: section /
option: input / checked posinset selected setsize
paragraph: / roledescription
presentation: / roledescription
progressbar: range /
radio: input / checked posinset setsize
radiogroup: select / readonly required
region: landmark /
row: group widget / colindex expanded level posinset rowindex selected setsize
rowgroup: structure /
rowheader: gridcell sectionhead / sort
scrollbar: range / orientation
search: landmark /
searchbox: textbox /
separator: structure / orientation valuemax valuemin valuenow valuetext
slider: input range / orientation readonly
spinbutton: composite input range / readonly required
status: section /
strong: / roledescription
subscript: / roledescription
superscript: / roledescription
switch: checkbox /
tab: sectionhead widget / expanded posinset selected setsize
table: section / colcount rowcount
tablist: composite / multiselectable orientation
tabpanel: section /
term: section /
textbox: input / activedescendant autocomplete multiline placeholder readonly required
time: section /
timer: status /
toolbar: group / orientation
tooltip: section /
tree: select / multiselectable required
treegrid: grid tree /
treeitem: listitem option / expanded
"""
#: What every role supports, and roles that only build others.
GLOBAL = "atomic busy controls current describedby details disabled dropeffect errormessage flowto grabbed haspopup hidden invalid keyshortcuts live owns relevant".split()
ABSTRACT = "structure section sectionhead landmark window widget input command composite range select".split()
#: Roles that mustn't have a name.
NAMELESS = "caption code deletion emphasis generic insertion none paragraph presentation strong subscript superscript".split()
#: Rows of the closure that are broadcast at most.
MOST_PAIRS = 10_000


def taxonomy(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(parents, own): role and superclass, role and attribute that it adds."""
    parents, own = [], []
    for line in TAXONOMY.strip().splitlines():
        role, rest = line.split(":")
        above, added = rest.split("/")
        parents += [(role, p) for p in above.split()]
        own += [(role, f"aria-{a}") for a in added.split()]
    return spark.createDataFrame(parents, "role string, parent string"), spark.createDataFrame(own, "role string, attribute string")


def closure(edges: DataFrame, child: str = "role", parent: str = "parent") -> DataFrame:
    """All pairs of a thing and what is above it, by doubling: each round joins the pairs with themselves until none is new. Cycles end as they add nothing."""
    pairs = edges.select(F.col(child).alias("a"), F.col(parent).alias("b")).distinct()
    count = pairs.count()
    while True:
        further = pairs.alias("x").join(pairs.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b")
        pairs = stored(pairs.union(further).distinct())
        before, count = count, pairs.count()
        if count == before:
            return pairs.select(F.col("a").alias(child), F.col("b").alias(parent))


def supported(spark: SparkSession) -> DataFrame:
    """role, attribute: all that each role supports, its own and its superclasses', and what all support. Abstract roles have no rows."""
    parents, own = taxonomy(spark)
    above = closure(parents)
    inherited = above.join(own.select(F.col("role").alias("parent"), "attribute"), "parent").select("role", "attribute")
    roles = parents.select("role").union(own.select("role")).union(spark.createDataFrame([("generic",)], "role string")).distinct()
    common = roles.withColumn("attribute", F.explode(F.array(*(F.lit(f"aria-{g}") for g in GLOBAL))))
    return own.unionByName(inherited).unionByName(common).distinct().filter(~F.col("role").isin(ABSTRACT))


def native_conflict(attribute: Column, value: Column) -> Column:
    """Whether HTML says it already: ARIA that mustn't stand beside a native attribute or state."""
    tag, wrong = F.col("tag"), F.lower(value) == "false"
    kind = F.lower(F.trim(attr("type")))
    other = lambda name: attr(name).isNotNull() & (F.trim(attr(name)) != value)
    rules = {
        "checked": (tag == "input") & F.coalesce(kind.isin("checkbox", "radio"), F.lit(False)), "disabled": wrong & has("disabled"), "readonly": wrong & has("readonly"), "required": wrong & has("required"), "placeholder": has("placeholder"),
        "valuemax": has("max"), "valuemin": has("min"), "colspan": other("colspan"), "rowspan": other("rowspan"),
    }
    found = F.lit(False)
    for name, rule in rules.items():
        found = F.when(attribute == f"aria-{name}", rule).otherwise(found)
    return F.coalesce(found, F.lit(False))


def attribute_findings(named: DataFrame) -> DataFrame:
    """page_id, rule_id, outcome, severity, pre, attribute of ARIA attributes that an element's role doesn't support or prohibits.

    `named` are the elements of names.with_names(), whose role is explicit or implicit; hidden ones are left alone. Attributes that ARIA doesn't know, and elements of roles that the taxonomy doesn't know,
    have no finding; audio and video without a role may have what all roles support. An empty value isn't prohibited, but must be supported.
    """
    spark = named.sparkSession
    pairs = stored(supported(spark))
    pairs = F.broadcast(pairs) if pairs.count() <= MOST_PAIRS else pairs
    known = pairs.select("attribute").distinct()
    roles = pairs.select("role").distinct()
    e = named.filter("not hidden").filter(F.exists(F.map_keys("attrs"), lambda k: F.startswith(k, F.lit("aria-"))))
    rows = e.select("page_id", "pre", "tag", "role", "attrs", F.explode(F.map_entries("attrs")).alias("a")).select("page_id", "pre", "tag", "role", "attrs", F.col("a.key").alias("attribute"), F.trim("a.value").alias("value")).join(known, "attribute", "left_semi")
    rows = rows.join(roles.withColumn("known", F.lit(True)), "role", "left").join(pairs.withColumn("ok", F.lit(True)), ["role", "attribute"], "left")
    bare = F.col("known").isNull() & F.col("tag").isin("audio", "video")
    filled, attribute = F.col("value") != "", F.col("attribute")
    name = attribute.isin("aria-label", "aria-labelledby")
    prohibited = (F.col("role").isin(NAMELESS) & name) | ((F.col("role") == "generic") & (attribute == "aria-roledescription"))
    rule = (
        F.when(bare & ~attribute.isin([f"aria-{g}" for g in GLOBAL]), "aria/attribute-not-allowed").when(filled & native_conflict(attribute, F.col("value")), "aria/attribute-not-allowed").when(F.col("known").isNull(), None)
        .when(prohibited, F.when(filled, "aria/attribute-prohibited")).when(F.col("ok").isNull(), "aria/attribute-not-allowed")
    )
    return rows.withColumn("rule_id", rule).filter("rule_id is not null").select("page_id", "rule_id", F.lit("fail").alias("outcome"), F.lit("high").alias("severity"), "pre", "attribute")
