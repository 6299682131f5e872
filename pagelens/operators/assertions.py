"""Conformance assertions on elements, as patterns of rules.

A pattern is a list of rules; the first rule whose condition holds for an element is the one that judges it. A rule has checks, each an id, a severity and the condition of a violation.
All are column expressions over with_context(), so one pass over the elements evaluates everything.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.plans.store import stored

from .context import HEADINGS, attr, html, map_name, named, squeezed, tokens, with_context

Check = tuple[str, str, Column]
Rule = tuple[Column, list[Check]]

# Fixed values of HTML and WAI-ARIA.
JAVASCRIPT = "application/ecmascript application/javascript application/x-ecmascript application/x-javascript text/ecmascript text/javascript text/javascript1.0 text/javascript1.1 text/javascript1.2 text/javascript1.3 text/javascript1.4 text/javascript1.5 text/jscript text/livescript text/x-ecmascript text/x-javascript".split()
NO_NAME = "abbr b bdi bdo caption cite code data del div em figcaption i ins kbd mark p pre q s samp small span strong sub sup time u var".split()
HIDDEN_INPUT_ARIA = "hidden expanded label labelledby describedby disabled invalid required checked pressed selected autocomplete controls owns haspopup live atomic busy current details flowto keyshortcuts modal multiline multiselectable orientation placeholder readonly relevant roledescription sort valuemax valuemin valuenow valuetext".split()
NOT_IN_HEADING = "alert alertdialog application dialog document feed listbox log marquee math note status tabpanel timer toolbar".split()
WIDGETS_IN_A = "button checkbox combobox grid gridcell listbox menu menubar menuitem menuitemcheckbox menuitemradio option radio scrollbar searchbox slider spinbutton switch tab textbox treeitem".split()
BODY_LINKS = "dns-prefetch modulepreload pingback preconnect prefetch preload prerender stylesheet".split()
TEXT_TYPES = "email password search tel text url".split()
SECTIONING = "article aside main nav section".split()
#: role: the element for which it goes without saying, and what else must hold.
IMPLIED = {
    "article": "article", "complementary": "aside", "definition": "dd", "group": "details", "img": "img", "main": "main", "navigation": "nav", "progressbar": "progress", "region": "section", "separator": "hr", "status": "output",
    "table": "table", "term": "dt", "form": "form", "listitem": "li", "rowgroup": "tbody", "button": "button", "dialog": "dialog", "figure": "figure", "deletion": "s",
}

def _true() -> Column:
    return F.lit(True)


def _false() -> Column:
    return F.lit(False)


def sure(c: Column) -> Column:
    return F.coalesce(c, _false())


def h(*tags: str) -> Column:
    return sure(html(F.col("tag"), F.col("ns"), *tags))


def has(*names: str) -> Column:
    """Whether the element has one of the attributes."""
    return named(F.col("names"), *names)


def eq(name: str, *values: str) -> Column:
    return sure(attr(name).isin(*values))


def low(name: str, letters: str, squeeze: bool = True) -> Column:
    """An attribute with some letters in lower case, empty where it is missing."""
    value = F.coalesce(attr(name), F.lit(""))
    up = "".join(sorted({*letters.upper()}))
    return F.translate(squeezed(value) if squeeze else value, up, up.lower())


def number(name: str) -> Column:
    """As number() sees it: null for what isn't one."""
    value = F.trim(attr(name))
    return F.when(F.rlike(value, F.lit(r"^-?(\d+(\.\d*)?|\.\d+)$")), value.try_cast("double"))


def at_most(a: Column, b: Column) -> Column:
    return sure(a <= b)


def blank(name: str) -> Column:
    return squeezed(F.coalesce(attr(name), F.lit(""))) == ""


def above(*tags: str) -> Column:
    return F.exists("anc", lambda a: html(a["tag"], a["ns"], *tags))


def above_role(*roles: str) -> Column:
    return F.exists("anc", lambda a: sure(a["role"].isin(*roles)))


def above_with(tag: str, name: str) -> Column:
    return F.exists("anc", lambda a: html(a["tag"], a["ns"], tag) & named(a["names"], name))


def parent(field: str) -> Column:
    return F.get("anc", F.lit(0))[field]


def inside(*tags: str) -> Column:
    return sure(html(parent("tag"), parent("ns"), *tags))


def kid(*tags: str) -> Column:
    return F.exists("kids", lambda k: html(k["tag"], k["ns"], *tags))


def rel(name: str, squeeze: bool = True) -> Column:
    """Whether the rel attribute has the word."""
    value = F.coalesce(attr("rel"), F.lit(""))
    return F.contains(F.concat(F.lit(" "), squeezed(value) if squeeze else value, F.lit(" ")), F.lit(f" {name} "))


def wide(name: str) -> Column:
    """Whether a candidate list has a width descriptor."""
    return F.rlike(F.coalesce(attr(name), F.lit("")), F.lit("[0-9][wW]"))


def found(name: str) -> Column:
    return sure(F.map_contains_key("found", F.lit(name)))


def refers(name: str, test) -> Column:
    """Whether an id in the attribute belongs to what passes the test."""
    return sure(F.exists(F.col("found")[name], test))


def owned(*roles: str) -> Column:
    return sure(F.arrays_overlap("owned", F.array(*map(F.lit, roles))))


def error(name: str, violated: Column) -> Check:
    return name, "error", violated


def warning(name: str, violated: Column) -> Check:
    return name, "warning", violated


def info(name: str, violated: Column) -> Check:
    return name, "info", violated


def one(context: Column, *checks: Check) -> list[Rule]:
    return [(context, list(checks))]


def role_patterns() -> list[list[Rule]]:
    aria_names = F.map_keys("attrs")
    any_aria = F.exists(aria_names, lambda k: F.startswith(k, F.lit("aria-")))
    naming_aria = F.exists(aria_names, lambda k: F.startswith(k, F.lit("aria-")) & (k != "aria-hidden"))
    img_named = ~blank("alt") | has("aria-label", "aria-labelledby")
    plain = eq("role", "none", "presentation")
    not_first = lambda *allowed: F.exists("kids", lambda k: k["role"].isNotNull() & ~k["role"].isin(*allowed))
    wired = sure((attr("aria-controls") != "") & refers("aria-controls", lambda x: x["panel"])) | sure((attr("id") != "") & F.col("panels"))
    labelled = refers("for", lambda x: x["labelable"]) & (attr("for") != "")
    containers = "treegrid grid rowgroup table".split()
    checkbox_like = "checkbox switch menuitemcheckbox menuitemradio option radio button".split()
    redundant = one(h("select") & eq("role", "listbox"), error("select-listbox-role.requires-multiple-or-size", ~(has("multiple") | sure(number("size") > 1))), warning("select-listbox-role.redundant", has("multiple") | sure(number("size") > 1)))
    extra = [h(IMPLIED[r]) & eq("role", r) for r in ("dialog", "figure", "deletion", "button", "rowgroup", "listitem")]
    li = lambda name, ancestors, *allowed: one(h("li") & has("role") & above_role(*ancestors), error(f"li-role-by-ancestor.{name}", ~eq("role", *allowed, "none", "presentation")))
    contained = lambda role, name, *above_: one(eq("role", role), error(f"role-{role}-containment.{name}", ~(above_role(*above_) | (owned(*above_) & (attr("id") != "")))))
    return [
        one(eq("role", "group"), error("author-requirements.group-in-list", sure(parent("role") == "list"))),
        one(eq("role", "group") & above_role("menu", "menubar"), error("author-requirements.group-in-menu", not_first("menuitem", "menuitemcheckbox", "menuitemradio"))),
        one(eq("role", "group") & above_role("tree"), error("author-requirements.group-in-tree", not_first("treeitem"))),
        one(sure(parent("role") == "rowgroup"), error("author-requirements.rowgroup-child-must-be-row", ~(h("tr") | eq("role", "row")))),
        one(h("img") & plain & eq("alt", ""), error("presentation-role.img-empty-alt-with-aria", any_aria)),
        one(h("img") & has("role"), error("img-role-needs-accessible-name.has-name", ~img_named)),
        one(h("img") & naming_aria, error("img-aria-needs-accessible-name.has-name", ~img_named)),
        one(h("label"), warning("presentational-children.label-descendant", above_role("separator", "progressbar", "img", "slider", "math"))),
        one(eq("role", "main"), *(warning(f"roles-properties-global.{n}-on-main", has(f"aria-{n}")) for n in ("disabled", "haspopup", "invalid"))),
        one(h("body"), error("roles-properties-global.aria-hidden-on-body", eq("aria-hidden", "true"))),
        one(has("aria-placeholder") & has("placeholder"), error("aria-placeholder.not-with-placeholder", _true())),
        *(one(has(f"aria-value{m}") & has(m), error(f"aria-value{m}.not-with-{m}", _true())) for m in ("min", "max")),
        [
            *((h(t), [warning(f"aria-value{m}.on-{t}", has(f"aria-value{m}")) for m in ("max", "min")]) for t in ("meter", "progress")),
            (h("input") & eq("type", "number"), [warning(f"aria-value{m}.on-input-number", has(f"aria-value{m}") & ~has(m)) for m in ("max", "min")]),
        ],
        [
            (h("input") & has("aria-checked") & eq("type", "checkbox", "radio") & (~has("role") | sure(attr("role") == attr("type"))), [error("aria-checked.on-implicit-checkbox-radio", _true())]),
            (h("input") & has("aria-checked") & has("type") & ~eq("type", "checkbox", "radio") & ~eq("role", *checkbox_like), [error("aria-checked.on-input-type", _true())]),
        ],
        one(h("input") & eq("type", "checkbox") & eq("role", "button"), error("checkbox.role-button-needs-aria-pressed", ~has("aria-pressed"))),
        [(h("h1", "h2", "h3") & above_role("button"), [error("presentational.no-heading-in-button", _true())]), (h("button") & above_role("img"), [warning("presentational.no-button-in-img", _true())])],
        one(h("input") & eq("type", "hidden") & has(*(f"aria-{n}" for n in HIDDEN_INPUT_ARIA)), error("aria.input-hidden-no-aria-attrs", _true())),
        [(plain & has("aria-label", "aria-labelledby", "aria-describedby", "aria-details", "aria-roledescription"), [warning("aria.none-role-global-aria-ignored", _true())]), (plain & has("tabindex"), [warning("aria.none-role-tabindex-ignored", _true())])],
        one(h("option") & has("aria-selected"), warning("aria.option-no-aria-selected", _true())),
        one(h("label") & has("aria-hidden") & (F.col("live_labelable") > 0), error("aria.label-hidden-labelable-descendant", _true())),
        one(h("img") & ~blank("alt") & plain, error("aria.img-alt-role-none-presentation", _true())),
        one(eq("aria-selected", "true") & F.array_contains(tokens(attr("role")), "tab"), error("aria.active-tab-needs-tabpanel", ~wired)),
        one(h(*NO_NAME) | (h("a", "area") & ~has("href")) | F.contains("tag", F.lit("-")), *(error(f"naming-prohibited.no-aria-{n}", has(f"aria-{n}")) for n in ("label", "labelledby", "braillelabel"))),
        one(eq("role", *NOT_IN_HEADING), error("role-forbidden-inside-heading.not-in-heading", above(*HEADINGS))),
        one(h("a") & has("href"), warning("a-href-forbidden-inside-widget-role.descendant", above_role("checkbox", "menuitem", "menuitemcheckbox", "menuitemradio", "option", "radio", "switch", "tab"))),
        one(has("tabindex"), warning("tabindex-forbidden-inside-role.descendant", above_role("option", "tab"))),
        [*((c, [warning(f"unnecessary-role-extra.{r}", _true())]) for r, c in zip(("dialog", "figure", "deletion", "button", "rowgroup", "listitem"), extra, strict=True)), (h("a") & has("href") & eq("role", "link"), [warning("unnecessary-role-extra.link", _true())])],
        redundant,
        one(h("html"), error("multiple-main-with-role.at-most-one-visible", F.col("any_mains") > 1)),
        one(h("a") & has("href"), warning("a-href-aria-disabled.true", eq("aria-disabled", "true"))),
        one(has("disabled"), warning("aria-disabled-redundant.on-disabled", has("aria-disabled"))),
        one(has("aria-expanded"), *(error(f"aria-expanded-restrictions.not-with-{n}", has(n)) for n in ("command", "popovertarget"))),
        one(h("input") & eq("type", "hidden"), error("aria-hidden-restrictions.not-on-hidden-input", has("aria-hidden"))),
        one(eq("hidden", "until-found"), error("aria-hidden-restrictions.not-true-with-hidden-until-found", eq("aria-hidden", "true"))),
        one(has("max"), error("aria-valuemax-on-max.forbidden", has("aria-valuemax"))),
        one(h("meter"), warning("aria-valuemin-on-meter.forbidden", has("aria-valuemin"))),
        one(eq("role", "listitem"), warning("role-listitem-aria-level.forbidden", has("aria-level"))),
        one(h("div") & inside("dl") & has("role"), error("dl-div-child-role.presentation-or-none", ~plain)),
        one(F.col("first_summary") & inside("details"), error("summary-role.forbidden", has("role"))),
        one(h("label") & has("role", "for"), error("label-role-restrictions.role-forbidden", has("role") & ((F.col("live_labelable") > 0) | labelled)), error("label-role-restrictions.aria-label-forbidden-when-for", has("aria-label") & labelled)),
        contained("cell", "needs-row-ancestor", "row"), contained("option", "needs-listbox-ancestor", "listbox"), contained("row", "needs-table-family-ancestor", *containers),
        li("listbox-or-list", ["listbox", "list"], "group", "option"), li("menu-or-menubar", ["menu", "menubar"], "group", "menuitem", "menuitemcheckbox", "menuitemradio", "separator"), li("tablist", ["tablist"], "tab"), li("tree", ["tree"], "treeitem"),
        [(eq("aria-hidden", "true"), [error("aria.hidden-not-focusable", has("tabindex"))]), (h("select"), [warning("aria.multiselectable-on-select", has("aria-multiselectable"))])],
        unnecessary_roles(),
    ]


def unnecessary_roles() -> list[Rule]:
    outside = ~above(*SECTIONING)
    several = has("multiple") | sure(number("size") > 1)
    special = {
        "banner": h("header") & outside, "contentinfo": h("footer") & outside, "list": h("ul", "ol"), "spinbutton": h("input") & eq("type", "number"), "textbox": h("input") & (~has("type") | eq("type", "text")) & ~has("list"),
        "searchbox": h("input") & eq("type", "search") & ~has("list"), "combobox": h("select") & ~several, "listbox": h("select") & several, "link": h("a") & has("href"),
    }
    rules = [(c & eq("role", r), [warning(f"roles.unnecessary-{r}", _true())]) for r, c in (special | {r: h(t) for r, t in IMPLIED.items()}).items()]
    return [*rules, ((F.col("tag") == "math") & has("role"), [warning("roles.unnecessary-math", _true())])]


def page_patterns() -> list[list[Rule]]:
    """Languages, references, headings, ids, microdata, tables."""
    own_table = lambda x: html(x["first"]["tag"], x["first"]["ns"], "th") & (x["first"]["table"] == F.col("table"))
    table_role = F.get(F.filter("anc", lambda a: html(a["tag"], a["ns"], "table")), F.lit(0))
    marked = F.col("from_markup").isNotNull()
    width = lambda kind, a, b, against: kind(f"tables.row-width-not-{against}", ~sure(a <= b) | F.isnan(a) | F.isnan(b))
    row, markup, first = F.col("row_width"), F.col("from_markup"), F.col("first_width")
    return [
        one(has("xml:lang"), error("attributes.lang-xml-lang-sameness", ~sure(attr("lang") == attr("xml:lang")))),
        one(has("headingoffset"), error("headingoffset-range.zero-to-eight", ~sure(number("headingoffset").between(0, 8)))),
        one(has("commandfor"), error("commandfor-target-exists.id-found", ~found("commandfor"))),
        one(has("aria-activedescendant"), error("aria-activedescendant-target-exists.id-found", ~found("aria-activedescendant"))),
        one(has("form"), error("attributes.form-ref-form", ~refers("form", lambda x: x["form"]))),
        one(h(*HEADINGS), warning("headings.empty", (F.col("txt") == "") & (F.size("kids") == 0))),
        *(one(h(t), warning(f"headings.{t}-lacks-heading", F.col("headings") == 0)) for t in ("article", "section")),
        one(h("body") & (F.col("lower_headings") > 0) & (F.col("h1s") == 0), warning("headings.no-top-level", _true())),
        one(h("h3") & F.col("earlier.h1") & ~F.col("earlier.h2"), error("headings.skip-level-h1-to-h3", _true())),
        one(has("id"), error("ids.duplicate", F.col("ids") > 1)),
        one(has("itemid"), error("microdata.itemid-without-itemtype", ~(has("itemscope") & has("itemtype")))),
        one(has("itemref"), error("microdata.itemref-without-itemscope", ~has("itemscope"))),
        one(has("itemtype"), error("microdata.itemtype-without-itemscope", ~has("itemscope"))),
        one(h("font", "center", "marquee", "blink"), warning("obsolete-elements.deprecated", _true())),
        one(h("th") & has("scope"), error("tables.th-scope-enum", ~eq("scope", "row", "col", "rowgroup", "colgroup"))),
        *(one(h(*tags) & has(name), error(f"tables.{name}-max", sure(number(name) > most))) for name, tags, most in (("colspan", ("td", "th"), 1000), ("rowspan", ("td", "th"), 65534), ("span", ("col", "colgroup"), 1000))),
        one(h("td") & has("role"), error("tables.td-role-in-table", sure((F.col("table") >= 0) & F.coalesce(table_role["role"], F.lit("table")).isin("table", "grid", "treegrid")))),
        one(h("td", "th") & has("headers"), error("tables.headers-ref-th", ~refers("headers", own_table))),
        one(h("tr") & ~kid("td", "th"), error("tables.row-no-cells", _true())),
        one(h("tr") & marked, width(error, markup, row, "less-than-column-markup"), width(error, row, markup, "exceeding-column-markup")),
        one(h("tr") & ~marked & (F.col("table") >= 0), width(warning, first, row, "less-than-first-row"), width(warning, row, first, "exceeding-first-row")),
    ]


def element_patterns() -> list[list[Rule]]:
    kind = low("type", "javascript")
    classic = kind.isin("", "text/javascript", "application/javascript", "ecmascript")
    lower_type = F.lower(F.coalesce(attr("type"), F.lit("")))
    typed = lambda name: low("type", name) == name
    both = lambda a, b: has(a) & has(b)
    over = lambda name, a, b: error(f"elements.{name}", both(a, b) & ~at_most(number(a), number(b)))
    lazy_img = sure(F.col("lazy_sibling"))
    auto = F.startswith(squeezed(F.translate(F.coalesce(attr("sizes"), F.lit("")), "AUTO", "auto")), F.lit("auto"))
    lazy = eq("loading", "lazy")
    drop_down = has("required") & ~has("multiple") & (~has("size") | sure(number("size") <= 1))
    options = F.filter("kids", lambda k: html(k["tag"], k["ns"], "option"))
    first_option = F.get(options, F.lit(0))
    user_scalable = F.translate(F.coalesce(attr("content"), F.lit("")), "USERCALB", "usercalb")
    no_scale = F.translate(F.coalesce(attr("content"), F.lit("")), "NO", "no")
    sheet = F.concat(F.lit(" "), low("rel", "alternative"), F.lit(" "))
    label_for = F.get(F.filter("anc", lambda a: html(a["tag"], a["ns"], "label")), F.lit(0))["target"]
    ruby = F.filter("kids", lambda k: html(k["tag"], k["ns"], "rb", "rt"))
    rb_pair = F.exists(F.sequence(F.lit(1), F.greatest(F.size(ruby), F.lit(2)) - 1), lambda i: sure((F.get(ruby, i)["tag"] == "rb") & (F.get(ruby, i - 1)["tag"] == "rb")))
    in_a = lambda name, context: (context & above("a"), [error(f"elements.{name}-in-a", _true())])
    word = F.get(tokens(attr("role")), F.lit(0))
    inline = lambda name, *attributes: error(f"elements.script-{name}", has(*attributes))
    loading = "crossorigin integrity referrerpolicy nonce".split()
    return [
        one(h("bdo"), error("elements.bdo-missing-dir", ~has("dir")), error("elements.bdo-dir-auto", eq("dir", "auto"))),
        one(h("area"), error("elements.area-outside-map", ~above("map"))),
        one(h("main"), error("elements.main-in-wrong-ancestor", above("article", "aside", "footer", "header", "nav"))),
        one(h("html"), error("elements.multiple-main-visible", F.col("mains") > 1)),
        one(h("map") & has("id") & has("name"), error("elements.map-id-name-mismatch", attr("id") != attr("name"))),
        one(h("link"), error("elements.link-missing-href", ~has("href", "imagesrcset", "resource"))),
        one(h("link") & rel("preload", False), error("elements.link-preload-missing-as", ~has("as"))),
        one(h("script") & eq("type", "importmap"), *(inline(f"importmap-{n}", n) for n in ("async", "defer", "src", "integrity"))),
        one(h("script") & eq("type", "speculationrules"), inline("speculationrules-integrity", "integrity")),
        one(h("script") & eq("type", "module"), inline("module-defer", "defer"), error("elements.script-module-inline-integrity", has("integrity") & ~has("src"))),
        one(h("script") & has("nomodule"), error("elements.script-module-nomodule", eq("type", "module"))),
        one(h("script") & has("integrity") & ~has("src"), error("elements.script-classic-inline-integrity", lower_type.isin("", *JAVASCRIPT))),
        one(h("script") & has("integrity") & has("type"), error("elements.script-datablock-integrity", ~lower_type.isin("", "module", "importmap", "speculationrules", *JAVASCRIPT))),
        one(h("link") & has("integrity"), error("elements.link-integrity-rel", ~(rel("stylesheet", False) | rel("preload", False) | rel("modulepreload", False)))),
        one(h("select") & ~has("multiple"), error("elements.select-multiple-selected", F.col("selected") > 1)),
        one(h("track") & has("label"), error("elements.track-empty-label", blank("label"))),
        one(h("audio", "video"), error("elements.track-multiple-default", F.size(F.filter("kids", lambda k: html(k["tag"], k["ns"], "track") & named(k["names"], "default"))) > 1)),
        one(h("input") & eq("type", "button"), error("elements.input-button-empty-value", blank("value"))),
        one(h("selectedcontent") & above("button") & above("select"), error("elements.selectedcontent-no-aria-hidden", has("aria-hidden")), error("elements.selectedcontent-no-role", has("role"))),
        one(has("autofocus"), error("elements.autofocus-multiple", F.col("scope_others") > 1)),
        one(h("meter"), over("meter-min-max", "min", "max"), over("meter-value-min", "min", "value"), error("elements.meter-value-no-min", ~has("min") & has("value") & ~sure(number("value") >= 0)), over("meter-value-max", "value", "max"),
            error("elements.meter-value-no-max", ~has("max") & has("value") & ~sure(number("value") <= 1)), over("meter-low-min", "min", "low"), over("meter-low-high", "low", "high"), over("meter-low-max", "low", "max"), over("meter-high-max", "high", "max"),
            over("meter-high-min", "min", "high"), over("meter-optimum-min", "min", "optimum"), over("meter-optimum-max", "optimum", "max")),
        one(h("progress"), over("progress-value-max", "value", "max"), error("elements.progress-value-no-max", ~has("max") & has("value") & ~sure(number("value") <= 1))),
        *(one(h("input") & has(n), error(f"elements.input-{i}", has("type") & ~eq("type", *types.split(), *TEXT_TYPES))) for n, i, types in (
            ("readonly", "readonly-type", "date datetime-local month number time week"), ("maxlength", "maxlength-type", "text"), ("required", "required-types", "checkbox date datetime-local file month number radio time week"))),
        one(h("input") & has("list"), error("elements.input-list-ref", ~refers("list", lambda x: html(x["first"]["tag"], x["first"]["ns"], "datalist")))),
        one(h("link") & has("as"), error("elements.link-as-missing-rel", ~(rel("preload") | rel("modulepreload")))),
        one(h("link") & has("imagesrcset"), error("elements.link-imagesrcset-as", ~eq("as", "image"))),
        one(h("label"), error("elements.label-max-one-labelable", F.col("labelable") > 1)),
        one(h("img") & has("srcset") & ~has("sizes") & ~lazy, error("elements.srcset-w-needs-sizes", wide("srcset"))),
        one(h("source") & inside("picture") & has("media"), error("elements.source-media-not-all", F.lower(squeezed(attr("media"))) == "all")),
        one(h("source", "img") & has("sizes") & has("srcset"), error("elements.srcset-sizes-needs-w-descriptor", ~wide("srcset"))),
        one(h("source") & F.col("later_srcset"), error("elements.source-needs-media-or-type", ~has("media", "type"))),
        one(F.contains("tag", F.lit("-")) & has("is"), error("elements.custom-element-no-is", _true())),
        one(h("form") & has("accept-charset"), error("elements.form-accept-charset-utf8", low("accept-charset", "utf") != "utf-8")),
        one(h("link") & has("imagesrcset") & ~has("imagesizes"), error("elements.link-imagesrcset-w-needs-imagesizes", wide("imagesrcset"))),
        one(h("meta") & has("charset"), error("elements.meta-charset-unique", F.col("charsets") > 1), error("elements.meta-charset-no-content-type", F.col("content_types") > 0)),
        one(h("meta") & has("media"), error("elements.meta-media-needs-theme-color", low("name", "themcolr", False) != "theme-color")),
        one(h("meta") & (low("http-equiv", "xuacompatible", False) == "x-ua-compatible"), error("elements.meta-x-ua-compatible-ie-edge", low("content", "iedg") != "ie=edge")),
        [
            (h("select") & kid("button"), [error("elements.select-button-allowed-only-dropdown", ~(sure(number("size") == 1) | ~has("size", "multiple")))]),
            (h("button") & inside("select") & has("aria-label"), [error("elements.select-button-no-aria-label", _true())]),
        ],
        [(h(t) & above("dt"), [error(f"elements.dt-no-{t}", _true())]) for t in (*HEADINGS, "header", "hgroup", "nav", "section")],
        one(h("base"), error("elements.base-before-link-script", F.col("earlier.loads"))),
        one(h("script") & ~has("src") & classic, inline("inline-no-async-defer", "async", "defer"), inline("inline-classic-no-blocking", "blocking"), inline("inline-classic-no-fetchpriority", "fetchpriority")),
        one(h("script") & ~has("src") & typed("module"), inline("inline-module-no-blocking", "blocking"), inline("inline-module-no-fetchpriority", "fetchpriority")),
        one(h("script") & kind.isin("text/javascript", "application/javascript", "ecmascript", "text/ecmascript"), warning("elements.script-type-text-javascript-unnecessary", _true())),
        one(h("source") & auto & ~lazy_img, error("elements.source-sizes-auto-lazy", _true())),
        [
            (h("img") & auto & ~lazy, [error("elements.img-sizes-auto-lazy", _true())]), (h("img", "source") & has("sizes") & ~has("srcset"), [error("elements.sizes-needs-srcset", _true())]),
            (h("img") & has("controls") & blank("alt"), [error("elements.img-controls-needs-alt", _true())]),
        ],
        [
            (h("input") & eq("type", "hidden") & ((low("autocomplete", "on", False) == "on") | (low("autocomplete", "of", False) == "off")), [error("elements.input-hidden-no-autocomplete-on-off", _true())]),
            (h("input") & has("pattern") & has("type") & ~eq("type", *TEXT_TYPES), [error("elements.input-pattern-types", _true())]),
            (h("input") & has("formaction") & ~eq("type", "submit", "image"), [error("elements.input-formaction-types", _true())]),
        ],
        [
            (h("script") & typed("importmap"), [inline("importmap-no-crossorigin", *loading), inline("importmap-no-blocking", "blocking"), inline("importmap-no-fetchpriority", "fetchpriority"), inline("importmap-no-nomodule", "nomodule")]),
            (h("script") & has("language"), [warning("elements.script-language-obsolete", _true())]),
        ],
        one(h("option") & ~has("label") & (F.col("txt") == ""), error("elements.option-empty-needs-label", _true())),
        [
            (h("label") & has("for"), [error("elements.label-for-non-form-control", ~refers("for", lambda x: x["labelable"]))]),
            (h("input") & above_with("label", "for"), [error("elements.label-for-descendant-matching-id", ~sure(attr("id") == label_for))]),
        ],
        one(h("script") & typed("speculationrules"), inline("speculationrules-no-disallowed-attrs", "src", "async", "defer", *loading), inline("speculationrules-no-blocking", "blocking"), inline("speculationrules-no-fetchpriority", "fetchpriority"), inline("speculationrules-no-nomodule", "nomodule")),
        [(h(t) & above("footer", "header"), [error(f"elements.no-{t}-in-header-footer", _true())]) for t in ("footer", "header")],
        one(h("dt") & above("dl"), warning("elements.dl-duplicate-dt", F.col("same_dt"))),
        one(h("ruby") & rb_pair, info("elements.ruby-tabular-rb", _true())),
        one(h("rtc"), info("elements.rtc-positioning", _true())),
        [
            (h("source") & has("srcset") & ~has("sizes") & ~lazy_img, [error("elements.source-srcset-w-needs-sizes", wide("srcset"))]),
            (h("img") & has("srcset") & ~has("sizes") & above("picture") & ~lazy, [error("elements.img-picture-srcset-w-needs-sizes", wide("srcset"))]),
        ],
        one(h("script") & has("type") & ~(typed("module") | typed("importmap") | typed("speculationrules") | classic) & has("src", "async", "defer", *loading, "fetchpriority", "nomodule", "blocking"), error("elements.script-datablock-no-async", _true())),
        [
            (h("link") & has("color"), [error("elements.link-color-needs-mask-icon", ~rel("mask-icon"))]), (h("link") & has("disabled"), [error("elements.link-disabled-needs-stylesheet", ~rel("stylesheet"))]),
            (h("link") & has("sizes"), [error("elements.link-sizes-allowed-rel", ~(rel("icon") | rel("apple-touch-icon") | rel("apple-touch-icon-precomposed")))]),
            (h("link") & above("body"), [error("elements.link-in-body-rel", ~(has("itemprop", "property") | reduce(lambda a, b: a | b, map(rel, BODY_LINKS))))]),
            (h("link") & rel("modulepreload") & eq("as", "font", "image"), [error("elements.link-modulepreload-as-invalid", _true())]), (h("link") & rel("preload") & eq("as", "json", "worker"), [error("elements.link-preload-as-invalid", _true())]),
        ],
        one(h("input") & (low("name", "isindex") == "isindex"), error("elements.input-name-isindex-forbidden", _true())),
        [(h("img") & has("ismap") & ~above_with("a", "href"), [error("elements.img-ismap-needs-a-href", _true())]), (h("img") & has("usemap"), [error("elements.img-usemap-target-exists", (map_name() != "") & ~found("usemap"))])],
        [
            (h("select") & drop_down, [error("elements.select-required-needs-option", F.size(options) == 0), error("elements.select-required-first-option-placeholder", (F.size(options) > 0) & ~sure(~named(first_option["names"], "value") | (first_option["value"] == "") | F.col("first_option_blank")))]),
            (h("select") & F.array_contains(tokens(attr("autocomplete")), "webauthn"), [error("elements.select-autocomplete-no-webauthn", _true())]),
        ],
        one(h("address") & above("address"), error("elements.address-no-nested-address", _true())),
        one(h("figure") & kid("figcaption") & eq("role", "img"), error("elements.figure-figcaption-no-role", _true())),
        one(h("figure") & kid("figcaption") & (F.size(F.filter("kids", lambda k: ~html(k["tag"], k["ns"], "figcaption"))) == 1) & sure(F.col("captioned_table")), warning("elements.figure-table-caption-should-be-figcaption", _true())),
        one(h("link") & F.contains(sheet, F.lit(" alternate ")) & F.contains(sheet, F.lit(" stylesheet ")), error("elements.link-alternate-stylesheet-needs-title", blank("title"))),
        one(h("link") & has("blocking"), error("elements.link-blocking-needs-stylesheet", ~F.contains(F.concat(F.lit(" "), low("rel", "stylesheet"), F.lit(" ")), F.lit(" stylesheet ")))),
        one(h("link") & has("imagesizes") & ~has("imagesrcset"), error("elements.link-imagesizes-needs-imagesrcset", _true())),
        one(h("meta") & eq("name", "description") & F.col("earlier.description"), error("elements.meta-multiple-description", _true())),
        one(h("meta") & (low("name", "viewport", False) == "viewport") & F.contains(user_scalable, F.lit("user-scalable")) & (F.contains(no_scale, F.lit("user-scalable=no")) | F.contains(no_scale, F.lit("user-scalable=0"))), warning("elements.meta-viewport-user-scalable-no", _true())),
        one(h("optgroup") & ~kid("legend") & ~has("label"), error("elements.optgroup-no-label-no-legend", _true())),
        one(h("title") & (F.col("txt") == ""), error("elements.title-not-empty", _true())),
        one(h("script") & (low("type", "textjavascript") == "text/javascript"), warning("elements.script-type-text-javascript-warning", _true())),
        one(h("audio") & has("controls") & above("button"), error("elements.audio-controls-in-button", _true())),
        [(has("itemprop") & ~has("itemscope") & ~F.exists("anc", lambda a: named(a["names"], "itemscope")), [error("elements.itemprop-needs-itemscope", _true())]), (has("itemref"), [error("elements.itemref-target-exists", F.array_contains(tokens(attr("itemref")), "nonexistent"))])],
        one(h("img") & ~has("alt", "role") & ~F.exists(F.map_keys("attrs"), lambda k: F.startswith(k, F.lit("aria-")) & (k != "aria-hidden")) & (F.coalesce(attr("title"), F.lit("")) == "") & ~above("figure"), error("elements.img-missing-alt", _true())),
        one(h("img") & ~has("alt") & sure(F.col("bare_figure")), error("elements.img-missing-alt-in-figure", _true())),
        one(h("a") & has("href") & above("button"), error("elements.a-href-in-button", _true())),
        one((F.col("tag") == "a") & (F.col("ns") == "svg") & F.exists("anc", lambda a: (a["tag"] == "a") & (a["ns"] == "svg")), error("elements.svg-a-in-svg-a", _true())),
        [
            in_a("a-href", h("a") & has("href")), *(in_a(t, h(t)) for t in "a button details dialog embed iframe label select textarea".split()), *(in_a(f"{t}-controls", h(t) & has("controls")) for t in ("video", "audio")),
            *(in_a(f"{t}-usemap", h(t) & has("usemap")) for t in ("img", "object")), in_a("input", h("input") & (low("type", "hiden", False) != "hidden")), in_a("tabindex", has("tabindex")), in_a("interactive-role", sure(word.isin(WIDGETS_IN_A))),
        ],
        one(h("footer", "header") & above("dt"), error("elements.dt-no-footer-or-header", _true())),
        one(h("input") & (squeezed(F.coalesce(attr("autocomplete"), F.lit(""))) == "webauthn"), error("elements.input-autocomplete-webauthn-alone", _true())),
        one(h("meta") & has("charset") & (low("charset", "utf") != "utf-8"), error("elements.meta-charset-not-utf8", _true())),
        one(h("html") & ~has("lang"), warning("elements.html-missing-lang", _true())),
    ]


def patterns() -> list[list[Rule]]:
    return [*role_patterns(), *page_patterns(), *element_patterns()]


def rule_ids() -> list[str]:
    return [f"assertion.{name}" for p in patterns() for _, checks in p for name, _, _ in checks]


def with_neighbours(e: DataFrame) -> DataFrame:
    """What elements say about their parents and siblings: a lazy img beside a source, the first option's text, a table's caption in a figure, a figure without caption above."""
    lazy = e.filter(F.exists("kids", lambda k: html(k["tag"], k["ns"], "img") & sure(k["loading"] == "lazy"))).select("page_id", F.col("pre").alias("parent_id"), _true().alias("lazy_sibling"))
    option = F.get(F.filter("kids", lambda k: html(k["tag"], k["ns"], "option")), F.lit(0))["pre"]
    first = e.filter(h("select")).select("page_id", option.alias("at"), "pre").filter("at is not null")
    blank_first = first.join(e.filter(h("option") & (F.col("txt") == "")).select("page_id", F.col("pre").alias("at")), ["page_id", "at"]).select("page_id", "pre", _true().alias("first_option_blank"))
    captioned = e.filter(h("table") & kid("caption")).select("page_id", F.col("parent_id").alias("pre"), _true().alias("captioned_table")).distinct()
    bare = e.filter(h("figure") & ~kid("figcaption")).select("page_id", F.col("pre").alias("at"))
    img = e.filter(h("img")).select("page_id", "pre", F.explode("anc.pre").alias("at")).join(bare, ["page_id", "at"]).select("page_id", "pre", _true().alias("bare_figure")).distinct()
    e = e.join(lazy, ["page_id", "parent_id"], "left")
    for side in (blank_first, captioned, img):
        e = e.join(side, ["page_id", "pre"], "left")
    return e


def assertion_findings(nodes: DataFrame) -> DataFrame:
    """page_id, rule_id, severity, pre, place (numbers of pattern, rule and check, by which results are ordered) of each violated check. Pages without elements have none."""
    fired = []
    for p, rules in enumerate(patterns()):
        before = _false()
        for r, (context, checks) in enumerate(rules):
            for c, (name, severity, violated) in enumerate(checks):
                fired.append(F.when(sure(context) & ~before & sure(violated), F.struct(F.lit(f"assertion.{name}").alias("rule_id"), F.lit(severity).alias("severity"), F.lit(p * 10_000 + r * 100 + c).alias("place"))))
            before = before | sure(context)
    e = with_neighbours(stored(with_context(nodes)))
    return e.select("page_id", "pre", F.explode(F.array_compact(F.array(*fired))).alias("f")).select("page_id", "f.rule_id", "f.severity", "pre", "f.place")
