"""Accessibility rules on the markup of pages, as expressions over the node table.

Rules on one element are conditions on its row and context. Rules on a page come from one grouping of flags by page; those on pairs of elements from
joins by page and id, and from windows in document order. Nothing compares all elements of a page with each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.plans.store import beside, stored

from .context import HEADINGS, attr, join_parts, named, tokens, with_context
from .forms import autofill_is_valid, autofilled, entry_findings
from .names import ROLES
from .tables import header_findings

# Fixed values of WAI-ARIA: its attributes, those that refer to ids, those that mustn't be empty, abstract roles, attributes that roles need, types of values.
ARIA = """aria-activedescendant aria-atomic aria-autocomplete aria-braillelabel aria-brailleroledescription aria-busy aria-checked aria-colcount aria-colindex
aria-colindextext aria-colspan aria-controls aria-current aria-describedby aria-description aria-details aria-disabled aria-dropeffect aria-errormessage
aria-expanded aria-flowto aria-grabbed aria-haspopup aria-hidden aria-invalid aria-keyshortcuts aria-label aria-labelledby aria-level aria-live aria-modal
aria-multiline aria-multiselectable aria-orientation aria-owns aria-placeholder aria-posinset aria-pressed aria-readonly aria-relevant aria-required
aria-roledescription aria-rowcount aria-rowindex aria-rowindextext aria-rowspan aria-selected aria-setsize aria-sort aria-valuemax aria-valuemin aria-valuenow aria-valuetext""".split()
REFERENCES = "aria-activedescendant aria-controls aria-describedby aria-details aria-errormessage aria-flowto aria-labelledby aria-owns".split()
TARGETS = ["for", "form", "list", "headers", *REFERENCES]
NOT_EMPTY = ("aria-activedescendant", "aria-controls", "aria-owns")
ABSTRACT = "command composite input landmark range roletype section sectionhead select structure widget window".split()
MODULES = "graphics-document graphics-object graphics-symbol doc-abstract doc-acknowledgments doc-afterword doc-appendix doc-backlink doc-biblioentry doc-bibliography doc-biblioref doc-chapter doc-colophon doc-conclusion doc-cover doc-credit doc-credits doc-dedication doc-endnote doc-endnotes doc-epigraph doc-epilogue doc-errata doc-example doc-footnote doc-foreword doc-glossary doc-glossref doc-index doc-introduction doc-noteref doc-notice doc-pagebreak doc-pagefooter doc-pageheader doc-pagelist doc-part doc-preface doc-prologue doc-pullquote doc-qna doc-subtitle doc-tip doc-toc".split()
REQUIRED = {"checkbox": "aria-checked", "switch": "aria-checked", "radio": "aria-checked", "combobox": "aria-expanded", "slider": "aria-valuenow", "spinbutton": "aria-valuenow", "scrollbar": "aria-controls aria-valuenow", "meter": "aria-valuenow", "separator": "aria-valuenow"}
BOOLEAN, OPTIONAL, TRISTATE = "true false", "true false undefined", "true false mixed undefined"
VALUES = {
    **dict.fromkeys("atomic busy disabled modal multiline multiselectable readonly required".split(), BOOLEAN), **dict.fromkeys("expanded grabbed hidden selected".split(), OPTIONAL), **dict.fromkeys("checked pressed".split(), TRISTATE),
    "autocomplete": "inline list both none", "haspopup": "false true menu listbox tree grid dialog", "live": "assertive off polite", "orientation": "horizontal vertical undefined", "sort": "ascending descending none other",
}
LISTS = {"dropeffect": "copy execute link move none popup", "relevant": "additions removals text all"}
INTEGERS, NUMBERS, SINGLE = "colcount colindex colspan level posinset rowcount rowindex rowspan setsize".split(), "valuemax valuemin valuenow".split(), "activedescendant errormessage".split()
# What says nothing about an image, marks of skip links, players and widgets, words that tell German and English.
FILLERS = "bild image img foto photo grafik graphic icon logo picture spacer platzhalter placeholder".split()
ENDINGS = r"\.(jpg|jpeg|png|gif|webp|svg|avif)$"
SKIPS = "skip|sprung|zum inhalt|zum hauptinhalt|direkt zum inhalt"
PLAYERS = r"^\s*[^/]*//([^/?#]*\.)?(youtube\.com|youtube-nocookie\.com|vimeo\.com|dailymotion\.com|wistia\.com|wistia\.net)([/?#]|$)"
SLIDERS = r"(?i)(^|\s)(swiper|slick|splide|glide|flickity|carousel|leaflet|mapboxgl|maplibregl|ol-viewport)(-\S*)?(\s|$)"
GERMAN = "der die das und ist sind mit für von auf eine einer nicht werden wird auch dass".split()
ENGLISH = "the and is are with for from this that not will also have has your our".split()
#: Points that only people can judge: what on the page calls for them, and their severity.
CHECKLIST = {
    "media-alternatives": ("media", "high"), "image-alternatives": ("images", "high"), "visual-structure": ("text", "medium"), "use-of-color": ("links fields", "medium"), "timing": ("fields refresh", "high"), "error-handling": ("fields", "high"),
    "authentication": ("login", "high"), "pointer-gestures": ("gestures", "medium"), "no-timing": ("fields refresh", "low"), "interruptions": ("interruptions", "low"), "re-authenticating": ("login", "low"), "unusual-words": ("text", "low"),
    "help": ("fields", "low"), "dragging-movements": ("gestures", "medium"), "consistent-help": ("text", "low"), "keyboard-trap": ("links fields interruptions", "high"), "character-shortcuts": ("shortcut", "medium"),
    "error-prevention": ("fields", "medium"), "pointer-cancellation": ("pointer", "medium"), "consistent-navigation": ("links", "medium"), "consistent-identification": ("links fields", "medium"), "sensory-characteristics": ("text", "medium"),
    "multiple-ways": ("links", "medium"), "text-spacing": ("text", "medium"), "content-on-hover-focus": ("hover", "medium"), "motion-actuation": ("motion", "medium"),
}
LANGUAGE = r"^([A-Za-z]{2,8}|[xXiI]-[A-Za-z0-9]{1,8})(-[A-Za-z0-9]{1,8})*$"


def has(*names: str) -> Column:
    return named(F.col("names"), *names)


def filled(name: str) -> Column:
    return F.coalesce(F.rlike(attr(name), F.lit(r"[^\t\n\f\r ]")), F.lit(False))


def tag(*tags: str) -> Column:
    return F.coalesce(F.col("tag").isin(*tags), F.lit(False))


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def low(name: str) -> Column:
    return F.lower(F.trim(F.coalesce(attr(name), F.lit(""))))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def explicit(role: Column) -> Column:
    return F.lower(F.get(tokens(role), F.lit(0)))


def own_role(*roles: str) -> Column:
    return sure(explicit(attr("role")).isin(*roles))


def above(*tags: str) -> Column:
    return F.exists("anc", lambda a: a["tag"].isin(*tags))


def or_above(condition) -> Column:
    """Whether the condition, on attribute names, holds for the element or one above it."""
    return condition(F.col("names")) | F.exists("anc", lambda a: condition(a["names"]))


def presentational() -> Column:
    return own_role("none", "presentation") & ~sure(F.trim(attr("tabindex")).try_cast("int").isNotNull())


def landmark(name: str, role: str) -> Column:
    """An element of this kind, or one whose role attribute has the word."""
    return F.when(attr("role").isNotNull(), F.exists(tokens(attr("role")), lambda t: F.lower(t) == role)).otherwise(tag(name))


def document_wide() -> Column:
    return ~F.exists("anc", lambda a: a["tag"].isin("article", "aside", "main", "nav", "section") | sure(explicit(a["role"]).isin("article", "complementary", "main", "navigation", "region")))


def heading_level() -> Column:
    native = F.when(F.rlike("tag", F.lit("^h[1-6]$")), F.substring("tag", 2, 1).cast("int"))
    return F.when(own_role("heading"), F.coalesce(F.trim(attr("aria-level")).try_cast("int"), F.lit(2))).when(attr("role").isNull() | own_role("heading"), native)


def finding(rule: str, when: Column, outcome: str | Column, severity: str | Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(sure(when), F.struct(F.lit(rule).alias("rule_id"), as_column(outcome).alias("outcome"), as_column(severity).alias("severity")))


def _viewport(key: str) -> Column:
    return F.regexp_extract(F.lower(attr("content")), rf"(?:^|[\s,;]){key}\s*=\s*([^\s,;]*)", 1)


def value_is_valid(name: Column, value: Column) -> Column:
    """Whether the value of an aria attribute is of its type; unknown attributes and empty values are."""
    v = F.lower(F.trim(value))
    plain = F.create_map(*(x for k, words in (VALUES | LISTS).items() for x in (F.lit(f"aria-{k}"), F.array(*map(F.lit, words.split())))))[name]
    of = lambda kind: name.isin([f"aria-{k}" for k in kind])
    return F.when(v == "", F.lit(True)).when(of(VALUES), F.array_contains(plain, v)).when(of(LISTS), F.forall(tokens(v), lambda t: F.array_contains(plain, t))).when(of(INTEGERS), F.rlike(v, F.lit(r"^[+-]?[0-9]+$"))).when(of(NUMBERS), F.rlike(v, F.lit(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"))).when(of(SINGLE), ~F.rlike(v, F.lit(r"\s"))).otherwise(F.lit(True))


def element_rules() -> list[Column]:
    root = tag("html") & (F.col("depth") == 0)
    viewport = tag("meta") & (low("name") == "viewport") & has("content")
    limit = _viewport("maximum-scale")
    limit = F.when(limit == "yes", 1.0).when(limit == "no", 0.1).when(limit.isin("device-width", "device-height"), 10.0).otherwise(limit.try_cast("double"))
    limit = F.when(limit >= 0, limit)
    locked = _viewport("user-scalable").isin("no", "0") | sure(limit < 2)
    decorative = sure(attr("aria-hidden") == "true") | presentational()
    other_name = filled("aria-label") | filled("aria-labelledby") | filled("title")
    alt = F.lower(F.trim(attr("alt")))
    blank_alt = has("alt") & (attr("alt") != "") & (alt == "")
    suspicious = (alt != "") & ((F.char_length(alt) < 3) | F.rlike(alt, F.lit(ENDINGS)) | alt.isin(FILLERS))
    kind = F.when(has("type"), low("type")).otherwise("text")
    field = tag("input", "select", "textarea") & ~kind.isin("hidden", "submit", "button", "reset", "image") & ~presentational()
    aria_named, wrapped = filled("aria-label") | has("aria-labelledby"), above("label")
    known = lambda t: t.isin([*ROLES, *MODULES])
    words = tokens(attr("role"))
    state_native = tag("meter", "progress") | (tag("input") & kind.isin("checkbox", "radio", "range", "number"))
    lacking = any_of(*(own_role(r) & any_of(*(~has(a) for a in needed.split())) & (has("tabindex") if r == "separator" else F.lit(True)) for r, needed in REQUIRED.items()))
    tabindex = F.trim(attr("tabindex")).try_cast("int")
    disabled = has("disabled") & tag("button", "input", "select", "textarea")
    reachable = F.when(tabindex.isNotNull(), tabindex >= 0).otherwise(((tag("a", "area") & has("href")) | (tag("input") & (kind != "hidden")) | tag("button", "select", "textarea", "summary", "iframe")) & ~disabled)
    aria_hidden = sure(attr("aria-hidden") == "true") | F.exists("anc", lambda a: a["hidden"] & ~named(a["names"], "hidden") | (a["hidden"] & named(a["names"], "aria-hidden")))
    in_modal = tag("dialog") & has("open") | F.exists("anc", lambda a: (a["tag"] == "dialog") & named(a["names"], "open") | named(a["names"], "aria-modal"))
    is_list = tag("ul", "ol", "menu") | own_role("list")
    item = lambda k: (k["tag"] == "li") & (k["role"].isNull() | (explicit(k["role"]) == "listitem")) | sure(explicit(k["role"]) == "listitem")
    foreign = F.exists("kids", lambda k: ~item(k) & ~k["tag"].isin("script", "template"))
    near_list = F.get(F.filter("anc", lambda a: a["tag"].isin("ul", "ol", "menu") | sure(explicit(a["role"]) == "list")), F.lit(0))
    list_role = explicit(near_list["role"])
    next_one = F.get(F.filter("next_kids", lambda k: ~k["tag"].isin("script", "template") & ~((k["tag"] == "dt") | sure(k["role"] == "term"))), F.lit(0))
    term = tag("dt") | sure(attr("role") == "term")
    table = tag("table") | sure(attr("role").isin("table", "grid"))
    layout = sure(attr("role").isin("presentation", "none"))
    described = lambda name: filled(name)
    from_owner = F.transform(F.filter(F.map_entries("attrs"), lambda x: F.startswith(x["key"], F.lit("aria-"))), lambda x: value_is_valid(x["key"], x["value"]))
    wait = F.regexp_extract(attr("content"), r"^[ \t\n\f\r]*([0-9]*)[0-9.]*(?:[;, \t\n\f\r].*)?$", 1)
    refresh = tag("meta") & (low("http-equiv") == "refresh") & F.rlike(attr("content"), F.lit(r"^[ \t\n\f\r]*[0-9.]+([;, \t\n\f\r]|$)"))
    seconds = F.coalesce(wait.try_cast("long"), F.lit(0))
    source_names = F.array_compact(F.concat(F.array(attr("src")), F.transform(F.filter("kids", lambda k: k["tag"] == "source"), lambda k: k["src"])))
    short = F.forall(source_names, lambda s: F.rlike(s, F.lit(r"#(?:.*&)?t=(?:npt:)?0*,[0-3](?:\.0*)?$"))) & (F.size(source_names) > 0)
    visible_here = ~or_above(lambda n: named(n, "hidden")) & ~F.exists("anc", lambda a: a["hidden"]) & ~sure(attr("aria-hidden") == "true")
    viz = tag("figure") & has("data-viz") & ~or_above(lambda n: named(n, "hidden"))
    viz_kind = low("data-viz")
    handler = any_of(*(has(h) for h in ("onkeydown", "onkeyup", "onkeypress")))
    native_control = tag("a", "area", "button", "input", "select", "textarea", "summary", "option", "label", "details", "iframe", "audio", "video", "html", "body")
    script_link = F.rlike(F.coalesce(attr("href"), F.lit("")), F.lit(r"(?i)^\s*(javascript:|#\s*$|$)"))
    jumps = F.rlike(F.concat_ws(" ", attr("onchange"), attr("oninput")), F.lit(r"(?i)submit\(|location|window\.open"))
    focus_jumps = F.rlike(F.coalesce(attr("onfocus"), F.lit("")), F.lit(r"(?i)submit\(|location|window\.open|\.blur\("))
    looks = lambda pattern: any_of(*(F.rlike(F.coalesce(attr(a), F.lit("")), F.lit(pattern)) for a in ("class", "id", "src")))
    popover = F.get(F.col("found")["popovertarget"], F.lit(0))
    words_of = F.filter(F.split(F.lower("reading"), r"[^\p{L}]+"), lambda w: w != "")
    count_of = lambda markers: F.size(F.filter(words_of, lambda w: w.isin(markers)))
    sounds = F.when((count_of(GERMAN) >= 5) & (count_of(ENGLISH) <= 1), "de").when((count_of(ENGLISH) >= 5) & (count_of(GERMAN) <= 1), "en")
    redundant = any_of(*(tag(t) & own_role(r) for t, r in (("article", "article"), ("aside", "complementary"), ("button", "button"), ("dialog", "dialog"), ("figure", "figure"), ("form", "form"), ("hr", "separator"), ("li", "listitem"), ("main", "main"), ("nav", "navigation"), ("table", "table"), ("textarea", "textbox"), ("option", "option"), ("progress", "progressbar"), ("output", "status"), *((t, "heading") for t in HEADINGS))))
    return [
        finding("document/lang-missing", root & ~filled("lang"), "fail", "high"),
        finding("document/lang-invalid", root & filled("lang") & ~F.rlike(F.trim(attr("lang")), F.lit(LANGUAGE)), "fail", "medium"),
        finding("document/lang-mismatch", root & filled("lang") & filled("xml:lang") & (F.substring_index(low("lang"), "-", 1) != F.substring_index(low("xml:lang"), "-", 1)), "fail", "medium"),
        finding("zoom/viewport-locked", viewport & locked, "fail", "high"),
        finding("zoom/viewport-scale-limited", viewport & ~locked & (limit < 5), "best_practice", "low"),
        finding("images/alt-missing", tag("img") & ~decorative & ((~has("alt") & ~other_name) | (blank_alt & ~other_name)), "fail", "high"),
        finding("images/alt-suspicious", tag("img") & ~decorative & has("alt") & suspicious, "review", "medium"),
        finding("images/area-alt-missing", tag("area") & has("href") & ~filled("alt") & ~filled("aria-label") & ~filled("aria-labelledby"), "fail", "high"),
        finding("images/input-alt-missing", tag("input") & (kind == "image") & ~filled("alt") & ~filled("title") & ~filled("aria-label") & ~filled("aria-labelledby"), "fail", "high"),
        finding("images/server-side-map", tag("img") & has("ismap") & F.exists("anc", lambda a: (a["tag"] == "a") & named(a["names"], "href")), "review", "medium"),
        finding("objects/alt-missing", tag("object") & ~presentational() & (F.col("words_below") == 0) & ~filled("title") & ~filled("aria-label") & ~filled("aria-labelledby"), "fail", "high"),
        finding("forms/label-missing", field & ~any_of(aria_named, F.col("has_label"), wrapped, filled("title"), filled("placeholder")), "fail", "critical"),
        finding("forms/placeholder-as-label", field & filled("placeholder") & ~has("aria-labelledby") & ~F.col("has_label") & ~wrapped, "review", "medium"),
        finding("forms/error-unidentified", sure(low("aria-invalid").isin("true", "grammar", "spelling")) & ~described("aria-describedby") & ~described("aria-errormessage"), "review", "medium"),
        finding("context/on-input", tag("select", "input") & jumps & any_of(has("onchange"), has("oninput")), "review", "medium"),
        finding("forms/autocomplete-invalid", autofilled() & attr("autocomplete").isNotNull() & ~autofill_is_valid(attr("autocomplete")), "fail", "low"),
        finding("context/autofocus", has("autofocus") & ~F.col("tag").isin("input", "select", "textarea") & ~F.coalesce(F.get(F.filter(tokens(attr("role")), lambda r: r.isin(ROLES)), F.lit(0)).isin("textbox", "searchbox", "combobox"), F.lit(False)), "review", "medium"),
        finding("context/on-focus", has("onfocus") & focus_jumps, "review", "high"),
        finding("auth/captcha", looks("(?i)captcha|turnstile"), "review", "medium"),
        finding("aria/role-abstract", F.exists(words, lambda t: t.isin(ABSTRACT)), "fail", "high"),
        finding("aria/role-invalid", ~F.exists(words, known) & F.exists(words, lambda t: ~known(t) & ~t.isin(ABSTRACT)), "fail", "high"),
        finding("aria/required-attribute-missing", lacking & ~state_native, "fail", "high"),
        finding("aria/attribute-unknown", F.exists(F.map_keys("attrs"), lambda k: F.startswith(k, F.lit("aria-")) & ~k.isin(ARIA)), "fail", "high"),
        finding("aria/attribute-value-invalid", F.exists(from_owner, lambda ok: ~ok), "fail", "high"),
        finding("aria/presentation-conflict", own_role("none", "presentation") & any_of(tabindex.isNotNull(), *(has(f"aria-{g}") for g in ("atomic", "busy", "controls", "current", "describedby", "details", "flowto", "keyshortcuts", "label", "labelledby", "live", "owns", "relevant", "roledescription"))), "fail", "medium"),
        finding("aria/presentational-children-focusable", (tag("button", "option") | own_role("button", "checkbox", "img", "math", "menuitemcheckbox", "menuitemradio", "option", "progressbar", "radio", "scrollbar", "separator", "slider", "switch", "tab")) & F.col("focus_below"), "fail", "high"),
        finding("aria/reference-missing", any_of(*(has(r) & ~filled(r) for r in NOT_EMPTY)), "fail", "high"),
        finding("aria/combobox-popup-missing", own_role("combobox") & sure(low("aria-expanded") == "true") & ~filled("aria-controls") & ~filled("aria-owns"), "fail", "medium"),
        finding("popover/target-missing", filled("popovertarget") & ~sure(F.map_contains_key("found", F.lit("popovertarget"))), "fail", "medium"),
        finding("popover/target-invalid", filled("popovertarget") & popover.isNotNull() & ~popover["popover"], "fail", "medium"),
        finding("inert/dialog-inert", (tag("dialog") & has("open") | own_role("dialog", "alertdialog")) & or_above(lambda n: named(n, "inert")), F.when(tag("dialog"), "fail").otherwise("review"), "high"),
        finding("keyboard/positive-tabindex", tabindex > 0, "review", "high"),
        finding("keyboard/hidden-focusable", aria_hidden & reachable & ~or_above(lambda n: named(n, "inert")), F.when(F.col("modal_open") & ~in_modal, "review").otherwise("fail"), "high"),
        finding("keyboard/click-handler-not-focusable", has("onclick") & ~native_control & tabindex.isNull() & ~F.col("focus_below"), F.when(attr("role").isNotNull() | handler, "fail").otherwise("review"), "high"),
        finding("links/used-as-button", tag("a") & has("href") & script_link & (has("onclick") | F.rlike(attr("href"), F.lit("(?i)^\\s*javascript:"))) & ~has("role"), "review", "low"),
        finding("lists/invalid-structure", is_list & (attr("role").isNull() | own_role("list")) & foreign, "fail", "medium"),
        finding("lists/empty", is_list & (attr("role").isNull() | own_role("list")) & ~foreign & ~F.exists("kids", item), "best_practice", "low"),
        finding("lists/item-outside-list", tag("li") & (attr("role").isNull() | own_role("listitem")) & (near_list.isNull() | (list_role.isNotNull() & ~list_role.isin("list", "directory", "none", "presentation"))), "fail", "medium"),
        finding("lists/term-without-definition", term & (F.col("parent_id") >= 0) & ~sure((next_one["tag"] == "dd") | (next_one["role"] == "definition")), "fail", "medium"),
        finding("tables/presentational-with-headers", table & layout & F.col("header_below"), "fail", "medium"),
        finding("tables/name-missing", table & ~layout & ~F.exists("kids", lambda k: k["tag"] == "caption") & ~other_name, "review", "low"),
        finding("tables/header-missing", table & ~layout & ~F.col("header_below"), "review", "high"),
        finding("media/audio-autoplay", tag("audio", "video") & has("autoplay") & ~has("muted") & ~(has("controls") & visible_here) & ~short, "review", "medium"),
        finding("media/video-captions-missing", tag("video") & ~(has("muted") & ~has("controls")) & visible_here & ~F.exists("kids", lambda k: (k["tag"] == "track") & sure(F.lower(F.trim(k["kind"])).isin("captions", "subtitles"))), "review", "medium"),
        finding("viz/text-missing", viz & ~F.col("viz_words"), "fail", "high"),
        finding("viz/caption-missing", viz & ~F.exists("kids", lambda k: k["tag"] == "figcaption"), "fail", "low"),
        finding("viz/static-missing", viz & viz_kind.isin("3d", "interactive") & ~F.col("viz_static"), "fail", "medium"),
        finding("viz/table-missing", viz & (viz_kind == "chart") & ~F.col("table_below"), "review", "low"),
        finding("display/text-hidden", has("data-viz-text") & F.exists("anc", lambda a: (a["tag"] == "figure") & named(a["names"], "data-viz")) & (or_above(lambda n: named(n, "inert", "hidden")) | sure(attr("aria-hidden") == "true") | F.exists("anc", lambda a: a["hidden"])) & ~F.exists("anc", lambda a: (a["tag"] == "figure") & named(a["names"], "hidden")), "fail", "high"),
        finding("language/part-invalid", ~root & (attr("lang") != "") & ~F.rlike(F.trim(attr("lang")), F.lit(LANGUAGE)) & (F.col("words_below") > 0), "fail", "medium"),
        finding("language/part-unmarked", F.col("page_lang").isin("de", "en") & (F.char_length("reading") >= 100) & (F.size(words_of) >= 16) & (F.coalesce("near_lang", "page_lang") == F.col("page_lang")) & (sounds != F.col("page_lang")), "review", "medium"),
        finding("language/abbreviation-unexpanded", tag("abbr", "acronym") & ~filled("title"), "review", "low"),
        finding("timing/meta-refresh", refresh & F.col("first_refresh") & (seconds > 0) & (seconds <= 72_000), "fail", "high"),
        finding("timing/meta-refresh-enhanced", refresh & F.col("first_refresh") & (seconds > 0), "fail", "medium"),
        finding("headings/section-without-heading", (tag("article") | (tag("section") & (filled("aria-label") | filled("aria-labelledby")))) & (F.col("headings_below") == 0), "review", "low"),
        finding("aria/role-redundant", redundant, "best_practice", "low"),
        finding("forms/group-missing", tag("input") & kind.isin("radio", "checkbox") & filled("name") & F.col("first_of_group") & ~above("fieldset") & ~F.exists("anc", lambda a: sure(explicit(a["role"]).isin("group", "radiogroup"))), "review", "medium"),
        finding("forms/no-submit", tag("form") & F.col("asks") & ~F.col("submits"), "review", "medium"),
    ]


def with_relations(nodes: DataFrame) -> DataFrame:
    """The elements with what the rules need beyond with_context(): labels, what lies below, what follows, the language around, and the marks of page_marks()."""
    e = stored(with_context(nodes))
    t, explicit_role = F.col("tag"), explicit(attr("role"))
    labels = e.filter((t == "label") & attr("for").isNotNull()).select("page_id", attr("for").alias("target")).distinct()
    has_label = e.filter(attr("id").isNotNull()).select("page_id", "pre", attr("id").alias("target")).join(labels, ["page_id", "target"]).select("page_id", "pre", F.lit(True).alias("has_label")).distinct()
    kind = F.coalesce(low("type"), F.lit(""))
    focus = (t.isin("a", "area") & has("href")) | (t.isin("input") & (kind != "hidden")) | t.isin("button", "select", "textarea", "summary", "iframe") | sure(F.trim(attr("tabindex")).try_cast("int") >= 0)
    flags = {
        "focus_below": focus, "header_below": t.isin("th") | sure(attr("role").isin("columnheader", "rowheader")), "table_below": t == "table", "viz_static": has("data-viz-static"),
        "asks": t.isin("select", "textarea") | (t.isin("input") & ~kind.isin("hidden", "submit", "image", "button", "reset")), "submits": (t.isin("input") & kind.isin("submit", "image")) | (t.isin("button") & ~kind.isin("button", "reset")),
    }
    marked = e.filter(any_of(*(sure(c) for c in flags.values()))).select("page_id", F.explode("anc.pre").alias("pre"), *(sure(c).alias(n) for n, c in flags.items()))
    below = marked.groupBy("page_id", "pre").agg(*(F.bool_or(n).alias(n) for n in flags))
    words = nodes.filter("kind = 'text'").filter(F.rlike("text", F.lit(r"\S")) & ~F.exists("anc", lambda a: a["tag"].isin("script", "style", "template")))
    counts = words.select("page_id", F.explode("anc.pre").alias("pre")).groupBy("page_id", "pre").agg(F.count("*").alias("words_below"))
    layers = words.filter(F.exists("anc", lambda a: named(a["names"], "data-viz-text"))).select("page_id", F.explode(F.filter("anc", lambda a: named(a["names"], "data-viz"))).alias("f")).select("page_id", F.col("f.pre").alias("pre"), F.lit(True).alias("viz_words")).distinct()
    blocks = words.filter(~F.exists("anc", lambda a: a["tag"].isin("code", "pre", "address"))).select("page_id", F.col("pre").alias("at"), "text", F.get(F.filter("anc", lambda a: a["tag"].isin("p", "li", "dd", "td", "figcaption")), F.lit(0))["pre"].alias("pre")).filter("pre is not null")
    reading = blocks.groupBy("page_id", "pre").agg(join_parts("at", "text").alias("reading"))
    heads = e.filter(heading_level().isNotNull()).select("page_id", F.explode("anc.pre").alias("pre")).groupBy("page_id", "pre").agg(F.count("*").alias("headings_below"))
    langs = e.filter(filled("lang")).select("page_id", F.col("pre").alias("at"), F.substring_index(low("lang"), "-", 1).alias("near_lang"))
    near = e.select("page_id", "pre", F.explode(F.concat(F.array("pre"), "anc.pre")).alias("at")).join(langs, ["page_id", "at"]).groupBy("page_id", "pre").agg(F.max_by("near_lang", "at").alias("near_lang"))
    groups = Window.partitionBy("page_id", attr("name"), low("type"))
    choices = e.filter(t.isin("input") & kind.isin("radio", "checkbox") & filled("name")).select("page_id", "pre", (F.row_number().over(groups.orderBy("pre")) == 1).alias("k"), F.count("*").over(groups).alias("n")).filter("k and n > 1").select("page_id", "pre", F.lit(True).alias("first_of_group"))
    rooms = e.filter("parent_id >= 0").select("page_id", F.col("parent_id").alias("up"), "pre").join(e.select("page_id", F.col("pre").alias("up"), F.col("kids").alias("siblings")).filter(F.exists("siblings", lambda k: (k["tag"] == "dt") | sure(k["role"] == "term"))), ["page_id", "up"])
    follow = rooms.select("page_id", "pre", F.filter("siblings", lambda k: k["pre"] > F.col("pre")).alias("next_kids"))
    extra = e.filter(filled("popovertarget")).select("page_id", "pre", F.trim(attr("popovertarget")).alias("target")).join(e.filter(attr("id").isNotNull()).groupBy("page_id", attr("id").alias("target")).agg(F.min_by(has("popover"), "pre").alias("popover")), ["page_id", "target"]).select("page_id", "pre", F.col("popover").alias("target_is_popover"))
    href = F.trim(attr("href"))
    pages = e.groupBy("page_id").agg(F.min_by(F.when(filled("lang"), F.substring_index(low("lang"), "-", 1)), "pre").alias("page_lang"), F.bool_or((t == "dialog") & has("open") | sure(low("aria-modal") == "true")).alias("modal_open"), F.min(F.when((t == "a") & (href != "") & ~F.rlike(href, F.lit("^#.+")), F.col("pre"))).alias("away"))
    e = e.withColumn("first_refresh", F.row_number().over(Window.partitionBy("page_id", (t == "meta") & (low("http-equiv") == "refresh")).orderBy("pre")) == 1)
    marks, shown = page_marks(e, nodes)
    e = beside(e, [has_label, below, counts, layers, reading, heads, near, choices, follow, extra, *marks]).join(pages, "page_id", "left")
    yes_no = ["has_label", *flags, "viz_words", "first_of_group"]
    popover = F.when(F.col("target_is_popover").isNotNull(), F.map_from_arrays(F.array(F.lit("popovertarget")), F.array(F.array(F.struct(F.col("target_is_popover").alias("popover"))))))
    return e.withColumns({**{n: F.coalesce(n, F.lit(False)) for n in yes_no}, "words_below": F.coalesce("words_below", F.lit(0)), "headings_below": F.coalesce("headings_below", F.lit(0)), "found": popover, "explicit_role": explicit_role}).withColumns(shown)


def page_flags(e: DataFrame) -> DataFrame:
    """A row for each page with what its page-wide rules ask for."""
    kind = F.when(has("type"), low("type")).otherwise("text")
    href = F.coalesce(F.trim(attr("href")), F.lit(""))
    link, real = tag("a") & has("href"), tag("a") & (href != "")
    fragment = F.rlike(href, F.lit("^#.+"))
    wide = attr("role").isNotNull() | document_wide()
    flags = {
        "root": tag("html") & (F.col("depth") == 0), "titled": tag("title") & (F.col("ns") == "html"), "viewport": tag("meta") & (low("name") == "viewport"), "heading": heading_level().isNotNull(), "h1": heading_level() == 1,
        "main": landmark("main", "main"), "nav": landmark("nav", "navigation") & wide, "banner": landmark("header", "banner") & wide, "contentinfo": landmark("footer", "contentinfo") & wide, "any_nav": landmark("nav", "navigation"),
        "modal": own_role("dialog", "alertdialog") | (tag("dialog") & has("open")), "scripted": has("onclick") | (tag("button") & ~above("form")), "real_link": real, "content": F.col("in_body_content"),
        "skip_words": link & fragment & (F.rlike(F.lower("link_text"), F.lit(SKIPS)) | F.rlike(F.lower(F.concat_ws(" ", attr("class"), attr("id"))), F.lit(SKIPS))), "to_main": F.col("to_main"), "ahead": real & fragment & F.col("before_real"), "not_fragment": real & ~fragment,
        "location": F.rlike(low("aria-current"), F.lit("page|location|step|true")) | F.rlike(F.lower(F.concat_ws(" ", attr("class"), attr("id"), attr("aria-label"))), F.lit("breadcrumb|brotkrumen|brotkrümel")),
        "viz": tag("figure") & has("data-viz") & ~or_above(lambda n: named(n, "hidden")), "toggle": has("data-display-toggle"), "display": tag("html") & has("data-display"), "any_viz": (tag("figure") & has("data-viz")) | has("data-display-toggle"),
        "early_script": tag("script") & above("head") & (~has("type") | F.rlike(low("type"), F.lit("^$|javascript|ecmascript"))) & (~has("src") | ~has("async", "defer")), "tablist": own_role("tablist"), "tabpanel": own_role("tabpanel"), "odd_lang": ~F.coalesce(F.col("page_lang"), F.lit("")).isin("de", "en", ""),
        "media": tag("video", "audio") | (tag("iframe") & F.rlike(F.lower(F.coalesce(attr("src"), F.lit(""))), F.lit(PLAYERS))), "images": tag("img", "area") | (tag("input") & (kind == "image")) | sure(attr("role") == "img"), "links": tag("a") & has("href"),
        "fields": tag("select", "textarea") | (tag("input") & ~kind.isin("hidden", "submit", "button", "reset", "image")), "refresh": tag("meta") & (low("http-equiv") == "refresh"),
        "login": (tag("input") & (kind == "password")) | any_of(*(F.rlike(F.coalesce(attr(a), F.lit("")), F.lit("(?i)captcha|turnstile")) for a in ("class", "id", "src"))),
        "gestures": (low("draggable") == "true") | has("ontouchstart", "ontouchmove", "onpointermove", "ongesturestart", "ondragstart") | F.rlike(F.coalesce(attr("class"), F.lit("")), F.lit(SLIDERS)),
        "interruptions": tag("dialog") | (tag("meta") & (low("http-equiv") == "refresh")) | sure(attr("role").isin("alert", "alertdialog", "status", "log", "marquee", "timer")) | (has("aria-live") & (low("aria-live") != "off")),
        "shortcut": has("accesskey", "onkeydown", "onkeypress", "onkeyup") | (tag("script") & F.rlike("own_text", F.lit("keydown|keypress|keyup"))), "pointer": has("onmousedown", "onpointerdown", "ontouchstart"),
        "hover": sure(attr("role") == "tooltip") | has("popover", "onmouseover") | (has("aria-haspopup") & (low("aria-haspopup") != "false")), "text": F.rlike("own_text", F.lit(r"\S")) & ~tag("title", "script", "style", "noscript"),
        "motion": tag("script") & F.rlike("own_text", F.lit("devicemotion|deviceorientation")),
    }
    flags = {n: sure(c) for n, c in flags.items()}
    at = lambda n, k: F.get(F.sort_array(F.collect_list(F.when(flags[n], F.col("pre")))), F.lit(k))
    second = lambda n: F.when(F.count_if(flags[n]) > 1, at(n, 1))
    return e.groupBy("page_id").agg(*(F.bool_or(c).alias(n) for n, c in flags.items()), second("h1").alias("second_h1"), second("main").alias("second_main"), F.min(F.when(flags["tablist"], F.col("pre"))).alias("tablist_at"), F.min_by(F.when(flags["titled"], F.col("txt") == ""), F.when(flags["titled"], F.col("pre"))).alias("title_blank"), F.min(F.when(flags["titled"], F.col("pre"))).alias("title_at"))


def page_rules() -> list[Column]:
    c = F.col
    skip = c("to_main") | (c("ahead") & c("not_fragment")) | c("skip_words")
    nothing = ~c("heading") & ~c("main") & ~skip
    repeated = c("any_nav") | c("banner")
    fails = repeated & ~c("scripted") & ~c("modal")
    once = lambda rule, when, outcome, severity, at=None: F.when(sure(when), F.struct(F.lit(rule).alias("rule_id"), (F.lit(outcome) if isinstance(outcome, str) else outcome).alias("outcome"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), (F.lit(None).cast("int") if at is None else at.cast("int")).alias("pre")))
    return [
        once("document/title-missing", c("root") & ~c("titled"), "fail", "high"),
        once("document/title-empty", c("titled") & c("title_blank"), "fail", "high", c("title_at")),
        once("zoom/viewport-missing", c("root") & ~c("viewport"), "best_practice", "high"),
        once("headings/none", nothing, F.when(fails, "fail").otherwise("review"), F.when(fails, "medium").otherwise("low")),
        once("headings/h1-missing", c("heading") & ~c("h1"), "best_practice", "medium"),
        once("headings/h1-multiple", c("second_h1").isNotNull(), "review", "low", c("second_h1")),
        once("landmarks/main-missing", c("content") & ~c("main"), "best_practice", F.when(c("modal"), "low").otherwise("high")),
        once("landmarks/main-duplicate", c("content") & c("second_main").isNotNull(), "best_practice", "high", c("second_main")),
        once("landmarks/navigation-missing", c("content") & ~c("nav"), "review", "low"),
        once("landmarks/banner-missing", c("content") & ~c("banner"), "review", "low"),
        once("landmarks/contentinfo-missing", c("content") & ~c("contentinfo"), "review", "low"),
        once("keyboard/skip-link-missing", (c("real_link") | c("any_nav") | c("banner")) & ~skip, "review", "medium"),
        once("navigation/location-missing", c("any_nav") & ~c("location"), "review", "low"),
        once("display/toggle-missing", c("viz") & ~c("toggle"), "fail", "medium"),
        once("display/init-missing", c("any_viz") & ~c("display") & ~c("early_script"), "review", "low"),
        once("aria/tabpanel-missing", c("tablist") & ~c("tabpanel"), "review", "low", c("tablist_at")),
        once("language/part-undetermined", c("odd_lang"), "untested", "medium"),
        *(once(f"manual/{name}", any_of(*(c(f) for f in flags.split())), "untested", severity) for name, (flags, severity) in CHECKLIST.items()),
    ]


def page_marks(e: DataFrame, nodes: DataFrame) -> tuple[list[DataFrame], dict[str, Column]]:
    """own_text (texts that are children), link_text, in_body_content, to_main (a link to where the main part begins), before_real (a link before the first that leaves the page): tables by page_id and pre, and columns from them."""
    texts = nodes.filter("kind = 'text'")
    own = texts.select("page_id", F.col("parent_id").alias("pre"), F.col("pre").alias("at"), "text").groupBy("page_id", "pre").agg(join_parts("at", "text").alias("own_text"))
    within = texts.select("page_id", F.col("pre").alias("at"), "text", F.get(F.filter("anc", lambda a: a["tag"] == "a"), F.lit(0))["pre"].alias("pre")).filter("pre is not null").groupBy("page_id", "pre").agg(join_parts("at", "text").alias("link_text"))
    href = F.trim(attr("href"))
    begins = e.filter(landmark("main", "main")).select("page_id", F.col("pre").alias("main_at"), "post")
    # The main part begins at its first descendants: those that follow one another down the tree without a sibling before them.
    starts = e.select("page_id", "pre", attr("id").alias("target"), "sib_element").filter("target is not null")
    first_in = starts.join(begins, "page_id").filter((F.col("pre") >= F.col("main_at")) & (F.col("pre") <= F.col("post"))).select("page_id", "pre", "target", "main_at")
    depth = e.select("page_id", "pre", F.explode(F.concat(F.array("pre"), "anc.pre")).alias("at")).join(e.select("page_id", F.col("pre").alias("at"), "sib_element"), ["page_id", "at"])
    straight = first_in.join(depth, ["page_id", "pre"]).filter("at > main_at").groupBy("page_id", "pre").agg(F.max("sib_element").alias("most")).filter("most > 1").select("page_id", "pre")
    at_start = first_in.join(straight, ["page_id", "pre"], "left_anti").select("page_id", "target").distinct()
    jumps = e.filter((F.col("tag") == "a") & F.rlike(href, F.lit("^#.+"))).select("page_id", "pre", F.regexp_replace(href, "^#", "").alias("target")).join(at_start, ["page_id", "target"]).select("page_id", "pre", F.lit(True).alias("to_main")).distinct()
    shown = (tag("body") | above("body")) & ~tag("script", "style", "template", "noscript") & (F.rlike(F.coalesce("own_text", F.lit("")), F.lit(r"\S")) | tag("img", "svg", "canvas", "video", "audio", "iframe", "object", "embed", "input", "button", "select", "textarea"))
    return [own, within, jumps], {"own_text": F.coalesce("own_text", F.lit("")), "link_text": F.coalesce("link_text", F.lit("")), "to_main": F.coalesce("to_main", F.lit(False)), "before_real": F.col("away").isNull() | (F.col("pre") < F.col("away")), "in_body_content": shown}


def heading_findings(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """Empty headings and skipped levels, in document order."""
    heads = e.withColumn("level", heading_level()).filter("level is not null")
    named_parts = e.filter(filled("aria-label") | (F.col("tag").isin("img") & filled("alt"))).select("page_id", "pre", "anc")
    inside = nodes.filter("kind = 'text'").filter(F.rlike("text", F.lit(r"\S"))).select("page_id", "pre", "anc").unionByName(named_parts).select("page_id", F.explode("anc.pre").alias("pre")).distinct().withColumn("inside", F.lit(True))
    blank = heads.join(inside, ["page_id", "pre"], "left").filter(F.col("inside").isNull() & ~filled("aria-label") & ~filled("title") & ~sure(F.col("labelled_words")))
    empty = blank.select("page_id", F.lit("headings/empty").alias("rule_id"), F.when(filled("aria-labelledby"), "review").otherwise("fail").alias("outcome"), F.lit("medium").alias("severity"), "pre")
    order = F.lag("level").over(Window.partitionBy("page_id").orderBy("pre"))
    skips = heads.withColumn("previous", order).filter(F.col("level") > F.col("previous") + 1).select("page_id", F.lit("headings/skip-level").alias("rule_id"), F.lit("best_practice").alias("outcome"), F.lit("medium").alias("severity"), "pre")
    return empty.unionByName(skips)


def reference_findings(e: DataFrame) -> DataFrame:
    """ARIA references without a target, ids that are referred to and come twice, elements that two own."""
    invalid = filled("aria-invalid") & (low("aria-invalid") != "false")
    asked = lambda names: F.explode(F.flatten(F.array(*(F.transform(tokens(F.when(invalid, attr(n)) if n == "aria-errormessage" else attr(n)), lambda t: t) for n in names))))
    ids = e.filter(attr("id").isNotNull() & (attr("id") != "")).select("page_id", "pre", attr("id").alias("target"))
    lost = e.select("page_id", "pre", asked(REFERENCES).alias("target")).join(ids.select("page_id", "target").distinct(), ["page_id", "target"], "left_anti")
    one = lambda df, rule, outcome, severity: df.select("page_id", F.lit(rule).alias("rule_id"), F.lit(outcome).alias("outcome"), F.lit(severity).alias("severity"), "pre")
    wanted = e.select("page_id", asked(TARGETS).alias("target")).distinct()
    place = F.row_number().over(Window.partitionBy("page_id", "target").orderBy("pre"))
    again = ids.withColumn("k", place).filter("k = 2").join(wanted, ["page_id", "target"], "left_semi")
    owned = e.filter(attr("aria-owns").isNotNull()).select("page_id", "pre", F.explode(F.array_distinct(tokens(attr("aria-owns")))).alias("target"))
    both = owned.withColumn("k", place).filter("k = 2")
    tips = e.filter(own_role("tooltip")).select("page_id", "pre", attr("id").alias("target")).join(e.select("page_id", asked(["aria-describedby", "aria-labelledby"]).alias("target")).distinct(), ["page_id", "target"], "left_anti")
    return one(lost, "aria/reference-missing", "fail", "high").unionByName(one(again, "ids/duplicate", "review", "medium")).unionByName(one(both, "aria/owns-conflict", "fail", "high")).unionByName(one(tips, "patterns/tooltip-unreferenced", "best_practice", "low"))


def tab_findings(e: DataFrame) -> DataFrame:
    """Lists of tabs none of which says that it is selected, and header references that name no header cell of the table."""
    tabs = e.filter(own_role("tab")).select("page_id", F.get(F.filter("anc", lambda a: sure(explicit(a["role"]) == "tablist")), F.lit(0))["pre"].alias("pre"), sure(low("aria-selected") == "true").alias("chosen")).filter("pre is not null")
    none = tabs.groupBy("page_id", "pre").agg(F.bool_or("chosen").alias("chosen")).filter("not chosen").join(e.filter(own_role("tablist") & (low("aria-multiselectable") != "true")).select("page_id", "pre"), ["page_id", "pre"], "left_semi")
    heads = e.filter(tag("th") | own_role("columnheader", "rowheader")).select("page_id", "table", attr("id").alias("target")).filter("target is not null").distinct()
    cells = e.filter(tag("td", "th") & has("headers")).select("page_id", "pre", "table", F.explode(tokens(attr("headers"))).alias("target")).join(heads, ["page_id", "table", "target"], "left_anti").select("page_id", "pre").distinct()
    one = lambda df, rule, outcome, severity: df.select("page_id", F.lit(rule).alias("rule_id"), F.lit(outcome).alias("outcome"), F.lit(severity).alias("severity"), "pre")
    return one(none, "aria/tab-selected-missing", "review", "medium").unionByName(one(cells, "tables/headers-attr-invalid", "fail", "high"))


def structure_findings(nodes: DataFrame) -> DataFrame:
    """page_id, rule_id, outcome, severity, pre (of the element; null: the page) of each finding. Pages without nodes have none."""
    e = stored(with_relations(nodes))
    own = e.select("page_id", "pre", F.explode(F.array_compact(F.array(*element_rules()))).alias("f")).select("page_id", "f.rule_id", "f.outcome", "f.severity", "pre")
    page = page_flags(e).select("page_id", F.explode(F.array_compact(F.array(*page_rules()))).alias("f")).select("page_id", "f.rule_id", "f.outcome", "f.severity", "f.pre")
    # Written, so that the rules' expressions are in no plan that waits for the joins of the others.
    rest = stored(heading_findings(e, nodes).unionByName(reference_findings(e)).unionByName(tab_findings(e)))
    return stored(own).unionByName(stored(page)).unionByName(rest).unionByName(header_findings(nodes)).unionByName(entry_findings(nodes))


def document_findings(nodes: DataFrame) -> DataFrame:
    """page_id, rule_id of the rules on a document's language, title and viewport, from one grouping of the node table and nothing else."""
    t, attrs = F.col("tag"), F.col("attrs")
    holder = F.get("anc", F.lit(0))
    words = (F.col("kind") == "text") & (holder["tag"] == "title") & (holder["ns"] == "html") & F.rlike("text", F.lit(r"[^\t\n\f\r ]"))
    page = nodes.groupBy("page_id").agg(
        F.bool_or((t == "html") & (F.col("depth") == 0)).alias("root"), F.bool_or((t == "html") & (F.col("depth") == 0) & F.coalesce(F.trim(attrs["lang"]) != "", F.lit(False))).alias("lang"), F.min(F.when((t == "title") & (F.col("ns") == "html"), F.col("pre"))).alias("title"),
        F.min(F.when(words, holder["pre"])).alias("worded"), F.bool_or((t == "meta") & (F.lower(attrs["name"]) == "viewport")).alias("viewport"),
    )
    is_ = lambda c: F.coalesce(c, F.lit(False))
    rules = {"document/lang-missing": is_(F.col("root")) & ~is_(F.col("lang")), "document/title-empty": F.col("title").isNotNull() & ~is_(F.col("worded") == F.col("title")), "zoom/viewport-missing": is_(F.col("root")) & ~is_(F.col("viewport"))}
    return page.select("page_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules.items())))).alias("rule_id"))
