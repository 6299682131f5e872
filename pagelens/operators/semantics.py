"""Accessibility rules on roles and names: columns of names.with_names(), joined by page where one element depends on others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelens.plans.store import stored

from .aria import attribute_findings
from .context import attr, tokens
from .names import any_of, has, with_names

# Names that say nothing about a link's target, by themselves or without what surrounds them, and words that announce a new window.
MEANINGLESS = """click here|click|here|read more|more|learn more|info|information|details|link|this link|link here|go|continue|download|view|see more|see all|read|start|begin|submit|next|previous|weiterlesen|mehr erfahren|mehr|mehr dazu|mehr lesen|hier klicken|klick hier|klicken sie hier|siehe hier|hier|weiter|dieser link|alle anzeigen|ansehen|jetzt lesen|öffnen|cliquez ici|ici|en savoir plus|lire la suite|lire plus|plus|voir plus|voir tout|continuer|télécharger|suivant|précédent|commencer|haz clic aquí|aquí|leer más|más|saber más|ver más|ver todo|continuar|descargar|siguiente|anterior|empezar|clicca qui|qui|leggi di più|scopri di più|più|vedi di più|vedi tutto|continua|scarica|successivo|precedente|inizia|clique aqui|aqui|leia mais|saiba mais|mais|ver mais|ver tudo|baixar|próximo|começar|klik hier|meer lezen|lees meer|meer|bekijk meer|volgende|vorige|downloaden|beginnen|klicka här|här|läs mer|mer|nästa|föregående|ladda ner|börja|klikk her|her|les mer|neste|forrige|last ned|klik her|læs mere|mere|næste|klikkaa tästä|lue lisää|lisää|seuraava|edellinen|lataa|kliknij tutaj|tutaj|czytaj więcej|więcej|następny|poprzedni|pobierz|buraya tıklayın|devamını oku|daha fazla|sonraki|önceki|indir|klikněte zde|zde|číst více|více|další|předchozí|stáhnout|citește mai mult|mai mult|următor|descărcați|tovább olvas|több|következő|előző|letöltés|...|>|>>|→""".split("|")
VAGUE_ALONE = """click here|click|here|read more|more|learn more|info|information|details|link|this link|go|continue|download|view|see more|see all|read|start|begin|submit|next|previous|page|article|post|weiterlesen|mehr erfahren|mehr|hier klicken|klicken sie hier|hier|weiter|alle anzeigen|ansehen|jetzt lesen|öffnen|seite|yes|no|ok|okay|open|close|show|hide|toggle|buy|get|add|remove|edit|update|save|send|try|see|...|>|>>|→|»""".split("|")
NEW_WINDOW = "new window|new tab|opens in|(external)|external link|[external]|neues fenster|neuem fenster|neuen tab|neuer tab|neuem tab|öffnet in|externer link|(extern)".split("|")
# Fixed values of WAI-ARIA.
NAME_REQUIRED = "checkbox combobox gridcell heading img link listbox menuitem menuitemcheckbox menuitemradio meter option progressbar radio radiogroup searchbox slider spinbutton switch tab textbox tree treegrid treeitem".split()
FIELDS = "textbox searchbox combobox listbox spinbutton slider checkbox radio radiogroup switch".split()
WIDGETS = "button link textbox checkbox radio combobox listbox menuitem menuitemcheckbox menuitemradio option tab treeitem slider spinbutton searchbox switch".split()
LABELLED = "button checkbox link menuitem menuitemcheckbox menuitemradio option radio switch tab treeitem".split()
NOT_INTERACTIVE = "generic group article section paragraph none presentation".split()
INTERACTIVE = "button link checkbox radio switch menuitem menuitemcheckbox menuitemradio tab option treeitem".split()
LANDMARKS = "banner complementary contentinfo form main navigation region search".split()
CONTENT_ROLES = "heading paragraph link button textbox checkbox radio img image listitem list table cell row".split()
NO_CONTENT = "script style template noscript svg".split()
PARENTS = {
    "caption": "figure grid table treegrid", "cell": "row", "columnheader": "row", "gridcell": "row", "listitem": "list directory", "menuitem": "group menu menubar", "menuitemcheckbox": "group menu menubar", "menuitemradio": "group menu menubar",
    "option": "group listbox", "row": "grid rowgroup table treegrid", "rowgroup": "grid table treegrid", "rowheader": "row", "tab": "tablist", "treeitem": "group tree",
}
CHILDREN = {
    "feed": "article", "grid": "row rowgroup", "list": "listitem", "listbox": "group option", "menu": "group menuitem menuitemcheckbox menuitemradio", "menubar": "group menuitem menuitemcheckbox menuitemradio", "row": "cell columnheader gridcell rowheader",
    "rowgroup": "row", "table": "row rowgroup", "tablist": "tab", "tree": "group treeitem", "treegrid": "row rowgroup",
}
SCHEMA = "page_id long, rule_id string, outcome string, severity string, pre int"

def _true() -> Column:
    return F.lit(True)


def _false() -> Column:
    return F.lit(False)


def sure(c: Column) -> Column:
    return F.coalesce(c, _false())


def is_role(*roles: str) -> Column:
    return sure(F.col("role").isin(*roles))


def tag(*tags: str) -> Column:
    return sure(F.col("tag").isin(*tags))


def unnamed() -> Column:
    return F.col("name").isNull()


def explicit(role: Column) -> Column:
    return F.lower(F.get(tokens(role), F.lit(0)))


def key_of(name: Column) -> Column:
    """A link's name in lower case, without marks and arrows at its end unless there is nothing else."""
    low = F.lower(F.trim(name))
    bare = F.trim(F.regexp_replace(low, r"[.!…>›→»]+$", ""))
    return F.when(bare == "", low).otherwise(bare)


def letters(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def in_svg() -> Column:
    nearest = F.get(F.filter("anc", lambda a: a["tag"].isin("svg", "foreignobject")), F.lit(0))
    return tag("svg") | (~tag("foreignobject") & sure(nearest["tag"] == "svg"))


def finding(rule: str, when: Column, outcome: str | Column, severity: str | Column) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(sure(when), F.struct(F.lit(rule).alias("rule_id"), as_column(outcome).alias("outcome"), as_column(severity).alias("severity")))


def landmark() -> Column:
    """The landmark that an element is, or null. Forms and regions need a name, asides within sections too."""
    own = explicit(attr("role"))
    sectioned = F.exists("anc", lambda a: a["tag"].isin("article", "aside", "nav", "section") | sure(explicit(a["role"]).isin("article", "complementary", "navigation", "region")))
    wide = ~F.exists("anc", lambda a: a["tag"].isin("article", "aside", "main", "nav", "section") | sure(explicit(a["role"]).isin("article", "complementary", "main", "navigation", "region")))
    t = F.col("tag")
    native = F.when(t == "main", "main").when(t == "nav", "navigation").when(t == "search", "search").when((t == "header") & wide, "banner").when((t == "footer") & wide, "contentinfo").when((t == "aside") & (~sectioned | ~unnamed()), "complementary").when(t == "section", "region").when(t == "form", "form")
    found = F.when(own.isNotNull(), F.when(own.isin(LANDMARKS), own)).otherwise(native)
    return F.when(~(found.isin("form", "region") & unnamed()), found)


def invisible_frame() -> Column:
    """Whether a frame is never seen by its markup: width and height of 0 or 1, or an inline style that doesn't display it."""
    tiny = lambda name: sure(F.trim(attr(name)).isin("0", "1"))
    undisplayed = F.exists(F.split(F.coalesce(attr("style"), F.lit("")), ";"), lambda d: F.rlike(d, F.lit(r"(?i)^\s*display\s*:\s*none\s*(!important\s*)?$")))
    return (tiny("width") & tiny("height")) | undisplayed


def is_disabled() -> Column:
    return has("disabled") & tag("button", "input", "select", "textarea", "fieldset", "optgroup", "option")


def native_focus() -> Column:
    editable = sure(F.lower(F.trim(attr("contenteditable"))) != "false")
    return editable | (tag("a", "area") & has("href")) | (tag("input") & ~sure(F.lower(F.trim(attr("type"))) == "hidden")) | (tag("audio", "video") & has("controls")) | tag("button", "select", "textarea", "summary", "iframe")


def element_findings() -> list[Column]:
    """Rules that an element's own row decides."""
    link = is_role("link") | (F.col("role").isNull() & tag("a") & has("href"))
    name, key = F.col("name"), key_of(F.col("name"))
    one = sure(F.char_length(F.trim(name)) == 1)
    graphic = sure(explicit(attr("role")).isin("img", "graphics-document", "graphics-symbol"))
    in_named_control = F.exists("anc", lambda a: a["tag"].isin("a", "button") | sure(explicit(a["role"]).isin("link", "button"))) & F.col("in_named")
    svg = (tag("svg") | (graphic & in_svg())) & ~sure(explicit(attr("role")).isin("presentation", "none")) & unnamed() & ~in_named_control & (graphic | ~F.col("has_graphic"))
    button = (is_role("button") | (tag("button") & ~is_role("none", "presentation"))) & ~tag("summary")
    claims = any_of(sure(F.trim(attr("aria-label")) != ""), has("aria-labelledby"), sure(F.trim(attr("title")) != ""), F.exists("anc", lambda a: a["tag"] == "label"), F.col("has_label"))
    required = is_role(*NAME_REQUIRED) & ~(tag("a") & has("href")) & ~tag("option", "h1", "h2", "h3", "h4", "h5", "h6") & ~(is_role("img") & (tag("img") | in_svg())) & ~is_role("heading", "gridcell", "link") & ~(tag("input", "select", "textarea") & ~claims) & unnamed()
    by_author = any_of(sure(F.trim(attr("aria-label")) != ""), sure(F.trim(attr("aria-labelledby")) != ""))
    by_attribute = by_author | sure(F.trim(attr("title")) == F.trim(name))
    dialog = is_role("dialog", "alertdialog") & ~(tag("dialog") & ~has("open"))
    live, status = F.lower(F.trim(attr("aria-live"))), is_role("alert", "status", "log")
    usual = F.when(F.col("role") == "alert", "assertive").otherwise("polite")
    seen, spoken = letters(F.col("visible_text")), letters(name)
    word_list = lambda text: F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rearranged = F.forall(word_list(F.col("visible_text")), lambda w: F.array_contains(word_list(name), w))
    mismatch = is_role(*LABELLED) & by_author & F.rlike("visible_text", F.lit(r"\p{L}")) & (F.char_length(seen) != 1) & (seen != "") & (spoken != "") & ~F.contains(spoken, seen)
    tabindex = F.trim(attr("tabindex")).try_cast("int")
    inert = has("inert") | F.exists("anc", lambda a: F.contains(a["names"], F.lit(" inert ")))
    shown = F.when(tag("a") & ~has("href", "role"), F.lit(None).cast("string")).otherwise(F.col("role"))
    disabled = is_disabled()
    managed = F.exists("anc", lambda a: F.contains(a["names"], F.lit(" aria-activedescendant ")))
    summary = tag("summary") & sure(F.get("anc", F.lit(0))["tag"] == "details") & F.col("first_summary")
    captionless = tag("fieldset") & F.col("legend_missing") & ~by_author
    grouped = sure(attr("role").isin("radiogroup", "group")) & ~tag("fieldset") & unnamed() & F.col("has_fields")
    title_only = is_role(*FIELDS) & tag("input", "select", "textarea") & ~any_of(by_author, F.col("native").isNotNull()) & sure(F.trim(attr("title")) != "")
    star = F.rlike(F.coalesce("native", name, F.lit("")), F.lit(r"(?i)\*|required|erforderlich|pflicht|obligatoire|requis|obligatorio|richiesto|verplicht"))
    described = F.col("description").isNotNull()
    must = (has("required") | sure(attr("aria-required") == "true")) & is_role(*FIELDS) & ~unnamed()
    return [
        finding("links/name-missing", tag("a") & has("href") & unnamed(), "fail", "critical"),
        finding("buttons/name-missing", button & unnamed(), "fail", "critical"),
        finding("svg/name-missing", svg, F.when(graphic, "fail").otherwise("review"), "high"),
        finding("links/generic-name", link & key.isin(MEANINGLESS), "review", F.when(F.col("has_context"), "low").otherwise("medium")),
        finding("links/url-name", link & ~F.col("has_context") & (F.rlike(F.lower(F.trim(name)), F.lit(r"^(https?://|www\.)")) | (~F.contains(name, F.lit(" ")) & F.rlike(F.lower(name), F.lit(r"\.(com|org|net)")))), "review", "low"),
        finding("links/single-character-name", link & one & ~F.rlike(name, F.lit(r"^\s*[0-9]\s*$")) & ~key.isin(MEANINGLESS), "review", "medium"),
        finding("links/new-window-unannounced", link & sure(F.lower(F.trim(attr("target"))) == "_blank") & ~unnamed() & ~any_of(*(F.contains(F.lower(name), F.lit(w)) for w in NEW_WINDOW)), "review", "low"),
        finding("links/purpose-link-only", link & key.isin(VAGUE_ALONE), "review", "low"),
        finding("names/required-missing", required, "fail", F.when(F.col("role").isin(FIELDS), "critical").otherwise("high")),
        finding("names/symbol-only", is_role(*WIDGETS) & one & ~F.rlike(name, F.lit(r"[\p{L}\p{N}]")) & by_attribute, "review", "medium"),
        finding("dialog/name-missing", dialog & unnamed(), "fail", "high"),
        finding("dialog/modal-unmarked", is_role("dialog") & ~tag("dialog") & ~sure(F.trim(attr("aria-modal")) == "true"), "review", "medium"),
        finding("dialog/focusable-missing", dialog & ~F.col("has_focusable"), "review", "medium"),
        finding("summary/name-missing", summary & unnamed(), "fail", "high"),
        finding("status/live-overridden", status & ((live == "off") | (live.isin("polite", "assertive") & (live != usual) & ~is_role("log"))), F.when(live == "off", "fail").otherwise("review"), F.when(F.col("role") == "alert", "high").otherwise("medium")),
        finding("label-in-name/mismatch", mismatch, F.when(rearranged | (F.char_length(seen) > 2 * F.char_length(spoken)), "review").otherwise("fail"), "medium"),
        finding("forms/group-name-missing", captionless | grouped, "review", "medium"),
        finding("forms/title-only-label", title_only, "review", "medium"),
        finding("forms/required-unmarked", must & ~star & ~described, "review", "medium"),
        finding("forms/instructions-missing", tag("input") & has("pattern") & ~described & ~has("placeholder") & (F.coalesce(F.trim(attr("title")), F.lit("")) == ""), "review", "medium"),
        finding("keyboard/focusable-no-role", ~inert & (tabindex >= 0) & ~native_focus() & (shown.isNull() | shown.isin(NOT_INTERACTIVE)), "review", "low"),
        finding("keyboard/interactive-not-focusable", ~inert & shown.isin(INTERACTIVE) & ~(tabindex.isNotNull() | native_focus()) & ~disabled & ~tag("option") & ~managed, "review", "high"),
        finding("patterns/accordion-controls-missing", ~tag("summary") & sure(F.lower(F.trim(attr("aria-expanded"))) == "true") & ~sure(F.trim(attr("aria-controls")) != "") & is_role("button") & ~F.exists("anc", lambda a: a["tag"].isin("nav", "header") | sure(explicit(a["role"]).isin("navigation", "banner"))), "review", "low"),
        finding("frames/name-missing", tag("iframe") & unnamed() & ~invisible_frame() & (F.coalesce(tabindex, F.lit(0)) >= 0), "fail", "high"),
        finding("names/title-only", is_role("button", "link") & sure(F.trim(attr("title")) != "") & ~by_author & F.col("native").isNull() & F.col("visible_text").isNull(), "review", "medium"),
        finding("aria/required-parent-missing", any_of(*((explicit(attr("role")) == r) & ~F.col("near_role").isin(p.split()) for r, p in PARENTS.items())) | any_of(*((explicit(attr("role")) == r) & F.col("near_role").isNull() for r in PARENTS)), "fail", "high"),
        finding("aria/required-children-missing", any_of(*((explicit(attr("role")) == r) & ~F.arrays_overlap("kid_roles", F.array(*map(F.lit, c.split()))) for r, c in CHILDREN.items())) & ~sure(attr("aria-busy") == "true") & ~has("aria-owns") & (F.size("kid_roles") > 0), "fail", "high"),
    ]


def with_surroundings(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """What rules need of other elements: text around a link, named controls above, focusable and graphic descendants, labels, legends, required owners and owned roles."""
    below = e.select("page_id", F.explode("anc.pre").alias("pre"), ((native_focus() | F.trim(attr("tabindex")).try_cast("int").isNotNull()) & ~is_disabled()).alias("focus"), (sure(explicit(attr("role")).isin("img", "graphics-document", "graphics-symbol")) & in_svg()).alias("graphic"), is_role(*FIELDS).alias("field"))
    below = below.filter("focus or graphic or field").groupBy("page_id", "pre").agg(F.bool_or("focus").alias("has_focusable"), F.bool_or("graphic").alias("has_graphic"), F.bool_or("field").alias("has_fields"))
    controls = e.filter((tag("a", "button") | sure(explicit(attr("role")).isin("link", "button"))) & ~unnamed()).select("page_id", F.col("pre").alias("at"))
    in_named = e.filter(tag("svg") | sure(explicit(attr("role")).isin("img", "graphics-document", "graphics-symbol"))).select("page_id", "pre", F.explode("anc.pre").alias("at")).join(controls, ["page_id", "at"]).select("page_id", "pre", _true().alias("in_named")).distinct()
    # A link has a context if its parent, or a paragraph, item or cell up to four levels above, has other text.
    texts = nodes.filter("kind = 'text'").filter(F.rlike("text", F.lit(r"\S"))).select("page_id", F.col("pre").alias("at"), "anc")
    boxes = texts.select("page_id", "at", F.posexplode("anc").alias("up", "box")).filter((F.col("up") == 0) | F.col("box.tag").isin("p", "li", "td", "th", "dd")).select("page_id", "at", F.col("box.pre").alias("box"))
    links = e.filter(is_role("link")).select("page_id", "pre", "post", F.posexplode(F.slice("anc", 1, 4)).alias("up", "box")).filter((F.col("up") == 0) | F.col("box.tag").isin("p", "li", "td", "th", "dd")).select("page_id", "pre", "post", F.col("box.pre").alias("box"))
    beside = links.join(boxes, ["page_id", "box"]).filter((F.col("at") < F.col("pre")) | (F.col("at") > F.col("post"))).select("page_id", "pre", _true().alias("has_context")).distinct()
    labels = e.filter(tag("label") & attr("for").isNotNull()).select("page_id", attr("for").alias("target")).distinct()
    labelled = e.filter(attr("id").isNotNull()).select("page_id", "pre", attr("id").alias("target")).join(labels, ["page_id", "target"]).select("page_id", "pre", _true().alias("has_label")).distinct()
    kids = e.filter("parent_id >= 0").groupBy("page_id", F.col("parent_id").alias("pre")).agg(F.max(tag("legend")).alias("has_legend"), F.min(F.when(tag("summary"), F.col("pre"))).alias("summary"))
    summaries = kids.filter("summary is not null").select("page_id", F.col("summary").alias("pre"), _true().alias("first_summary"))
    roles = e.select("page_id", F.col("pre").alias("at"), F.col("role").alias("r"))
    above = e.select("page_id", "pre", F.posexplode("anc.pre").alias("k", "at")).join(roles, ["page_id", "at"]).filter("r is not null and r not in ('generic', 'none', 'presentation')")
    near = above.groupBy("page_id", "pre").agg(F.min_by(F.struct("at", "r"), "k").alias("n")).select("page_id", "pre", F.col("n.r").alias("near_role"), F.col("n.at").alias("owner"))
    owned = near.join(e.select("page_id", "pre", F.col("role").alias("own")).filter("own is not null and own not in ('generic', 'none', 'presentation')"), ["page_id", "pre"]).groupBy("page_id", F.col("owner").alias("pre")).agg(F.collect_set("own").alias("kid_roles"))
    for side in (below, in_named, beside, labelled, kids.select("page_id", "pre", "has_legend"), summaries, near.drop("owner"), owned):
        e = e.join(side, ["page_id", "pre"], "left")
    flags = ["has_focusable", "has_graphic", "has_fields", "in_named", "has_context", "has_label", "first_summary"]
    return e.withColumns({**{f: F.coalesce(f, _false()) for f in flags}, "legend_missing": ~F.coalesce("has_legend", _false()), "kid_roles": F.coalesce("kid_roles", F.array().cast("array<string>"))})


def page_findings(e: DataFrame) -> DataFrame:
    """Rules on several elements of a page: links of one name to several targets, landmarks that can't be told apart, lie within others, or come twice."""
    links = e.filter(tag("a") & ~unnamed() & attr("href").isNotNull()).select("page_id", "pre", F.lower(F.trim("name")).alias("name"), attr("href").alias("href"))
    # More targets than one in a group: the smallest and the largest differ.
    same = Window.partitionBy("page_id", "name")
    ambiguous = links.withColumns({"low": F.min("href").over(same), "high": F.max("href").over(same)}).filter("low < high")
    ambiguous = ambiguous.select("page_id", F.lit("links/ambiguous-name").alias("rule_id"), F.lit("review").alias("outcome"), F.lit("medium").alias("severity"), "pre")
    marks = e.withColumn("landmark", landmark()).filter("landmark is not null").select("page_id", "pre", "post", "landmark", F.lower(F.coalesce("name", F.lit(""))).alias("name"), "anc")
    alike = marks.withColumn("n", F.count("*").over(Window.partitionBy("page_id", "landmark", "name"))).filter("n > 1").select("page_id", F.lit("landmarks/not-unique").alias("rule_id"), F.lit("review").alias("outcome"), F.lit("medium").alias("severity"), "pre")
    inner = marks.filter("landmark in ('banner', 'contentinfo', 'main')").select("page_id", "pre", F.explode("anc.pre").alias("at")).join(marks.select("page_id", F.col("pre").alias("at")), ["page_id", "at"]).select("page_id", "pre").distinct()
    nested = inner.select("page_id", F.lit("landmarks/not-top-level").alias("rule_id"), F.lit("best_practice").alias("outcome"), F.lit("medium").alias("severity"), "pre")
    order = F.row_number().over(Window.partitionBy("page_id", "landmark").orderBy("pre"))
    twice = marks.filter("landmark in ('banner', 'contentinfo')").withColumn("k", order).filter("k = 2").select("page_id", F.concat(F.lit("landmarks/"), "landmark", F.lit("-duplicate")).alias("rule_id"), F.lit("best_practice").alias("outcome"), F.lit("medium").alias("severity"), "pre")
    body = e.filter(tag("body")).groupBy("page_id").agg(F.min("pre").alias("body"))
    return ambiguous.unionByName(alike).unionByName(nested).unionByName(twice).join(body, "page_id", "left").drop("body")


def content_outside(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """The outermost elements with content that stand in the body, in no landmark and around none; what has text beside a landmark is the holder of both.

    Content is text, and named elements of CONTENT_ROLES. Links to places on the page that come before the first other link are there to skip, and are no content. A page without a body is judged as its html.
    """
    page = e.groupBy("page_id").agg(F.coalesce(F.min(F.when(tag("body"), F.col("pre"))), F.min(F.when(tag("html"), F.col("pre")))).alias("body"), F.min(F.when(tag("a") & (F.trim(attr("href")) != "") & ~F.rlike(attr("href"), F.lit("(?s)^#.")), F.col("pre"))).alias("leaving")).filter("body is not null")
    jumps = e.filter(tag("a") & (F.trim(attr("href")) != "")).join(page, "page_id").filter("leaving is null or pre < leaving").select("page_id", "pre", _true().alias("jump"))
    marks = e.withColumn("landmark", landmark()).filter("landmark is not null")
    around = marks.select("page_id", F.explode(F.concat(F.array(F.struct("pre", _true().alias("is_mark"))), F.transform("anc", lambda a: F.struct(a["pre"].alias("pre"), _false().alias("is_mark"))))).alias("a")).groupBy("page_id", "a.pre").agg(F.bool_or("a.is_mark").alias("is_mark"))
    outside = ~F.exists("anc", lambda a: a["hidden"] | a["tag"].isin(*NO_CONTENT, "head"))
    words = nodes.filter("kind = 'text'").filter(F.rlike("text", F.lit(r"\S")) & outside).select("page_id", F.col("pre").alias("at"), F.col("anc.pre").alias("path"), _true().alias("is_text"))
    things = e.filter(is_role(*CONTENT_ROLES) & ~unnamed() & ~tag(*NO_CONTENT) & outside).select("page_id", F.col("pre").alias("at"), F.concat(F.array("pre"), "anc.pre").alias("path"), _false().alias("is_text"))
    units = words.unionByName(things).join(page, "page_id").filter(F.array_contains("path", F.col("body"))).withColumn("path", F.filter("path", lambda p: p > F.col("body")))
    steps = units.select("page_id", "at", "is_text", "body", F.posexplode_outer("path").alias("k", "pre")).join(around, ["page_id", "pre"], "left").join(jumps, ["page_id", "pre"], "left")
    seen = steps.groupBy("page_id", "at", "is_text", "body").agg(F.bool_or(sure(F.col("is_mark")) | sure(F.col("jump"))).alias("done"), F.min(F.when(F.col("is_mark").isNull(), F.col("pre"))).alias("top"), F.min_by("pre", "k").alias("nearest"))
    found = seen.filter("not done").select("page_id", F.coalesce("top", F.when(F.col("is_text"), F.coalesce("nearest", "body"))).alias("pre")).filter("pre is not null").distinct()
    return found.select("page_id", F.lit("landmarks/content-outside").alias("rule_id"), F.lit("best_practice").alias("outcome"), F.lit("medium").alias("severity"), "pre")


def semantic_findings(nodes: DataFrame) -> DataFrame:
    """page_id, rule_id, outcome, severity, pre of each finding on roles and names. Hidden elements have none; pages without elements have none."""
    e = stored(with_names(nodes))
    shown = with_surroundings(e, nodes).filter("not hidden")
    own = shown.select("page_id", "pre", F.explode(F.array_compact(F.array(*element_findings()))).alias("f")).select("page_id", "f.rule_id", "f.outcome", "f.severity", "pre")
    visible = e.filter("not hidden")
    return own.unionByName(page_findings(visible)).unionByName(content_outside(visible, nodes)).unionByName(attribute_findings(e).drop("attribute").distinct())
