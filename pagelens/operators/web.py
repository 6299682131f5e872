"""Checks of page metadata and addresses, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shortest and longest recommended length.
TITLE, DESCRIPTION = (30, 60), (120, 160)


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"<title>([^<]*)</title>", 1)


def length_class(text: Column, bounds: tuple[int, int]) -> Column:
    """A null text is missing."""
    n = F.coalesce(F.char_length(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))), F.lit(0))
    return F.when(n == 0, "missing").when(n < bounds[0], "short").when(n > bounds[1], "long").otherwise("ok")


def page_key(url: Column) -> Column:
    """What is equal for addresses of the same page: trimmed, no fragment, scheme and host in lower case, no slash at the path's end; the query stays, an empty one doesn't count."""
    bare = F.regexp_replace(F.trim(url), "(?s)#.*$", "")
    front, query = F.regexp_extract(bare, r"(?s)^([^?]*)", 1), F.regexp_extract(bare, r"(?s)^[^?]*\?(.*)$", 1)
    host, path = F.regexp_extract(front, "^([^/]*://[^/]*)", 1), F.regexp_replace(front, "^[^/]*://[^/]*", "")
    return F.concat(F.lower(host), F.regexp_replace(path, "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def is_default_language(code: Column) -> Column:
    return F.lower(F.trim(code)) == "x-default"


def language_code_is_valid(code: Column) -> Column:
    """x-default, or a language with a script and a region at most, in either case, whatever blanks stand around it."""
    return is_default_language(code) | F.rlike(F.trim(code), F.lit(r"^[A-Za-z]{2,3}(-[A-Za-z]{4})?(-[A-Za-z]{2})?$"))


def language_set(alternates: DataFrame, page: str, url: str) -> DataFrame:
    """Of each page's alternates (hreflang, href): n, has_default, invalid (how many codes), self_reference (one that isn't x-default leads to the page)."""
    own = ~is_default_language(F.col("hreflang")) & (page_key(F.col("href")) == page_key(F.col(url)))
    return alternates.groupBy(page).agg(F.count("*").alias("n"), F.coalesce(F.bool_or(is_default_language(F.col("hreflang"))), F.lit(False)).alias("has_default"), F.count_if(~language_code_is_valid(F.col("hreflang"))).alias("invalid"), F.coalesce(F.bool_or(own), F.lit(False)).alias("self_reference"))


# Names of crawlers by what they do.
BOTS = {
    "search_engine": "googlebot bingbot slurp duckduckbot baiduspider yandexbot naverbot seznambot qwantify startpage",
    "ai_training": "gptbot google-extended applebot-extended bytespider ccbot omgili",
    "ai_citation": "perplexitybot youbot amazonbot oai-searchbot claude-searchbot claude-user claude-web",
    "ai_mixed": "claudebot anthropic-ai chatgpt-user meta-externalagent facebookbot cohere-ai diffbot",
    "unknown_ai": "dotbot petalbot wpbot semrushbot ahrefsbot mj12bot rogerbot",
    "general": "archive.org_bot ia_archiver linkedinbot twitterbot",
}


def bot_class(agent: Column) -> Column:
    """The class of the longest crawler name in a user agent; the first listed of equally long ones."""
    low = F.lower(agent)
    hits = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(name)), F.struct(F.lit(len(name)).alias("n"), F.lit(-k).alias("k"), F.lit(kind).alias("kind"))) for k, (kind, name) in enumerate((kind, name) for kind, names in BOTS.items() for name in names.split()))))
    return F.when(F.trim(agent) == "*", "wildcard").otherwise(F.coalesce(F.array_max(hits)["kind"], F.lit("unknown")))


def robots_lines(sites: DataFrame) -> DataFrame:
    """site, at, key, value, ends of the lines of robots.txt files (site, text) that mean something: `ends` marks blank lines and comments, key and value are of the others that have a colon."""
    line = F.trim(F.col("line"))
    rows = sites.select("site", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\\r\\n|\\n")).alias("at", "line")).withColumn("ends", (line == "") | F.startswith(line, F.lit("#")))
    rows = rows.filter(F.col("ends") | F.contains("line", F.lit(":")))
    return rows.select("site", "at", F.when(~F.col("ends"), F.lower(F.trim(F.substring_index(line, ":", 1)))).alias("key"), F.trim(F.regexp_replace(line, "^[^:]*:", "")).alias("value"), "ends")


def robots_groups(sites: DataFrame) -> DataFrame:
    """site, number, user_agent, bot_class, allows, disallows, crawl_delay: one row for each agent of robots.txt files (site, text), numbered in order.

    A group ends at a blank line or comment once it has an agent, and where an agent follows rules; rules before the first agent are nobody's. An empty disallow is kept, an empty allow isn't; of delays the last counts, and one that
    isn't a whole number is none. Groups are told apart by numbering: windows find for each line what came last before it, so whether it begins a group, and a running count numbers the groups.
    """
    delay = F.when(F.rlike("value", F.lit(r"^\+?[0-9]{1,10}$")), F.col("value").try_cast("long"))
    delay = F.when(delay < 2**32, delay)
    rows = robots_lines(sites).withColumn("delay", F.when(F.col("key") == "crawl-delay", delay))
    key, filled = F.col("key"), F.col("value") != ""
    is_ = {"agent": (key == "user-agent") & filled, "named": key == "user-agent", "end": F.col("ends"), "rule": (key == "disallow") | ((key == "allow") & filled), "wait": F.col("delay").isNotNull(), "no_wait": (key == "crawl-delay") & F.col("delay").isNull()}
    order = Window.partitionBy("site").orderBy("at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda test: F.coalesce(F.max(F.when(test, F.col("at"))).over(before), F.lit(-1))
    rows = rows.withColumns({n: F.coalesce(t, F.lit(False)) for n, t in is_.items()})
    rows = rows.withColumns({f"last_{n}": last(F.col(n)) for n in is_})
    rows = rows.withColumn("ruled", F.greatest("last_rule", F.when(F.col("last_wait") > F.col("last_no_wait"), F.col("last_wait")).otherwise(-1)))
    # An agent line without a name ends a group that has rules, too.
    rows = rows.withColumn("cut", F.col("named") & ~F.col("agent") & (F.col("ruled") > F.col("last_named")) & (F.col("ruled") > F.col("last_end"))).withColumn("last_cut", last(F.col("cut")))
    rows = rows.withColumn("closes", F.col("end") & (F.col("last_agent") > F.greatest("last_end", "last_cut"))).withColumn("last_closes", last(F.col("closes")))
    rows = rows.withColumn("opens", F.col("named") & (F.col("ruled") > F.col("last_named")) & (F.col("ruled") > F.col("last_closes")))
    counted = F.coalesce(F.sum(F.col("closes").cast("int")).over(before), F.lit(0)) + F.sum(F.col("opens").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("group", counted)
    texts = lambda test: F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("at", "value")))), lambda x: x["value"])
    groups = rows.groupBy("site", "group").agg(texts((key == "allow") & filled).alias("allows"), texts(key == "disallow").alias("disallows"), F.max_by("delay", F.when(key == "crawl-delay", F.col("at"))).alias("crawl_delay"))
    agents = rows.filter("agent").select("site", "group", "at", F.col("value").alias("user_agent"))
    found = agents.join(groups, ["site", "group"]).withColumn("number", F.row_number().over(order))
    return found.select("site", "number", "user_agent", bot_class(F.col("user_agent")).alias("bot_class"), "allows", "disallows", "crawl_delay")


def robots_sitemaps(sites: DataFrame) -> DataFrame:
    """site, at, sitemap: the sitemaps that robots.txt files name, whatever group they stand in."""
    return robots_lines(sites).filter("key = 'sitemap' and value <> ''").select("site", "at", F.col("value").alias("sitemap"))


def wildcard_disallows(groups: DataFrame, paths: DataFrame) -> DataFrame:
    """site, path, disallowed of paths (site, path): what all groups for * of the site say together; without one, nothing is disallowed."""
    rules = groups.filter("bot_class = 'wildcard'").groupBy("site").agg(F.flatten(F.collect_list("allows")).alias("allows"), F.flatten(F.collect_list("disallows")).alias("disallows"))
    joined = paths.join(rules, "site", "left")
    return joined.select("site", "path", F.coalesce(path_is_disallowed(F.col("disallows"), F.col("allows"), F.col("path")), F.lit(False)).alias("disallowed"))


def blocked_classes(groups: DataFrame) -> DataFrame:
    """site, bot_class of crawlers that a site disallows anything, by a group of their own."""
    return groups.filter(F.size("disallows") > 0).select("site", "bot_class").distinct()


def rule_length(rule: Column, path: Column) -> Column:
    """The length of a rule that matches the path, else null; * stands for anything, $ at the end for the path's end. An empty rule matches nothing."""
    anchored = F.endswith(rule, F.lit("$"))
    body = F.regexp_replace(F.regexp_replace(rule, "[$]$", ""), "([\\\\\\^$.|?+()\\[\\]{}])", "\\\\$1")
    pattern = F.concat(F.lit("(?s)^"), F.replace(body, F.lit("*"), F.lit(".*")), F.when(anchored, F.lit("$")).otherwise(F.lit("")))
    return F.when((rule != "") & F.rlike(path, pattern), F.octet_length(rule))


def path_is_disallowed(disallows: Column, allows: Column, path: Column) -> Column:
    """Whether the longest matching rule disallows the path; of equally long ones the allowing one holds."""
    longest = lambda rules: F.coalesce(F.array_max(F.transform(rules, lambda r: rule_length(r, path))), F.lit(-1))
    return longest(disallows) > longest(allows)


# Tags of social previews.
OPEN_GRAPH, OPEN_GRAPH_REQUIRED = "og:title og:description og:image og:url og:type og:site_name".split(), 4
TWITTER, TWITTER_REQUIRED, CARDS = "twitter:card twitter:title twitter:description twitter:image".split(), 3, "summary summary_large_image app player".split()


def social(tags: Column) -> Column:
    """struct of a page's tags (map): the share of Open Graph and Twitter fields that aren't blank (in whole percent), whether the required ones are all there, whether card and image are valid."""
    present = lambda t: F.coalesce(F.trim(tags[t]) != "", F.lit(False)).cast("int")
    share = lambda names: F.floor(sum((present(t) for t in names), F.lit(0)) * 100 / len(names)).cast("int")
    complete = lambda names: sum((present(t) for t in names), F.lit(0)) == len(names)
    return F.struct(share(OPEN_GRAPH).alias("open_graph"), complete(OPEN_GRAPH[:OPEN_GRAPH_REQUIRED]).alias("open_graph_complete"), share(TWITTER).alias("twitter"), complete(TWITTER[:TWITTER_REQUIRED]).alias("twitter_complete"),
                    F.trim(tags["twitter:card"]).isin(CARDS).alias("card_valid"), F.rlike(F.trim(tags["og:image"]), F.lit("^https?://")).alias("image_absolute"))


def social_tags(nodes: DataFrame) -> DataFrame:
    """page_id, tags (property or name: the first content) of each page with meta elements."""
    name = F.coalesce(F.col("attrs")["property"], F.col("attrs")["name"])
    meta = nodes.filter("tag = 'meta'").select("page_id", F.lower(name).alias("name"), F.col("attrs")["content"].alias("content"), "pre").filter("name is not null and content is not null")
    first = meta.groupBy("page_id", "name").agg(F.min_by("content", "pre").alias("content"))
    return first.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "content"))).alias("tags"))


def links(pages: DataFrame) -> DataFrame:
    """page_id, position, target of each link."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("position", "target"))


def contrast(lum_a: Column, lum_b: Column) -> Column:
    return (F.greatest(lum_a, lum_b) + 0.05) / (F.least(lum_a, lum_b) + 0.05)


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of 8-bit colour channels."""
    line = lambda c: F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4)))
    return 0.2126 * line(r) + 0.7152 * line(g) + 0.0722 * line(b)


# Fixed values of schema.org: what search engines require and recommend of some types.
REQUIREMENTS = {
    "Article": ("headline", "author datePublished image"), "BreadcrumbList": ("itemListElement", ""), "Event": ("name startDate location", "endDate image offers"), "FAQPage": ("mainEntity", ""), "JobPosting": ("title description datePosted hiringOrganization", "jobLocation validThrough"),
    "LocalBusiness": ("name address", "telephone openingHours url"), "Organization": ("name", "url logo"), "Person": ("name", "url"), "Product": ("name", "image offers review aggregateRating"), "Recipe": ("name image", "author recipeIngredient recipeInstructions"),
    "VideoObject": ("name thumbnailUrl uploadDate", "description contentUrl"), "WebSite": ("name url", "potentialAction"), "WebPage": ("name", "description"),
}


def _names_schema_org(context: Column) -> Column:
    return F.coalesce(F.rlike(context, F.lit(r"^\s*\"?https?://schema\.org/*\"?\s*$")) | F.rlike(context, F.lit(r"\"https?://schema\.org/*\"")), F.lit(False))


def type_name(value: Column) -> Column:
    """A type without its vocabulary's address."""
    return F.regexp_extract(F.regexp_replace(F.trim(value), "/+$", ""), "([^/#]*)$", 1)


def data_blocks(nodes: DataFrame) -> DataFrame:
    """page_id, block (number on the page), json of the JSON-LD scripts."""
    scripts = nodes.filter((F.col("tag") == "script") & (F.lower(F.trim(F.col("attrs")["type"])) == "application/ld+json")).select("page_id", "pre")
    texts = nodes.filter("kind = 'text'").select("page_id", F.col("parent_id").alias("pre"), F.col("text").alias("json"))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("pre")) - 1
    return scripts.withColumn("block", number).join(texts, ["page_id", "pre"], "left").select("page_id", "block", F.coalesce("json", F.lit("")).alias("json"))


def data_nodes(blocks: DataFrame) -> DataFrame:
    """page_id, block, place, types, json, issue of each root of JSON-LD blocks, roots of arrays and graphs each for itself; a block that can't be read has one row with its issue."""
    text, none = F.trim("json"), F.lit(None).cast("string")
    as_array = lambda j: F.from_json(j, "array<string>")
    valid = F.try_parse_json(F.col("json")).isNotNull()
    is_list, is_object = F.startswith(text, F.lit("[")), F.startswith(text, F.lit("{"))
    roots = F.when(is_list, as_array(text)).otherwise(F.array(text))
    issue = F.when(text == "", "empty_script").when(~valid, "invalid_json").when(is_list & (F.size(roots) == 0), "empty_document").when(~is_list & ~is_object, "invalid_root")
    rows = blocks.select("page_id", "block", issue.alias("_broken"), F.when(issue.isNull(), roots).otherwise(F.array(none)).alias("_roots"))
    rows = rows.select("page_id", "block", "_broken", F.posexplode("_roots").alias("root", "json"))
    get = lambda k: F.get_json_object("json", f"$['{k}']")
    graph = F.when(F.startswith(F.trim(get("@graph")), F.lit("[")), as_array(get("@graph")))
    own = rows.withColumns({"context": get("@context"), "graph": get("@graph"), "_items": graph})
    inner = own.filter("_items is not null").select("page_id", "block", "root", F.posexplode("_items").alias("item", "inner"), _names_schema_org(F.col("context")).alias("_held"))
    inner = inner.select("page_id", "block", "root", (F.col("item") + 1).alias("item"), F.col("inner").alias("json"), none.alias("_broken"), F.lit(None).cast("string").alias("graph"), "_held")
    every = own.select("page_id", "block", "root", F.lit(0).alias("item"), "json", "_broken", "graph", F.lit(False).alias("_held")).unionByName(inner)
    context = get("@context")
    in_vocabulary = F.col("_held") | _names_schema_org(context)
    kinds = F.when(F.startswith(F.trim(get("@type")), F.lit("[")), as_array(get("@type"))).otherwise(F.array_compact(F.array(get("@type"))))
    foreign = context.isNotNull() & ~in_vocabulary
    kept = F.filter(kinds, lambda t: (F.trim(t) != "") & (~foreign | F.rlike(F.trim(t), F.lit("^https?://schema\\.org/"))))
    wrong = F.when(F.col("_broken").isNotNull(), F.col("_broken")).when(foreign, "non_schema_org_context").when(~in_vocabulary & F.col("graph").isNotNull(), "graph_without_context").when(~in_vocabulary, "missing_context").when(F.col("graph").isNotNull() & ~F.startswith(F.trim("graph"), F.lit("[")), "graph_not_array").when((F.size(kinds) == 0) & F.col("graph").isNull(), "missing_type")
    return every.select("page_id", "block", (F.col("root") * 100_000 + F.col("item")).alias("place"), F.transform(kept, type_name).alias("types"), "json", wrong.alias("issue"))


def duplicate_data_types(data: DataFrame) -> DataFrame:
    """page_id, type, blocks: types that several blocks of a page describe."""
    return data.select("page_id", "block", F.explode("types").alias("type")).groupBy("page_id", "type").agg(F.array_sort(F.collect_set("block")).alias("blocks")).filter("size(blocks) > 1")


def present_at(json: Column, path: str) -> Column:
    """Whether a property (a dotted path) is there and neither empty nor null."""
    value = F.get_json_object(json, "$." + path)
    return F.coalesce(~F.trim(value).isin("", "[]", "{}", "null"), F.lit(False))


def assessed(data: DataFrame) -> DataFrame:
    """page_id, block, place, type, status (complete, incomplete, invalid), missing_required, missing_recommended of each node of a known type."""
    rows = data.select("page_id", "block", "place", "json", F.explode("types").alias("type")).filter(F.col("type").isin(list(REQUIREMENTS)))
    lacking = lambda k: F.coalesce(*(F.when(F.col("type") == t, F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(~present_at(F.col("json"), p), F.lit(p)) for p in names[k].split())))) for t, names in REQUIREMENTS.items()))
    rows = rows.withColumns({"missing_required": lacking(0), "missing_recommended": lacking(1)})
    return rows.select("page_id", "block", "place", "type", F.when(F.size("missing_required") > 0, "invalid").when(F.size("missing_recommended") > 0, "incomplete").otherwise("complete").alias("status"), "missing_required", "missing_recommended")


def data_inventory(data: DataFrame) -> DataFrame:
    """type, nodes, pages: what is described, over all pages."""
    return data.select("page_id", F.explode("types").alias("type")).groupBy("type").agg(F.count("*").alias("nodes"), F.countDistinct("page_id").alias("pages"))
