"""Content-security policies: parsing, the directive registry, what is valid, and which inline code a page's own policies block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .context import attr, names_of

# Fixed values of CSP: the kinds of value each directive takes, and those that are deprecated.
SOURCES = "child-src connect-src default-src font-src frame-src img-src manifest-src media-src object-src script-src script-src-elem script-src-attr style-src style-src-elem style-src-attr worker-src base-uri form-action".split()
REGISTRY = {
    **dict.fromkeys(SOURCES, "sources"), "sandbox": "sandbox", "frame-ancestors": "ancestors", "report-to": "token", "report-uri": "tokens", "upgrade-insecure-requests": "none", "block-all-mixed-content": "none",
    "require-trusted-types-for": "token", "trusted-types": "policies", "plugin-types": "tokens",
}
DEPRECATED = ("report-uri", "block-all-mixed-content", "plugin-types")
KEYWORDS = "self unsafe-inline unsafe-eval strict-dynamic unsafe-hashes report-sample unsafe-allow-redirects wasm-unsafe-eval".split()
SANDBOX = "forms modals orientation-lock pointer-lock popups popups-to-escape-sandbox same-origin scripts top-navigation top-navigation-by-user-activation top-navigation-to-custom-protocols downloads presentation".split()
S = r"[ \t\n\f\r]"
HASH = r"'(?i:sha256|sha384|sha512)-[A-Za-z0-9+/_-]+={0,2}'"
NONCE = r"'(?i:nonce)-[A-Za-z0-9+/_-]+={0,2}'"
SCHEME = r"[A-Za-z][A-Za-z0-9+.-]*:"
HOST = r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:\*|(?:\*\.)?[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*\.?)(?::(?:[0-9]+|\*))?(?:/[^ ;,?#]*)?"
_words = "|".join(KEYWORDS)
SOURCE = rf"(?i:'(?:{_words})')|{HASH}|{NONCE}|{SCHEME}|{HOST}"
DIRECTIVE = "struct<policy:int,place:int,name:string,value:string>"


def _words_of(value: Column) -> Column:
    return F.filter(F.split(F.coalesce(value, F.lit("")), S + "+"), lambda t: t != "")


def directives(text: Column) -> Column:
    """array(policy, place, name, value) of a list of policies; names in lower case, value null where there is none. Empty parts don't count."""
    one = lambda part, p, k: F.struct(p.cast("int").alias("policy"), k.cast("int").alias("place"), F.lower(F.regexp_extract(part, rf"^([^ \t\n\f\r]+)", 1)).alias("name"), F.nullif(F.regexp_replace(part, rf"^[^ \t\n\f\r]+{S}*", ""), F.lit("")).alias("value"))
    strip = lambda x: F.regexp_replace(x, f"^{S}+|{S}+$", "")
    of = lambda policy, p: F.filter(F.transform(F.split(policy, ";"), lambda part, k: one(strip(part), p, k)), lambda d: d["name"] != "")
    return F.flatten(F.transform(F.split(F.coalesce(text, F.lit("")), ","), of)).cast(f"array<{DIRECTIVE}>")


def hash_expression(source: Column) -> Column:
    """struct(algorithm, value) of a hash source, or null."""
    parts = lambda k: F.regexp_extract(source, r"^'([A-Za-z0-9]+)-([A-Za-z0-9+/_-]+={0,2})'$", k)
    return F.when(F.rlike(source, F.lit(rf"^(?:{HASH})$")), F.struct(F.lower(parts(1)).alias("algorithm"), parts(2).alias("value")))


def grammar(name: Column) -> Column:
    """The kind of value of a directive, or null for an unknown one."""
    return F.create_map(*(F.lit(x) for pair in REGISTRY.items() for x in pair))[name]


def value_is_clean(name: Column, value: Column) -> Column:
    own, kind = _words_of(value), grammar(name)
    all_match = lambda pattern: F.forall(own, lambda t: F.rlike(t, F.lit(rf"^(?:{pattern})$")))
    alone = lambda pattern: (F.size(own) == 1) & all_match(pattern)
    single = (F.size(F.array_distinct(F.transform(own, F.lower))) == F.size(own)) & (F.size(own) > 0)
    nothing = alone("(?i:'none')")
    sources = nothing | (single & all_match(SOURCE))
    ancestors = nothing | (single & all_match(f"(?i:'self')|{SCHEME}|{HOST}"))
    trusted = F.forall(own, lambda t: F.rlike(t, F.lit(r"^(?:[A-Za-z0-9#=_/@.%-]+|\*|'allow-duplicates'|'none')$"))) & (F.size(F.array_distinct(own)) == F.size(own))
    return (
        F.when(kind == "sources", sources).when(kind == "ancestors", ancestors).when(kind == "sandbox", F.forall(own, lambda t: F.lower(t).isin([f"allow-{k}" for k in SANDBOX])) & (F.size(F.array_distinct(own)) == F.size(own)))
        .when(kind == "none", value.isNull()).when(name == "require-trusted-types-for", alone("'script'")).when(kind == "token", F.size(own) == 1)
        .when(name == "plugin-types", (F.size(own) > 0) & all_match(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+/[!#$%&'*+.^_`|~0-9A-Za-z-]+")).when(kind == "tokens", F.size(own) > 0).when(kind == "policies", trusted).otherwise(F.lit(False))
    )


def policy_is_clean(text: Column) -> Column:
    """Whether nothing in a list of policies is unknown, doubled, or ill-formed."""
    bare = F.replace(F.replace(text, F.lit("allow-downloads"), F.lit("")), F.lit("allow-presentation"), F.lit(""))
    own = directives(bare)
    keys = F.transform(own, lambda d: F.concat_ws(" ", d["policy"].cast("string"), d["name"]))
    return ~F.rlike(text, F.lit(r"[^\x00-\x7F]")) & (F.size(F.array_distinct(keys)) == F.size(keys)) & F.forall(own, lambda d: F.coalesce(value_is_clean(d["name"], d["value"]), F.lit(False)))


def directive_table(rows: DataFrame, text: str) -> DataFrame:
    """A row for each directive of a policy column: policy, place, name, value, kind, deprecated, clean, doubled (the first of a name counts)."""
    out = rows.select(*[c for c in rows.columns if c != text], F.explode(directives(F.col(text))).alias("d"), F.transform(directives(F.col(text)), lambda d: F.struct(d["policy"], d["name"], d["place"])).alias("every"))
    same = F.exists("every", lambda x: (x["policy"] == F.col("d.policy")) & (x["name"] == F.col("d.name")) & (x["place"] < F.col("d.place")))
    return out.withColumn("doubled", same).drop("every").select("*", "d.policy", "d.place", "d.name", "d.value").drop("d").withColumns({"kind": grammar(F.col("name")), "deprecated": F.col("name").isin(*DEPRECATED), "clean": value_is_clean(F.col("name"), F.col("value"))})


def source_verdict(value: Column, nonce: Column, script: bool) -> Column:
    """2: blocked, 1: only a hash could allow it, 0: allowed."""
    own = _words_of(value)
    some = lambda pattern: F.exists(own, lambda t: F.rlike(t, F.lit(rf"^(?:{pattern})$")))
    own_nonce = F.coalesce(F.exists(own, lambda t: F.regexp_extract(t, r"^'(?i:nonce)-(.+)'$", 1) == nonce) & (nonce != ""), F.lit(False))
    ignored = some(f"{HASH}|{NONCE}") | (some("(?i:'strict-dynamic')") if script else F.lit(False))
    return F.when(own_nonce, 0).when(some("(?i:'unsafe-inline')") & ~ignored, 0).when(some(HASH), 1).otherwise(2)


def enforcement_findings(nodes: DataFrame) -> DataFrame:
    """page_id, pre, construct (script, handler, style, attribute), name, verdict (blocked, hash) of inline code against the page's policies in meta elements."""
    e = nodes.filter("kind = 'element'")
    policy = e.filter((F.col("tag") == "meta") & (F.lower(attr("http-equiv")) == "content-security-policy") & attr("content").isNotNull())
    policy = policy.select("page_id", F.col("pre").alias("meta"), F.explode(directives(attr("content"))).alias("d")).groupBy("page_id", "meta", "d.policy").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("d.name", "d.value")))).alias("rules"))
    handlers = F.transform(F.filter(F.map_keys("attrs"), lambda k: F.startswith(k, F.lit("on")) & (F.char_length(k) > 2)), lambda k: F.struct(F.lit("handler").alias("construct"), k.alias("name")))
    has = lambda name: F.contains(names_of(F.col("attrs")), F.lit(f" {name} "))
    single = lambda construct, name, when: F.when(when, F.array(F.struct(F.lit(construct).alias("construct"), F.lit(name).alias("name")))).otherwise(F.array().cast("array<struct<construct:string,name:string>>"))
    inline = F.concat(single("script", "script", (F.col("tag") == "script") & ~has("src")), handlers, single("style", "style", F.col("tag") == "style"), single("attribute", "style", has("style")))
    used = e.select("page_id", "pre", attr("nonce").alias("nonce"), F.explode(inline).alias("i")).select("page_id", "pre", "nonce", "i.construct", "i.name")
    both = used.join(policy, "page_id")
    chain = {"script": ("script-src-elem", "script-src"), "handler": ("script-src-attr", "script-src"), "style": ("style-src-elem", "style-src"), "attribute": ("style-src-attr", "style-src")}
    verdict = F.lit(0)
    for construct, (first, second) in chain.items():
        value, given = F.lit(None).cast("string"), F.lit(False)
        for name in ("default-src", second, first):
            there = F.map_contains_key("rules", name)
            value, given = F.when(there, F.col("rules")[name]).otherwise(value), given | there
        nonce = F.col("nonce") if construct in ("script", "style") else F.lit(None).cast("string")
        verdict = F.when((F.col("construct") == construct) & given, source_verdict(value, nonce, construct in ("script", "handler"))).otherwise(verdict)
    worst = both.withColumn("verdict", verdict).groupBy("page_id", "pre", "construct", "name").agg(F.max("verdict").alias("verdict")).filter("verdict > 0")
    return worst.withColumn("verdict", F.when(F.col("verdict") == 2, "blocked").otherwise("hash"))
