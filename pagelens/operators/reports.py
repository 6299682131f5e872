"""Findings: identities, summaries, catalogues, differences of snapshots, and the formats they are handed on in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the report format.
IMPACT = {"low": "minor", "medium": "moderate", "high": "serious", "critical": "critical"}
LEVELS = ("A", "AA", "AAA")
PAGEWIDE = "__pagewide__"
SARIF = "https://json.schemastore.org/sarif-2.1.0.json"
OFFSET_HIGH, OFFSET_LOW, PRIME = 0xCBF29CE4, 0x84222325, 0x1B3
MASK = 0xFFFFFFFF


def summary(findings: DataFrame, *by: str) -> DataFrame:
    """Counts of findings (outcome, severity) by outcome; severities are counted over problems (fail, review) only."""
    problem = F.col("outcome").isin("fail", "review")
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in ("fail", "review", "pass", "untested")]
    return findings.groupBy(*by).agg(*counts, F.count_if(problem).alias("problems"), *(F.count_if(problem & (F.col("severity") == s)).alias(s) for s in ("low", "medium", "high", "critical")))


def rule_runs(pages: DataFrame, rules: list[str], findings: DataFrame, not_run: dict[str, str] | None = None) -> DataFrame:
    """A row for each page and rule, found or not. Rules in `not_run` weren't evaluated, for the reason given; their findings are null, not zero."""
    lacking = not_run or {}
    each = F.array(*(F.struct(F.lit(r).alias("rule_id"), F.lit(lacking.get(r)).cast("string").alias("not_run")) for r in [*rules, *(r for r in lacking if r not in rules)]))
    every = pages.select("page_id", F.explode(each).alias("r")).select("page_id", "r.rule_id", "r.not_run")
    n = findings.groupBy("page_id", "rule_id").agg(F.count("*").alias("n"))
    counted = every.join(n, ["page_id", "rule_id"], "left").withColumn("findings", F.when(F.col("not_run").isNull(), F.coalesce("n", F.lit(0))))
    return counted.select("page_id", "rule_id", "findings", *(["not_run"] if lacking else []))


def first_match(rows: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """rule: the first whose condition (SQL) holds for the row, or null."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(rules):
        out = F.when(F.expr(condition), name).otherwise(out)
    return rows.withColumn("rule", out)


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") == F.col("after"), "same").otherwise("changed")
    return a.join(b, key, "full_outer").withColumn("change", change)


def heading_skips(rows: DataFrame, context: str, order: str, level: str) -> DataFrame:
    """Headings whose level is more than one below the heading before."""
    w = Window.partitionBy(context).orderBy(order)
    return rows.withColumn("previous", F.lag(level).over(w)).filter(F.col(level) > F.col("previous") + 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def selector_pattern(selector: Column) -> Column:
    """A selector without what differs from page to page: runs of digits as #, white space as one blank, letters A to Z small; no selector is the whole page."""
    trimmed = F.regexp_replace(F.coalesce(selector, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    bare = ascii_lower(F.regexp_replace(F.regexp_replace(trimmed, "[0-9]+", "#"), r"[\s\p{Z}]+", " "))
    return F.when(trimmed.isin("", "document"), PAGEWIDE).otherwise(bare)


def location_patterns(rows: DataFrame, location: str) -> DataFrame:
    """pattern, n, pages: locations that differ in numbers, white space and case only are one pattern."""
    return rows.groupBy(selector_pattern(F.col(location)).alias("pattern")).agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("pages"))


def short_hash(text: Column) -> Column:
    """Eight hexadecimal digits: the upper half of the 64-bit FNV-1a hash, kept as two words so that no product overflows."""
    codes = F.transform(F.split(F.regexp_replace(F.hex(F.encode(text, "utf-8")), "(..)", "$1,"), ","), lambda h: F.conv(F.nullif(h, F.lit("")), 16, 10).cast("bigint"))
    start = F.struct(F.lit(OFFSET_HIGH).cast("bigint").alias("high"), F.lit(OFFSET_LOW).cast("bigint").alias("low"))

    def step(acc: Column, code: Column) -> Column:
        low = acc["low"].bitwiseXOR(code)
        product = low * PRIME
        high = (acc["high"] * PRIME + F.shiftright(product, 32) + F.shiftleft(low, 8)).bitwiseAND(F.lit(MASK))
        return F.struct(high.cast("bigint").alias("high"), product.bitwiseAND(F.lit(MASK)).cast("bigint").alias("low"))

    found = F.aggregate(F.filter(codes, lambda c: c.isNotNull()), start, step, lambda acc: acc["high"])
    return F.lower(F.lpad(F.hex(found), 8, "0"))


def finding_id(rule_id: Column, selectors: Column) -> Column:
    """F- and a hash of the rule and its selectors' patterns (an array; in any order, each once; none: the page)."""
    patterns = F.array_sort(F.array_distinct(F.transform(selectors, selector_pattern)))
    patterns = F.when(F.size(patterns) == 0, F.array(F.lit(PAGEWIDE))).otherwise(patterns)
    return F.concat(F.lit("F-"), short_hash(F.concat_ws("\n", rule_id, F.array_join(patterns, "\n"))))


def finding_id_at(rule_id: Column, file: Column, line: Column, column: Column) -> Column:
    return F.concat(F.lit("F-"), short_hash(F.concat(rule_id, F.lit("\n@"), F.coalesce(file, F.lit("")), F.lit(":"), line.cast("string"), F.lit(":"), column.cast("string"))))


def root_cause_id(rule_id: Column, selector: Column) -> Column:
    return F.concat(F.lit("RC-"), short_hash(F.concat(rule_id, F.lit("\n"), selector_pattern(selector))))


def axe_impact(severity: Column) -> Column:
    return F.create_map(*(F.lit(x) for pair in IMPACT.items() for x in pair))[severity]


def level_included(level: Column, target: str) -> Column:
    """Whether a conformance level (A, AA, AAA) belongs to the target."""
    return level.isin(*LEVELS[: LEVELS.index(target) + 1])


def criterion_states(criteria: DataFrame, findings: DataFrame, checked: DataFrame) -> DataFrame:
    """page_id, criterion, state: not_met with a failure, not_detected without one but with a run, not_applicable where the run had nothing to look at, not_checked without a run; counts and may_deduct as reports use them.

    criteria: page_id, criterion; findings: page_id, criterion, outcome; checked: page_id, criterion, applicable.
    """
    failed = findings.groupBy("page_id", "criterion").agg(F.bool_or(F.col("outcome") == "fail").alias("failed"), F.bool_or(F.col("outcome") == "pass").alias("passed"))
    runs = checked.groupBy("page_id", "criterion").agg(F.bool_or("applicable").alias("applicable"))
    both = criteria.join(failed, ["page_id", "criterion"], "left").join(runs, ["page_id", "criterion"], "left")
    state = F.when(F.col("failed"), "not_met").when(F.col("applicable").isNull(), "not_checked").when(~F.col("applicable"), "not_applicable").when(F.col("passed"), "met").otherwise("not_detected")
    return both.select("page_id", "criterion", state.alias("state")).withColumns({"counts": ~F.col("state").isin("not_applicable", "not_checked"), "may_deduct": F.col("state") == "not_met"})


def selected(findings: DataFrame, only: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """Findings of the rules asked for: ids, or beginnings that end in *."""
    meets = lambda patterns: F.exists(F.array(*map(F.lit, patterns)), lambda p: (F.col("rule_id") == p) | (F.endswith(p, F.lit("*")) & F.startswith(F.col("rule_id"), F.regexp_replace(p, r"\*$", ""))))
    if only:
        findings = findings.filter(meets(only))
    return findings.filter(~meets(skip)) if skip else findings


def localized(findings: DataFrame, messages: DataFrame, locale: str) -> DataFrame:
    """findings with `message` in the locale (messages: rule_id, locale, message), in English where there is none."""
    own = messages.filter(F.col("locale") == locale).select("rule_id", F.col("message").alias("own"))
    english = messages.filter("locale = 'en'").select("rule_id", F.col("message").alias("english"))
    return findings.join(F.broadcast(own), "rule_id", "left").join(F.broadcast(english), "rule_id", "left").withColumn("message", F.coalesce("own", "english")).drop("own", "english")


def as_text(findings: DataFrame) -> DataFrame:
    """value: path, place, severity, message and rule of each finding on a line."""
    at = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string"))
    return findings.select(F.concat(F.coalesce(at, "path"), F.lit(": "), F.when(F.col("outcome") == "fail", "error").otherwise("warning"), F.lit(": "), "message", F.lit(" ["), "rule_id", F.lit("]")).alias("value"))


def as_json(findings: DataFrame) -> DataFrame:
    """value: an object for each finding."""
    return findings.select(F.to_json(F.struct(*findings.columns)).alias("value"))


#: Findings whose texts are joined at once.
PIECE = 4096


def pieces(findings: DataFrame, order: list[str], text: Column, between: str, *more: Column) -> DataFrame:
    """path, part, value: the texts of each file's findings in order, joined PIECE at most at a time; parts go up along the file. `more` are further aggregates of a part.

    Findings are sorted over all tasks, not file by file, so no task and no row grows with a file.
    """
    placed = findings.repartitionByRange("path", *order).sortWithinPartitions("path", *order).withColumn("_at", F.monotonically_increasing_id())
    one = F.transform(F.sort_array(F.collect_list(F.struct("_at", text.alias("text")))), lambda x: x["text"])
    return placed.groupBy("path", F.floor(F.col("_at") / PIECE).alias("part")).agg(F.array_join(one, between).alias("value"), *more)


def _whole(between: str) -> Column:
    """A file's parts joined: the row is as large as the file's report, which is what a row stands for here."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "value"))), lambda x: x["value"]), between)


def sarif_results(findings: DataFrame) -> DataFrame:
    """path, part, value, rules: the results of each file's log in order, comma-joined, PIECE at most in a row, with the rules that they name. Results of one rule and message are numbered, so fingerprints differ."""
    w = Window.partitionBy("path", "rule_id", "message").orderBy("line", "column", "level")
    numbered = findings.withColumn("level", F.when(F.col("outcome") == "fail", "error").otherwise("warning")).withColumn("k", F.row_number().over(w))
    region = F.struct(F.col("line").alias("startLine"), F.col("column").alias("startColumn"))
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.when(F.col("line").isNotNull(), region).alias("region")).alias("physicalLocation")))
    mark = F.left(F.sha2(F.concat_ws("\n", "rule_id", "path", "message", F.col("k").cast("string")), 256), F.lit(32))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), F.struct(mark.alias("finding")).alias("partialFingerprints"))
    return pieces(numbered, ["line", "column", "rule_id", "k", "level", "message"], F.to_json(result), ",", F.collect_set("rule_id").alias("rules"))


def sarif_log(rules: Column, results: Column) -> Column:
    """A SARIF 2.1.0 log from its rules' ids and its results, comma-joined."""
    driver = F.struct(F.lit("pagelens").alias("name"), F.transform(rules, lambda r: F.struct(r.alias("id"))).alias("rules"))
    run = F.struct(F.lit("unicodeCodePoints").alias("columnKind"), F.struct(driver.alias("driver")).alias("tool"))
    frame = F.to_json(F.struct(F.lit(SARIF).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs")))
    return F.concat(F.substring(frame, F.lit(1), F.char_length(frame) - 3), F.lit(',"results":['), results, F.lit("]}]}"))


def rules_of_parts() -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list("rules"))))


def as_sarif(findings: DataFrame) -> DataFrame:
    """path, value: SARIF 2.1.0 logs, one for each file; files whose log doesn't fit a row are to be written from sarif_results()."""
    files = sarif_results(findings).groupBy("path").agg(rules_of_parts().alias("rules"), _whole(",").alias("results"))
    return files.select("path", sarif_log(F.col("rules"), F.col("results")).alias("value"))


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def as_junit(findings: DataFrame) -> DataFrame:
    """path, value: a test suite for each file, a failing case for each failure and a skipped one for what is left to people."""
    at = F.coalesce(F.concat(F.lit(" at "), F.col("line").cast("string"), F.lit(":"), F.col("column").cast("string")), F.lit(""))
    fails = F.col("outcome") == "fail"
    name, path, message = escaped(F.concat("rule_id", at)), escaped(F.col("path")), escaped(F.col("message"))
    inner = F.when(fails, F.concat(F.lit('<failure message="'), message, F.lit('" type="'), escaped(F.col("rule_id")), F.lit('">'), path, at, F.lit(": "), message, F.lit("</failure>"))).otherwise(F.concat(F.lit('<skipped message="'), F.when(F.col("outcome") == "review", "warning: ").otherwise("not evaluated: "), message, F.lit('"/>')))
    case = F.concat(F.lit('<testcase classname="'), path, F.lit('" name="'), name, F.lit('">'), inner, F.lit("</testcase>"))
    parts = pieces(findings.withColumn("case", case), ["line", "column", "case"], F.col("case"), "", F.count_if(fails).alias("failures"), F.count("*").alias("tests"))
    suites = parts.groupBy("path").agg(_whole("").alias("cases"), F.sum("failures").alias("failures"), F.sum("tests").alias("tests"))
    return suites.select("path", F.concat(F.lit('<testsuite name="'), escaped(F.col("path")), F.lit('" tests="'), F.col("tests").cast("string"), F.lit('" failures="'), F.col("failures").cast("string"), F.lit('">'), "cases", F.lit("</testsuite>")).alias("value"))


def as_svrl(findings: DataFrame) -> DataFrame:
    """path, value: validation reports, a failed assertion for each finding."""
    one = F.concat(F.lit('<svrl:failed-assert id="'), escaped(F.col("rule_id")), F.lit('" role="'), F.when(F.col("outcome") == "fail", "error").otherwise("warning"), F.lit('"><svrl:text>'), escaped(F.col("message")), F.lit("</svrl:text></svrl:failed-assert>"))
    files = pieces(findings.withColumn("one", one), ["line", "column", "one"], F.col("one"), "").groupBy("path").agg(_whole("").alias("all"))
    return files.select("path", F.concat(F.lit('<svrl:schematron-output xmlns:svrl="http://purl.oclc.org/dsdl/svrl">'), "all", F.lit("</svrl:schematron-output>")).alias("value"))
