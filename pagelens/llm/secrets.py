"""Secrets: patterns, and two character Markov models compared by log-likelihood ratio; DataFrame functions only.

The models are trained on all documents: values that the patterns find are the samples of random strings, other tokens
of the same characters, outside these matches, the samples of ordinary identifiers (each spelling once).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

# The kinds of base matches in the order they are listed, their patterns and the shortest match that counts.
PATTERNS = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
SHORTEST = {"assign": 6, "access": 20, "hex": 24}
KINDS = [*PATTERNS, "markov"]

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]"
#: Shortest identifier that trains, shortest string that is judged, and the ratio (in nats, and for each character) that makes it a secret.
TRAIN_CHARS, LEAST_CHARS, LEAST_RATIO, RATIO_PER_CHAR = 8, 20, 12.0, 0.35
SPAN = "struct<kind:string,start:bigint,end:bigint,value:string>"


def matches(text: Column, kind: str, pattern: str, group: int, shortest: int) -> Column:
    """array(struct(kind, start, end, value)) of the leftmost matches that don't overlap and whose `group` has `shortest` characters; code points from 0, end exclusive.

    What split() leaves between the matches and the matches themselves have the lengths that give each one's place.
    """
    whole, value = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), value.alias("value"))
    parts = F.filter(parts, lambda p: p["whole"].isNotNull())
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + F.char_length(p["gap"])
        end = begin + F.char_length(p["whole"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), p["value"].alias("value"))
        return F.struct(end.cast("bigint").alias("at"), F.when(F.char_length(p["value"]) >= shortest, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    found = F.aggregate(parts, start, step, lambda acc: acc["found"])
    return F.when(F.rlike(text, F.lit(pattern)), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    # Runs of hex digits and of an access key's characters are matched whole, so asking for their length in the pattern finds the same ones, without the many short ones.
    return F.concat(
        matches(text, "assign", PATTERNS["assign"], 2, SHORTEST["assign"]),
        matches(text, "access", r"AKIA[A-Z0-9]{16,}", 0, SHORTEST["access"]),
        matches(text, "hex", r"[0-9a-f]{24,}", 0, SHORTEST["hex"]),
    )


def _pairs(tokens: DataFrame) -> dict[tuple[int, int], float]:
    """How often one character of ALPHABET (by number from 1, 0: any other) follows another in the distinct strings `token`."""
    pairs = tokens.distinct().select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("token") - 1), lambda i: F.substring("token", i, 2))).alias("pair"))
    counted = pairs.groupBy("pair").count()  # at most the square of the alphabet's size
    place = lambda k: F.instr(F.lit(ALPHABET), F.substring("pair", k, 1))
    return {(r[0], r[1]): float(r[2]) for r in counted.select(place(1), place(2), "count").collect()}


def train(docs: DataFrame) -> list[float]:
    """log(P(next | character) as in random strings / as in identifiers), by ALPHABET number times (its length + 1)."""
    text = F.coalesce("text", F.lit(""))
    values = docs.select(F.explode(base_spans(text)).alias("s")).select(F.explode(F.regexp_extract_all(F.col("s.value"), F.lit(TOKEN + "{6,}"), F.lit(0))).alias("token"))
    rest = F.transform(F.array(base_spans(text)), lambda spans: redacted(text, spans, " "))[0]  # no secret that is known trains the identifiers
    others = docs.select(F.explode(F.regexp_extract_all(rest, F.lit(f"{TOKEN}{{{TRAIN_CHARS},}}"), F.lit(0))).alias("token"))
    random, plain = _pairs(values), _pairs(others)
    size = len(ALPHABET) + 1
    out = []
    for a in range(size):
        of_random, of_plain = (sum(n for (x, _), n in m.items() if x == a) for m in (random, plain))
        for b in range(size):
            p = 0.5 / size + 0.5 * (random.get((a, b), 0.0) + 1 / size) / (of_random + 1)
            q = (plain.get((a, b), 0.0) + 0.5) / (of_plain + 0.5 * size)
            out.append(math.log(p / q))
    return out


def ratio(value: Column, table: Column) -> Column:
    """The log-likelihood ratio of a string's characters."""
    size = len(ALPHABET) + 1
    places = F.transform(F.split(value, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    add = lambda own: F.aggregate(F.sequence(F.lit(1), F.size(own) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table, F.element_at(own, i) * size + F.element_at(own, i + 1) + 1))
    return F.transform(F.array(places), add)[0]


def scan(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """All columns of docs and `secrets`, an array of (kind, start, end, value) by start, then kind: base matches, and what the models find apart from them.

    A null or empty text has none. An input column named secrets is replaced. Without rows the result is empty; without samples the models are
    uniform and find nothing. `model` is what train() gave; by default it is trained on docs.
    """
    table = F.split(F.lit(",".join(map(repr, model or train(docs)))), ",").cast("array<double>")
    text = F.coalesce("text", F.lit(""))
    base, runs = fresh(docs, "_base"), fresh(docs, "_runs")
    rows = docs.withColumn(base, base_spans(text)).withColumn(runs, matches(text, "markov", f"{TOKEN}{{{LEAST_CHARS},}}", 0, LEAST_CHARS))
    apart = F.filter(runs, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    added = F.filter(apart, lambda c: F.transform(F.array(ratio(c["value"], table)), lambda r: (r >= LEAST_RATIO) & (r >= F.char_length(c["value"]) * RATIO_PER_CHAR))[0])
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    order = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise((rank(a) - rank(b)).cast("int"))
    return rows.withColumn("secrets", F.array_sort(F.concat(base, added), order)).drop(base, runs)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (they may overlap) replaced by the mark."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        apart = s["start"] >= acc["at"]
        out = F.concat(acc["out"], F.when(apart, F.concat(gap, F.lit(mark))).otherwise(F.lit("")))
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def secret_counts(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base matches of each kind, the digest of the base matches' list, and the list of all spans.

    A null or empty text has no match; a very long one is searched whole. Repeated rows come out each, a null doc_id too. Other columns aren't read. Without rows the result is empty.
    """
    found = scan(docs.select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "markov")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k) for k in PATTERNS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
