"""Merkle-tree fingerprints of documents, with DataFrame functions only.

Leaves are clauses (up to a mark and the blank or line end behind it), their parents are paragraphs (lines), and runs of
paragraphs form sections: a section ends after a paragraph whose digest begins with 0 to 3, so that an edit
moves no section border but its own. Roots are equal exactly when texts are; where they differ, the sections,
paragraphs and leaves that differ locate the edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Documents in one bucket of neighbouring ids, and the most buckets.
BUCKET_ROWS, MOST_BUCKETS = 2000, 50_000


def leaves(text: Column) -> Column:
    """Clauses and line ends; put together they are the text again."""
    return F.split(text, r"(?<=\n)|(?<=\p{Punct} )", -1)


def tree(text: Column) -> Column:
    """struct(root, sections, paragraphs, leaves) of a text that isn't null. Leaves have 16 hex digits, with ';' behind the last of a line and ' ' behind others."""
    bottom = F.transform(leaves(text), lambda s: F.concat(F.left(F.sha2(s, 256), F.lit(16)), F.when(F.endswith(s, F.lit("\n")), ";").otherwise(" ")))
    return F.transform(F.array(bottom), _upper)[0]


def _upper(bottom: Column) -> Column:
    lines = F.transform(F.split(F.array_join(bottom, ""), ";"), lambda p: F.left(F.sha2(p, 256), F.lit(32)))
    return F.transform(F.array(lines), lambda own: _sections(bottom, own))[0]


def _sections(bottom: Column, lines: Column) -> Column:
    parts = F.transform(F.split(F.array_join(lines, " "), r"(?<=\b[0-3][0-9a-f]{31}) "), lambda s: F.left(F.sha2(s, 256), F.lit(32)))
    return F.transform(F.array(parts), lambda own: F.struct(F.sha2(F.array_join(own, " "), 256).alias("root"), own.alias("sections"), lines.alias("paragraphs"), F.transform(bottom, lambda x: F.left(x, F.lit(16))).alias("leaves")))[0]


def merkle_trees(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs, and `tree` (root, sections, paragraphs, leaves). A null text counts as empty. An input column named tree is replaced."""
    return docs.withColumn("tree", tree(F.coalesce(F.col(text), F.lit(""))))


def fingerprint(text: Column) -> Column:
    """The root, a colon, eight digits of each section, a colon, and eight digits of each leaf."""
    short = lambda xs: F.array_join(F.transform(xs, lambda x: F.left(x, F.lit(8))), " ")
    return F.transform(F.array(tree(text)), lambda t: F.concat_ws(":", t["root"], short(t["sections"]), short(t["leaves"])))[0]


def level(mark: Column, number: int) -> Column:
    """The digests of the sections (1) or leaves (2) of a fingerprint."""
    return F.split(F.element_at(F.split(mark, ":"), number + 1), " ")


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: 1 for equal roots, else the distinct leaves they share over all they have."""
    x, y = level(a, 2), level(b, 2)
    share = F.size(F.array_intersect(x, y))
    return F.when(a == b, F.lit(1.0)).otherwise(share / (F.size(F.array_distinct(x)) + F.size(F.array_distinct(y)) - share)).cast("double")


def differing_branches(a: Column, b: Column) -> Column:
    """Where text b differs from text a, by their fingerprints: struct(sections: numbers of b's sections that a lacks, first and last: the leaves of b between those that both begin and end with; null for equal roots)."""
    sections, own = level(b, 1), level(a, 1)
    new = F.filter(F.transform(sections, lambda x, k: F.when(~F.array_contains(own, x), k)), lambda k: k.isNotNull())
    x, y = level(a, 2), level(b, 2)
    prefix = lambda p, q: F.coalesce(F.nullif(F.array_position(F.zip_with(p, q, lambda u, v: u.eqNullSafe(v)), False), F.lit(0)) - 1, F.least(F.size(p), F.size(q)).cast("bigint"))
    begin = prefix(x, y)
    end = F.least(prefix(F.reverse(x), F.reverse(y)), F.least(F.size(x), F.size(y)) - begin)
    return F.when(a != b, F.struct(new.alias("sections"), begin.cast("int").alias("first"), (F.size(y) - end).cast("int").alias("last")))


def with_next(docs: DataFrame, value_columns: list[str]) -> DataFrame:
    """doc_id and `value_columns`, and each of these of the next row by ascending (doc_id, values), as next_<name>; the first row follows the last.

    Rows go to buckets of neighbouring ids by quantiles of doc_id, and the first id of each bucket also goes to the one
    before it, so no task sorts the whole table. Null ids come first.
    """
    n, least, nulls = docs.agg(F.count("*"), F.min("doc_id"), F.max(F.col("doc_id").isNull())).first()
    count = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / count for k in range(1, count)], 20 * count).alias("q")).first()["q"] if count > 1 else []
    bounds = sorted({*(cuts or []), *([] if least is None else [least])})
    step = max(1, round(len(bounds) ** 0.5))
    coarse = bounds[step::step]
    fine = [bounds[k : k + step] for k in range(0, max(1, len(bounds)), step)]
    numbers = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>") if xs else F.array().cast("array<bigint>")
    at = lambda xs: F.size(F.filter(xs, lambda b: b <= F.col("doc_id")))
    rows = docs.select("doc_id", *value_columns).withColumn("_c", at(numbers(coarse)))
    table = F.split(F.lit(";".join(",".join(map(str, xs)) for xs in fine)), ";")
    own = F.element_at(F.transform(table, lambda s: F.split(s, ",").cast("array<bigint>")), F.col("_c") + 1)
    rows = rows.withColumn("_b", F.greatest(F.col("_c") * step + at(own) - 1, F.lit(0)))
    first = F.array_contains(own, F.col("doc_id")) & (F.col("_b") > 0) if len(bounds) > 1 else F.lit(False)
    whole_first = F.col("doc_id").isNull() if nulls else F.col("doc_id") == F.lit(least)
    last = max(0, len(bounds) - 1)
    none = F.lit(None).cast("struct<b:int,ghost:boolean>")
    place = lambda b, ghost: F.struct(b.cast("int").alias("b"), F.lit(ghost).alias("ghost"))
    places = F.array(place(F.col("_b"), False), F.when(first, place(F.col("_b") - 1, True)).otherwise(none), F.when(whole_first, place(F.lit(last), True)).otherwise(none))
    rows = rows.select("doc_id", *value_columns, F.explode(F.array_compact(places)).alias("_p"))
    w = Window.partitionBy("_p.b").orderBy("_p.ghost", F.col("doc_id").asc_nulls_first(), *value_columns)
    return rows.select("doc_id", *value_columns, "_p", *(F.lead(c).over(w).alias(f"next_{c}") for c in value_columns)).filter("not _p.ghost").drop("_p")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, in which the last half is replaced by the next document's first half; `edits` locates what differs between the two.

    doc_id is a whole number. A null text counts as empty; a very long one is read whole. A table of one row is its own next document. Rows with the same doc_id follow one another by
    text; null ids come first. Other columns aren't read. Without rows the result is empty.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("fingerprint", fingerprint(F.col("text")))
    both = with_next(own, ["text", "fingerprint"])
    both = both.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    both = both.withColumn("edited", F.concat(F.left(F.col("text"), (F.col("n_chars") - F.col("half")).cast("int")), F.left(F.col("next_text"), F.col("half"))))
    both = both.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited")).alias("edited_fingerprint"), "next_fingerprint")
    return both.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), differing_branches(F.col("fingerprint"), F.col("edited_fingerprint")).alias("edits"))
