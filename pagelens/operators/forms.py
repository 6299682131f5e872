"""Fields of a form that ask for the same thing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.datatypes import CONTACT, FIELDS

from .context import attr
from .names import has

# What forms shouldn't ask for twice and the words that show it, words of fields that repeat on purpose, and words of forms that offer an earlier entry.
ENTRIES = {
    "email address": ["email", "e-mail"], "phone number": ["telefon", "phone", "mobil", "handynummer"], "name": ["vorname", "nachname", "first name", "last name", "firstname", "lastname", "full name", "surname", "family name"],
    "street address": ["straße", "strasse", "address line", "street address"], "postal code": ["postleitzahl", "plz", "zip code", "zipcode", "postal code"],
}
REPETITION = ["confirm", "repeat", "again", "verify", "wiederhol", "bestät", "bestaet", "erneut", "captcha", "otp", "one-time code", "one time code", "verification code"]
ADOPTION = ["same as", "identical to", "use shipping", "use the shipping", "use billing", "use the billing", "wie oben", "wie bei", "entspricht", "gleich wie"]
CONTACT_FIELDS = "tel tel-country-code tel-national tel-area-code tel-local tel-local-prefix tel-local-suffix tel-extension email impp".split()
NO_ENTRY = ["hidden", "password", "submit", "button", "reset", "checkbox", "radio"]


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def autofill_is_valid(value: Column) -> Column:
    """Whether autocomplete is empty, on or off, or what a browser fills in: section-*, shipping or billing, a kind of contact before fields of contacts only, the field, webauthn."""
    some = lambda names: f"(?:{'|'.join(names)})"
    field = rf"(?:(?:{some(CONTACT)}\s+)?{some(CONTACT_FIELDS)}|{some(sorted(set(FIELDS) - set(CONTACT_FIELDS), key=len, reverse=True))})"
    return F.rlike(F.lower(value), F.lit(rf"^\s*(?:on|off|(?:section-\S*\s+)?(?:(?:shipping|billing)\s+)?{field}(?:\s+webauthn)?)?\s*\z"))


def autofilled() -> Column:
    """Whether an element is a field that a user fills in, so that autocomplete means something."""
    kind = F.lower(F.trim(F.coalesce(attr("type"), F.lit("text"))))
    field = F.col("tag").isin("select", "textarea") | ((F.col("tag") == "input") & ~kind.isin("hidden", "button", "submit", "reset"))
    return field & ~has("disabled") & ~F.coalesce(F.lower(F.trim(attr("aria-disabled"))) == "true", F.lit(False))


def entry(text: Column) -> Column:
    """What a field asks for by its words, or null; the first kind that has one of them."""
    low = F.lower(text)
    return F.when(~_any(low, REPETITION), F.coalesce(*(F.when(_any(low, words), kind) for kind, words in ENTRIES.items())))


def field_entries(nodes: DataFrame) -> DataFrame:
    """page_id, form, pre, entry of the fields in forms that a user must fill in: not hidden, prefilled, disabled or filled by autocomplete. A field's words are its name, id, placeholder, aria-label and labels."""
    e = nodes.filter("kind = 'element'")
    texts = nodes.filter("kind = 'text'").select("page_id", F.col("pre").alias("at"), "text", F.explode(F.filter("anc", lambda a: a["tag"] == "label")["pre"]).alias("label"))
    words = texts.groupBy("page_id", "label").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda t: t["text"]), "").alias("words"))
    named = e.filter((F.col("tag") == "label") & attr("for").isNotNull()).groupBy("page_id", attr("for").alias("id")).agg(F.min("pre").alias("label")).join(words, ["page_id", "label"]).select("page_id", "id", F.col("words").alias("for_words"))
    kind, filled = F.lower(F.trim(F.coalesce(attr("type"), F.lit("text")))), F.lower(F.trim(attr("autocomplete")))
    field = F.col("tag").isin("select", "textarea") | ((F.col("tag") == "input") & ~kind.isin(NO_ENTRY))
    open_ = ~has("readonly", "disabled") & ~F.coalesce(F.trim(attr("value")) != "", F.lit(False)) & ~F.coalesce((filled != "") & ~filled.isin("off", "on"), F.lit(False))
    nearest = lambda tag: F.get(F.filter("anc", lambda a: a["tag"] == tag), F.lit(0))["pre"]
    fields = e.filter(field & open_).select("page_id", "pre", attr("id").alias("id"), nearest("label").alias("label"), nearest("form").alias("form"), F.concat_ws(" ", attr("name"), attr("id"), attr("placeholder"), attr("aria-label")).alias("own")).filter("form is not null")
    fields = fields.join(named, ["page_id", "id"], "left").join(words, ["page_id", "label"], "left")
    return fields.select("page_id", "form", "pre", entry(F.concat_ws(" ", "own", "for_words", "words")).alias("entry")).filter("entry is not null")


def redundant_entries(nodes: DataFrame) -> DataFrame:
    """page_id, pre (of the form), entry, n: what a form asks for twice or more, unless its text offers to take an earlier entry over."""
    offers = nodes.filter("kind = 'text'").select("page_id", F.col("pre").alias("at"), "text", F.explode(F.filter("anc", lambda a: a["tag"] == "form")["pre"]).alias("form"))
    offers = offers.groupBy("page_id", "form").agg(F.lower(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda t: t["text"]), "")).alias("t")).filter(_any(F.col("t"), ADOPTION)).select("page_id", "form")
    twice = field_entries(nodes).groupBy("page_id", "form", "entry").agg(F.count("*").alias("n")).filter("n > 1")
    return twice.join(offers, ["page_id", "form"], "left_anti").select("page_id", F.col("form").alias("pre"), "entry", "n")


def entry_findings(nodes: DataFrame) -> DataFrame:
    """forms/redundant-entry, once for each kind of entry of a form."""
    return redundant_entries(nodes).select("page_id", F.lit("forms/redundant-entry").alias("rule_id"), F.lit("review").alias("outcome"), F.lit("medium").alias("severity"), "pre")
