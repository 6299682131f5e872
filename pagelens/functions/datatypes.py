"""Checks of attribute values against the datatypes of the conformance schema, as column expressions.

Most are one regular expression over the whole value (in the part of the syntax that both Java and RE2 know); the rest compare parts of it. A null value is null.
Known differences: host names aren't parsed further than their characters, names of XML use Unicode's letters, sizes and media
conditions are matched by shape (features by name).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of HTML and its registries.
CONTACT = "home work mobile fax pager".split()
FIELDS = """name honorific-prefix given-name additional-name family-name honorific-suffix nickname username new-password current-password one-time-code organization-title organization
street-address address-line1 address-line2 address-line3 address-level4 address-level3 address-level2 address-level1 country country-name postal-code cc-name cc-given-name cc-additional-name
cc-family-name cc-number cc-exp cc-exp-month cc-exp-year cc-csc cc-type transaction-currency transaction-amount language bday bday-day bday-month bday-year sex url photo tel tel-country-code
tel-national tel-area-code tel-local tel-local-prefix tel-local-suffix tel-extension email impp""".split()
RELATIONS = """about acl alternate amphtml api-catalog appendix apple-touch-icon apple-touch-startup-image archives author blocked-by bookmark c2pa-manifest canonical chapter cite-as collection
compression-dictionary contents convertedfrom copyright create-form current deprecation describedby describes disclosure dns-prefetch duplicate edit edit-form edit-media enclosure external first
geofeed glossary help hosts hub ice-server icon index intervalafter intervalbefore intervalcontains intervaldisjoint intervalduring intervalequals intervalfinishedby intervalfinishes intervalin
intervalmeets intervalmetby intervaloverlappedby intervaloverlaps intervalstartedby intervalstarts item last latest-version license linkset lrdd manifest mask-icon me media-feed memento micropub
modulepreload monitor monitor-group next next-archive nofollow noopener noreferrer opener openid2.local_id openid2.provider original p3pv1 payment pingback preconnect predecessor-version prefetch
preload prerender prev prev-archive preview previous privacy-policy profile publication rdap-active rdap-bottom rdap-down rdap-top rdap-up related replies restconf ruleinput search section self
service service-desc service-doc service-meta sip-trunking-capability sitemap sponsored start status stylesheet subsection successor-version sunset tag terms-of-service timegate timemap type ugc up
version-history via webmention working-copy working-copy-of""".split()
SANDBOX = "downloads forms modals orientation-lock pointer-lock popups popups-to-escape-sandbox presentation same-origin scripts top-navigation top-navigation-by-user-activation top-navigation-to-custom-protocols".split()
SCRIPTS = "application/(?:x-)?(?:ecma|java)script|text/(?:x-)?(?:ecma|java)script|text/javascript1\\.[0-5]|text/jscript|text/livescript"
RESERVED = "annotation-xml color-profile font-face font-face-format font-face-name font-face-src font-face-uri missing-glyph".split()
ENCODINGS = "utf-8 ibm866 iso-8859-2 iso-8859-3 iso-8859-4 iso-8859-5 iso-8859-6 iso-8859-7 iso-8859-8 iso-8859-8-i iso-8859-10 iso-8859-13 iso-8859-14 iso-8859-15 iso-8859-16 koi8-r koi8-u macintosh windows-874 windows-1250 windows-1251 windows-1252 windows-1253 windows-1254 windows-1255 windows-1256 windows-1257 windows-1258 x-mac-cyrillic gbk gb18030 big5 euc-jp iso-2022-jp shift_jis euc-kr utf-16be utf-16le x-user-defined".split()
OLD_TAGS = "i-ami i-bnn i-default i-enochian i-hak i-klingon i-lux i-mingo i-navajo i-pwn i-tao i-tay i-tsu sgn-be-fr sgn-be-nl sgn-ch-de art-lojban cel-gaulish no-bok no-nyn zh-guoyu zh-hakka zh-min zh-min-nan zh-xiang".split()
FEATURES = "(?:min-|max-)?(?:width|height|aspect-ratio|resolution|color|color-index|monochrome)|orientation|scan|grid|update|overflow-block|overflow-inline|hover|any-hover|pointer|any-pointer|color-gamut|dynamic-range|inverted-colors|prefers-reduced-motion|prefers-color-scheme|prefers-contrast|prefers-reduced-transparency|forced-colors|scripting|display-mode|environment-blending|nav-controls|video-dynamic-range|horizontal-viewport-segments|vertical-viewport-segments"

S = r"[ \t\n\f\r]"
_D = r"(?:[12][0-9]{3}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|1[0-9]|2[0-8]))|(?:[12][0-9](?:0[48]|[2468][048]|[13579][26])|(?:12|16|20|24|28)00)-02-29)"
_T = r"(?:[01][0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]{1,3})?)?"
_Z = r"(?:Z|\+(?:(?:0[0-9]|1[0-3]):?(?:00|30|45)|14:?00)|-(?:(?:0[1-9]|1[01]):?(?:00|30|45)|00:?(?:30|45)|12:?00))"
_N = r"(?:\.[0-9]+|[0-9]+(?:\.[0-9]+)?)(?:[eE][+-]?[0-9]+)?"
_TOKEN = r"[!#$%&'*+.^_`|~0-9A-Za-z-]+"
_PARAMETERS = rf"(?:{S}*;{S}*{_TOKEN}=(?:{_TOKEN}|\"(?:[^\"\\]|\\.)*\"))*"
_ISO = r"[Pp](?:[0-9]+[Dd](?:[Tt](?:[0-9]+[Hh])?(?:[0-9]+[Mm])?(?:[0-9]+(?:\.[0-9]+)?[Ss])?)?|[Tt](?:[0-9]+[Hh](?:[0-9]+[Mm])?(?:[0-9]+(?:\.[0-9]+)?[Ss])?|[0-9]+[Mm](?:[0-9]+(?:\.[0-9]+)?[Ss])?|[0-9]+(?:\.[0-9]+)?[Ss]))"
_WORDS = rf"(?:{S}*[0-9]+{S}*(?:[WwDdHhMmSs]|\.[0-9]+[Ss]))+{S}*"
_MONTH_DAY = r"(?:(?:0[13578]|1[02])-(?:0[1-9]|[12][0-9]|3[01])|(?:0[469]|11)-(?:0[1-9]|[12][0-9]|30)|02-(?:0[1-9]|[12][0-9]))"
_YM, _YW = r"[1-9][0-9]{3,}-(?:0[1-9]|1[0-2])", r"[1-9][0-9]{3,}-W(?:0[1-9]|[1-4][0-9]|5[0-2])"
_PATH = r"(?:[^\x00-\x20\"<>\\^`{}|%\x7F-\x{9F}\[\]#]|%[0-9A-Fa-f]{2})*"
_SPECIAL = rf"(?i:https?|ftp|wss?)://[^\x00-\x20\"<>\\^`{{}}|%/?#@\x7F-\x{{9F}}\[\]]+(?:/{_PATH}|\?{_PATH})?"
_OTHER = rf"[A-Za-z][A-Za-z0-9+.-]*:{_PATH}"
_FRAGMENT = rf"(?:#{_PATH})?"
_HASH = r"(?i:sha256|sha384|sha512)-[A-Za-z0-9+/_-]+={0,2}"
_CONDITION = rf"\({S}*(?:{FEATURES}){S}*(?::{S}*[A-Za-z0-9.+/ -]+)?\)|\({S}*[0-9.]+[a-z]*{S}*[<>]=?{S}*(?:{FEATURES}){S}*(?:[<>]=?{S}*[0-9.]+[a-z]*{S}*)?\)|\({S}*(?:{FEATURES}){S}*[<>=]=?{S}*[0-9./]+[a-z]*{S}*\)"
_CONDITIONS = rf"(?:not{S}+(?:{_CONDITION})|(?:{_CONDITION})(?:{S}+and{S}+(?:{_CONDITION}))*|(?:{_CONDITION})(?:{S}+or{S}+(?:{_CONDITION}))*)"
_MEDIA = rf"(?:(?:(?:only|not){S}+)?(?:all|screen|print)(?:{S}+and{S}+(?:{_CONDITION}))*|{_CONDITIONS})"
_LENGTH = r"(?:\+?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)(?:e[+-]?[0-9]+)?(?:px|em|rem|ex|ch|vw|vh|vmin|vmax|cm|mm|q|in|pt|pc)|[+-]?0|(?:calc|min|max|clamp)\([^;]*\))"
_NUM, _COMMA = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", rf"{S}*,?{S}*"


def _path(letters: str, count: int) -> str:
    one = _COMMA.join([_NUM] * count)
    return rf"[{letters}]{S}*{one}(?:{_COMMA}{one})*{S}*"


_ARC = _COMMA.join([_NUM, _NUM, _NUM, "[01]", "[01]", _NUM, _NUM])
_SEGMENT = "|".join([r"[Zz]" + f"{S}*", _path("LlTt", 2), _path("HhVv", 1), _path("Cc", 6), _path("SsQq", 4), rf"[Aa]{S}*{_ARC}(?:{_COMMA}{_ARC})*{S}*"])

#: Datatypes that are one expression.
PATTERNS = {
    "ID": r"[^ \t\n\f\r]+", "IDREF": r"[^ \t\n\f\r]+", "IDREFS": r"(?s).*[^ \t\n\f\r].*", "non-empty-string": r"(?s).+", "string": r"(?s).*", "string-without-line-breaks": r"[^\n\r]*",
    "zero": "0", "integer": "-|-?[0-9]+", "integer-non-negative": "[0-9]+", "integer-positive": "0*[1-9][0-9]*",
    "float": f"-?{_N}", "float-non-negative": rf"{_N}|-(?:\.0+|0+(?:\.0+)?)(?:[eE][+-]?[0-9]+)?", "float-positive": r"(?:[0-9]*[1-9][0-9]*(?:\.[0-9]+)?|[0-9]*\.[0-9]*[1-9][0-9]*)(?:[eE][+-]?[0-9]+)?",
    "hash-name": r"(?s)#.+", "browsing-context": r"(?s)[^_].*", "browsing-context-or-keyword": r"(?s)[^_].*|_(?i:blank|self|top|parent)", "simple-color": "#[0-9A-Fa-f]{6}",
    "date": _D, "datetime-local": f"{_D}[T ]{_T}", "datetime-tz": f"{_D}[T ]{_T}{_Z}", "month": _YM, "time": _T,
    "iri": rf"{S}*(?:{_SPECIAL}|{_OTHER}){_FRAGMENT}{S}*", "email-address": r"(?s).*", "email-address-list": r"(?s).*", "color": r"(?s).*",
    "mime-type": f"{_TOKEN}/{_TOKEN}{_PARAMETERS}", "mime-type-list": rf"{S}*(?:\*/\*|\.{_TOKEN}|{_TOKEN}/{_TOKEN}){S}*(?:,{S}*(?:\*/\*|\.{_TOKEN}|{_TOKEN}/{_TOKEN}){S}*)*", "charset": f"(?i:{'|'.join(x.replace('.', chr(92) + '.') for x in ENCODINGS)})",
    "meta-charset": rf"(?is)text/html;.*?charset{S}*={S}*(?:utf-8(?:[ \t\n\f\r;].*)?|\"utf-8\".*|'utf-8'.*)", "integrity-metadata": rf"{S}*(?:{_HASH}(?:\?[^ \t\n\f\r]*)?(?:{S}+|$))*", "circle": "-?[0-9]+,-?[0-9]+,[0-9]+", "polyline": r"(?:-?[0-9]+,-?[0-9]+,){2}(?:-?[0-9]+,-?[0-9]+,)*-?[0-9]+,-?[0-9]+",
    "media-query": rf"(?i){S}*{_MEDIA}{S}*(?:,{S}*{_MEDIA}{S}*)*", "source-size-list": rf"(?i){S}*(?:auto{S}*(?:,{S}*)?)?(?:{_CONDITIONS}{S}+{_LENGTH}{S}*,{S}*)*(?:(?:{_CONDITIONS}{S}+)?{_LENGTH}){S}*|(?i){S}*auto{S}*",
    "xml-name": r"[\p{L}\p{Nl}_:][\p{L}\p{Nl}\p{Nd}\p{M}._:\x{B7}-]*", "svg-pathdata": rf"{S}*(?:{_path('Mm', 2)}(?:{_SEGMENT})*)*",
}


def matches(value: Column, pattern: str) -> Column:
    return F.rlike(value, F.lit(rf"^(?:{pattern})\z"))


def words(value: Column) -> Column:
    return F.filter(F.split(value, S + "+"), lambda t: t != "")


def distinct(items: Column) -> Column:
    return F.size(F.array_distinct(items)) == F.size(items)


def custom_element_name(value: Column) -> Column:
    return matches(value, r"[a-z][^A-Z \t\n\f\r\x00/>]*") & F.contains(value, F.lit("-")) & ~value.isin(RESERVED)


def autocomplete(value: Column) -> Column:
    """section-*, shipping or billing, a kind of contact, a field name, webauthn: each once at most and in this order; a field name, or webauthn alone."""
    lead = rf"(?:section-[^ \t\n\f\r]*{S}+)?(?:(?:shipping|billing){S}+)?(?:(?:{'|'.join(CONTACT)}){S}+)?"
    return matches(F.lower(value), rf"{S}*(?:{lead}(?:{'|'.join(FIELDS)})(?:{S}+webauthn)?|webauthn){S}*")


def key_labels(value: Column) -> Column:
    own = words(value)
    return F.forall(own, lambda t: F.char_length(t) == 1) & distinct(own)


def language(value: Column) -> Column:
    """The shape of BCP 47 tags, without their registry."""
    low = F.lower(value)
    shape = r"x(?:-[a-z0-9]{1,8})+|(?:[a-z]{2,3}|[a-z]{5,8})(?:-[a-z]{3})?(?:-[a-z]{4})?(?:-(?:[a-z]{2}|[0-9]{3}))?(?:-(?:[a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*(?:-[^x-](?:-[^-]{2,8})+)*(?:-x(?:-[a-z0-9]{1,8})+)?"
    return low.isin(OLD_TAGS) | (matches(low, shape) & ~low.isin("mo", "bat-smg", "zzz", "ja-jpan") & ~F.startswith(low, F.lit("zzz-")))


def relations(value: Column) -> Column:
    """No word twice, and none that looks like a misspelt relation: two edits at most from one, with the same first or last letter."""
    own = F.transform(words(value), lambda t: F.regexp_replace(t, "^:", ""))
    known = F.array(*map(F.lit, RELATIONS))
    long = F.array(*(F.lit(r) for r in RELATIONS if len(r) > 3))

    def typo(t: Column) -> Column:
        near = lambda r: (F.abs(F.char_length(r) - F.char_length(t)) <= 2) & ((F.left(r, F.lit(1)) == F.left(t, F.lit(1))) | (F.right(r, F.lit(1)) == F.right(t, F.lit(1)))) & (F.levenshtein(r, t) <= 2)
        return (F.char_length(t) > 3) & ~F.array_contains(known, t) & F.exists(long, near)

    return distinct(own) & ~F.exists(own, lambda t: typo(F.lower(t)))


def sandbox(value: Column) -> Column:
    own = F.transform(words(value), F.lower)
    has = lambda k: F.array_contains(own, f"allow-{k}")
    return distinct(own) & F.forall(own, lambda t: t.isin([f"allow-{k}" for k in SANDBOX])) & ~(has("scripts") & has("same-origin")) & ~(has("top-navigation") & has("top-navigation-by-user-activation"))


def script_type(value: Column) -> Column:
    return matches(value, SCRIPTS) | (matches(value, f"{_TOKEN}/{_TOKEN}(?:;{S}*{_TOKEN}=(?:{_TOKEN}|\"(?:[^\"\\\\]|\\\\.)*\"){S}*)*") & ~matches(value, f"(?:{SCRIPTS}).+"))


def microdata_property(value: Column) -> Column:
    return ~F.rlike(value, F.lit("[.:]")) | matches(value, f"(?:{_SPECIAL}|{_OTHER}){_FRAGMENT}")


def iri_reference(value: Column) -> Column:
    """An absolute address, or one relative to a base; not empty."""
    bare = F.trim(F.regexp_replace(value, f"^{S}+|{S}+$", ""))
    relative = matches(bare, rf"(?:[^:/?#]*(?:[/?].*)?|//[^/?#@]+.*|#.*)") & matches(bare, f"{_PATH}{_FRAGMENT}")
    return (bare != "") & (matches(value, PATTERNS["iri"]) & ~matches(F.lower(bare), r"(?:https?|ftp|wss?):(?:[^/].*|/[^/].*|/?)") | relative)


def http_reference(value: Column) -> Column:
    return iri_reference(value) & ~matches(F.lower(F.trim(value)), r"[a-z][a-z0-9+.-]*:.*") | (iri_reference(value) & matches(F.lower(F.trim(value)), "https?:.*"))


def long_year(year: Column) -> Column:
    """Whether an ISO year has 53 weeks: its last day, or that of the year before, falls on the right weekday."""
    weekday = lambda y: (y + F.floor(y / 4) - F.floor(y / 100) + F.floor(y / 400)) % 7
    return (weekday(year) == 4) | (weekday(year - 1) == 3)


def week(value: Column) -> Column:
    year = F.regexp_extract(value, r"^([1-9][0-9]{3,8})-W53\z", 1).try_cast("long")
    return matches(value, _YW) | F.coalesce(long_year(year), F.lit(False))


def time_datetime(value: Column) -> Column:
    bare = F.regexp_replace(value, f"^{S}+|{S}+$", "")
    return matches(bare, "|".join([_D, f"{_D}[T ]{_T}{_Z}?", _YM, _T, _MONTH_DAY, _Z, r"[1-9][0-9]{3,}", _ISO, _WORDS])) | week(bare)


def rectangle(value: Column) -> Column:
    own = F.transform(F.split(value, ","), lambda t: t.try_cast("int"))
    return matches(value, "-?[0-9]+(?:,-?[0-9]+){3}") & F.coalesce((F.get(own, F.lit(0)) < F.get(own, F.lit(2))) & (F.get(own, F.lit(1)) < F.get(own, F.lit(3))), F.lit(False))


def refresh(value: Column) -> Column:
    return matches(value, "[0-9]+") | (matches(value, rf"[0-9]+;{S}+[uU][rR][lL]=[^\"' \t\n\f\r](?s:.*[^ \t\n\f\r])?") & iri_reference(F.regexp_extract(value, r"(?s)^[0-9]+;\s+[uU][rR][lL]=(.*)$", 1)))


def candidates(value: Column) -> Column:
    """A srcset: addresses, each with a width or a density, no mix of the two and no descriptor twice."""
    one = rf"[^ \t\n\f\r,](?:[^ \t\n\f\r]*[^ \t\n\f\r,])?(?:{S}+(?:0*[1-9][0-9]*w|[0-9]*\.?[0-9]+(?:[eE][+-]?[0-9]+)?x))?"
    shape = matches(value, rf"{S}*{one}(?:{S}*,{S}+{one}|{S}+,{S}*{one}|,{S}*{one})*{S}*")
    marks = F.transform(F.regexp_extract_all(F.concat(value, F.lit(",")), F.lit(rf"{S}([0-9.eE+-]+[wx]){S}*,"), F.lit(1)), lambda d: F.concat(F.regexp_replace(d, "[wx]$", "").try_cast("double").cast("string"), F.right(d, F.lit(1))))
    bare = F.size(F.regexp_extract_all(value, F.lit(rf"{S}*({one})"), F.lit(1))) > F.size(marks)
    widths, densities = F.exists(marks, lambda d: F.endswith(d, F.lit("w"))), F.exists(marks, lambda d: F.endswith(d, F.lit("x")))
    return shape & distinct(marks) & ~(widths & (densities | bare)) & ~F.exists(marks, lambda d: F.startswith(d, F.lit("0.0")) & F.rlike(d, F.lit("^0\\.0[wx]$"))) & ~(bare & F.array_contains(marks, "1.0x"))


def security_policy(value: Column) -> Column:
    from pagelens.operators.policies import policy_is_clean

    return policy_is_clean(value)


CHECKS = {
    "custom-element-name": custom_element_name, "autocomplete-any": autocomplete, "keylabellist": key_labels, "language": language, "rel-value": relations, "sandbox-allow-list": sandbox, "script-type": script_type,
    "microdata-property": microdata_property, "time-datetime": time_datetime, "week": week, "iri-ref": iri_reference, "iri-ref-http-or-https": http_reference, "refresh": refresh, "rectangle": rectangle,
    "image-candidate-strings": candidates, "content-security-policy": security_policy,
}
NAMES = sorted([*PATTERNS, *CHECKS])


def is_valid(value: Column, datatype: str) -> Column:
    """Whether the value is of the datatype (without the w: prefix)."""
    return CHECKS[datatype](value) if datatype in CHECKS else matches(value, PATTERNS[datatype])
