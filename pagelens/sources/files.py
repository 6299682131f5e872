"""Pages from files, in whatever encoding they say; their stylesheets; node tables from columns of arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.plans.store import stored

# Names of encodings that pages use, and Java's names for them.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "iso-8859-1": "windows-1252", "latin1": "windows-1252", "us-ascii": "windows-1252", "ascii": "windows-1252", "windows-1252": "windows-1252", "utf-16": "UTF-8", "utf-16le": "UTF-8", "utf-16be": "UTF-8"}
PRESCAN = 1024


def page_files(spark: SparkSession, path: str) -> DataFrame:
    """path, html, encoding, unread (why a file wasn't read, or null) of HTML files below a folder, sorted by path when shown."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.rlike(F.lower("path"), F.lit(r"\.(html?|xhtml)$")))
    return decoded(files.select("path", "content"))


#: Windows-1252 differs from ISO-8859-1 in these: the characters of the latter, and what they are in the former; five bytes are control characters in both.
_C1 = [b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)]
WINDOWS = "".join(map(chr, _C1)), bytes(_C1).decode("cp1252")


def sniffed(content: Column) -> Column:
    """The encoding of a page's bytes: by its byte order mark, else what a meta element in the first 1024 bytes names outside comments, else UTF-8."""
    head = F.decode(F.substring(content, 1, PRESCAN), "ISO-8859-1")
    bare = F.lower(F.regexp_replace(head, r"(?s)<!--.*?(-->|$)", ""))
    named = F.coalesce(F.nullif(F.regexp_extract(bare, r"<meta[^>]*?\scharset\s*=\s*[\"']?\s*([^\s\"'/>;]+)", 1), F.lit("")), F.nullif(F.regexp_extract(bare, r"<meta[^>]*?content\s*=\s*[\"'][^\"'>]*charset\s*=\s*([^\s\"'/>;]+)", 1), F.lit("")))
    known = F.create_map(*(F.lit(x) for pair in CHARSETS.items() for x in pair))
    starts = F.hex(F.substring(content, 1, 3))
    return F.when(starts == "EFBBBF", "UTF-8").when(F.left(starts, F.lit(4)) == "FEFF", "UTF-16BE").when(F.left(starts, F.lit(4)) == "FFFE", "UTF-16LE").otherwise(F.coalesce(known[named], F.lit("UTF-8")))


def decoded(files: DataFrame) -> DataFrame:
    """path, html, encoding, unread of files (path, content). Bytes that aren't of the encoding make a file unread instead of changed."""
    rows = files.withColumn("encoding", sniffed(F.col("content")))
    text = F.lit(None).cast("string")
    for name in ("UTF-8", "windows-1252", "UTF-16BE", "UTF-16LE"):
        plain = F.try_validate_utf8("content") if name == "UTF-8" else F.decode("content", name) if name.startswith("UTF") else F.translate(F.decode("content", "ISO-8859-1"), *WINDOWS)
        text = F.when(F.col("encoding") == name, plain).otherwise(text)
    rows = rows.withColumn("html", F.regexp_replace(text, "^\\x{FEFF}", ""))
    return rows.select("path", "html", "encoding", F.when(F.col("html").isNull(), F.concat(F.lit("not valid "), "encoding", F.lit("; the file was not checked"))).alias("unread"))


def stylesheets(nodes: DataFrame) -> DataFrame:
    """page_id, pre, href, css, media of each page's sheets in order: style elements with their text, and links to sheets that aren't disabled or alternate."""
    attrs = F.col("attrs")
    rel = F.split(F.lower(F.coalesce(attrs["rel"], F.lit(""))), r"\s+")
    links = nodes.filter((F.col("tag") == "link") & F.array_contains(rel, "stylesheet") & ~F.array_contains(rel, "alternate") & attrs["disabled"].isNull() & attrs["href"].isNotNull())
    links = links.select("page_id", "pre", F.trim(attrs["href"]).alias("href"), F.lit(None).cast("string").alias("css"), attrs["media"].alias("media"))
    styles = nodes.filter((F.col("tag") == "style") & (attrs["type"].isNull() | F.lower(attrs["type"]).isin("", "text/css"))).select("page_id", "pre", attrs["media"].alias("media"))
    texts = nodes.filter("kind = 'text'").select("page_id", F.col("parent_id").alias("pre"), F.col("text").alias("css"))
    return links.unionByName(styles.join(texts, ["page_id", "pre"], "left").select("page_id", "pre", F.lit(None).cast("string").alias("href"), F.coalesce("css", F.lit("")).alias("css"), "media"))


def bound(sheets: DataFrame, files: DataFrame) -> DataFrame:
    """sheets with css from files (href, css) where they are links; missing where there is no such file."""
    return sheets.join(files.select("href", F.col("css").alias("_css")), "href", "left").withColumn("missing", F.col("href").isNotNull() & F.col("_css").isNull()).withColumn("css", F.coalesce("css", "_css")).drop("_css")


def imports(css: Column) -> Column:
    """array(href, media, layer) of the @import rules that begin a sheet."""
    head = F.regexp_extract(F.regexp_replace(css, r"(?s)/\*.*?\*/", ""), r"(?is)^(\s*(?:@charset[^;]*;\s*)?(?:@(?:import|layer)[^;{]*;\s*)*)", 1)
    each = F.regexp_extract_all(head, F.lit(r"(?is)@import\s+([^;]*);"), F.lit(1))
    return F.transform(each, lambda x: F.struct(F.regexp_extract(x, r"(?i)^(?:url\(\s*)?[\"']?([^\"')\s]+)", 1).alias("href"), F.trim(F.regexp_replace(x, r"(?i)^(?:url\([^)]*\)|\"[^\"]*\"|'[^']*')\s*(?:layer(?:\([^)]*\))?)?", "")).alias("media"), F.regexp_extract(x, r"(?i)\slayer\(([^)]*)\)", 1).alias("layer")))


def expanded(sheets: DataFrame, files: DataFrame) -> DataFrame:
    """sheets (page_id, place, css) with the sheets they import before them: level by level, each joined with what the files (href, css) import, until none is new. A sheet within itself isn't read again, so there are as many levels at most as files.

    A file is read for its imports once, not for each page; levels carry its number in place of its text.
    """
    numbered = stored(files.select("href", "css", F.monotonically_increasing_id().alias("file")))
    told = lambda df, *keys: df.select(*keys, F.posexplode(imports(F.col("css"))).alias("k", "i")).select(*keys, F.col("k").cast("int").alias("k"), "i.href", "i.media").join(numbered.select("href", F.col("file").alias("target")), "href")
    edges = stored(told(numbered, "file"))
    level = stored(told(sheets, "page_id", "place").select("page_id", F.array("place", "k").alias("path"), F.array("href").alias("chain"), F.col("target").alias("file"), "media"))
    found = level
    while not level.isEmpty():
        asked = level.drop("media").join(edges, "file").filter(~F.array_contains("chain", F.col("href")))
        level = stored(asked.select("page_id", F.concat("path", F.array("k")).alias("path"), F.concat("chain", F.array("href")).alias("chain"), F.col("target").alias("file"), "media"))
        found = found.unionByName(level)
    own = sheets.select("page_id", F.array("place").alias("path"), F.array().cast("array<string>").alias("chain"), "css", F.lit("").alias("media"))
    return own.unionByName(found.hint("merge").join(numbered.select("file", "css"), "file").select(own.columns))


def from_arena(arenas: DataFrame) -> DataFrame:
    """A node table from columns of arrays (page_id; tag, parent, attr_start, attr_name, attr_value numbers; tag_dict, attr_dict joined by U+0001; values array): element rows with parents, tags and attributes."""
    tags, names = F.split("tag_dict", "\u0001"), F.split("attr_dict", "\u0001")
    rows = arenas.select("page_id", tags.alias("_tags"), names.alias("_names"), "attr_start", "attr_name", "attr_value", F.posexplode(F.arrays_zip("tag", "parent")).alias("node_id", "n"))
    begin, end = F.get("attr_start", F.col("node_id")), F.get("attr_start", F.col("node_id") + 1)
    own = F.map_from_arrays(F.transform(F.slice("attr_name", begin + 1, end - begin), lambda k: F.get(F.col("_names"), k)), F.slice("attr_value", begin + 1, end - begin))
    return rows.select("page_id", "node_id", F.col("n.parent").alias("parent_id"), F.get(F.col("_tags"), F.col("n.tag")).alias("tag"), own.alias("attrs"))


def with_rendering(nodes: DataFrame, rendering: DataFrame) -> DataFrame:
    """nodes with what a browser measured (page_id, node_id, x, y, w, h, display, visibility, …); what wasn't measured is null, not false."""
    return nodes.join(rendering, ["page_id", "node_id"], "left")
