"""robots.txt files against a parser that reads them line by line; encodings byte by byte; all that semantic rules find on whole pages."""

import random
import re

from pagelens import catalog
from pagelens.operators import forms, web
from pagelens.sources import files


def plain(text):
    """(agent, allows, disallows, delay) in order, and the sitemaps."""
    groups, maps, agents, allows, disallows, delay = [], [], [], [], [], None

    def close():
        nonlocal agents, allows, disallows, delay
        groups.extend((a, tuple(allows), tuple(disallows), delay) for a in agents)
        agents, allows, disallows, delay = [], [], [], None

    for line in re.split("\r\n|\n", text or ""):
        line = line.strip(" ")
        if line == "" or line.startswith("#"):
            if agents:
                close()
            continue
        if ":" not in line:
            continue
        key, value = (x.strip(" ") for x in line.split(":", 1))
        key = key.lower()
        if key == "user-agent":
            if allows or disallows or delay is not None:
                close()
            if value:
                agents.append(value)
        elif key == "allow" and value:
            allows.append(value)
        elif key == "disallow":
            disallows.append(value)
        elif key == "sitemap" and value:
            maps.append(value)
        elif key == "crawl-delay":
            delay = int(value) if re.fullmatch(r"\+?[0-9]+", value) and int(value) < 2**32 else None
    close()
    return groups, maps


def test_robots(spark):
    r = random.Random(8)
    lines = ["User-agent: a", "user-AGENT:b", "User-agent: *", "User-agent:", "Disallow: /x", "Disallow:", "Allow: /y", "Allow:", "Crawl-delay: 3", "Crawl-delay: x", "crawl-delay:99999999999", "# c", "", "  ", "nonsense", "Sitemap: s:1", "sitemap:", " Disallow : /z ", "other: q"]
    texts = ["\n".join(r.choice(lines) for _ in range(r.randint(0, 14))) for _ in range(600)] + [None, "User-agent: a\r\nDisallow: /\r\n\r\nDisallow: /b"]
    sites = spark.createDataFrame(list(enumerate(texts)), "site long, text string")
    found, maps = {}, {}
    for g in sorted(web.robots_groups(sites).collect(), key=lambda g: g.number):
        found.setdefault(g.site, []).append((g.user_agent, tuple(g.allows), tuple(g.disallows), g.crawl_delay))
    for m in sorted(web.robots_sitemaps(sites).collect(), key=lambda m: m["at"]):
        maps.setdefault(m.site, []).append(m.sitemap)
    assert [(k, t) for k, t in enumerate(texts) if (found.get(k, []), maps.get(k, [])) != plain(t)] == []


def test_every_byte_of_windows_1252(spark):
    head = b"<meta charset=windows-1252>"
    rows = [(str(b), bytearray(head + bytes([b]))) for b in range(256)]
    found = {r.path: r.html for r in files.decoded(spark.createDataFrame(rows, "path string, content binary")).collect()}
    undefined = {0x81, 0x8D, 0x8F, 0x90, 0x9D}
    assert {b: found[str(b)][len(head) :] for b in range(256)} == {b: bytes([b]).decode("latin-1" if b in undefined else "cp1252") for b in range(256)}


def test_visible_text_length(spark):
    pages = [(1, "<head><title>no</title></head><p> ä  b\n</p><p hidden>x</p><script>y</script><p>c"), (2, "<p> </p>"), (3, None)]
    found = catalog.perception.visible_text_length(catalog.html_nodes(spark.createDataFrame(pages, "page_id long, html string"))).collect()
    assert {r.page_id: r.chars for r in found} == {1: len("ä b".encode()) + 1, 2: 0}


def test_imports_of_any_depth(spark):
    """Thirty sheets, each importing the next, and the last one the first."""
    css = [(f"s{k}.css", f"@import url(s{(k + 1) % 30}.css); p{{}}") for k in range(30)]
    found = files.expanded(spark.createDataFrame([(1, 0, css[0][1]), (2, 0, "p{}")], "page_id long, place int, css string"), spark.createDataFrame(css, "href string, css string"))
    assert {r.page_id: r["count"] for r in found.groupBy("page_id").count().collect()} == {1: 31, 2: 1}


def test_autofill(spark):
    good = ["", " ", "on", "OFF", "email", "Work  email", "section-a billing home tel", "section- name", "shipping street-address", "current-password webauthn", " cc-exp-month "]
    bad = ["webauthn", "work name", "foo email", "email email", "billing shipping name", "home", "section-a", "on off", "name webauthn x", "tel home"]
    df = spark.createDataFrame([(v, v in good) for v in good + bad], "v string, want boolean")
    assert [r.v for r in df.filter(forms.autofill_is_valid(df.v) != df.want).collect()] == []
