from __future__ import annotations

import random
import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import duckdb
from pyspark.sql import functions as F

from ruzi.llm import url_filters as uf
from ruzi.llm.components import components

SCHEMA = "page_id long, url string, html string"


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(300)]
    edges += [(i, i + 1) for i in range(1000, 1064)] + [(5000, i) for i in range(4000, 4100)] + [(7, 7)] * 3
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges + [(None, 3)], "u long, v long")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: find(x) for x in list(root)}
    assert components(df.where("false")).count() == 0


def test_rules_and_parts(spark):
    rows = [
        (1, "http://A.example.NET/en/1?x", None),
        (2, "http://example.net/fr/", ""),
        (3, "http://example.net", None),
        (4, "https://x.example.com/de/a#b://c/d", None),
        (5, "no scheme", None),
        (6, None, None),
        (7, "http://notexample.com/de/", None),
        (8, "http://w.org/fr/1", None),
        (9, "http://É.COM?q=/x", None),
        (None, "a\nb://h\nh/p\np#", None),
    ]
    got = {r.page_id: tuple(r)[1:] for r in uf.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        1: ("a.example.net", "/en/1", "example.net/en/", "allow"),
        2: ("example.net", "/fr/", "net/", "block"),
        3: ("example.net", "", None, "allow"),
        4: ("x.example.com", "/de/a", "example.com/de/", "block"),
        5: ("", "", None, "allow"),
        6: ("", "", None, "allow"),
        7: ("notexample.com", "/de/", None, "allow"),
        8: ("w.org", "/fr/1", "org/fr/", "allow"),
        9: ("É.com", "", None, "allow"),
        None: ("h\nh", "/p\np", None, "allow"),
    }


def test_aliases_take_block_verdicts(spark):
    link = '<html><link href="{}" rel=canonical></html>'
    rows = [
        (1, "http://a.io/1", link.format("http://bad.net/x")),
        (2, "http://b.io/1#top", link.format("//a.io/1")),
        (3, "http://b.io/2", '<meta http-equiv="Refresh" content="0; url=/1">'),
        (4, "http://w.org/fr/1", link.format("http://bad.net/x")),
        (5, "http://c.io/1", link.format("http://c.io/1")),
        (6, "http://d.io/1", None),
    ]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r.verdict for r in uf.judge(pages).collect()}
    # The rule on page 4 allows it, and so its aliases too.
    assert got == dict.fromkeys(range(1, 7), "allow") | {}
    got = {r.page_id: r.verdict for r in uf.judge(pages.where("page_id != 4")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 5: "allow", 6: "allow"}
    more = spark.createDataFrame([("http://d.io/1", "http://bad.net/")], "source string, target string")
    got = {r.page_id: r.verdict for r in uf.judge(pages.where("page_id = 6"), redirects=more).collect()}
    assert got == {6: "block"}


def test_empty_and_clashing(spark):
    pages = spark.createDataFrame([], SCHEMA + ", host string, source string, target string, node string, fit string")
    assert uf.judge(pages).count() == 0


def test_links_behind_long_attributes(spark):
    long = "q" * 5000
    rows = [
        (1, "http://a.io/1", f'<link title="{long}" href="http://bad.net/x" rel="canonical">'),
        (2, "http://b.io/1", f'<meta name="{long}" content="0; url=http://bad.net/x" http-equiv="refresh">'),
        (3, "http://c.io/1", f'<link title="{long}">'),
    ]
    got = {r.page_id: r.verdict for r in uf.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


class Parsed(HTMLParser):
    """The links of a page by a parser of the whole language."""

    def __init__(self, url, html):
        super().__init__()
        self.url, self.base, self.found = url, None, []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        first = {}
        for name, value in attrs:
            first.setdefault(name, value or "")
        if tag == "base" and self.base is None and "href" in first:
            to = urljoin(self.url, first["href"].strip())
            self.base = to if urlsplit(to).netloc else self.url
        if tag == "link" and "canonical" in first.get("rel", "").lower().split():
            self.found.append(first.get("href", ""))
        if tag == "meta" and first.get("http-equiv", "").strip().lower() == "refresh":
            if m := re.match(r"\s*[\d.]*\s*[;,\s]\s*(?:url\s*=\s*)?(?:\"([^\"]*)|'([^']*)|(.*))", first.get("content", ""), re.I | re.S):
                self.found.append(m[1] or m[2] or m[3] or "")

    handle_startendtag = handle_starttag


def keys_by_parser(url, html):
    page, out = Parsed(url, html), set()
    for to in page.found:
        to = to.strip()
        if to and not to.startswith("#"):
            parts = urlsplit(urljoin(page.base or url, to))
            if parts.netloc:
                out.add(parts.netloc.lower() + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))
    return out


TARGETS = ["http://bad.net/x", "//a.io/1", "/top", "d", "../up/e", "./f/../g?x=1&amp;y=2", "?v=1", "#part", "", "mailto:a@b.cd", "HTTP://W.org/fr/#z", "/a/./b/..", " /padded "]
OTHERS = [
    "<p>text</p>", "<!-- <link rel=canonical href=/hidden> -->", "<script>'<link rel=canonical href=/js>'</script>", "<a title='a > b' href=x>",
    '<meta name="x" content="<link rel=canonical href=/quoted>">', "<link rel=stylesheet href=/s.css>", "<LINKS rel=canonical href=/no>", "it's", "<br/>", "< link rel=canonical href=/no2>",
]


def random_page(rng):
    out = []
    for _ in range(rng.randint(0, 6)):
        quote, to = rng.choice(['"', "'"]), rng.choice(TARGETS)
        rel = rng.choice(["canonical", "CANONICAL", "alternate canonical", "canonical\tnofollow", "canonicalx", "alternate"])
        rel_part, href = f"rel={quote}{rel}{quote}", f"href={quote}{to}{quote}"
        out.append(rng.choice([
            f"<link {rel_part} {href}>", f"<LINK\n{href} data-a='x>y' {rel_part} />", f"<link title={quote}rel=canonical href=/t{quote} {href}>",
            f"<link disabled {rel_part} {href} href=/second>", f"<meta http-equiv=refresh content={quote}0; URL={to}{quote}>",
            f"<meta content='5;url=\"{to}\"' http-equiv=' Refresh '>", f"<meta http-equiv=refresh content='{rng.choice(['3', '0,', '1.5 '])}{to}'>",
            rng.choice(OTHERS), f"<base {href}>" if rng.random() < 0.3 else "<base target=_top>",
        ]))
    return "".join(out)


def test_links_equal_a_parsers(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice(["http://h.io/p/q/r{}.html?z#f", "https://H{}.io", "http://h.io/{}/"]).format(i), random_page(rng)) for i in range(1500)]
    pages = spark.createDataFrame(rows, SCHEMA)
    found = uf.links(pages).select("source", uf.key_of(F.col("target")).alias("key"))
    got = {}
    for r in found.collect():
        got.setdefault(r.source, set()).add(r.key)
    for _, url, html in rows:
        assert got.get(url, set()) == keys_by_parser(url, html), html


def test_verdicts_equal_sql_on_random_pages(spark, tmp_path):
    rng = random.Random(13)
    sites = ["h.io", "bad.net", "a.example.com", "w.org"]
    rows = [(i, f"http://{rng.choice(sites)}{rng.choice(['', '/', '/de/x', '/fr/../y', '/p/q?v=1', '/p/./q'])}", random_page(rng)) for i in range(120)]
    rows += [(900, "http://long.io/", f'<link title="{"q" * 70_000}" href="http://worse.net/x" rel="canonical">'), (901, None, None), (902, "x", "<link rel=canonical href=y>")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = sorted(con.execute(uf.SQL).fetchall())
    got = sorted(tuple(r) for r in uf.judge(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect())
    assert got == want
    assert [r[4] for r in got if r[0] == 900] == ["block"]
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_tags_of_many_attributes(spark):
    many = " ".join(f'a{i}="v{i}"' for i in range(30_000))
    rows = [(1, "http://a.io/1", f'<link {many} href="http://bad.net/x" rel="canonical">'), (2, "http://b.io/1", "<link " + "x" * 500_000), (3, "http://c.io/1", "<a>" * 100_000)]
    got = {r.page_id: r.verdict for r in uf.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow"}
