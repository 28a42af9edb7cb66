"""URL filters with redirect equivalence.

A url is decided by the longest rule that fits its host and path.  Urls that no
rule fits take the verdict of their aliases: pages, redirects and canonical links
form a graph, its components are found with distributed rounds, and a component
with a blocked member blocks its undecided members unless one of its members is
allowed by a rule.  A rule on the url itself always wins.

DataFrame functions only.  Scale: html is read once for the few links in it; what
is shuffled are the edges and, where there are any, the urls.  Rules are a list
given by the caller, compiled into one expression, so keep it to a few thousand.

Defined results: a null url, or one without ``://``, has an empty host and path
and no rule, no aliases, and is allowed; a null html has no links, a link's target
that isn't a page's address is none; repeated pages are judged each; dot segments
matter to a page's own rule and not to its aliases; ties between rules of equal length go to allow; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruzi.llm.components import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
ROOT = r"^([^?#]*?://[^/?#]*)"


class Rule(NamedTuple):
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, ADDRESS, 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """A struct of text and verdict of the longest fitting rule, or null."""
    found = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.verdict != "allow", r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        value = F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<text:string,verdict:string>")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """What ``body`` makes of a value that it uses several times and that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; an empty one is ``/``."""
    none = F.expr("CAST(array() AS array<string>)")

    def step(kept: Column, part: Column) -> Column:
        up = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    def walked(path: Column) -> Column:
        closed = F.when(path.rlike(r"/\.\.?$"), F.concat(path, F.lit("/"))).otherwise(path)
        return F.array_join(F.aggregate(F.split(closed, "/", -1), none, step), "/")

    return bound(path, lambda p: F.when(p == "", F.lit("/")).when(p.rlike(r"/\.\.?(/|$)"), walked(p)).otherwise(p))


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^#]*?(\?[^#]*)", 1)


def key_of(url: Column) -> Column:
    """What makes two urls one node: host, path without dot segments and query; neither scheme nor fragment."""
    return bound(url, lambda u: F.concat(host_of(u), without_dots(path_of(u)), query_of(u)))


def tidy(url: Column) -> Column:
    """A url without dot segments and fragment."""
    return bound(url, lambda u: F.concat(F.regexp_extract(u, ROOT, 1), without_dots(path_of(u)), query_of(u)))


def either_case(word: str) -> str:
    """A pattern for an ASCII word in either case, the same in any dialect of patterns."""
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


#: White space of HTML, and what comes between tags that looks like one: comments and the text of elements that hold no tags.
GAP = r"[\x20\x09-\x0D]"
RAW = tuple(rf"<{either_case(name)}\b(?s:.*?)(?:</{either_case(name)}\b|\z)" for name in ("script", "style", "textarea", "title"))
#: One tag with quoted attributes whole.  The possessive form takes constant stack for tags of any length.
TAG = r"""<[a-zA-Z][^\x20\x09-\x0D/>]*+(?:[^'">]++|"[^"]*+"|'[^']*+')*+>"""
MARKUP = "|".join((r"<!--(?s:.*?)(?:-->|\z)", *RAW, TAG))
#: A name and, with it or without, a value.
ATTRIBUTE = rf"""([^\x20\x09-\x0D"'<>/=]+)(?:{GAP}*={GAP}*("[^"]*"|'[^']*'|[^\x20\x09-\x0D"'>][^\x20\x09-\x0D>]*))?"""
OUR_TAG = rf"^<(?:{either_case('link')}|{either_case('meta')}|{either_case('base')})(?:[\x20\x09-\x0D/]|$)"
#: Where a refresh goes: seconds, a separator, perhaps ``url=``, perhaps a quote.
REFRESH = rf"""^{GAP}*[0-9]*(?:\.[0-9.]*)?{GAP}*[;,\x20\x09-\x0D]{GAP}*(?:{either_case('url')}{GAP}*={GAP}*)?(?:"([^"]*)|'([^']*)|((?:[^"'](?s:.*))?))"""
AMPERSAND = rf"&(?:{either_case('amp')}|#38|#{either_case('x')}26);"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def tags_of(html: Column) -> Column:
    """The link, meta and base tags outside comments, scripts and the like, in their order."""
    every = F.regexp_extract_all(html, F.lit(MARKUP), F.lit(0))
    return F.filter(every, lambda tag: tag.rlike(OUR_TAG))


def attributes(tag: Column, names: tuple[str, ...]) -> Column:
    """A struct with the tag's kind and the values of its first attributes of those names, without quotes; null where there is none."""

    def value(pairs: Column, name: str) -> Column:
        first = F.get(F.filter(pairs, lambda pair: F.translate(pair["name"], UPPER, LOWER) == name), F.lit(0))["value"]
        bare = bound(first, lambda v: F.when(v.rlike(r"^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v))
        return F.regexp_replace(bare, AMPERSAND, "&")

    inner = F.regexp_replace(tag, r"^<[a-zA-Z]+", "")
    pairs = F.arrays_zip(*[F.regexp_extract_all(inner, F.lit(ATTRIBUTE), F.lit(i)).alias(name) for i, name in ((1, "name"), (2, "value"))])
    kind = F.translate(F.regexp_extract(tag, r"^<([a-zA-Z]+)", 1), UPPER, LOWER)
    return bound(pairs, lambda p: F.struct(kind.alias("kind"), *[value(p, name).alias(name.replace("-", "_")) for name in names]))


def cleaned(text: Column) -> Column:
    """An address without white space around it and line breaks or tabs in it."""
    return F.regexp_replace(F.regexp_replace(text, rf"^{GAP}+|{GAP}+$", ""), r"[\n\r\t]", "")


def resolved(target: Column, base: Column) -> Column:
    """A target against a base url; null for what isn't a page's address."""

    def against(v: Column) -> Column:
        to, at = v["to"], v["at"]
        folder = F.regexp_extract(at, r"^([^?#]*?://[^/?#]*(?:[^?#]*/)?)", 1)
        found = F.when(to.rlike(SCHEME), F.when(to.rlike(SCHEME + "//"), to)).when(to.startswith("//"), F.concat(F.lit("http:"), to))
        found = found.when(to.startswith("/"), F.concat(F.regexp_extract(at, ROOT, 1), to))
        found = found.when(to.startswith("?"), F.concat(F.regexp_extract(at, r"^([^?#]*)", 1), to))
        return found.otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), to))

    return bound(F.struct(target.alias("to"), base.alias("at")), against)


def links(pages: DataFrame) -> DataFrame:
    """source and target of all canonical links and refresh redirects in html.

    Targets are resolved against the address of the page's first ``base``, or its own url where that is none.
    Comments, scripts, styles, titles and text areas hold no tags; ``rel`` is a list of words in
    any case; of the entities only the ampersand's are read.
    """
    rows = pages.where(F.col("url").contains("://")).select(F.col("url").alias("source"), tags_of(F.col("html")).alias("tags"))
    rows = rows.where(F.size("tags") > 0)
    rows = rows.select("source", F.transform("tags", lambda t: attributes(t, ("rel", "href", "http-equiv", "content"))).alias("tags"))

    def is_canonical(tag: Column) -> Column:
        words = F.split(F.translate(tag["rel"], UPPER, LOWER), rf"{GAP}+", -1)
        return (tag["kind"] == "link") & F.coalesce(F.array_contains(words, "canonical"), F.lit(False))

    def is_refresh(tag: Column) -> Column:
        return (tag["kind"] == "meta") & (F.translate(cleaned(tag["http_equiv"]), UPPER, LOWER) == "refresh")

    moved = lambda c: F.concat(*[F.coalesce(F.regexp_extract(c, REFRESH, i), F.lit("")) for i in (1, 2, 3)])
    bases = F.filter("tags", lambda t: (t["kind"] == "base") & t["href"].isNotNull())
    found = rows.select("source", cleaned(F.get(bases, F.lit(0))["href"]).alias("base"), F.explode(F.concat(
        F.transform(F.filter("tags", is_canonical), lambda t: t["href"]), F.transform(F.filter("tags", is_refresh), lambda t: moved(t["content"])),
    )).alias("to"))
    found = found.select("source", "base", cleaned(F.col("to")).alias("to")).where((F.col("to") != "") & ~F.col("to").startswith("#"))
    found = found.withColumn("named", F.when(F.col("base") != "", resolved(F.col("base"), tidy(F.col("source")))))
    found = found.withColumn("base", tidy(F.coalesce("named", "source")))
    return found.select("source", resolved(F.col("to"), F.col("base")).alias("target")).where(F.col("target").isNotNull())


def alias_verdicts(edges: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key of every undecided node of ``edges`` (source, target: urls) that its component blocks."""
    pairs = edges.select(key_of(F.col("source")).alias("u"), key_of(F.col("target")).alias("v"))
    nodes = components(pairs)
    url = F.concat(F.lit("x://"), "node")
    judged = nodes.select("node", "component", longest_rule(rules, host_of(url), path_of(url))["verdict"].alias("own"))
    groups = judged.groupBy("component").agg(
        F.max(F.coalesce(F.col("own") == "block", F.lit(False))).alias("blocked"),
        F.max(F.coalesce(F.col("own") == "allow", F.lit(False))).alias("allowed"),
    )
    refused = groups.where(F.col("blocked") & ~F.col("allowed")).select("component")
    return judged.where(F.col("own").isNull()).join(refused, "component", "left_semi").select(F.col("node").alias("alias_key"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict of each page.

    ``redirects`` adds edges (source, target) that a crawl log knows of.
    """
    edges = links(pages)
    if redirects is not None:
        edges = edges.union(redirects.select("source", "target"))
    aliases = alias_verdicts(edges, rules).withColumn("alias_blocked", F.lit(True))
    own = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.when(F.col("url").contains("://"), query_of(F.col("url"))).alias("query"),
    )
    own = own.select("page_id", "host", "path", F.concat("host", without_dots(F.col("path")), "query").alias("page_key"))
    own = own.withColumn("fit", longest_rule(rules, F.col("host"), F.col("path")))
    joined = own.join(aliases, F.col("page_key") == F.col("alias_key"), "left")
    verdict = F.coalesce("fit.verdict", F.when(F.col("alias_blocked"), "block"), F.lit("allow"))
    return joined.select("page_id", "host", "path", F.col("fit.text").alias("rule"), verdict.alias("verdict"))


def _sql() -> str:
    """The query's rows in DuckDB SQL: patterns without possessive parts, paths walked by a list's reduction, links by recursion."""
    quote = lambda pattern: "'" + pattern.replace("*+", "*").replace("++", "+").replace("'", "''") + "'"
    lower = lambda text: f"translate({text}, '{UPPER}', '{LOWER}')"
    host = lambda url: f"coalesce({lower(f'regexp_extract({url}, {quote(ADDRESS)}, 1)')}, '')"
    path = lambda url: f"coalesce(regexp_extract({url}, {quote(ADDRESS)}, 2), '')"
    query = lambda url: f"regexp_extract({url}, '^[^#]*?(\\?[^#]*)', 1)"
    edge = lambda text: f"regexp_replace(regexp_replace({text}, '^{GAP}+|{GAP}+$', '', 'g'), '[\\n\\r\\t]', '', 'g')"

    def value(name: str) -> str:
        found = f"vals[list_position(names, '{name}')]"
        bare = f"CASE WHEN regexp_matches({found}, '^[\"'']') THEN {found}[2:-2] ELSE {found} END"
        return f"regexp_replace({bare}, {quote(AMPERSAND)}, '&', 'g')"

    def dots(place: str) -> str:
        closed = f"CASE WHEN regexp_matches({place}, '/\\.\\.?$') THEN {place} || '/' ELSE {place} END"
        walk = (
            "lambda a, b: CASE WHEN b[1] = '..' THEN list_slice(a, 1, greatest(len(a) - 1, 1)) WHEN b[1] = '.' THEN a ELSE list_concat(a, b) END"
        )
        walked = f"array_to_string(list_reduce(list_transform(string_split({closed}, '/'), lambda x: [x]), {walk}), '/')"
        return f"CASE WHEN {place} = '' THEN '/' WHEN regexp_matches({place}, '/\\.\\.?(/|$)') THEN {walked} ELSE {place} END"

    def absolute(target: str, base: str) -> str:
        folder = f"regexp_extract({base}, '^([^?#]*?://[^/?#]*(?:[^?#]*/)?)', 1)"
        return (
            f"CASE WHEN regexp_matches({target}, '{SCHEME}') THEN CASE WHEN regexp_matches({target}, '{SCHEME}//') THEN {target} END "
            f"WHEN starts_with({target}, '//') THEN 'http:' || {target} "
            f"WHEN starts_with({target}, '/') THEN regexp_extract({base}, '{ROOT}', 1) || {target} "
            f"WHEN starts_with({target}, '?') THEN regexp_extract({base}, '^([^?#]*)', 1) || {target} "
            f"ELSE {folder} || CASE WHEN ends_with({folder}, '/') THEN '' ELSE '/' END || {target} END"
        )

    clean = lambda url: f"regexp_extract({url}, '{ROOT}', 1) || {dots(path(url))} || {query(url)}"
    key = lambda url: f"{host(url)} || {dots(path(url))} || {query(url)}"
    rules = ", ".join(f"('{rule.host}', '{rule.path}', '{rule.verdict}')" for rule in RULES)
    return f"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, {host("url")} AS host, {path("url")} AS path, CASE WHEN contains(url, '://') THEN {key("url")} END AS page_key
  FROM pages
), every AS (
  SELECT row_number() OVER () AS page, url, list_filter(regexp_extract_all(html, {quote(MARKUP)}), lambda t: regexp_matches(t, {quote(OUR_TAG)})) AS tags
  FROM p WHERE contains(url, '://')
), one AS (
  SELECT page, url, unnest(tags) AS tag, unnest(range(len(tags))) AS place FROM every
), attribute AS (
  SELECT page, url, place, {lower("regexp_extract(tag, '^<([a-zA-Z]+)', 1)")} AS kind,
         list_transform(regexp_extract_all(regexp_replace(tag, '^<[a-zA-Z]+', ''), {quote(ATTRIBUTE)}, 1), lambda n: {lower("n")}) AS names,
         regexp_extract_all(regexp_replace(tag, '^<[a-zA-Z]+', ''), {quote(ATTRIBUTE)}, 2) AS vals
  FROM one
), named AS (
  SELECT page, url, place, kind, {value("rel")} AS rel, {value("href")} AS href, {value("http-equiv")} AS equiv, {value("content")} AS content FROM attribute
), based AS (
  SELECT page, {edge("arg_min(href, place)")} AS href FROM named WHERE kind = 'base' AND href IS NOT NULL GROUP BY page
), pointed AS (
  SELECT page, url, href AS t FROM named WHERE kind = 'link' AND list_contains(regexp_split_to_array({lower("rel")}, '{GAP}+'), 'canonical')
  UNION ALL
  SELECT page, url, coalesce(regexp_extract(content, {quote(REFRESH)}, 1), '') || coalesce(regexp_extract(content, {quote(REFRESH)}, 2), '')
                    || coalesce(regexp_extract(content, {quote(REFRESH)}, 3), '') FROM named
  WHERE kind = 'meta' AND {lower(edge("equiv"))} = 'refresh'
), cleaned AS (
  SELECT url, {edge("t")} AS t, based.href, {clean("url")} AS own FROM pointed LEFT JOIN based USING (page)
), founded AS (
  SELECT url, t, coalesce(CASE WHEN href <> '' THEN {absolute("href", "own")} END, url) AS base FROM cleaned
), target AS (
  SELECT url, {absolute("t", f"({clean('base')})")} AS t FROM founded WHERE t <> '' AND NOT starts_with(t, '#')
), edge AS (
  SELECT {key("url")} AS u, {key("t")} AS v FROM target WHERE t IS NOT NULL
), both_ways AS (
  SELECT u, v FROM edge UNION SELECT v, u FROM edge UNION SELECT u, u FROM edge UNION SELECT v, v FROM edge
), reach AS (
  SELECT u AS a, v AS b FROM both_ways UNION SELECT r.a, e.v FROM reach r JOIN both_ways e ON r.b = e.u
), rules(r_host, r_path, r_verdict) AS (
  VALUES {rules}
), site AS (
  SELECT host, path, 'page' AS what, host || path AS k FROM p
  UNION SELECT regexp_extract(b, '^[^/?]*', 0), regexp_extract(b, '^[^/?]*([^?]*)', 1), 'node', b FROM reach
), fit AS (
  SELECT what, k, arg_max(r_host || r_path, length(r_host || r_path)) AS rule, arg_max(r_verdict, length(r_host || r_path)) AS verdict
  FROM site JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path) GROUP BY what, k
), alias AS (
  SELECT a, bool_or(coalesce(verdict = 'block', false)) AND NOT bool_or(coalesce(verdict = 'allow', false)) AS blocked
  FROM reach LEFT JOIN fit ON reach.b = fit.k AND fit.what = 'node' GROUP BY a
)
SELECT page_id, host, path, fit.rule, coalesce(fit.verdict, CASE WHEN alias.blocked THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN fit ON fit.what = 'page' AND fit.k = host || path LEFT JOIN alias ON alias.a = page_key
"""


#: DuckDB SQL for the query's rows.
SQL = _sql()
