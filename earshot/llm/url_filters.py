"""URL filters with redirect equivalence, in DataFrame and SQL functions alone.

1. Rules. A rule is a verdict, a host and the beginning of a path; it fits its host and all subdomains, and the longest
   rule that fits decides. Up to ``MOST_INLINE`` rules are one expression; more are joined by the suffixes of distinct
   hosts, so that a long list isn't broadcast unmeasured.
2. Edges. A page's canonical link, its refresh (http-equiv) and the rows of an optional table of redirects link two
   addresses. A node is an address without scheme and fragment, its dot segments resolved, an empty path as ``/``.
3. Components. Distributed connected components over the edges give each node its class of aliases. A class is blocked
   where a rule blocks one of its addresses (pages or not) and no rule allows one: an explicit allow takes precedence.
4. A page keeps the verdict of its own rule. Without one it is blocked where its address is in a blocked class, else
   allowed.

Only (page, address) pairs are shuffled, and only nodes that have an edge enter the components. Pages with a rule of their
own or without an address get keys of their own in the last join, so no key but an address is hot, and that side has one
row per address (AQE splits the other).

Edge cases: a url that is null or has no ``://`` has an empty host and path, no rule and no aliases, and is allowed; null
or empty html has no link; several links of one page all count, links with another scheme than an address
(``mailto:``, ``javascript:``) and empty ones don't, those in comments and scripts neither; relative links are resolved
against the page's address (a ``base`` element is not read); a tag ends at its first ``>``; rows that repeat a page_id or url are judged each on their
own and share their address's class; of rules of equal length ``allow`` wins, then the smaller text (only copies of one
rule can tie); an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, stage, table

#: Rules that are put into one expression.
MOST_INLINE = 200
#: Verdict, host and path of the registered query's rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
WITH_QUERY = r"(?s)^.*?://[^/?#]*([^#]*)"
ABSOLUTE, SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*://", "^[A-Za-z][A-Za-z0-9+.-]*:"
HREF = r"""(?i)\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
CONTENT = r"""(?i)\bcontent\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
CANONICAL = r"""(?i)\brel\s*=\s*("[^"]*\bcanonical\b[^"]*"|'[^']*\bcanonical\b[^']*'|canonical\b)"""
REFRESH = r"""(?i)\bhttp-equiv\s*=\s*["']?\s*refresh\b"""
REFRESH_TO = r"""(?i)\burl\s*=\s*["']?\s*([^"'\s]+)"""
UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
TAGS = r"(?i)<(?:link|meta)\b[^>]*>"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, ADDRESS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def _unquoted(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"""^["']|["']$""", ""), "(?i)&amp;", "&"))


def plain_path(path: Column) -> Column:
    """``path`` with dot segments resolved; an empty one is ``/``. Only paths that have such segments are taken apart."""
    parts = F.split(F.regexp_replace(path, "^/", ""), "/")
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(s == ".", acc).otherwise(F.concat(acc, F.array(s))),
    )
    last = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    dotted = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last, F.lit("/")).otherwise(F.lit("")))
    return F.when(path == "", F.lit("/")).when(path.rlike(r"(^|/)\.\.?(/|$)"), dotted).otherwise(path)


def node_of(url: Column) -> Column:
    """The address of a url without scheme and fragment; null without ``://`` or host."""
    host, rest = host_of(url), F.regexp_extract(url, WITH_QUERY, 1)
    return F.when(host != "", F.concat(host, plain_path(F.regexp_extract(rest, "^[^?]*", 0)), F.regexp_extract(rest, r"(?s)[?].*$", 0)))


def resolved(link: Column, url: Column) -> Column:
    """The absolute form of a link on the page ``url``; null where it isn't an address."""
    host, path = host_of(url), path_of(url)
    top = F.concat(F.lit("//"), host)
    folder = F.when(path == "", F.lit("/")).otherwise(F.regexp_extract(path, "(?s)^.*/", 0))
    absolute = (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike(ABSOLUTE), link)
        .when(link.rlike(SCHEME), None)
        .when(link.startswith("//"), link)
        .when(host == "", None)
        .when(link.startswith("/"), F.concat(top, link))
        .when(link.startswith("?"), F.concat(top, path, link))
        .otherwise(F.concat(top, folder, link))
    )
    return F.when(absolute.startswith("//"), F.concat(F.lit("x:"), absolute)).otherwise(absolute)


def links_of(pages: DataFrame) -> DataFrame:
    """(node, to): the canonical links and refreshes of pages, as addresses; only pages that name one are parsed."""
    some = pages.where(F.col("html").rlike("(?i)canonical|refresh")).select("url", F.regexp_replace("html", UNREAD, "").alias("html"))
    tags = some.select("url", F.explode(F.regexp_extract_all("html", F.lit(TAGS), F.lit(0))).alias("tag"))
    canonical = F.when(F.col("tag").rlike("(?i)^<link") & F.col("tag").rlike(CANONICAL), _unquoted(F.regexp_extract("tag", HREF, 1)))
    refresh = F.when(F.col("tag").rlike("(?i)^<meta") & F.col("tag").rlike(REFRESH), _unquoted(F.regexp_extract(F.regexp_extract("tag", CONTENT, 1), REFRESH_TO, 1)))
    found = tags.select("url", F.coalesce(canonical, refresh).alias("link")).where("link is not null")
    return found.select(node_of(F.col("url")).alias("node"), node_of(resolved(F.col("link"), F.col("url"))).alias("to"))


def _fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | host.endswith(F.concat(F.lit("."), rule_host))) & path.startswith(rule_path)


def _ordered(rules: list[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    for verdict, host, _ in rules:
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {verdict} {host}")
    return sorted(set(rules), key=lambda r: (-len(r[1] + r[2]), r[0], r[1] + r[2]))


def with_rules(df: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``df`` (host, path, ...) with ``rule`` and ``ruled``, text and verdict of the longest rule that fits, or null."""
    rules = _ordered(rules)
    if len(rules) <= MOST_INLINE:
        best = F.lit(None).cast("struct<rule:string,ruled:string>")
        for verdict, host, path in reversed(rules):
            best = F.when(_fits(F.col("host"), F.col("path"), F.lit(host), F.lit(path)), F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("ruled"))).otherwise(best)
        return df.withColumn("_r", best).withColumn("rule", F.col("_r.rule")).withColumn("ruled", F.col("_r.ruled")).drop("_r")
    rows = df.sparkSession.createDataFrame([(h, p, v, i) for i, (v, h, p) in enumerate(rules)], "suffix string, start string, verdict string, rank int")
    names = F.split("host", "[.]")
    hosts = df.select("host").distinct().withColumn("suffix", F.explode(F.transform(F.sequence(F.lit(1), F.size(names)), lambda i: F.array_join(F.slice(names, i, F.size(names)), "."))))
    known = hosts.join(rows, "suffix").groupBy(F.col("host").alias("_h")).agg(F.sort_array(F.collect_list(F.struct("rank", "start", "verdict", "suffix"))).alias("_all"))
    first = F.get(F.filter("_all", lambda x: F.col("path").startswith(x.start)), F.lit(0))
    out = df.join(known, F.col("host") == F.col("_h"), "left").withColumn("_r", first)
    return out.withColumn("rule", F.concat(F.col("_r.suffix"), F.col("_r.start"))).withColumn("ruled", F.col("_r.verdict")).drop("_r", "_all", "_h")


def blocked_aliases(edges: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(node, n_aliases): addresses whose class of aliases holds a blocked one and none that is allowed."""
    ends = stage(edges.where("node is not null and to is not null and node <> to").distinct(), "edges")
    if ends.isEmpty():
        return ends.select("node", F.lit(1).cast("long").alias("n_aliases"))
    classes = components(ends, "node", "to")
    address = F.concat(F.lit("x://"), F.col("node"))
    judged = with_rules(classes.withColumn("host", host_of(address)).withColumn("path", path_of(address)), rules)
    of = judged.groupBy("component").agg(F.max((F.col("ruled") == "block").cast("int")).alias("block"), F.max((F.col("ruled") == "allow").cast("int")).alias("allow"), F.count("*").alias("n_aliases"))
    bad = of.where("block = 1 and coalesce(allow, 0) = 0").select("component", "n_aliases")
    return stage(judged.select("node", "component").join(bad, "component").select("node", "n_aliases"), "blocked")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, n_aliases) of every row of ``pages`` (page_id, url, html).

    ``redirects`` holds further edges as urls (source, target). ``n_aliases`` is the size of the class that blocked the page.
    """
    edges = links_of(pages)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("node"), node_of(F.col("target")).alias("to")))
    bad = blocked_aliases(edges, rules)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = with_rules(rows, rules)
    own = F.when(F.col("rule").isNull(), node_of(F.col("url")))
    rows = rows.withColumn("node", F.coalesce(own, F.concat(F.lit(" "), F.xxhash64("page_id", "url").cast("string")))).drop("url")
    out = rows.join(bad, "node", "left")
    verdict = F.coalesce("ruled", F.when(F.col("n_aliases").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "n_aliases")


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


def _case(rules: list[tuple[str, str, str]], column: int) -> str:
    when = " ".join(f"WHEN (host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}') THEN '{(r[1] + r[2], r[0])[column]}'" for r in _ordered(rules))
    return f"CASE {when} END"


_HOST = f"translate(regexp_extract({{0}}, '{ADDRESS}', 1), '{UPPER}', '{LOWER}')"
_PATH = f"regexp_extract({{0}}, '{ADDRESS}', 2)"


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _node_sql(url: str) -> str:
    """The SQL form of ``node_of`` for a column; segments are folded by ``list_reduce``."""
    rest = f"regexp_extract({url}, {_q(WITH_QUERY)}, 1)"
    path = f"regexp_extract({rest}, '^[^?]*')"
    parts = f"string_split(regexp_replace({path}, '^/', ''), '/')"
    kept = f"list_reduce({parts}, lambda acc, s: CASE WHEN s = '..' THEN list_slice(acc, 1, len(acc) - 1) WHEN s = '.' THEN acc ELSE list_append(acc, s) END, []::VARCHAR[])"
    last = f"CASE WHEN {parts}[-1] IN ('.', '..') AND len({kept}) > 0 THEN '/' ELSE '' END"
    host = _HOST.format(url)
    plain = f"CASE WHEN {path} = '' THEN '/' WHEN regexp_matches({path}, '(^|/)[.][.]?(/|$)') THEN '/' || array_to_string({kept}, '/') || {last} ELSE {path} END"
    return f"CASE WHEN coalesce({host}, '') <> '' THEN {host} || {plain} || regexp_extract({rest}, '(?s)[?].*$') END"


ORACLE = f"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, {_q(UNREAD)}, '', 'g'), {_q(TAGS)})) AS tag FROM pages
), raw AS (
  SELECT url, CASE WHEN regexp_matches(tag, '(?i)^<link') AND regexp_matches(tag, {_q(CANONICAL)}) THEN regexp_extract(tag, {_q(HREF)}, 1)
    WHEN regexp_matches(tag, '(?i)^<meta') AND regexp_matches(tag, {_q(REFRESH)}) THEN regexp_extract(regexp_extract(tag, {_q(CONTENT)}, 1), {_q(REFRESH_TO)}, 1) END AS link FROM tags
), links AS (
  SELECT url, trim(regexp_replace(regexp_replace(link, {_q('''^["']|["']$''')}, '', 'g'), '(?i)&amp;', '&', 'g')) AS link,
    {_HOST.format('url')} AS host, {_PATH.format('url')} AS path FROM raw WHERE link IS NOT NULL
), full_links AS (
  SELECT url, CASE WHEN link = '' OR starts_with(link, '#') THEN NULL WHEN regexp_matches(link, '{ABSOLUTE}') THEN link
    WHEN regexp_matches(link, '{SCHEME}') THEN NULL WHEN starts_with(link, '//') THEN 'x:' || link WHEN host = '' THEN NULL
    WHEN starts_with(link, '/') THEN 'x://' || host || link WHEN starts_with(link, '?') THEN 'x://' || host || path || link
    ELSE 'x://' || host || CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '(?s)^.*/') END || link END AS target FROM links
), edges AS (
  SELECT {_node_sql('url')} AS u, {_node_sql('target')} AS v FROM full_links
), both_ways AS (
  SELECT u, v FROM edges WHERE u IS NOT NULL AND v IS NOT NULL AND u <> v UNION SELECT v, u FROM edges WHERE u IS NOT NULL AND v IS NOT NULL AND u <> v
), reach(node, other) AS (
  SELECT u, u FROM both_ways UNION SELECT r.node, e.v FROM reach r JOIN both_ways e ON e.u = r.other
), parts AS (
  SELECT node, {_HOST.format("'x://' || other")} AS host, {_PATH.format("'x://' || other")} AS path FROM reach
), blocked AS (
  SELECT node, count(*) AS n_aliases FROM (SELECT node, {_case(RULES, 1)} AS ruled FROM parts) GROUP BY node
  HAVING count(*) FILTER (WHERE ruled = 'block') > 0 AND count(*) FILTER (WHERE ruled = 'allow') = 0
), judged AS (
  SELECT page_id, coalesce({_HOST.format('url')}, '') AS host, coalesce({_PATH.format('url')}, '') AS path, {_node_sql('url')} AS node FROM pages
), ruled AS (SELECT *, {_case(RULES, 0)} AS rule, {_case(RULES, 1)} AS own FROM judged)
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN b.node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN rule IS NULL THEN n_aliases END AS n_aliases
FROM ruled LEFT JOIN blocked b USING (node)
"""
