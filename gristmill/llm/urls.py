"""URL filters with redirect equivalence (native).

A rule list decides pages by host and path. Pages that redirect to one another, or name one another as
canonical, are aliases: connected components over those links pass a block on to every alias without a
rule of its own, unless some alias is explicitly allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm.common import cut, small, table
from gristmill.llm.components import components

#: (verdict, host and path) of the registered query.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]

LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), *LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, host, path, rule, verdict) of distinct urls; rule and verdict are null where none fits.

    rules: (verdict, rule), a rule being host and path. A rule fits its host and all subdomains if the
    path starts with the rule's; the longest rule wins, then allow over block. Every url asks for its
    host suffixes and for those prefixes of its path whose length some rule of that host has: an
    equi-join, however long the rule list; its table is broadcast only when counted small.
    """
    r = rules.select(
        F.translate(F.substring_index("rule", "/", 1), *LOWER).alias("r_host"),
        F.expr("CASE WHEN instr(rule, '/') > 0 THEN substr(rule, instr(rule, '/')) ELSE '' END").alias("r_path"),
        "rule", "verdict",
    )
    r = r.groupBy("r_host", "r_path").agg(F.min(F.struct("verdict", "rule")).alias("r")).select("r_host", "r_path", "r.rule", "r.verdict")
    lengths = r.groupBy("r_host").agg(F.sort_array(F.collect_set(F.length("r_path"))).alias("lengths")).withColumnRenamed("r_host", "h")
    u = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    labels = F.split("host", r"\.")
    asked = u.withColumn(
        "suffix",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))),
    )
    asked = asked.join(small(lengths), F.col("suffix") == F.col("h")).select(
        "url", "suffix", F.explode(F.expr("transform(filter(lengths, n -> n <= length(path)), n -> left(path, n))")).alias("prefix")
    )
    best = (
        asked.join(small(r), (F.col("suffix") == F.col("r_host")) & (F.col("prefix") == F.col("r_path")))
        .groupBy("url")
        .agg(F.min(F.struct((-F.length("rule")).alias("n"), "verdict", "rule")).alias("r"))
        .select(F.col("url").alias("best_url"), "r.rule", "r.verdict")
    )
    return u.join(best, F.col("url") == F.col("best_url"), "left").drop("best_url")


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*("([^"]*)"|'([^']*)'|[^\s"'>]+)""", 1)
    return F.trim(F.regexp_replace(value, """^["']|["']$""", ""))


def node_of(url: Column) -> Column:
    """A url without its fragment; null where nothing is left."""
    x = F.trim(F.substring_index(url, "#", 1))
    return F.when(F.length(x) > 0, x)


def alias_links(pages: DataFrame) -> DataFrame:
    """(a, b): each page's url and what its canonical link and its meta refresh name, resolved against it."""
    html = F.col("html")
    tags = F.when(
        html.rlike("(?i)canonical|http-equiv"),
        F.filter(
            F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)),
            lambda t: t.rlike(r"""(?i)\brel\s*=\s*["']?canonical\b|\bhttp-equiv\s*=\s*["']?refresh\b"""),
        ),
    )
    found = pages.select("url", F.explode(tags).alias("tag")).withColumn(
        "to",
        F.when(F.col("tag").rlike(r"(?i)\A<link"), _attribute(F.col("tag"), "href")).otherwise(
            F.trim(F.regexp_replace(F.regexp_extract(_attribute(F.col("tag"), "content"), r"(?is)\burl\s*=\s*(.+)", 1), """^["']|["']$""", ""))
        ),
    )
    scheme = F.regexp_extract("url", r"(?s)\A(.*?)://", 1)
    root = F.regexp_extract("url", r"(?s)\A(.*?://[^/?#]*)", 1)
    to = (
        F.when(F.col("to").contains("://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(root, F.col("to")))
        .when(F.length("to") > 0, F.concat(F.regexp_replace(F.substring_index("url", "?", 1), r"(?<=[^:/])/[^/]*\z", ""), F.lit("/"), F.col("to")))
    )
    return found.select(node_of(F.col("url")).alias("a"), node_of(to).alias("b")).where("a is not null and b is not null").distinct()


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Adds host, path, rule, verdict to pages (url, html, ...), in place of columns of these names.

    The longest rule decides a page that one fits. Any other page takes its component's decision: allow
    if some alias is allowed by a rule, else block if some alias is blocked by one, else the default.
    """
    pages = pages.drop("host", "path", "rule", "verdict")
    links = cut(alias_links(pages))
    ends = links.select(F.col("a").alias("url")).union(links.select("b")).distinct()
    judged = matched_rules(pages.select("url").where("url is not null").union(ends).distinct(), rules).select(
        F.col("url").alias("m_url"), "host", "path", "rule", "verdict"
    )
    judged = cut(judged)
    groups = components(links)
    decided = (
        groups.join(judged, F.col("node") == F.col("m_url"))
        .groupBy("root")
        .agg(F.max(F.col("verdict") == "allow").alias("some_allow"), F.max(F.col("verdict") == "block").alias("some_block"))
        .select(F.col("root").alias("d_root"), F.when(F.col("some_allow"), "allow").when(F.col("some_block"), "block").alias("passed_on"))
        .where("passed_on is not null")
    )
    aliases = groups.join(decided, F.col("root") == F.col("d_root")).select(F.col("node").alias("alias"), "passed_on")
    passed = judged.join(aliases, node_of(F.col("m_url")) == F.col("alias"), "left")
    final = passed.select("m_url", "host", "path", "rule", F.coalesce("verdict", "passed_on", F.lit(default)).alias("verdict"))
    # Pages without a url meet nothing; they are kept out of the join, in which all of them would be one key.
    own = [F.col(f"`{c}`") for c in pages.columns]
    known = pages.where("url IS NOT NULL").join(final, F.col("url") == F.col("m_url"))
    unknown = pages.where("url IS NULL")
    constants = [F.lit(x).cast("string").alias(c) for c, x in (("host", ""), ("path", ""), ("rule", None), ("verdict", default))]
    return known.select(*own, "host", "path", "rule", "verdict").union(unknown.select(*own, *constants))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict of every page under RULES.

    A null url or one without :// has an empty host and path, fits no rule and is an alias of nothing
    but what it links to; null html has no links. Repeated rows are judged alike, each in its own row. Pages of any
    length are read whole; without rows the result is empty; other columns are not read.
    """
    listed = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("rule")) for v, r in RULES])
    rules = spark.range(1).select(F.inline(listed))
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{v}', '{r}', '{r.split('/')[0]}', '/{r.split('/', 1)[1]}')" for v, r in RULES)

ORACLE = rf"""
WITH RECURSIVE rules(verdict, rule, r_host, r_path) AS (VALUES {_VALUES}),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages),
links AS (SELECT split_part(url, '#', 1) AS a, split_part(CASE WHEN tag ILIKE '<link%'
    THEN regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?([^\s"''>]+)', 1)
    ELSE regexp_extract(tag, '(?is)\burl\s*=\s*["'']?([^\s"''>]+)', 1) END, '#', 1) AS b
  FROM tags WHERE regexp_matches(tag, '(?i)\brel\s*=\s*["'']?canonical\b|\bhttp-equiv\s*=\s*["'']?refresh\b')),
both_ways AS (SELECT a, b FROM links WHERE b <> '' UNION SELECT b, a FROM links WHERE b <> ''),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
urls AS (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT a FROM both_ways),
hosts AS (SELECT url, translate(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), '{LOWER[0]}', '{LOWER[1]}') AS host,
    regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls),
best AS (SELECT url, host, path, rule, verdict FROM hosts LEFT JOIN rules
    ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY length(rule) DESC NULLS LAST, verdict) = 1),
passed AS (SELECT r.a, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' WHEN bool_or(verdict = 'block') THEN 'block' END AS v
  FROM reach r JOIN best ON r.b = best.url GROUP BY r.a)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(verdict, v, 'allow') AS verdict
FROM pages LEFT JOIN best USING (url) LEFT JOIN passed ON passed.a = split_part(pages.url, '#', 1)
"""
