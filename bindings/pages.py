"""Page-corpus jobs on the web pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query, table
from cartolex.functions.html import anchors, decode_entities, resolve_links
from cartolex.functions.text import host_of, normalize_text
from cartolex.operators.corpus import (
    crawl_frontier,
    group_fingerprint,
    page_links,
    page_text,
    page_usable,
    parsed_links,
    parsed_pages,
    policy_join,
    polite_schedule,
)
from cartolex.operators.keep import keep_first
from cartolex.vocab import rules

_WS = "[\\s\\x0B\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# The SQL has lists of its own: a slip in the library's tables must show.
_REFERENCES = [("&nbsp;", "\u00a0"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&eacute;", "\u00e9"), ("&amp;", "&")]
_UNSEEN = ["script", "style", "noscript", "svg", "iframe", "template", "head"]
_LINES = "p|div|li|h[1-6]|tr|section|article"


def _decode_sql(expr: str) -> str:
    for entity, char in _REFERENCES:
        expr = f"replace({expr}, {quote(entity)}, {quote(char)})"
    return expr


def _text_sql(html: str = "html") -> str:
    c = f"regexp_replace({html}, '<!--.*?-->', '', 'gs')"
    for tag in _UNSEEN:
        c = f"regexp_replace({c}, '<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', '', 'gis')"
    c = f"regexp_replace({c}, '</({_LINES})\\s*>|<br\\s*/?>', chr(10), 'gi')"
    c = _decode_sql(f"regexp_replace({c}, '<[^>]*>', '', 'gs')")
    c = f"regexp_replace({c}, '[ \\t\\f\\x0B\u00a0]+', ' ', 'g')"
    c = f"regexp_replace({c}, '{_WS}*\\n{_WS}*', chr(10), 'g')"
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


@query(
    "page_text",
    f"SELECT page_id, length(text) AS chars, sha256(text) AS hash FROM (SELECT page_id, {_text_sql()} AS text FROM pages)",
)
def texts(spark, folder):
    return page_text(table(spark, folder, "pages")).select("page_id", F.length("text").cast("bigint").alias("chars"), "hash")


_ANCHOR = """<a\\s[^>]*?href\\s*=\\s*(?:"[^"]*"|''[^'']*''|[^\\s>"'']+)[^>]*>.*?</a\\s*>"""
_HREF = """^<a\\s[^>]*?href\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s>"'']+))"""


def _encode_sql(expr: str) -> str:
    expr = f"url_encode({expr})"
    for ch in "!$&'()*+,/:;=?@[]|":
        expr = f"replace({expr}, '%{ord(ch):02X}', {quote(ch)})"
    return f"replace({expr}, '%25', '%')"


# All links of the test pages are either rooted paths or absolute addresses.
LINKS_SQL = f"""
found AS (SELECT page_id, url AS page_url, regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(?is){_ANCHOR}') AS a FROM pages),
each AS (SELECT page_id, page_url, unnest(a) AS a, generate_subscripts(a, 1) - 1 AS pos FROM found),
parts AS (
  SELECT page_id, page_url, pos, trim({_decode_sql(f"regexp_extract(a, '(?is){_HREF}', 1) || regexp_extract(a, '(?is){_HREF}', 2) || regexp_extract(a, '(?is){_HREF}', 3)")}) AS href,
         regexp_replace({_decode_sql("regexp_replace(a, '<[^>]*>', '', 'gs')")}, '^{_WS}+|{_WS}+$', '', 'g') AS text,
         regexp_extract(page_url, '^(https?://[^/?#]*)', 1) AS origin
  FROM each),
resolved AS (
  SELECT *, CASE WHEN href LIKE 'http%://%' THEN regexp_extract(href, '^(https?://[^/?#]*)', 1) ELSE origin END AS site,
         CASE WHEN href LIKE 'http%://%' THEN regexp_extract(href, '^https?://[^/?#]*([^#]*)', 1) ELSE regexp_replace(href, '#.*$', '') END AS rest
  FROM parts),
links AS (
  SELECT page_id, page_url, pos, href, text, lower(site) || {_encode_sql("CASE WHEN rest = '' THEN '/' ELSE rest END")} AS url,
         regexp_replace(regexp_extract(lower(origin), '^https?://(.*)', 1), '^www\\.', '') AS host
  FROM resolved
  WHERE regexp_replace(lower(site), '^https?://(www\\.)?', '') = regexp_replace(lower(origin), '^https?://(www\\.)?', ''))"""


@query("page_links", f"WITH {LINKS_SQL} SELECT page_id, pos, href, text, url FROM links")
def links(spark, folder):
    out = page_links(table(spark, folder, "pages"), "page_id")
    return out.select("page_id", F.col("pos").cast("bigint").alias("pos"), "href", "text", "url")


_STRAY = "replace(html, '</article>', ' 1 &lt; 2 &lt;3</article>')"


@query(
    "broken_html",
    f"SELECT page_id, sha256({_text_sql(_STRAY)}) AS hash FROM pages",
)
def broken_html(spark, folder):
    """The pages without end tags of paragraphs and list items, with a > in attributes and stray < in the text."""
    html = F.regexp_replace("html", "</(p|li)>", "")
    html = F.replace(F.replace(html, F.lit("<p>"), F.lit('<P data-x="a > b" title=\'</p>\'>')), F.lit("</article>"), F.lit("<br> 1 < 2 <3</article >"))
    pages = table(spark, folder, "pages").select("page_id", html.alias("html"))
    return parsed_pages(pages).select("page_id", "hash")


@query(
    "broken_links",
    f"WITH {LINKS_SQL} SELECT page_id, href, text, url FROM links QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY pos) = 1",
)
def broken_links(spark, folder):
    """The pages without end tags of links and list items: the next link ends the one before. First link of each address."""
    html = F.regexp_replace("html", "</(a|li)>", "")
    pages = table(spark, folder, "pages").select("page_id", "url", html.alias("html"))
    return keep_first(parsed_links(pages, "page_id"), ["page_id", "href"], ["pos"]).select("page_id", "href", "text", "url")


LINK_RULES = [("/the|\\bthe\\b", "coffee"), ("[aeiou]nd|tion", "menu"), (".", "shop")]


@query(
    "crawl_frontier",
    f"""WITH {LINKS_SQL},
classed AS (
  SELECT host AS site, url, page_id, pos, length(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)) AS size,
         lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) || ' ' || text) AS hay, page_url, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path
  FROM links),
kinds AS (
  SELECT *, CASE WHEN regexp_matches(hay, '/the|\\bthe\\b') THEN 'coffee' WHEN regexp_matches(hay, '[aeiou]nd|tion') THEN 'menu' ELSE 'shop' END AS kind
  FROM classed WHERE url <> regexp_replace(page_url, '#.*$', '')
    AND NOT regexp_matches(path, {quote(rules.LINK_SKIP_PATH.replace('(?i)', ''))}, 'i') AND NOT regexp_matches(path, {quote(rules.LINK_SKIP_EXT.replace('(?i)', ''))}, 'i')),
firsts AS (SELECT * FROM kinds QUALIFY row_number() OVER (PARTITION BY site, url ORDER BY page_id, pos) = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY site ORDER BY CASE kind WHEN 'coffee' THEN 0 WHEN 'menu' THEN 1 ELSE 3 END, size, page_id, pos, url) AS rank FROM firsts)
SELECT site, rank, kind, url FROM ranked WHERE rank <= 6""",
)
def frontier(spark, folder):
    found = page_links(table(spark, folder, "pages"), "page_id")
    out = crawl_frontier(found, host_of(F.col("page_url")), ["page_id", "pos"], 6, LINK_RULES)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "policy_join",
    """
WITH p AS (
  SELECT page_id, url, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS host,
         regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS path FROM pages),
hosts AS (SELECT host, min(page_id) AS first FROM p GROUP BY 1),
policy AS (
  SELECT host, '/en' AS prefix, 0 AS allow FROM hosts UNION ALL SELECT host, '/en/7', 1 FROM hosts
  UNION ALL SELECT host, '/fr', 0 FROM hosts UNION ALL SELECT host, '/fr', 1 FROM hosts UNION ALL SELECT host, '/', 0 FROM hosts WHERE host LIKE 'blog.%'),
hits AS (SELECT page_id, max(length(prefix) * 10 + allow) % 10 AS allow FROM p JOIN policy USING (host) WHERE starts_with(path, prefix) GROUP BY 1)
SELECT page_id, CASE WHEN host LIKE 'm.%' THEN true WHEN host LIKE 'spam%' THEN false ELSE coalesce(allow, 1) = 1 END AS allowed
FROM p LEFT JOIN hits USING (page_id)""",
)
def policy(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    blogs = F.when(F.col("host").startswith("blog."), F.struct(F.lit("/").alias("prefix"), F.lit(False).alias("allow")))
    listed = [("/en", False), ("/en/7", True), ("/fr", False), ("/fr", True)]
    rows = [F.struct(F.lit(p).alias("prefix"), F.lit(a).alias("allow")) for p, a in listed]
    policy = hosts.select("host", F.inline(F.array_compact(F.array(*rows, blogs))))
    status = hosts.select(
        "host", F.when(F.col("host").startswith("m."), 404).when(F.col("host").startswith("spam"), 503).otherwise(200).alias("code")
    )
    return policy_join(pages, "page_id", "url", policy, status).select("page_id", "allowed")


WILD_RULES = [
    ("/*/1", False, "^/.*/1"), ("/*1$", False, "^/.*1$"), ("/en/*5*7", True, "^/en/.*5.*7"), ("/*/", False, "^/.*/"), ("/de/2*$", True, "^/de/2.*$"),
    ("/fr/10$", False, "^/fr/10$"), ("/fr*0", True, "^/fr.*0"), ("*3$", True, "^.*3$"), ("/es/**9", True, "^/es/.*9"), ("/en/4$4", False, "^/en/4[$]4"),
]


@query(
    "wildcard_policy",
    f"""
WITH p AS (
  SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS host,
         regexp_extract(url, '^https?://[^/?#]*([^#]*)', 1) AS path FROM pages),
policy AS (SELECT * FROM (VALUES {", ".join(f"({quote(r)}, {int(a)}, {quote(p)})" for r, a, p in WILD_RULES)}) AS v(rule, allow, pattern)),
hits AS (
  SELECT page_id, max(strlen(rule) * 10 + allow) % 10 AS allow FROM p JOIN policy ON regexp_matches(path, pattern)
  WHERE rule <> '/*/' OR host LIKE 'blog.%' GROUP BY 1)
SELECT page_id, coalesce(allow, 1) = 1 AS allowed FROM p LEFT JOIN hits USING (page_id)""",
)
def wildcard_policy(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    rows = [F.struct(F.lit(r).alias("prefix"), F.lit(a).alias("allow")) for r, a, _ in WILD_RULES]
    policy = hosts.select("host", F.inline(F.array(*rows))).filter((F.col("prefix") != "/*/") | F.col("host").startswith("blog."))
    return policy_join(pages, "page_id", "url", policy).select("page_id", "allowed")


@query(
    "polite_schedule",
    """
WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS host FROM pages)
SELECT page_id, host, (row_number() OVER (PARTITION BY host ORDER BY page_id) - 1)
   * CASE WHEN host LIKE 'blog.%' THEN 30.0 WHEN host LIKE 'm.%' THEN 5.0 ELSE 2.0 END::DOUBLE AS start_s FROM p""",
)
def schedule(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    hosts = pages.select(host_of(F.col("url")).alias("host")).distinct()
    delay = F.when(F.col("host").startswith("blog."), 90.0).when(F.col("host").startswith("m."), 5.0)
    delays = hosts.select("host", delay.alias("delay_s")).filter("delay_s IS NOT NULL")
    out = polite_schedule(pages, "url", ["page_id"], 2.0, delays, chunk=F.floor(F.col("page_id") / 100_000), most_s=30.0)
    return out.select("page_id", "host", "start_s")


@query(
    "platform_detect",
    """
SELECT page_id, CASE WHEN regexp_matches(html, 'track\\([0-9]*0\\)') THEN 'shopify' WHEN regexp_matches(html, 'lang="fr"') THEN 'woocommerce'
   WHEN regexp_matches(html, '<!-- ad [0-9]*7 -->') THEN 'square' ELSE 'other' END AS platform FROM pages""",
)
def platforms(spark, folder):
    from cartolex.operators.corpus import detect_platform

    marked = [(r"track\([0-9]*0\)", "shopify"), ('lang="fr"', "woocommerce"), ("<!-- ad [0-9]*7 -->", "square")]
    return detect_platform(table(spark, folder, "pages"), markers=marked).select("page_id", "platform")


@query(
    "platform_markers",
    """
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'shopify' WHEN page_id % 4 = 1 THEN 'woocommerce' WHEN page_id % 4 = 2 THEN 'square' ELSE 'other' END AS platform
FROM pages""",
)
def markers(spark, folder):
    from cartolex.operators.corpus import detect_platform

    kind = F.col("page_id") % 4
    marker = (
        F.when(kind == 0, '<script src="https://CDN.shopify.com/s/files/1.js"></script>')
        .when(kind == 1, '<body class="theme woocommerce">')
        .when(kind == 2, '<a href="https://shop.square.site/">')
        .otherwise("")
    )
    pages = table(spark, folder, "pages").withColumn("html", F.concat(marker, F.col("html")))
    return detect_platform(pages).select("page_id", "platform")


@query(
    "site_fingerprint",
    """
WITH p AS (SELECT regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^www\\.', '') AS site, url || '#' || sha256(html) AS part FROM pages)
SELECT site, count(*) AS parts,
  substr(sha256(count(*) || ':' || sum(CAST('0x' || substr(sha256(part), 1, 15) AS BIGINT)) || ':' || sum(CAST('0x' || substr(sha256(part), 16, 15) AS BIGINT))), 1, 16) AS fingerprint
FROM p GROUP BY 1""",
)
def fingerprint(spark, folder):
    pages = table(spark, folder, "pages").withColumn("site", host_of(F.col("url")))
    return group_fingerprint(pages, ["site"], F.concat_ws("#", "url", F.sha2("html", 256)))


@query(
    "usable_pages",
    f"""
SELECT page_id, length(trim(text)) > 500 AND kind <> 'products-json' AS usable
FROM (SELECT page_id, {_text_sql()} AS text, CASE WHEN regexp_matches(html, 'lang="de"') THEN 'products-json' ELSE 'home' END AS kind FROM pages)""",
)
def usable(spark, folder):
    pages = page_text(table(spark, folder, "pages"))
    kind = F.when(F.col("html").contains('lang="de"'), F.lit("products-json")).otherwise(F.lit("home"))
    return pages.select("page_id", page_usable(F.col("text"), kind, 500).alias("usable"))


@query(
    "link_paths",
    """
WITH p AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site, CAST(page_id % 5 AS INTEGER) AS up FROM pages),
c AS (SELECT *, ['a', 'b', 'c', 'd', 'e'][1:5 - up] AS kept FROM p)
SELECT page_id, lower(site) || '/' || array_to_string(kept, '/') || CASE WHEN len(kept) > 0 THEN '/' ELSE '' END || 'x' || page_id AS url FROM c""",
)
def link_paths(spark, folder):
    """Links with nested dot segments: five folders down, zero to four (and at the root three more) up."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    up = F.array_join(F.array_repeat(F.lit(".."), (F.col("page_id") % 5).cast("int")), "/")
    target = F.concat(F.lit("/../.././../a/b/./c/d/e/"), F.when(F.length(up) > 0, F.concat(up, F.lit("/"))).otherwise(""), F.lit("x"), F.col("page_id").cast("string"))
    found = anchors(F.concat(F.lit('<a href="'), target, F.lit('#top">here</a>')))
    return pages.select("page_id", F.get(resolve_links(F.col("url"), found), F.lit(0))["url"].alias("url"))


@query(
    "entity_text",
    """
SELECT page_id, 'Caf' || chr(252) || ' ' || chr(8220) || 'x' || chr(8221) || ' '' &lt; <&nope; ' || chr(128512) || ' '
   || chr(CAST(192 + page_id % 300 AS INTEGER)) || chr(CAST(913 + page_id % 17 AS INTEGER)) || '&amp;' || length(html) AS text
FROM pages""",
)
def entity_text(spark, folder):
    """Named, decimal and hexadecimal references, one that is not known, and ampersands that must not be read twice."""
    number = (F.lit(913) + F.col("page_id") % 17).cast("string")
    shifting = F.concat(F.lit("&#x"), F.hex(F.lit(192) + F.col("page_id") % 300), F.lit(";&#"), number, F.lit(";&amp;amp;"), F.length("html").cast("string"))
    text = F.concat(F.lit("Caf&uuml; &ldquo;x&#8221; &#x27; &amp;lt; &lt;&nope; &#x1F600; "), shifting)
    return table(spark, folder, "pages").select("page_id", decode_entities(text).alias("text"))


@query(
    "folded_keys",
    """
SELECT page_id, 'swiss watertm ' || CASE page_id % 4 WHEN 0 THEN '1 2 lb viii kg abc' WHEN 1 THEN 'ij office no' WHEN 2 THEN '3 oz strasse' ELSE 'cafe ole x2' END || ' ' || page_id AS key
FROM pages""",
)
def folded_keys(spark, folder):
    """Compatibility forms: signs, fractions, numerals, units, ligatures, full-width and mathematical letters."""
    kind = F.col("page_id") % 4
    text = (
        F.when(kind == 0, "\u00bd lb \u2167 \u338f \U0001d400bc")
        .when(kind == 1, "\u0133 o\ufb03ce \u2116")
        .when(kind == 2, "\uff13 oz Stra\u017fse")
        .otherwise("Caf\u00e9 Ol\u00c9 x\u00b2")
    )
    return table(spark, folder, "pages").select("page_id", normalize_text(F.concat_ws(" ", F.lit("Swiss Water\u2122"), text, F.col("page_id").cast("string"))).alias("key"))
