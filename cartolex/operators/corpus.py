"""Page-corpus jobs: text, links, crawl planning inputs and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolex.functions.html import anchors, resolve_links, visible_text
from cartolex.functions.markup import parsed
from cartolex.functions.text import first_match, host_of, path_of, short_hash
from cartolex.operators.keep import keep_first
from cartolex.operators.running import with_running
from cartolex.vocab import rules



def page_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add the visible ``text`` of each page and its SHA-256 ``hash``."""
    return pages.withColumn("text", visible_text(F.col(html))).withColumn("hash", F.sha2("text", 256))


def page_usable(text: Column, kind: Column, min_chars: int = 40) -> Column:
    """Enough text to read, and not a product catalogue."""
    return (F.length(F.trim(text)) > min_chars) & (kind != "products-json")


def page_links(pages: DataFrame, id: str, url: str = "url", html: str = "html") -> DataFrame:
    """(id, page_url, pos, href, text, url): same-site links in document order."""
    found = resolve_links(F.col(url), anchors(F.col(html)))
    links = pages.select(F.col(id), F.col(url).alias("page_url"), F.posexplode(found).alias("pos", "a"))
    same_site = host_of(F.col("a.url")) == host_of(F.col("page_url"))
    return links.filter(same_site).select(id, "page_url", "pos", "a.href", "a.text", "a.url")


def parsed_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``text``, its ``hash`` and ``links`` (href, text) as an HTML parser reads the page: right on broken markup too.

    One pass over each page in Python, in Arrow batches; ``page_text`` and ``page_links`` stay in the JVM and read
    well-formed markup alike.
    """
    read = pages.withColumn("_read", parsed(F.col(html)))
    out = read.withColumns({"text": F.col("_read.text"), "links": F.col("_read.links")}).drop("_read")
    return out.withColumn("hash", F.sha2("text", 256))


def parsed_links(pages: DataFrame, id: str, url: str = "url", html: str = "html") -> DataFrame:
    """As ``page_links``, of pages with any markup."""
    read = pages.select(id, F.col(url).alias("page_url"), parsed(F.col(html))["links"].alias("links"))
    found = resolve_links(F.col("page_url"), F.col("links"))
    links = read.select(id, "page_url", F.posexplode(found).alias("pos", "a"))
    same_site = host_of(F.col("a.url")) == host_of(F.col("page_url"))
    return links.filter(same_site).select(id, "page_url", "pos", "a.href", "a.text", "a.url")


def link_kind(path: Column, text: Column, link_rules: Sequence[tuple[str, str]] = tuple(rules.LINK_RULES)) -> Column:
    """Kind of a link from its path and text; NULL when nothing suggests products or a menu."""
    hay = F.lower(F.concat_ws(" ", path, text))
    pdf = path.rlike(r"(?i)\.pdf$") & hay.rlike(rules.LINK_PDF_HINT)
    return F.when(pdf, F.lit("pdf")).otherwise(first_match(hay, list(link_rules)))


def crawl_frontier(
    links: DataFrame,
    site: Column,
    order: Sequence[str],
    budget: int | Column,
    link_rules: Sequence[tuple[str, str]] = tuple(rules.LINK_RULES),
    kind_rank: dict[str, int] | None = None,
) -> DataFrame:
    """Links worth fetching per site: best kind, then shortest path, then document order.

    ``links`` come from ``page_links``. ``budget`` is the number of fetches left
    for the row's site, the only limit.
    """
    ranks = kind_rank or rules.LINK_RANK
    path = path_of(F.col("url"))
    own = F.regexp_replace(F.col("page_url"), r"#.*$", "")
    classed = (
        links.withColumns({"site": site, "path": path, "budget": F.lit(budget) if isinstance(budget, int) else budget})
        .filter((F.col("url") != own) & ~F.col("path").rlike(rules.LINK_SKIP_PATH) & ~F.col("path").rlike(rules.LINK_SKIP_EXT))
        .withColumn("kind", link_kind(F.col("path"), F.col("text"), link_rules))
        .filter("kind IS NOT NULL")
        .withColumn("kind_rank", F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in ranks.items()], F.lit(99)))
    )
    unique = keep_first(classed.select("site", "url", "kind", "kind_rank", "path", "budget", *order), ["site", "url"], list(order))
    best = [F.col("kind_rank"), F.length("path"), *[F.col(o) for o in order], F.col("url")]
    ranked = unique.withColumn("rank", F.row_number().over(Window.partitionBy("site").orderBy(*best)))
    if isinstance(budget, int):
        # A literal bound lets each map task send no more than that many rows per site.
        ranked = ranked.filter(F.col("rank") <= budget)
    return (
        ranked.filter(F.col("rank") <= F.col("budget"))
        .select("site", "rank", "kind", "url")
    )


def detect_platform(
    pages: DataFrame,
    html: str = "html",
    pinned: str | None = None,
    markers: Sequence[tuple[str, str]] = tuple(rules.PLATFORM_RULES),
    headers: str | None = None,
    header_markers: Sequence[tuple[str, str, str]] = (),
    chars: int | None = None,
) -> DataFrame:
    """Add ``platform``: a pinned value, else the first shop-software marker, else ``other``.

    ``headers`` names a map column of response headers (names in any case); a
    header marker (name, pattern, platform) decides before the page does.
    ``chars`` looks only at so many characters of the page; by default at all.
    """
    body = F.col(html) if chars is None else F.substring(F.col(html), 1, chars)
    found = F.coalesce(first_match(body, list(markers)), F.lit("other"))
    if headers is not None:
        lowered = F.transform_keys(F.col(headers), lambda k, _: F.lower(k))
        sent = [F.when(F.element_at(lowered, name.lower()).rlike(pattern), F.lit(platform)) for name, pattern, platform in header_markers]
        found = F.coalesce(*sent, found)
    return pages.withColumn("platform", F.coalesce(F.col(pinned), found) if pinned else found)


def _rule_matches(path: Column, tails: Column, anchored: Column, at: Column) -> Column:
    """Whether the literals between a rule's wildcards follow in ``path`` from ``at`` on, one after another.

    Each is found as early as it can be; the last one of an anchored rule must end the path.
    """
    last = F.get(tails, F.size(tails) - 1)
    free = F.when(anchored, F.slice(tails, F.lit(1), F.greatest(F.size(tails) - 1, F.lit(0)))).otherwise(tails)

    def found(place: Column, part: Column) -> Column:
        here = F.call_function("locate", part, path, place)
        return F.when((place > 0) & (here > 0), here + F.length(part)).otherwise(0)

    end = F.when(F.size(free) == 0, at).otherwise(F.aggregate(free, at, found))
    rest = F.when(F.size(tails) == 0, F.length(path) + 1 == at).otherwise(path.endswith(last) & (F.length(path) - F.length(last) + 1 >= end))
    return (end > 0) & (~anchored | rest)


def policy_join(urls: DataFrame, id: str, url: str, policy: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Add ``allowed``: the longest rule that matches the path decides; no rule allows.

    ``policy`` has (host, prefix, allow). A rule matches the begin of the path (with its query); ``*`` in it stands for any
    characters, ``$`` at its end for the end of the path. A URL is exploded into those prefixes of its own path that have the
    length of the literal head of a rule of its host, so the match is an equality join; what follows the head is looked at in
    the rows that are left. Rules are as long as their octets; on equal length "allow" wins. ``status`` has
    (host, code): client errors allow all, server errors (or 0, unreachable)
    deny all.
    """
    target = urls.select(F.col(id), host_of(F.col(url)).alias("_host"), F.regexp_extract(F.col(url), r"^[^:]+://[^/?#]*([^#]*)", 1).alias("_path"))
    target = target.withColumn("_path", F.when(F.col("_path").startswith("/"), F.col("_path")).otherwise(F.concat(F.lit("/"), F.col("_path"))))
    anchored = F.col("prefix").endswith("$")
    parts = F.split(F.when(anchored, F.expr("left(prefix, length(prefix) - 1)")).otherwise(F.col("prefix")), "[*]")
    rules_of = policy.select(host_of(F.concat(F.lit("http://"), F.col("host"))).alias("_host"), "prefix", F.col("allow").cast("int").alias("_allow"))
    wanted = rules_of.groupBy("_host", "prefix").agg(F.max("_allow").alias("_allow")).select(
        "_host", parts[0].alias("_prefix"), F.slice(parts, F.lit(2), F.size(parts)).alias("_tails"), anchored.alias("_anchored"), F.octet_length("prefix").alias("_long"), "_allow"
    )
    # Only the lengths that occur among the host's rules: a few short prefixes of a path, not all of them.
    sizes = wanted.groupBy("_host").agg(F.collect_set(F.length("_prefix")).alias("_sizes"))
    own = F.filter("_sizes", lambda n: n <= F.length("_path"))
    prefixes = target.join(sizes, "_host").select(id, "_host", "_path", F.explode(own).alias("_n")).select(
        id, "_host", "_path", F.substring("_path", F.lit(1), F.col("_n")).alias("_prefix")
    )
    met = prefixes.join(wanted, ["_host", "_prefix"])
    # Not a filter: that would become part of the join, which cannot hold a fold over an array.
    fits = _rule_matches(F.col("_path"), F.col("_tails"), F.col("_anchored"), F.length("_prefix") + 1)
    verdict = met.groupBy(id).agg(F.max(F.when(fits, F.struct("_long", "_allow")))["_allow"].alias("_allow"))
    out = urls.join(verdict, id, "left")
    allowed = F.coalesce(F.col("_allow") == 1, F.lit(True))
    if status is not None:
        codes = status.select(host_of(F.concat(F.lit("http://"), F.col("host"))).alias("_host"), F.col("code").alias("_code"))
        out = out.withColumn("_host", host_of(F.col(url))).join(codes, "_host", "left").drop("_host")
        allowed = (
            F.when(F.col("_code").between(400, 499), True)
            .when((F.col("_code") >= 500) | (F.col("_code") == 0), False)
            .otherwise(allowed)
        )
        return out.withColumn("allowed", allowed).drop("_allow", "_code")
    return out.withColumn("allowed", allowed).drop("_allow")


def polite_schedule(
    urls: DataFrame,
    url: str,
    order: Sequence[str],
    interval_s: float = 2.0,
    delays: DataFrame | None = None,
    chunk: Column | None = None,
    most_s: float | None = None,
) -> DataFrame:
    """Add ``host`` and ``start_s``: earliest start of each fetch, one at a time per host.

    ``delays`` has (host, delay_s); a delay raises the interval, up to ``most_s`` if that is given.
    """
    queued = with_running(urls.withColumn("host", host_of(F.col(url))), order, ["host"], chunk=chunk).drop("before")
    step = F.lit(float(interval_s))
    if delays is not None:
        queued = queued.join(delays.select("host", "delay_s"), "host", "left")
        raised = F.greatest(F.col("delay_s").cast("double"), step)
        raised = raised if most_s is None else F.least(raised, F.lit(float(most_s)))
        step = F.when(F.col("delay_s").isNotNull(), raised).otherwise(step)
    return queued.withColumn("start_s", F.col("position") * step).drop("position", "delay_s")


def group_fingerprint(df: DataFrame, group: Sequence[str], part: Column) -> DataFrame:
    """Order-insensitive fingerprint per group: hash of the number of its parts and of two sums of their digests.

    Counts and sums are merged from partial ones, so the value means the same for a group of any size and no task holds a
    group. The two sums take 60 bits of each part's digest and are exact.
    """
    digest = F.sha2(part, 256)
    sums = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 16)]
    return df.groupBy(*group).agg(F.count(part).alias("parts"), short_hash(F.concat_ws(":", F.count(part), *sums)).alias("fingerprint"))


def pages_hash(pages: DataFrame, site: str, url: str = "url", hash: str = "hash") -> DataFrame:
    """(site, pages_hash): changes when any page of the site does."""
    out = group_fingerprint(pages, [site], F.concat_ws("#", F.col(url), F.col(hash)))
    return out.select(site, F.col("fingerprint").alias("pages_hash"))
