"""URL filtering: fixed rules first, then path templates judged by the labels seen under them.

Each host has a tree of path segments. Segments that are plainly variable (numbers, dates, long hexadecimal strings) become
wildcards at once. From the top down, children whose
shares of good labels differ by a test of proportions from the rest of their branching are set apart, alike ones together, and
the others, with those that have no labels, are merged, into a wildcard where the branching has more than ``children``; their
subtrees with them; a subtree whose labels do not differ is folded. What is left are templates; each is judged by its labelled share of good pages, smoothed towards its host's, which is smoothed towards that of
all pages. The tree is made of counts by template: pages are aggregated before anything is compared.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.llm.common import ship, stored

#: Sums over the paths of a node, and the segments of its longest path.
TOTALS = ["n_labelled", "n_good", "n_paths", "n_size"]
#: Names that a template spells out at one level; children are compared however many there are.
CHILDREN = 50
#: Labels' worth of the parent's share that is mixed into a share.
STRENGTH = 10.0
#: Standard deviations from which on two shares differ, if only these two are compared.
DIFFERS = 1.96


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; then up to ``? #`` or the end. Else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (``host/path``, verdict) that fits a host or its subdomains and the begin of the path, and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r)):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _general(path: Column) -> Column:
    """The segments of a path, joined by ``/``, with the plain variables as wildcards."""
    kind = lambda s: F.when(s.rlike(r"^[0-9]+$"), "*").when(s.rlike(r"^[0-9a-fA-F-]{16,}$"), "*").otherwise(F.regexp_replace(s, r"[0-9]{2,}", "*"))
    return F.array_join(F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), kind), "/")


def _alike(labelled: np.ndarray, good: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Groups of the labelled children of one branching, given as distinct counts and how many children have them.

    Children that differ from the rest of their branching leave it, until none does: what stays is group 0. Those that left,
    most labels first, join the group whose pooled counts are nearest, or open one if they differ from all. Among many
    children some differ by chance, so the more are compared the larger a difference has to be.
    """
    normal = NormalDist()
    differs = -normal.inv_cdf(normal.cdf(-DIFFERS) / max(int(times.sum()), 1))

    def gap(n, g, m, h):
        one, two = (g + 0.5) / (n + 1.0), (h + 0.5) / (m + 1.0)
        return np.abs(one - two) / np.sqrt(one * (1 - one) / (n + 1.0) + two * (1 - two) / (m + 1.0))

    stays = np.ones(len(labelled), bool)
    while True:
        n, g = ((c * times)[stays].sum() for c in (labelled, good))
        leaves = stays & (n > labelled) & (gap(labelled, good, np.maximum(n - labelled, 0), np.maximum(g - good, 0)) >= differs)
        if not leaves.any():
            break
        stays &= ~leaves
    groups, pooled_n, pooled_g = np.zeros(len(labelled), np.int64), np.zeros(0), np.zeros(0)
    for i in np.lexsort((good, -labelled)):
        if stays[i]:
            continue
        far = gap(pooled_n, pooled_g, labelled[i], good[i])
        k = int(far.argmin()) if len(far) else 0
        if not len(far) or far[k] >= differs:
            k, pooled_n, pooled_g = len(far), np.append(pooled_n, 0.0), np.append(pooled_g, 0.0)
        pooled_n[k] += times[i] * labelled[i]
        pooled_g[k] += times[i] * good[i]
        groups[i] = k + 1
    return groups


def _grouped(stats: DataFrame, branching: list[str]) -> DataFrame:
    """The group of each pair of counts in each branching.

    Children of equal counts are one row of a partial aggregate: a task holds the distinct counts of a branching, which are
    few beside its labels, and not its children.
    """
    pairs = stats.filter("b_labelled > 0").groupBy(*branching, "b_labelled", "b_good").agg(F.count("*").alias("times"))

    def task(rows: pa.Table) -> pa.Table:
        counts = [rows.column(c).to_numpy() for c in ("b_labelled", "b_good", "times")]
        return rows.drop_columns(["times"]).append_column("part", pa.array(_alike(*counts), pa.int64()))

    kinds = dict(stats.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [*branching, "b_labelled", "b_good"])
    return pairs.groupBy(*branching).applyInArrow(task, f"{schema}, part bigint")


def _merged(counts: DataFrame, children: int) -> DataFrame:
    """The group of each branch (host, node, name), its label, and the totals of the group: branches that are alike."""
    node = ["host", "node"]
    stats = counts.groupBy(*node, "name").agg(F.sum("labelled").alias("b_labelled"), F.sum("good").alias("b_good"), F.count_if(F.col("labelled") > 0).alias("paths"), F.max("size").alias("size"))
    near = stats.join(_grouped(stats, node), [*node, "b_labelled", "b_good"], "left").withColumn("part", F.coalesce("part", F.lit(0)))
    star = F.max(F.col("name") == "*")
    width = near.groupBy(*node).agg(F.count("*").alias("width"), star.alias("any_star"))
    totals = [F.sum("b_labelled").alias("n_labelled"), F.sum("b_good").alias("n_good"), F.sum("paths").alias("n_paths"), F.max("size").alias("n_size")]
    sizes = near.groupBy(*node, "part").agg(F.count("*").alias("names"), F.min("name").alias("first"), F.max("name").alias("last"), star.alias("star"), *totals)
    short = near.join(sizes.filter(F.col("names") <= children).select(*node, "part"), [*node, "part"], "left_semi")
    short = short.groupBy(*node, "part").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("all"))
    # Of a wide branching the children that do not differ are the wildcard; only short lists of names are spelled out.
    others = F.when((F.col("part") == 0) & (F.col("width") > children), F.when(F.col("any_star") & ~F.col("star"), "*|*").otherwise("*"))
    groups = sizes.join(width, node).join(short, [*node, "part"], "left")
    label = F.coalesce(others, "all", F.concat_ws("|", "first", F.lit("*"), "last"))
    groups = groups.select(*node, "part", label.alias("label"), *TOTALS)
    return near.select(*node, "name", "part").join(groups, [*node, "part"])


def _templates(counts: DataFrame, depth: int | None, children: int) -> DataFrame:
    """The template (host, node) of each generalised path and its text, from ``counts`` (host, general, labelled, good).

    A round for each level, over the nodes whose labels are mixed and on more than one path. The others are folded: below them
    nothing can differ. So rounds end with the deepest node of mixed labels, whatever the longest path.
    """
    counts = counts.withColumn("size", F.when(F.col("general") == "", 0).otherwise(F.size(F.split("general", "/"))))
    roots = counts.groupBy("host").agg(F.sum("labelled").alias("n_labelled"), F.sum("good").alias("n_good"), F.count_if(F.col("labelled") > 0).alias("n_paths"), F.max("size").alias("n_size"))
    columns = ["host", "general", "labelled", "good", "size"]
    open_ = counts.join(roots, "host").select(*columns, F.lit("").alias("node"), F.col("host").alias("text"), *TOTALS)
    closed, level = [], 0
    while True:
        mixed = (F.col("n_good") > 0) & (F.col("n_good") < F.col("n_labelled")) & (F.col("n_paths") > 1)
        goes = mixed if depth is None else mixed & F.lit(level < depth - 1)
        open_ = stored(open_.withColumn("goes", goes), "templates")
        # Text that stops here stays apart from text that goes on.
        stops = F.col("goes") & (F.col("size") == level)
        fold = F.when(F.col("goes") | (F.col("n_size") <= level), "").when(F.col("n_size") == level + 1, "/*").otherwise("/**")
        done = open_.filter(~F.col("goes") | stops)
        closed.append(done.select("host", "general", "labelled", "good", F.concat("node", F.when(stops, "!").otherwise("")).alias("node"), F.concat("text", fold).alias("template")))
        going = open_.filter(F.col("goes") & (F.col("size") > level)).withColumn("name", F.get(F.split("general", "/"), F.lit(level)))
        if going.isEmpty():
            break
        found = going.drop(*TOTALS).join(_merged(going, children), ["host", "node", "name"])
        open_ = found.select(*columns, F.concat("node", F.lit("."), F.col("part").cast("string")).alias("node"), F.concat("text", F.lit("/"), "label").alias("text"), *TOTALS)
        level += 1
    return reduce(DataFrame.unionByName, closed)


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], least: float = 0.5, depth: int | None = None, children: int = CHILDREN, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """A verdict on every url: the longest rule's, else its template's.

    ``labels`` has page_id and good (boolean): rows without either are left out, an id with both is good and bad once.
    Templates are as deep as the labels differ, or have at most ``depth`` levels, the last one wildcard.
    Returns page_id, host, path, rule (null if none fits), verdict (allow or block), template and share (the smoothed share of
    good labels), a row for each row of the input. A null url, or one without ``://``, has an empty host and path and is
    judged with its like. Without any labels all shares are 1. Other columns are not read.
    """
    ship(pages.sparkSession)
    host, path = host_and_path(F.col(f"`{url}`").cast("string"))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("general", _general(F.col("path")))
    given = labels.filter(F.col("page_id").isNotNull() & F.col("good").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), F.col("good").cast("int").alias("good")).groupBy("page_id").agg(F.count("*").alias("labelled"), F.sum("good").alias("good"))
    counts = rows.join(given, "page_id", "left").groupBy("host", "general").agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("labelled"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    counts = _templates(stored(counts, "templates"), depth, children)
    whole = counts.agg(F.sum("good").alias("all_good"), F.sum("labelled").alias("all_labelled")).select(((F.col("all_good") + 1) / (F.col("all_labelled") + 1)).alias("all_share"))
    smooth = lambda good, labelled, prior: (good + STRENGTH * prior) / (labelled + STRENGTH)
    hosts = counts.groupBy("host").agg(F.sum("good").alias("h_good"), F.sum("labelled").alias("h_labelled"))
    # One row, an aggregate: every host gets the share of all pages as its prior.
    prior = whole.first()[0]
    hosts = hosts.select("host", smooth(F.col("h_good"), F.col("h_labelled"), F.lit(float(prior if prior is not None else 1.0))).alias("host_share"))
    templates = counts.groupBy("host", "node").agg(F.sum("good").alias("t_good"), F.sum("labelled").alias("t_labelled")).join(hosts, "host")
    templates = templates.select("host", "node", smooth(F.col("t_good"), F.col("t_labelled"), F.col("host_share")).alias("share"))
    known = counts.select("host", "general", "node", "template").join(templates, ["host", "node"]).drop("node")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = rows.join(known, ["host", "general"])
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("share") < least, "block").otherwise("allow")).alias("verdict"), "template", "share")
