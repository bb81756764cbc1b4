"""Faceted filtering, ordering and option lists."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.functions.geo import haversine_km
from cartolex.functions.text import normalize_variety
from cartolex.vocab.countries import CONTINENTS
from cartolex.vocab.enums import FLAVOR_FAMILIES, KINDS, PROCESSES, ROAST_LEVELS


@dataclass(frozen=True)
class Filters:
    """A selection: OR inside a dimension, AND across. Empty means no filter."""

    kinds: Sequence[str] = ()
    sells_online: bool = False
    roast_levels: Sequence[str] = ()
    processes: Sequence[str] = ()
    origin_countries: Sequence[str] = ()
    flavor_families: Sequence[str] = ()
    varieties: Sequence[str] = ()
    decaf_only: bool = False

    @property
    def active(self) -> int:
        """Number of dimensions in use."""
        return sum(bool(getattr(self, f.name)) for f in fields(self))

    @property
    def about_items(self) -> bool:
        """Any dimension that only items can satisfy?"""
        return self.active > bool(self.kinds) + bool(self.sells_online)


@dataclass(frozen=True)
class FacetColumns:
    """Where a table keeps each dimension."""

    kind: str = "kind"
    status: str = "data_status"
    sells_online: str = "sells_online"
    roast_levels: str = "roast_levels"
    processes: str = "processes"
    origin_countries: str = "origin_countries"
    flavor_families: str = "flavor_families"
    varieties: str = "varieties"
    has_decaf: str = "has_decaf"
    with_items: str = field(default="beans")


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def overlaps(values: Column, selected: Sequence[str]) -> Column:
    return sure(F.exists(values, lambda v: v.isin(list(selected))))


def kind_matches(kind: Column, selected: Sequence[str]) -> Column:
    """``both`` satisfies either single kind; asking for ``both`` accepts only itself."""
    wanted = set(selected)
    if wanted & {"roaster", "cafe"}:
        wanted.add("both")
    return sure(kind.isin(sorted(wanted)))


def taxonomy_matches(values: Column, selected: Sequence[str]) -> Column:
    """A selected node matches itself and everything below it."""

    def below(v: Column) -> Column:
        hit = v.isin(list(selected))
        for s in selected:
            hit = hit | v.startswith(f"{s}/")
        return hit

    return sure(F.exists(values, below))


def alias_matches(values: Column, selected: Sequence[str]) -> Column:
    """Match after both sides are brought to their variety key."""
    wanted = F.array(*[normalize_variety(F.lit(s)) for s in selected])
    return sure(F.exists(values, lambda v: F.array_contains(wanted, normalize_variety(v))))


def facet_predicate(f: Filters, at: FacetColumns = FacetColumns()) -> Column:
    terms = []
    if f.kinds:
        terms.append(kind_matches(F.col(at.kind), f.kinds))
    if f.sells_online:
        terms.append(sure(F.col(at.sells_online)))
    if f.about_items:
        terms.append(sure(F.col(at.status) == at.with_items))
    for dim in ("roast_levels", "processes", "origin_countries"):
        if getattr(f, dim):
            terms.append(overlaps(F.col(getattr(at, dim)), getattr(f, dim)))
    if f.flavor_families:
        terms.append(taxonomy_matches(F.col(at.flavor_families), f.flavor_families))
    if f.varieties:
        terms.append(alias_matches(F.col(at.varieties), f.varieties))
    if f.decaf_only:
        terms.append(sure(F.col(at.has_decaf)))
    out = F.lit(True)
    for t in terms:
        out = out & t
    return out


def apply_filters(index: DataFrame, f: Filters, at: FacetColumns = FacetColumns()) -> DataFrame:
    return index.filter(facet_predicate(f, at))


def count_matching(index: DataFrame, f: Filters, at: FacetColumns = FacetColumns()) -> DataFrame:
    return apply_filters(index, f, at).agg(F.count("*").alias("matching")).withColumn("active", F.lit(f.active))


def item_matches(
    f: Filters,
    roast: Column | None = None,
    process: Column | None = None,
    countries: Column | None = None,
    families: Column | None = None,
    varieties: Column | None = None,
    decaf: Column | None = None,
) -> Column:
    """All item dimensions on one item; false when none is in use."""
    if not f.about_items:
        return F.lit(False)
    out = F.lit(True)
    if f.roast_levels:
        out = out & sure((F.col("roast_level") if roast is None else roast).isin(list(f.roast_levels)))
    if f.processes:
        out = out & sure((F.col("process") if process is None else process).isin(list(f.processes)))
    if f.origin_countries:
        out = out & overlaps(F.col("countries") if countries is None else countries, f.origin_countries)
    if f.flavor_families:
        out = out & taxonomy_matches(F.col("flavor_families") if families is None else families, f.flavor_families)
    if f.varieties:
        out = out & alias_matches(F.col("varieties") if varieties is None else varieties, f.varieties)
    if f.decaf_only:
        out = out & sure(F.col("is_decaf") if decaf is None else decaf)
    return out


def tier(status: Column) -> Column:
    """Rank of a data status: items, then menu only, then nothing."""
    return F.when(status == "beans", 0).when(status == "menu-only", 1).otherwise(2)


def entity_order(point: tuple[float, float] | None = None) -> list[Column]:
    """Sort keys: tier, distance from ``point`` (lng, lat) when given, then name."""
    keys = [tier(F.col("data_status"))]
    if point is not None:
        keys.append(haversine_km(F.lit(point[0]), F.lit(point[1]), F.col("lng"), F.col("lat")))
    return [*keys, F.collate(F.col("name"), "UNICODE")]


def sort_entities(index: DataFrame, point: tuple[float, float] | None = None) -> DataFrame:
    return index.orderBy(*entity_order(point), F.col("id"))


def title_label(value: Column) -> Column:
    """The first letter of every run of word characters raised, all else as it is: ``sl-28a`` gives ``Sl-28a``."""
    parts = F.regexp_extract_all(value, F.lit(r"\w+|\W+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))), "")


def order_items(items: DataFrame, f: Filters, within: Sequence[str] = (), id: str = "item_id") -> DataFrame:
    """Items with ``matches``: matches first, then in stock, then by name, ties by id."""
    marked = items.withColumn("matches", item_matches(f))
    in_stock = F.coalesce(F.col("in_stock"), F.lit(True))
    return marked.orderBy(*within, F.desc("matches"), in_stock.desc(), F.collate(F.col("name"), "UNICODE"), F.col(id))


ARRAY_DIMS = ("roast_levels", "processes", "origin_countries", "flavor_families", "varieties")


def facet_options(index: DataFrame, dims: Sequence[str] = ARRAY_DIMS, flag: str | None = "has_decaf") -> DataFrame:
    """(dim, value): distinct values present, plus one row for the flag when any entity has it.

    One pass over the index whatever the number of dimensions.
    """
    def tagged(dim: str) -> Column:
        return F.transform(F.col(dim), lambda v: F.struct(F.lit(dim).alias("dim"), v.alias("value")))

    rows = [tagged(d) for d in dims]
    if flag:
        none = F.array().cast("array<struct<dim:string,value:string>>")
        rows.append(F.when(F.col(flag), F.array(F.struct(F.lit(flag).alias("dim"), F.lit("true").alias("value")))).otherwise(none))
    return index.select(F.inline(F.concat(*rows))).filter("value IS NOT NULL").distinct()


def group_by_continent(codes: DataFrame, countries: DataFrame) -> DataFrame:
    """(ord, continent, codes): fixed continent order, names sorted inside, unknown codes last."""
    order = F
    for i, c in enumerate(CONTINENTS):
        order = order.when(F.col("continent") == c, F.lit(i))
    named = codes.select("code").distinct().join(countries, "code", "left")
    listed = named.select(
        F.coalesce("continent", F.lit("Other")).alias("continent"),
        order.otherwise(F.lit(len(CONTINENTS))).alias("ord"),
        F.coalesce("name", "code").alias("name"),
        "code",
    )
    # Known codes are a closed vocabulary; what is not in it is listed in full under "Other".
    return (
        listed.groupBy("ord", "continent")
        .agg(F.array_sort(F.collect_list(F.struct("name", "code"))).alias("_c"))
        .select("ord", "continent", F.transform("_c", lambda c: c["code"]).alias("codes"))
        .orderBy("ord")
    )


def _fixed(spark, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "group_ord int, title string, ord int, value string, label string, child boolean")


def options_for(dim: str, index: DataFrame, selected: Sequence[str], countries: DataFrame) -> DataFrame:
    """Option rows of a filter dimension, in display order.

    Roast, process, notes and type have fixed lists; origins and varieties list
    what the index holds, and keep values that are selected but absent.
    """
    spark = index.sparkSession
    if dim == "roast":
        return _fixed(spark, [(0, None, i, v, n, False) for i, (v, n) in enumerate(ROAST_LEVELS.items())])
    if dim == "process":
        return _fixed(spark, [(0, None, i, v, n, False) for i, (v, n) in enumerate(PROCESSES.items())])
    if dim == "type":
        rows = [*KINDS.items(), ("sells-online", "Sells beans online")]
        return _fixed(spark, [(0, None, i, v, n, False) for i, (v, n) in enumerate(rows)])
    if dim == "notes":
        tops = [f for f in FLAVOR_FAMILIES if "/" not in f]
        rows = []
        for g, top in enumerate(tops):
            members = [top, *[f for f in FLAVOR_FAMILIES if f.startswith(f"{top}/")]]
            rows += [(g, None, i, f, FLAVOR_FAMILIES[f], "/" in f) for i, f in enumerate(members)]
        return _fixed(spark, rows)

    def present(column: str) -> DataFrame:
        values = index.select(F.explode(column).alias("value")).filter("value IS NOT NULL").distinct()
        kept = spark.createDataFrame([(v, i + 1) for i, v in enumerate(selected)], "value string, _late int")
        absent = kept.join(values, "value", "left_anti")
        return values.withColumn("_late", F.lit(0)).unionByName(absent)

    if dim == "origin":
        order = F
        for i, c in enumerate(CONTINENTS):
            order = order.when(F.col("continent") == c, F.lit(i))
        joined = present("origin_countries").join(countries, F.col("value") == F.col("code"), "left")
        return joined.select(
            order.otherwise(F.lit(len(CONTINENTS))).alias("group_ord"),
            F.coalesce("continent", F.lit("Other")).alias("title"),
            F.lit(None).cast("int").alias("ord"),
            "value",
            F.coalesce("name", "value").alias("label"),
            F.lit(False).alias("child"),
        ).orderBy("group_ord", F.collate(F.col("label"), "UNICODE"))
    if dim == "more":
        decaf = _fixed(spark, [(0, "Decaf", 0, "decaf", "Has decaf", False)])
        varieties = present("varieties").select(
            F.lit(1).alias("group_ord"),
            F.lit("Variety").alias("title"),
            F.col("_late").alias("ord"),
            "value",
            title_label(F.col("value")).alias("label"),
            F.lit(False).alias("child"),
        )
        return decaf.unionByName(varieties).orderBy("group_ord", "ord", "value")
    raise ValueError(f"unknown dimension {dim!r}")
