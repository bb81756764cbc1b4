"""The bitmap index against filters on the entities themselves."""

import itertools
import re

from pyspark.sql import functions as F

from cartolex.operators.bitmaps import count_by_bitmaps, filter_by_bitmaps, write_facet_index
from cartolex.operators.facets import Filters, apply_filters

SCHEMA = """id string, kind string, data_status string, sells_online boolean, roast_levels array<string>, processes array<string>,
origin_countries array<string>, flavor_families array<string>, varieties array<string>, has_decaf boolean, facet_note string"""

ROWS = [
    ("a", "both", "beans", True, ["light"], ["washed"], ["ET", "KE"], ["fruity/berry"], ["SL-28"], True, "x"),
    ("b", "roaster", "beans", False, ["dark", None], None, ["BR"], ["fruity", "nutty"], ["geisha"], None, None),
    ("c", "cafe", "menu-only", True, ["light"], ["washed"], ["ET"], ["fruity/"], ["Gesha"], True, "x"),
    ("d", "cafe", "beans", None, [], [], [], ["fruityish"], [], False, ""),
    ("d", "cafe", "beans", None, [], [], [], ["fruityish"], [], False, ""),
    (None, None, None, None, None, None, None, None, None, None, None),
    ("e", "both", "beans", True, ["light", "light"], ["natural"], ["KE"], [None, "fruity/berry/red"], ["sl28", None], True, "y"),
]

FILTERS = [
    Filters(),
    Filters(kinds=["roaster"]),
    Filters(kinds=["both"]),
    Filters(kinds=["cafe", "none"], sells_online=True),
    Filters(roast_levels=["light", "dark"]),
    Filters(flavor_families=["fruity"]),
    Filters(flavor_families=["fruity/berry", "nutty"], varieties=["SL28", "Geisha"]),
    Filters(origin_countries=["ET", "KE"], processes=["washed"], decaf_only=True),
    Filters(varieties=["gesha"]),
    Filters(varieties=["unknown"]),
    Filters(kinds=["both"], sells_online=True, roast_levels=["light"], processes=["natural"], origin_countries=["KE"], flavor_families=["fruity"], varieties=["SL-28"], decaf_only=True),
]


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_equal_to_filters_on_entities(spark, tmp_path):
    index = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / "facets")
    write_facet_index(index, path)
    for f in FILTERS:
        want = apply_filters(index, f)
        assert rows_of(filter_by_bitmaps(spark, path, f)) == rows_of(want), f
        assert tuple(count_by_bitmaps(spark, path, f).first()) == (want.count(), f.active), f


def test_empty_index(spark, tmp_path):
    path = str(tmp_path / "facets")
    write_facet_index(spark.createDataFrame([], SCHEMA), path)
    assert filter_by_bitmaps(spark, path, Filters()).collect() == []
    assert filter_by_bitmaps(spark, path, Filters()).columns == [c.split()[0] for c in SCHEMA.replace("\n", " ").split(", ")]
    assert count_by_bitmaps(spark, path, Filters(kinds=["cafe"])).first().matching == 0


def many(spark, n):
    def pick(name, values):
        return F.element_at(F.array(*map(F.lit, values)), (F.pmod(F.xxhash64(F.lit(name), "id"), F.lit(len(values))) + 1).cast("int"))

    return spark.range(n).select(
        "id",
        pick("kind", ["cafe", "roaster", "both"]).alias("kind"),
        pick("status", ["beans", "beans", "menu-only"]).alias("data_status"),
        (pick("online", [0, 1]) == 1).alias("sells_online"),
        F.array(pick("roast", ["light", "medium", "dark"])).alias("roast_levels"),
        F.array(pick("process", ["washed", "natural"])).alias("processes"),
        F.array(F.when(F.col("id").between(100_000, 100_400), "ZZ").otherwise("ET")).alias("origin_countries"),
        F.array(pick("family", ["fruity/berry", "nutty", "fruity"])).alias("flavor_families"),
        F.array(pick("variety", ["SL-28", "geisha", "bourbon"])).alias("varieties"),
        (pick("decaf", [0, 1, 2]) == 1).alias("has_decaf"),
    )


def test_many_blocks(spark, tmp_path):
    index = many(spark, 200_000)
    path = str(tmp_path / "facets")
    write_facet_index(index, path, shelf_blocks=1)
    for kinds, roasts, families in itertools.product([(), ("roaster",)], [("light", "dark")], [(), ("fruity",)]):
        f = Filters(kinds=kinds, roast_levels=roasts, flavor_families=families)
        assert count_by_bitmaps(spark, path, f).first().matching == apply_filters(index, f).count()
    f = Filters(origin_countries=["ZZ"], roast_levels=["light"])
    found = filter_by_bitmaps(spark, path, f)
    assert sorted(r.id for r in found.collect()) == sorted(r.id for r in apply_filters(index, f).collect())
    # 200,000 entities have at least seven shelves of a block each; those asked for lie in one or two.
    shelves = [name for name in (tmp_path / "facets" / "entities").iterdir() if name.name.startswith("facet_shelf=")]
    plan = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pruned = re.search(r"PartitionFilters: \[(.*facet_shelf.*)\]", plan)[1]
    assert len(shelves) >= 7 and len(set(re.findall(r"\b\d+\b", re.sub(r"#\d+L?", "", pruned)))) <= 2
