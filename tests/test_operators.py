import hashlib

"""Behaviours the table bindings do not reach."""

import pytest
from pyspark.sql import functions as F

from cartolex.functions.geo import geohash
from cartolex.functions.numbers import round_half_up, valid_range
from cartolex.operators.corpus import group_fingerprint
from cartolex.operators.facets import Filters, apply_filters, item_matches, order_items, title_label
from cartolex.operators.keep import cap_per_group, keep_first
from cartolex.operators.running import with_running
from cartolex.operators.shards import shard_by_bytes
from cartolex.sources.dims import ADD_SCHEMA, PATCH_SCHEMA, ConfigError, check_overrides, read_dim
from cartolex.sources.places import read_places, scan_bbox
from cartolex.sources.snapshots import load_index, read_snapshot, write_index, write_snapshot


def test_running_totals_with_a_hot_group(spark):
    rows = [("hot", i, float(i)) for i in range(300)] + [(f"g{i}", i, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, i int, v double")
    for chunk in (None, F.floor(F.col("i") / 50)):
        out = with_running(df, ["i"], ["g"], F.col("v"), chunk).filter("g = 'hot'").collect()
        assert len(out) == 300
        assert all(r.position == r.i and r.before == sum(range(r.i)) for r in out)


def test_fingerprint_is_one_definition(spark):
    """Order and partitions do not matter, copies and changes do, and a large group is cut into nothing."""
    small = [("a", "x"), ("a", "y"), ("a", "y"), ("b", "x"), ("c", None)]
    large = [("big", f"part {i}") for i in range(12_000)]
    prints = lambda rows, n: {r.g: (r.parts, r.fingerprint) for r in group_fingerprint(spark.createDataFrame(rows, "g string, p string").repartition(n), ["g"], F.col("p")).collect()}
    one, two = prints(small + large, 2), prints((small + large)[::-1], 7)
    assert one == two and one["a"][0] == 3 and one["big"][0] == 12_000 and one["c"][0] == 0
    digests = [hashlib.sha256(p.encode()).hexdigest() for _, p in large]
    sums = [sum(int(d[at : at + 15], 16) for d in digests) for at in (0, 15)]
    assert one["big"][1] == hashlib.sha256(f"12000:{sums[0]}:{sums[1]}".encode()).hexdigest()[:16]
    assert prints([("a", "x"), ("a", "y")], 1)["a"] != one["a"] and prints(large[1:], 3)["big"] != one["big"]


@pytest.mark.parametrize("per_node, room", [(2, 100), (64, 100)])
def test_shards_same_as_fold(spark, per_node, room):
    rows = [("r", i, (i * 37) % 29 + 1 if i % 40 else 300) for i in range(150)]
    want, used, shard = {}, None, 0
    for _, i, b in rows:
        if used is None or used + 1 + b > room:
            shard, used = (0 if used is None else shard + 1), 10 + b
        else:
            used += 1 + b
        want[i] = shard
    df = spark.createDataFrame(rows, "r string, i int, b int")
    out = shard_by_bytes(df, F.col("r"), ["i"], F.col("b"), 10, room, F.floor(F.col("i") / 40), per_node)
    assert {r.i: r.shard for r in out.collect()} == want


def test_small_numbers(spark):
    row = spark.range(1).select(
        round_half_up(F.lit(1.005)).alias("half"),
        valid_range(F.lit(2.999), 3, 500).alias("low"),
        valid_range(F.lit(12.345678), 3, 500).alias("ok"),
        geohash(F.lit(42.3736), F.lit(-71.1097)).alias("cell"),
    ).first()
    assert (row.half, row.low, row.ok, row.cell) == (1.0, None, 12.35, "drt3jcgkp")


def test_keep_and_cap(spark):
    df = spark.createDataFrame([("a", i, i % 3) for i in range(9)], "g string, i int, k int")
    assert sorted(r.i for r in keep_first(df, ["g", "k"], ["i"]).collect()) == [0, 1, 2]
    capped = cap_per_group(df, ["g"], [F.desc("i")], 2)
    assert sorted(r.i for r in capped.collect()) == [7, 8]
    assert "WindowGroupLimit" in capped._jdf.queryExecution().executedPlan().toString()


ITEM = "id string, roast_level string, process string, countries array<string>, flavor_families array<string>, varieties array<string>, is_decaf boolean, in_stock boolean, name string"


def test_items_match_on_one_item(spark):
    items = spark.createDataFrame(
        [
            ("1", "light", "washed", ["ET"], ["fruity/berry"], ["gesha"], False, False, "b"),
            ("2", "dark", "natural", ["KE"], ["sweet"], [], True, None, "a"),
            ("3", None, None, [], [], [], False, True, "c"),
        ],
        ITEM,
    )
    f = Filters(roast_levels=["light"], flavor_families=["fruity"], varieties=["Geisha"])
    assert f.active == 3 and f.about_items
    assert [(r.id, r.matches) for r in order_items(items, f, id="id").collect()] == [("1", True), ("2", False), ("3", False)]
    assert not any(r.m for r in items.select(item_matches(Filters(kinds=["cafe"])).alias("m")).collect())
    assert [r.id for r in items.filter(item_matches(Filters(decaf_only=True))).collect()] == ["2"]


def test_overrides_are_checked(spark):
    good = ("manual-x", "boston", "X", "cafe", 1.0, 2.0, None, None)
    patch = read_dim(spark, [("p", None, "both", None, None)], PATCH_SCHEMA)
    check_overrides(read_dim(spark, [good], ADD_SCHEMA), patch)
    for bad in (("x", *good[1:]), (*good[:3], "bar", *good[4:]), (*good[:4], None, *good[5:])):
        with pytest.raises(ConfigError):
            check_overrides(read_dim(spark, [bad], ADD_SCHEMA), patch)


def test_snapshots_and_index(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", "nyc"), ("2", "y", "boston")], "id string, name string, region_id string")
    path = str(tmp_path / "snap")
    write_snapshot(df, path, 1)
    write_snapshot(df.filter("id = '1'"), path, 2)
    assert read_snapshot(spark, path, 1).count() == 2 and read_snapshot(spark, path, 2).count() == 1
    index = str(tmp_path / "index")
    write_index(df, index)
    write_index(df.filter("region_id = 'nyc'").withColumn("id", F.lit("9")), index)
    assert [r.id for r in load_index(spark, index, "nyc").collect()] == ["9"]
    assert [r.id for r in load_index(spark, index, "boston").collect()] == ["2"]


def test_box_reaches_the_parquet_scan(spark, tmp_path):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    schema = (
        "id string, names struct<primary:string>, taxonomy struct<primary:string,hierarchy:array<string>,alternates:array<string>>, "
        "confidence double, websites array<string>, socials array<string>, phones array<string>, brand struct<names:struct<primary:string>>, "
        "addresses array<struct<freeform:string,locality:string,region:string,postcode:string>>, operating_status string, "
        "bbox struct<xmin:float,xmax:float,ymin:float,ymax:float>"
    )
    row = lambda id, cat, alts, x: (id, (id,), (cat, [], alts), 0.9, None, None, None, None, [], None, (x, x, 42.3, 42.3))
    rows = [row("in", "cafe", None, -71.1), row("alt", "bar", ["coffee_shop"], -71.1), row("out", "cafe", None, -72.0), row("other", "bar", None, -71.1)]
    path = str(tmp_path / "release=1" / "places")
    spark.createDataFrame(rows, schema).write.parquet(path)
    places = read_places(spark, str(tmp_path / "release={release}" / "places"), "1")
    out = scan_bbox(places, (-71.2, 42.2, -71.0, 42.4), ["cafe"], ["coffee_shop"])
    assert sorted(r.id for r in out.collect()) == ["alt", "in"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(bbox.xmin" in plan
    assert "hierarchy" not in plan


def test_empty_filter_keeps_all(spark):
    df = spark.createDataFrame([("cafe",), (None,)], "kind string")
    assert apply_filters(df, Filters()).count() == 2
    assert apply_filters(df, Filters(kinds=["roaster"])).count() == 0


def test_published_region_without_rows_is_emptied(spark, tmp_path):
    df = spark.createDataFrame([("1", "x", "nyc"), ("2", "y", "boston")], "id string, name string, region_id string")
    index = str(tmp_path / "index")
    write_index(df, index)
    write_index(df.filter("region_id = 'nyc'"), index, regions=["nyc", "boston"])
    assert load_index(spark, index, "boston").count() == 0 and load_index(spark, index, "nyc").count() == 1


def test_labels_raise_letters_only(spark):
    df = spark.createDataFrame([("sl-28a",), ("brand#x",), ("red BOURBON",), ("",)], "v string")
    assert [r[0] for r in df.select(title_label(F.col("v"))).collect()] == ["Sl-28a", "Brand#X", "Red BOURBON", ""]
