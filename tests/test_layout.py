"""Places stored along a Z-curve: a box reads the row groups near it."""

from pyspark.sql import functions as F

from cartolex.sources.places import inside_box, read_places, write_places


def test_box_reads_few_row_groups(spark, tmp_path):
    n = 300_000
    x = (F.xxhash64(F.lit("x"), "id") % 180_000_000).cast("double") / 1e6
    y = (F.xxhash64(F.lit("y"), "id") % 85_000_000).cast("double") / 1e6
    rows = spark.range(n).select("id", F.struct(F.sha2(F.col("id").cast("string"), 256).alias("primary")).alias("names"), F.struct(x.alias("xmin"), (x + 0.001).alias("xmax"), y.alias("ymin"), (y + 0.001).alias("ymax")).alias("bbox"))
    path = str(tmp_path / "places")
    write_places(rows, path, rows_per_file=40_000, group_bytes=1 << 20)
    box = (-80.0, 30.0, -70.0, 40.0)
    want = sorted(r.id for r in rows.filter(inside_box(box)).select("id").collect())
    found = read_places(spark, path).filter(inside_box(box)).select("id")
    assert sorted(r.id for r in found.collect()) == want and len(want) > 200
    read = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()
    assert read < n / 8
    pushed = found._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "GreaterThanOrEqual(bbox.xmin" in pushed


def test_places_without_bounds(spark, tmp_path):
    schema = "id int, bbox struct<xmin: float, xmax: float, ymin: float, ymax: float>"
    rows = [(1, None), (2, (None, None, None, None)), (3, (1.0, 1.0, 2.0, 2.0)), (3, (1.0, 1.0, 2.0, 2.0)), (4, (-180.0, -180.0, -90.0, -90.0))]
    path = str(tmp_path / "places")
    write_places(spark.createDataFrame(rows, schema), path)
    back = read_places(spark, path)
    assert sorted(r.id for r in back.collect()) == [1, 2, 3, 3, 4]
    assert [r.id for r in back.filter(inside_box((0.0, 0.0, 5.0, 5.0))).collect()] == [3, 3]
