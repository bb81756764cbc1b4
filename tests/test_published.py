"""A published index: readers see one version whole, whatever happens to a publication."""

import pytest
from pyspark.sql import functions as F

from cartolex.sources import published as p

SCHEMA = "id string, name string, region_id string"


def rows(spark, names, version):
    return spark.createDataFrame([(f"{r}-{i}", f"v{version}", r) for r, n in names.items() for i in range(n)], SCHEMA)


def held(df):
    return sorted((r.region_id, r.name, r.n) for r in df.groupBy("region_id", "name").agg(F.count("*").alias("n")).collect())


def test_regions_are_replaced_and_emptied(spark, tmp_path):
    path = str(tmp_path / "index")
    assert p.read_published(spark, path) is None and p.manifest(spark, path)["version"] == 0
    assert p.publish(rows(spark, {"a b": 3, "b/c=d%": 2, "c": 1}, 1), path) == 1
    assert p.publish(rows(spark, {"a b": 5}, 2), path, regions=["a b", "c"]) == 2
    assert held(p.read_published(spark, path)) == [("a b", "v2", 5), ("b/c=d%", "v1", 2)]
    assert held(p.read_published(spark, path, ["c"])) == []
    assert held(p.read_published(spark, path, ["b/c=d%", "nowhere"])) == [("b/c=d%", "v1", 2)]
    assert {r: v["rows"] for r, v in p.manifest(spark, path)["regions"].items()} == {"a b": 5, "b/c=d%": 2}
    assert [r.name for r in p.find(spark, path, "a b-4").collect()] == ["v2"]


def test_nothing_published(spark, tmp_path):
    path = str(tmp_path / "index")
    assert p.publish(rows(spark, {}, 1), path) == 1
    assert p.read_published(spark, path).count() == 0 and p.read_published(spark, path).columns == ["id", "name", "region_id"]


def test_reader_between_the_steps(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    p.publish(rows(spark, {"a": 3, "b": 2}, 1), path)
    seen = []
    commit = p._commit

    def watched(*args):
        seen.append(held(p.read_published(spark, path)))
        commit(*args)

    monkeypatch.setattr(p, "_commit", watched)
    before = p.read_published(spark, path)
    p.publish(rows(spark, {"a": 9}, 2), path, regions=["a", "b"])
    assert seen == [[("a", "v1", 3), ("b", "v1", 2)]]
    # A reader that began before still has its rows after the commit.
    assert held(before) == seen[0] and held(p.read_published(spark, path)) == [("a", "v2", 9)]


def test_run_that_dies_leaves_the_index(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    p.publish(rows(spark, {"a": 3}, 1), path)

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(p, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            p.publish(rows(spark, {"a": 8}, 2), path)
    assert held(p.read_published(spark, path)) == [("a", "v1", 3)]
    for version in (2, 3, 4):
        assert p.publish(rows(spark, {"a": version}, version), path) == version
    # What the dead run wrote, and what nobody reads any more, is gone.
    assert len(list((tmp_path / "index" / "data").iterdir())) == p.KEPT
    assert len([f for f in (tmp_path / "index" / "manifests").iterdir() if f.name.isdigit()]) == p.KEPT


def test_two_publishers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    p.publish(rows(spark, {"a": 3}, 1), path)
    with pytest.raises(p.PublicationConflict):
        p.publish(rows(spark, {"a": 4}, 2), path, based_on=0)
    commit, first = p._commit, []

    def late(*args):
        if not first:
            first.append(True)
            p.publish(rows(spark, {"a": 5}, 5), path)
        commit(*args)

    monkeypatch.setattr(p, "_commit", late)
    with pytest.raises(p.PublicationConflict):
        p.publish(rows(spark, {"a": 6}, 6), path)
    assert held(p.read_published(spark, path)) == [("a", "v5", 5)]
    assert not [f for f in (tmp_path / "index" / "manifests").iterdir() if f.name.startswith(".draft")]


def test_lookup_reads_one_row_group(spark, tmp_path):
    path = str(tmp_path / "index")
    many = spark.range(400_000).select(F.format_string("%08d", "id").alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("name"), (F.col("id") % 3).cast("string").alias("region_id"))
    p.publish(many, path, rows_per_file=60_000, group_bytes=1 << 20)
    found = p.find(spark, path, "00123456")
    assert [r.region_id for r in found.collect()] == ["0"]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert 1 <= scan.metrics().apply("numOutputRows").value() <= 30_000
    assert p.find(spark, path, "nothing").count() == 0
