"""Facet counts after many changes against counts of everything."""

import random

import pytest
from pyspark.sql import functions as F

from cartolex.operators import facet_state as state
from cartolex.operators.entities import FACET_SETS, compute_facets

TINY = {
    "customer": "SELECT range AS c_custkey, 'c' AS c_name, 1 AS c_nationkey, 9500.0::DOUBLE AS c_acctbal, 'BUILDING' AS c_mktsegment FROM range(60)",
    "supplier": "SELECT 0::BIGINT AS s_suppkey, 's' AS s_name, 3 AS s_nationkey, 0.0::DOUBLE AS s_acctbal",
    "part": "SELECT 0::BIGINT AS p_partkey, 'red ring' AS p_name, 'B' AS p_brand, 'SMALL' AS p_type, 1 AS p_size, 2.0::DOUBLE AS p_retailprice",
    "orders": "SELECT range AS o_orderkey, range AS o_custkey, 'F' AS o_orderstatus, '2-HIGH' AS o_orderpriority FROM range(60)",
    "lineitem": "SELECT range AS l_orderkey, 0::BIGINT AS l_partkey, 0::BIGINT AS l_suppkey, 1 AS l_linenumber, 50.0::DOUBLE AS l_quantity, CASE WHEN range % 2 = 0 THEN 'R' ELSE 'N' END AS l_returnflag, 'O' AS l_linestatus FROM range(60)",
}
SCHEMA = "entity_id int, roast_level string, process string, countries array<string>, flavor_families array<string>, varieties array<string>, url string, is_decaf boolean"


def item(rnd, entity):
    some = lambda words: rnd.choice([None, [], [rnd.choice(words) for _ in range(rnd.randint(1, 4))], [rnd.choice(words), None]])
    return (entity, rnd.choice(["light", "dark", None]), rnd.choice(["washed", "honey", None]), some(["BR", "KE", "ET"]), some(["a", "a/b", "c"]), some(["x", "y"]), rnd.choice([None, "", "u"]), rnd.choice([None, False, True]))


def frame(spark, items, entities=None):
    return spark.createDataFrame([i for e, own in items.items() if entities is None or e in entities for i in own], SCHEMA)


def plain(items):
    counts = {}
    for e, own in items.items():
        for _, roast, process, countries, families, varieties, url, decaf in own:
            shown = {("_items", None), ("roast_levels", roast), ("processes", process)}
            shown |= {(n, m) for n, c in (("origin_countries", countries), ("flavor_families", families), ("varieties", varieties)) for m in c or []}
            shown = {(n, m) for n, m in shown if m is not None or n == "_items"}
            shown |= {("_linked", None)} if url else set()
            shown |= {("_decaf", None)} if decaf else set()
            for n, m in shown:
                counts[(e, n, m)] = counts.get((e, n, m), 0) + 1
    return counts


def as_dict(counts):
    rows = counts.collect()
    out = {(r.entity_id, r.facet, r.member): r.n for r in rows}
    assert len(out) == len(rows)
    return out


def test_ten_changes_equal_a_rebuild(spark, tmp_path):
    rnd, path = random.Random(3), str(tmp_path / "facets")
    items = {e: [item(rnd, e) for _ in range(rnd.randint(0, 6))] for e in range(12)}
    counts = lambda entities=None: state.member_counts(frame(spark, items, entities), "entity_id")
    state.write_state(counts(), path)
    assert as_dict(state.read_state(spark, path, "entity_id")) == plain(items)
    for run in range(10):
        changed = set(rnd.sample(range(14), 3))
        before = counts(changed).collect()
        before = spark.createDataFrame(before, "entity_id int, facet string, member string, n bigint")
        for e in changed:
            kept = [i for i in items.get(e, []) if rnd.random() < 0.5]
            items[e] = kept + [item(rnd, e) for _ in range(rnd.randint(0, 2))]
        state.append_change(state.member_change(before, counts(changed), "entity_id"), path, f"r{run}")
        if run == 4:
            state.compact(spark, path, "entity_id")
    held = state.read_state(spark, path, "entity_id")
    assert as_dict(held) == plain(items)
    entities = spark.createDataFrame([(e,) for e in range(14)], "entity_id int")
    rebuilt = compute_facets(entities, frame(spark, items), None, "entity_id", F.lit("other"))
    facets = state.facets_of(held, "entity_id", FACET_SETS)
    joined = {r.entity_id: r for r in facets.collect()}
    for r in rebuilt.collect():
        if r.bean_count == 0:
            assert r.entity_id not in joined
            continue
        kept = joined[r.entity_id]
        assert kept.bean_count == r.bean_count and kept.has_decaf == r.has_decaf
        assert [kept[n] for n in FACET_SETS] == [[m for m in r[n] if m is not None] for n in FACET_SETS]


def test_a_run_again_and_a_run_that_dies(spark, tmp_path):
    path, schema = str(tmp_path / "facets"), "entity_id int, facet string, member string, n bigint"
    change = lambda n: spark.createDataFrame([(1, "processes", "honey", n)], schema)
    with pytest.raises(FileNotFoundError):
        state.read_state(spark, path, "entity_id")
    with pytest.raises(FileNotFoundError):
        state.append_change(change(1), path, "a")
    state.write_state(change(2), path)
    state.append_change(change(1), path, "a")
    state.append_change(change(1), path, "a")
    state.append_change(change(5), path, "b")
    (tmp_path / "facets" / "changes-0" / "run=b" / "_SUCCESS").unlink()
    (tmp_path / "facets" / "state-1").mkdir()
    assert as_dict(state.read_state(spark, path, "entity_id")) == {(1, "processes", "honey"): 3}
    state.append_change(change(-3), path, "b")
    assert as_dict(state.read_state(spark, path, "entity_id")) == {}
    state.compact(spark, path, "entity_id")
    assert as_dict(state.read_state(spark, path, "entity_id")) == {}


def test_the_change_is_worked_out_once(spark, tmp_path):
    """Ten changes out of one table: the query joins the lines for the counts and for the change, not for each of the ten."""
    import duckdb

    import __spark_entry__ as entry

    for t in ("customer", "supplier", "part", "orders", "lineitem"):
        duckdb.sql(f"COPY ({TINY[t]}) TO '{tmp_path}/{t}.parquet'")
    plan = entry.queries()["facets_kept"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_partkey") and plan.count("Relation") <= 30


def test_merged_counts_are_shuffled_once(spark):
    """What is summed for facets is dealt by entity, so that facets take it from where it is."""
    schema = "entity_id int, facet string, member string, n bigint"
    one, other = (spark.createDataFrame([(e, "processes", m, n) for e in range(5)], schema) for m, n in (("honey", 2), ("washed", 1)))
    merged = state.merge_counts("entity_id", one, other, one.withColumn("n", -F.col("n")), together=True)
    facets = state.facets_of(merged, "entity_id", ["processes"])
    plan = facets._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted((r.entity_id, r.processes) for r in facets.collect()) == [(e, ["washed"]) for e in range(5)]
