"""Snapshot comparison on orders, customers and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query, table
from bindings.shared import lat, lat_sql, lng, lng_sql
from cartolex.functions.hashing import content_hash
from cartolex.functions.numbers import days_between
from cartolex.operators.changes import (
    changed_pages,
    classify_changes,
    freshness_due,
    item_grace,
    keep_first_seen,
    lifecycle_replay,
    meta_hash,
    number_runs,
    snapshot_diff,
)
from cartolex.operators.jobs import assemble_outcomes
from cartolex.operators.keep import missing_rows
from cartolex.sources.snapshots import upsert

CUT = "1998-06-01"


def _totals(spark, folder, before: bool):
    """Per customer: orders and value before the cut, or up to the end."""
    o = table(spark, folder, "orders")
    part = o.filter(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz")) if before else o.filter("o_orderstatus <> 'P'")
    cents = (F.col("o_totalprice") * 100).cast("bigint")
    return part.groupBy("o_custkey").agg(
        F.count("*").alias("orders"), F.max(cents).alias("top"), F.max("o_orderpriority").alias("priority")
    )


@query(
    "snapshot_diff",
    f"""
WITH old AS (SELECT o_custkey, count(*) AS orders, max(CAST(trunc(o_totalprice * 100) AS BIGINT)) AS top, max(o_orderpriority) AS priority
             FROM orders WHERE o_orderdate < TIMESTAMP '{CUT}' GROUP BY 1),
new AS (SELECT o_custkey, count(*) AS orders, max(CAST(trunc(o_totalprice * 100) AS BIGINT)) AS top, max(o_orderpriority) AS priority
        FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
SELECT coalesce(new.o_custkey, old.o_custkey) AS o_custkey,
       CASE WHEN old.o_custkey IS NULL THEN 'created' WHEN new.o_custkey IS NULL THEN 'vanished'
            WHEN (new.top, new.priority) = (old.top, old.priority) THEN 'unchanged' ELSE 'updated' END AS action
FROM new FULL JOIN old ON new.o_custkey = old.o_custkey""",
)
def diff(spark, folder):
    hashed = lambda df: df.withColumn("content_hash", content_hash(df, ["top", "priority"]))
    return snapshot_diff(hashed(_totals(spark, folder, False)), hashed(_totals(spark, folder, True)), "o_custkey")


@query(
    "content_hash",
    """
SELECT p_partkey, substr(sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name || '","p_size":' || p_size || '}'), 1, 16) AS hash FROM part""",
)
def hashes(spark, folder):
    part = table(spark, folder, "part").withColumnRenamed("p_type", "last_seen")
    return part.select("p_partkey", content_hash(part, ["p_size", "p_name", "p_brand", "last_seen"]).alias("hash"))


@query(
    "meta_hash",
    f"""
SELECT c_custkey, substr(sha256('["' || c_name || '","cafe",{{"line1":"1 Main St","city":"' || c_mktsegment || '"}},"'
  || printf('%.5f', {lat_sql('c_custkey')}) || '","' || printf('%.5f', {lng_sql('c_custkey')}) || '","","555","","ok"]'), 1, 16) AS hash FROM customer""",
)
def metas(spark, folder):
    c = table(spark, folder, "customer").select(
        "c_custkey",
        F.col("c_name").alias("name"),
        F.lit("cafe").alias("kind"),
        F.struct(F.lit("1 Main St").alias("line1"), F.col("c_mktsegment").alias("city"), F.lit(None).cast("string").alias("state")).alias("address"),
        lat(F.col("c_custkey")).alias("lat"),
        lng(F.col("c_custkey")).alias("lng"),
        F.lit(None).cast("string").alias("website"),
        F.lit("555").alias("phone"),
        F.lit("").alias("instagram"),
    )
    return c.select("c_custkey", meta_hash(F.lit("ok")).alias("hash"))


def _classify(spark, folder, complete: bool):
    """Customers as the current run, suppliers' nations and balances as the old state."""
    c = table(spark, folder, "customer")
    now = c.filter("c_mktsegment <> 'FURNITURE'").select(
        F.col("c_custkey").alias("id"),
        (F.col("c_nationkey") % 2 == 0).alias("fresh"),
        F.col("c_mktsegment").alias("content_hash"),
        F.when(F.col("c_acctbal") > 8000, "moved").otherwise("here").alias("meta_hash"),
    )
    old = c.filter("c_mktsegment <> 'MACHINERY'").select(
        F.col("c_custkey").alias("id"),
        F.when(F.col("c_acctbal") < 5000, F.col("c_mktsegment")).otherwise("other").alias("content_hash"),
        F.lit("here").alias("meta_hash"),
        F.when(F.col("c_nationkey") > 20, F.col("c_nationkey") - 21).otherwise(0).alias("hidden_runs"),
        (F.col("c_acctbal") > -500).alias("in_index"),
        (F.col("c_acctbal") > -800).alias("has_document"),
    )
    return classify_changes(now, old, "id", complete)


def _classify_sql(complete: bool) -> str:
    gone = (
        "CASE WHEN hidden + 1 >= 4 THEN 'deleted' WHEN hidden = 0 THEN 'hidden' ELSE 'still-hidden' END"
        if complete
        else "'kept'"
    )
    after = "hidden + 1" if complete else "hidden"
    return f"""
WITH t AS (
  SELECT c_custkey AS id, c_mktsegment <> 'FURNITURE' AS now, c_mktsegment <> 'MACHINERY' AS old, c_nationkey % 2 = 0 AS fresh,
         c_acctbal < 5000 AS same, c_acctbal > 8000 AS moved, greatest(c_nationkey - 21, 0) AS hidden,
         c_acctbal > -500 AS in_index, c_acctbal > -800 AS has_document FROM customer)
SELECT id, CASE WHEN NOT now THEN {gone} WHEN NOT old THEN 'created'
    WHEN fresh OR ((hidden > 0 OR moved OR NOT in_index) AND has_document) THEN CASE WHEN same AND hidden = 0 THEN 'unchanged' ELSE 'updated' END
    WHEN hidden > 0 OR moved OR NOT in_index THEN 'created' ELSE 'carried' END AS action,
  now AND old AND NOT fresh AND (hidden > 0 OR moved OR NOT in_index) AS rebuilt,
  CASE WHEN now THEN 0 ELSE {after} END AS hidden_runs FROM t"""


@query("classify_changes", _classify_sql(True))
def classify(spark, folder):
    return _classify(spark, folder, True)


@query("classify_partial_run", _classify_sql(False))
def classify_partial(spark, folder):
    return _classify(spark, folder, False)


@query(
    "changed_pages",
    """
SELECT c_custkey AS id, c_name AS pages_hash, CASE WHEN c_acctbal < 0 THEN 'error' ELSE 'ok' END AS status FROM customer
WHERE c_acctbal >= 0 AND NOT (c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey < 20)""",
)
def changed(spark, folder):
    c = table(spark, folder, "customer")
    crawls = c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("pages_hash"),
        F.when(F.col("c_acctbal") < 0, "error").otherwise("ok").alias("status"),
    )
    before = (
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_name"))
        .when(F.col("c_mktsegment") == "FURNITURE", "")
        .otherwise("old")
    )
    state = c.filter("c_nationkey < 20").select(F.col("c_custkey").alias("id"), before.alias("pages_hash"))
    return changed_pages(crawls, state, "id")


def _sightings(spark, folder):
    """(user, event type, day) of every event."""
    return table(spark, folder, "events").select(
        F.col("user_id").alias("entity_id"), F.col("event_type").alias("item_id"), F.to_date("ts").alias("day"), "ts"
    )


GRACE_SQL = """
present AS (SELECT user_id AS entity_id, event_type AS item_id, min(ts)::DATE::VARCHAR AS first_seen FROM events WHERE ts >= TIMESTAMP '2024-01-26' GROUP BY 1, 2),
known AS (SELECT user_id AS entity_id, event_type AS item_id, min(ts)::DATE::VARCHAR AS first_seen,
                 CASE WHEN max(value) > 20 THEN 0 ELSE 1 END AS misses, min(value) < 5 AS has_row
          FROM events WHERE ts < TIMESTAMP '2024-01-26' GROUP BY 1, 2),
fresh AS (SELECT DISTINCT user_id AS entity_id FROM events WHERE ts >= TIMESTAMP '2024-01-28')"""


def _grace_tables(spark, folder):
    e = table(spark, folder, "events")
    cut = lambda d: F.lit(d).cast("timestamp_ntz")
    key = [F.col("user_id").alias("entity_id"), F.col("event_type").alias("item_id")]
    first = F.to_date(F.min("ts")).cast("string").alias("first_seen")
    present = e.filter(F.col("ts") >= cut("2024-01-26")).groupBy(*key).agg(first)
    known = e.filter(F.col("ts") < cut("2024-01-26")).groupBy(*key).agg(
        first, F.when(F.max("value") > 20, 0).otherwise(1).alias("misses"), (F.min("value") < 5).alias("has_row")
    )
    fresh = e.filter(F.col("ts") >= cut("2024-01-28")).select(F.col("user_id").alias("entity_id"))
    return present, known, fresh


@query(
    "item_grace",
    f"""WITH {GRACE_SQL},
j AS (
  SELECT coalesce(p.entity_id, k.entity_id) AS entity_id, coalesce(p.item_id, k.item_id) AS item_id, p.item_id IS NOT NULL AS now, k.item_id IS NOT NULL AS old,
         k.misses, k.has_row, coalesce(k.first_seen, p.first_seen) AS first_seen
  FROM present p FULL JOIN known k ON p.entity_id = k.entity_id AND p.item_id = k.item_id),
a AS (SELECT *, CASE WHEN now AND old THEN 'kept' WHEN now THEN 'added' WHEN entity_id NOT IN (SELECT entity_id FROM fresh) THEN 'carried'
                     WHEN misses + 1 < 2 AND has_row THEN 'grace' ELSE 'removed' END AS action FROM j)
SELECT entity_id, item_id, action, CASE action WHEN 'carried' THEN misses WHEN 'grace' THEN misses + 1 ELSE 0 END AS misses, first_seen FROM a""",
)
def grace(spark, folder):
    return item_grace(*_grace_tables(spark, folder), "entity_id", "item_id")


@query(
    "first_seen",
    f"""WITH {GRACE_SQL}
SELECT p.entity_id, p.item_id, coalesce(k.first_seen, p.first_seen) AS first_seen
FROM present p LEFT JOIN known k ON p.entity_id = k.entity_id AND p.item_id = k.item_id""",
)
def first_seen(spark, folder):
    present, known, _ = _grace_tables(spark, folder)
    return keep_first_seen(present, known, ["entity_id", "item_id"])


@query(
    "missing_items",
    f"""WITH {GRACE_SQL}
SELECT k.entity_id, k.item_id FROM known k ANTI JOIN present p ON p.entity_id = k.entity_id AND p.item_id = k.item_id""",
)
def missing(spark, folder):
    present, known, _ = _grace_tables(spark, folder)
    return missing_rows(known, present, ["entity_id", "item_id"]).select("entity_id", "item_id")


def _replay_sql(entity: list[str], where: str, limit: int, labels: list[str]) -> str:
    created, carried, returned, hidden, still, deleted = labels
    cols = ", ".join(entity)
    using = f"USING ({cols}, run_no)"
    return f"""
WITH days AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS run_no FROM (SELECT DISTINCT ts::DATE AS day FROM events WHERE {where})),
seen AS (SELECT DISTINCT user_id AS entity_id, event_type AS item_id, run_no FROM events JOIN days ON ts::DATE = day WHERE {where}),
s AS (SELECT DISTINCT {cols}, run_no, true AS here FROM seen),
firsts AS (SELECT {cols}, min(run_no) AS first FROM s GROUP BY {cols}),
every_run AS (SELECT {cols}, days.run_no FROM firsts JOIN days ON days.run_no >= first),
marked AS (SELECT {cols}, run_no, here, CASE WHEN here THEN run_no END AS sighted FROM every_run LEFT JOIN s {using}),
w AS (SELECT *, max(sighted) OVER (PARTITION BY {cols} ORDER BY run_no) AS last,
             max(sighted) OVER (PARTITION BY {cols} ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM marked)
SELECT {cols}, run_no, CASE
    WHEN here AND (prev IS NULL OR run_no - prev - 1 >= {limit}) THEN '{created}' WHEN here AND run_no - prev = 1 THEN '{carried}' WHEN here THEN '{returned}'
    WHEN run_no - last = {limit} THEN '{deleted}' WHEN run_no - last = 1 THEN '{hidden}' ELSE '{still}' END AS action
FROM w WHERE here OR run_no - last <= {limit}"""


LADDER = ["created", "carried", "returned", "hidden", "still-hidden", "deleted"]
ITEM_LADDER = ["added", "kept", "back", "grace", "grace", "removed"]


def _replay(spark, folder, entity, only, limit, labels):
    events = _sightings(spark, folder)
    events = events.filter(only) if only else events
    runs = number_runs(events, F.col("day"))
    numbered = events.join(runs, F.col("day") == F.col("run"))
    last = runs.agg(F.max("run_no")).first()[0]
    return lifecycle_replay(numbered, entity, F.col("run_no"), last, limit, labels)


@query("lifecycle_replay", _replay_sql(["entity_id"], "event_type = 'purchase'", 4, LADDER))
def replay(spark, folder):
    return _replay(spark, folder, ["entity_id"], "item_id = 'purchase'", 4, LADDER)


@query("entity_replay", _replay_sql(["entity_id"], "true", 4, LADDER))
def entity_replay(spark, folder):
    """The replay over events of all types; ``lifecycle_replay`` has purchases only."""
    return _replay(spark, folder, ["entity_id"], None, 4, LADDER)


@query("item_replay", _replay_sql(["entity_id", "item_id"], "true", 2, ITEM_LADDER))
def item_replay(spark, folder):
    return _replay(spark, folder, ["entity_id", "item_id"], None, 2, ITEM_LADDER)


@query(
    "freshness_touch",
    """
SELECT o_orderkey, round((epoch(TIMESTAMP '1998-07-01 06:00:00') - epoch(o_orderdate)) / 86400, 6) AS days,
       o_orderstatus <> 'P' AND (o_orderpriority = '5-LOW' OR epoch(TIMESTAMP '1998-07-01 06:00:00') - epoch(o_orderdate) >= 21 * 86400) AS due FROM orders""",
)
def freshness(spark, folder):
    now = F.lit("1998-07-01 06:00:00").cast("timestamp_ntz")
    last = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate"))
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.round(days_between(F.col("o_orderdate"), now), 6).alias("days"),
        freshness_due(F.col("o_orderstatus") != "P", last, now).alias("due"),
    )


@query(
    "upsert",
    """
SELECT c_custkey AS id, CASE WHEN op = 'set' THEN 'new' WHEN op = 'patch' THEN 'patched' ELSE c_name END AS name,
       CASE WHEN op = 'set' THEN NULL ELSE c_mktsegment END AS segment
FROM (SELECT *, CASE WHEN c_nationkey < 5 THEN 'set' WHEN c_nationkey < 10 THEN 'patch' WHEN c_nationkey < 13 THEN 'delete' END AS op FROM customer)
WHERE op IS DISTINCT FROM 'delete'
UNION ALL SELECT -s_suppkey - 1, s_name, 'supplier' FROM supplier WHERE s_nationkey < 12""",
)
def upserts(spark, folder):
    c, s = table(spark, folder, "customer"), table(spark, folder, "supplier")
    target = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    nation = F.col("c_nationkey")
    none = F.lit(None).cast("string")
    op = F.when(nation < 5, "set").when(nation < 10, "patch").otherwise("delete")
    changes = c.filter(nation < 13).select(
        F.col("c_custkey").alias("id"), op.alias("op"), F.when(nation < 5, "new").otherwise("patched").alias("name"), none.alias("segment")
    )
    added = s.select(
        (-F.col("s_suppkey") - 1).alias("id"),
        F.when(F.col("s_nationkey") < 12, "set").when(F.col("s_nationkey") < 18, "patch").otherwise("delete").alias("op"),
        F.col("s_name").alias("name"),
        F.lit("supplier").alias("segment"),
    )
    return upsert(target, changes.unionByName(added))


@query(
    "upsert_clear",
    """
SELECT c_custkey AS id, CASE WHEN c_nationkey < 10 THEN 'patched' ELSE c_name END AS name, CASE WHEN c_nationkey < 10 AND c_nationkey % 2 = 0 THEN NULL ELSE c_mktsegment END AS segment
FROM customer""",
)
def upsert_clear(spark, folder):
    """Patches that empty a field, beside those that leave it."""
    c = table(spark, folder, "customer")
    target = c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    emptied = F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("segment")))
    changes = c.filter("c_nationkey < 10").select(
        F.col("c_custkey").alias("id"), F.lit("patch").alias("op"), F.lit("patched").alias("name"), F.lit(None).cast("string").alias("segment"), emptied.alias("clear")
    )
    return upsert(target, changes, clear="clear")


@query(
    "outcomes",
    """
WITH t AS (
  SELECT c_custkey AS id, c_acctbal > 0 AS changed, c_nationkey < 8 AS store, c_nationkey % 3 <> 0 AS job, c_mktsegment = 'BUILDING' AS menu_only,
         c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 3 <> 0 AS answer FROM customer)
SELECT id, fresh, CASE WHEN fresh THEN CASE WHEN store THEN NOT job OR answer ELSE true END END AS menu_fresh,
       CASE WHEN fresh THEN CASE WHEN store THEN 'store' WHEN answer THEN 'model' END END AS item_source
FROM (SELECT *, changed AND (store OR NOT job OR answer) AS fresh FROM t)""",
)
def outcomes(spark, folder):
    c = table(spark, folder, "customer").withColumnRenamed("c_custkey", "id")
    jobs = c.filter("c_nationkey % 3 <> 0").select("id", F.when(F.col("c_mktsegment") == "BUILDING", "menu").otherwise("both").alias("mode"))
    answers = c.filter("c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey % 3 <> 0")
    out = assemble_outcomes(c.select("id"), c.filter("c_acctbal > 0"), c.filter("c_nationkey < 8"), jobs, answers, "id")
    return out.select("id", "fresh", "menu_fresh", "item_source")
