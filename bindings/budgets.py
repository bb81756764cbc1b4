"""Work planning, budgets, byte limits and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings import query, table
from bindings.places import CASCADE_SQL, _judged
from bindings.shared import PLACES_SQL
from cartolex.functions.numbers import json_bytes
from cartolex.operators.budget import fit_bytes, write_budget
from cartolex.operators.jobs import job_pages, pack_context, plan_jobs
from cartolex.operators.keep import take_budget
from cartolex.operators.report import count_by, failed_ratio, run_report
from cartolex.operators.shards import shard_by_bytes


@query(
    "context_pack",
    """
WITH r AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
           FROM conversations WHERE length(text) > 0),
p AS (SELECT *, substr(text, 1, CAST(2000 - before AS BIGINT)) AS piece FROM r WHERE before < 2000)
SELECT conv_id, count(*) AS pieces, CAST(sum(length(piece)) AS BIGINT) AS chars,
       sha256(string_agg('--- PAGE (' || role || ')' || chr(10) || piece, chr(10) || chr(10) ORDER BY turn)) AS hash FROM p GROUP BY 1""",
)
def context(spark, folder):
    header = F.concat(F.lit("--- PAGE ("), "role", F.lit(")"))
    out = pack_context(
        table(spark, folder, "conversations"), "conv_id", ["turn"], "text", 2000, header, chunk=F.floor(F.col("turn") / 1000)
    )
    return out.select("conv_id", "pieces", F.col("chars").cast("bigint").alias("chars"), F.sha2("context", 256).alias("hash"))


# Documents as the pages of their source; language and label give the kind.
KIND_SQL = """
docs AS (
  SELECT source AS id, doc_id, text,
         CASE WHEN quality = 1 AND source IN ('src1', 'src2', 'src3', 'src5', 'src8') THEN 'coffee' WHEN toxic = 1 AND source <> 'src7' THEN 'menu'
              WHEN lang = 'es' THEN 'products-json' WHEN lang = 'fr' THEN 'pdf' WHEN source IN ('src4', 'src7') THEN 'home' ELSE 'note' END AS kind
  FROM documents LEFT JOIN labels USING (doc_id)),
kinds AS (
  SELECT id, bool_or(kind IN ('coffee', 'shop')) AS items, bool_or(kind IN ('menu', 'pdf')) AS menu, bool_or(kind = 'home') AS home
  FROM docs WHERE length(trim(text, ' ')) > 40 AND kind <> 'products-json' GROUP BY 1),
jobs AS (
  SELECT id, CASE WHEN NOT stocked AND items THEN 1 WHEN stocked AND menu THEN 2 WHEN NOT stocked AND (menu OR home) THEN 3 END AS priority
  FROM (SELECT *, id IN ('src2', 'src6', 'src7', 'src9', 'src11') AS stocked, id = 'src13' AS blocked FROM kinds) WHERE NOT blocked)"""


def _site_pages(spark, folder):
    docs = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
    source = F.col("source")
    kind = (
        F.when((F.col("quality") == 1) & source.isin("src1", "src2", "src3", "src5", "src8"), "coffee")
        .when((F.col("toxic") == 1) & (source != "src7"), "menu")
        .when(F.col("lang") == "es", "products-json")
        .when(F.col("lang") == "fr", "pdf")
        .when(source.isin("src4", "src7"), "home")
        .otherwise("note")
    )
    pages = docs.select(source.alias("id"), "doc_id", "text", kind.alias("kind"))
    sites = pages.select("id").distinct().select(
        "id",
        F.when(F.col("id") == "src13", "blocked-robots").otherwise("ok").alias("status"),
        F.col("id").isin("src2", "src6", "src7", "src9", "src11").alias("has_items"),
    )
    return sites, pages


@query(
    "plan_jobs",
    f"WITH {KIND_SQL} SELECT id, CASE WHEN priority = 2 THEN 'menu' ELSE 'both' END AS mode, priority FROM jobs WHERE priority IS NOT NULL",
)
def planned(spark, folder):
    return plan_jobs(*_site_pages(spark, folder), "id")


@query(
    "job_pages",
    f"""WITH {KIND_SQL},
p AS (SELECT d.id, doc_id, priority, CASE WHEN kind IN ('coffee', 'shop') THEN 0 WHEN kind IN ('menu', 'pdf') THEN 1 WHEN kind = 'home' THEN 2 END AS section
      FROM docs d JOIN jobs j ON j.id = d.id WHERE length(trim(text, ' ')) > 40 AND kind <> 'products-json')
SELECT id, doc_id, section FROM p WHERE section IS NOT NULL AND (priority = 1 OR priority = 2 AND section = 1 OR priority = 3 AND section > 0)""",
)
def pages_of_jobs(spark, folder):
    sites, pages = _site_pages(spark, folder)
    return job_pages(plan_jobs(sites, pages, "id"), pages, "id").select("id", "doc_id", "section")


@query(
    "take_budget",
    """
SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) <= 50 AS taken FROM documents""",
)
def taken(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    done, skipped = take_budget(docs, [F.desc("n_chars"), F.col("doc_id")], 50, "doc_id")
    return done.withColumn("taken", F.lit(True)).unionByName(skipped.withColumn("taken", F.lit(False)))


@query(
    "write_budget",
    """
SELECT doc_id, sum(octet_length(encode(text))) OVER (ORDER BY doc_id) <= (SELECT sum(octet_length(encode(text))) / 2 FROM documents) AS accepted FROM documents""",
)
def writes(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", F.octet_length("text").alias("cost"))
    half = docs.agg((F.sum("cost") / 2).cast("bigint")).first()[0]
    out = write_budget(docs, ["doc_id"], half, F.col("cost"), chunk=F.floor(F.col("doc_id") / 100_000))
    return out.select("doc_id", "accepted")


@query(
    "byte_shards",
    """
WITH RECURSIVE d AS (SELECT source AS region, doc_id, octet_length(encode(text)) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
fold(region, n, doc_id, used, shard) AS (
  SELECT region, n, doc_id, 40 + size, 0::BIGINT FROM d WHERE n = 1
  UNION ALL
  SELECT d.region, d.n, d.doc_id, CASE WHEN used + size + 1 > 20000 THEN 40 + size ELSE used + size + 1 END, shard + CASE WHEN used + size + 1 > 20000 THEN 1 ELSE 0 END
  FROM fold JOIN d ON d.region = fold.region AND d.n = fold.n + 1)
SELECT region, doc_id, shard FROM fold""",
)
def shards(spark, folder):
    docs = table(spark, folder, "documents").select(F.col("source").alias("region"), "doc_id", F.octet_length("text").alias("size"))
    return shard_by_bytes(
        docs, F.col("region"), ["doc_id"], F.col("size"), 40, 20_000, chunk=F.floor(F.col("doc_id") / 100_000)
    ).select("region", "doc_id", "shard")


_FIT = 1400


@query(
    "fit_bytes",
    f"""
WITH RECURSIVE f(id, n, step) AS (
  SELECT doc_id, CAST(len(string_split(text, ' ')) AS BIGINT), 0 FROM documents
  UNION ALL
  SELECT id, CAST(floor(n * 0.8::DOUBLE) AS BIGINT), step + 1 FROM f WHERE 10 + n * 12 + greatest(n - 1, 0) > {_FIT} AND n > 0)
SELECT id, min(n) AS members, max(step) > 0 AS trimmed FROM f GROUP BY 1""",
)
def fitted(spark, folder):
    # One member of fixed size per word of the document: {"w":"abcd"} is 12 bytes.
    member = F.struct(F.lit("abcd").alias("w"))
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.transform(F.split("text", " ", -1), lambda _: member).alias("members")
    )
    out = fit_bytes(docs, ["members"], F.lit(10), _FIT)
    return out.select("id", F.size("members").cast("bigint").alias("members"), "trimmed")


@query(
    "json_size",
    """
SELECT p_partkey, CAST(octet_length(encode('{"p_name":"' || p_name || '","p_size":' || p_size || ',"é":"ü' || p_type || '"}')) AS BIGINT) AS bytes FROM part""",
)
def sizes(spark, folder):
    row = [F.col("p_name"), F.col("p_size"), F.concat(F.lit("ü"), "p_type").alias("é"), F.lit(None).cast("string").alias("gone")]
    return table(spark, folder, "part").select("p_partkey", json_bytes(*row).alias("bytes"))


@query(
    "run_report",
    f"""WITH {PLACES_SQL}, {CASCADE_SQL}
SELECT 'dropped' AS section, reason AS key, count(*) AS value FROM judged WHERE reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'orders', o_orderstatus, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'events', event_type, count(*) FROM events GROUP BY 2""",
)
def report(spark, folder):
    dropped = _judged(spark, folder).filter("reason IS NOT NULL")
    return run_report(
        [
            count_by(dropped, "dropped", F.col("reason")),
            count_by(table(spark, folder, "orders"), "orders", F.col("o_orderstatus")),
            count_by(table(spark, folder, "events"), "events", F.col("event_type")),
        ]
    )


@query(
    "failed_ratio",
    """
SELECT count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type <> 'signup') AS with_site,
       round(count(*) FILTER (event_type = 'error') / count(*) FILTER (event_type <> 'signup'), 9) AS ratio FROM events""",
)
def failures(spark, folder):
    status = F.when(F.col("event_type") == "signup", "no-site").when(F.col("event_type") == "error", "error").otherwise("ok")
    out = failed_ratio(table(spark, folder, "events").select(status.alias("status")))
    return out.withColumn("ratio", F.round("ratio", 9))
