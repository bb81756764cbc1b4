"""From flat place rows to curated candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.functions.text import clean_url, normalize_text, trim_all
from cartolex.operators.dedupe import spatial_dedupe
from cartolex.session import durable
from cartolex.vocab import rules

REASONS = ("no-name", "hidden", "closed", "low-confidence", "chain", "duplicate")


def first_reason(rules_in_order: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds; NULL when none does."""
    out = F
    for reason, holds in rules_in_order:
        out = out.when(F.coalesce(holds, F.lit(False)), F.lit(reason))
    return out


def drop_cascade(df: DataFrame, rules_in_order: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add ``reason``: the first rule that drops the row; NULL for rows that stay. One frame, so nothing is judged twice."""
    return df.withColumn("reason", first_reason(rules_in_order))


def word_prefixes(normalized: Column) -> Column:
    """Every leading run of whole words, e.g. ``a b c`` gives ``a``, ``a b`` and ``a b c``."""
    words = F.filter(F.split(normalized, " "), lambda w: w != "")
    return F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda n: F.array_join(F.slice(words, 1, n), " ")
    )


def denied_ids(df: DataFrame, id: str, names: Sequence[Column], deny: DataFrame) -> DataFrame:
    """Ids with a name that equals a deny phrase or starts with one and a space.

    The "starts with" test becomes an equality: a name is exploded into its
    word prefixes, so the join is a hash join instead of a nested loop.
    """
    phrases = deny.select(normalize_text(F.col("phrase")).alias("_p")).filter("_p <> ''").distinct()
    prefixes = F.flatten(F.array(*[word_prefixes(normalize_text(F.coalesce(n, F.lit("")))) for n in names]))
    exploded = df.select(F.col(id), F.explode(F.array_distinct(prefixes)).alias("_p")).filter("_p <> ''")
    return exploded.join(phrases, "_p", "left_semi").select(id).distinct()


def flag_ids(df: DataFrame, id: str, ids: DataFrame, flag: str) -> DataFrame:
    """Boolean ``flag``: is the row's id listed in ``ids``?"""
    listed = ids.select(F.col(id)).distinct().withColumn(flag, F.lit(True))
    return df.join(listed, id, "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def detect_kind(name: Column, category: Column, alternates: Column, roaster_categories: Sequence[str]) -> Column:
    wanted = list(roaster_categories)
    by_category = F.coalesce(category.isin(wanted), F.lit(False)) | F.coalesce(
        F.exists(alternates, lambda c: F.coalesce(c.isin(wanted), F.lit(False))), F.lit(False)
    )
    by_name = F.coalesce(normalize_text(name).rlike(rules.ROASTER_NAME), F.lit(False))
    return F.when(by_category | by_name, F.lit("roaster")).otherwise(F.lit("cafe"))


def first_website(websites: Column) -> Column:
    return F.get(F.filter(F.transform(websites, clean_url), lambda u: u.isNotNull()), F.lit(0))


def instagram_of(urls: Column) -> Column:
    found = F.get(F.filter(urls, lambda u: u.rlike(r"(?i)instagram\.com/")), F.lit(0))
    return F.regexp_replace(F.regexp_replace(found, r"[?#].*$", ""), r"/+$", "")


def state_code(region: Column) -> Column:
    return F.when(region != "", F.upper(F.regexp_replace(region, r"(?i)^US-", "")))


def project_candidate(flat: DataFrame, region_id: str, roaster_categories: Sequence[str]) -> DataFrame:
    return flat.select(
        "id",
        F.lit(region_id).alias("region_id"),
        trim_all(F.col("name")).alias("name"),
        detect_kind(F.col("name"), F.col("category"), F.col("alternates"), roaster_categories).alias("kind"),
        "lat",
        "lng",
        F.struct(
            F.col("street").alias("line1"),
            F.col("locality").alias("city"),
            state_code(F.col("region")).alias("state"),
            F.col("postcode").alias("postcode"),
        ).alias("address"),
        first_website(F.col("websites")).alias("website"),
        F.get(F.col("phones"), F.lit(0)).alias("phone"),
        instagram_of(F.concat(F.col("socials"), F.col("websites"))).alias("instagram"),
        F.col("id").alias("source_id"),
        "confidence",
        F.lit("places").alias("source"),
        F.lit(None).cast("string").alias("platform"),
    )


def apply_patch(candidates: DataFrame, patch: DataFrame) -> DataFrame:
    """Override fields that are set in ``patch``.

    A patched website is cleaned like any other; one that is rejected clears the field.
    """
    p = patch.select("id", *[F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in ("name", "kind", "website", "platform")])
    joined = candidates.join(p, "id", "left")
    return joined.withColumns(
        {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in ("name", "kind", "platform")}
        | {"website": F.when(F.col("_website").isNotNull(), clean_url(F.col("_website"))).otherwise(F.col("website"))}
    ).select(*candidates.columns)


def manual_additions(add: DataFrame, hide: DataFrame, patch: DataFrame, region_id: str) -> DataFrame:
    """Hand-made rows of the region that are not hidden; a patch can pin only their platform."""
    pinned = patch.select("id", F.nullif(F.col("platform"), F.lit("")).alias("platform"))
    return (
        add.filter(F.col("region_id") == region_id)
        .join(hide, "id", "left_anti")
        .join(pinned, "id", "left")
        .select(
            "id",
            "region_id",
            "name",
            "kind",
            "lat",
            "lng",
            F.struct(F.col("address").alias("line1")).alias("address"),
            clean_url(F.col("website")).alias("website"),
            F.lit("manual").alias("source"),
            "platform",
        )
    )


def order_by_name(df: DataFrame, name: str = "name", id: str = "id") -> DataFrame:
    """Locale-aware name order, ties by id."""
    return df.orderBy(F.collate(F.col(name), "UNICODE"), F.col(id))


def curate(
    flat: DataFrame,
    region_id: str,
    *,
    deny: DataFrame,
    hide: DataFrame,
    patch: DataFrame,
    add: DataFrame,
    roaster_categories: Sequence[str] = tuple(rules.ROASTER_CATEGORIES),
    min_confidence: float = rules.MIN_CONFIDENCE,
    dedupe_m: float = rules.DEDUPE_METERS,
) -> tuple[DataFrame, DataFrame]:
    """(candidates, drops): cascade, de-duplication, patches, then manual rows."""
    marked = flag_ids(flat, "id", hide, "_hidden")
    marked = flag_ids(marked, "id", denied_ids(flat, "id", [F.col("name"), F.col("brand")], deny), "_chain")
    name = trim_all(F.coalesce(F.col("name"), F.lit("")))
    judged = drop_cascade(
        marked,
        [
            ("no-name", name == ""),
            ("hidden", F.col("_hidden")),
            ("closed", F.col("operating_status").isin(rules.CLOSED_STATUSES)),
            ("low-confidence", F.col("confidence") < min_confidence),
            ("chain", F.col("_chain")),
        ],
    )
    # Kept and dropped rows both come from here: judged once, stored once.
    judged = durable(judged)
    dropped = judged.filter("reason IS NOT NULL")
    candidates = project_candidate(judged.filter("reason IS NULL"), region_id, roaster_categories)
    unlike = spatial_dedupe(
        candidates,
        "id",
        normalize_text(F.col("name")),
        F.col("lng"),
        F.col("lat"),
        [-F.coalesce(F.col("confidence"), F.lit(0.0)), F.col("website").isNull().cast("int")],
        dedupe_m,
    )
    drops = dropped.select("id", name.alias("name"), "reason").unionByName(
        unlike.filter(~F.col("kept")).select("id", "name", F.lit("duplicate").alias("reason"))
    )
    unique = apply_patch(unlike.filter("kept").drop("kept"), patch)
    manual = manual_additions(add, hide, patch, region_id)
    address_type = unique.schema["address"].dataType
    manual = manual.withColumn(
        "address",
        F.struct(*[(F.col("address.line1") if f.name == "line1" else F.lit(None).cast(f.dataType)).alias(f.name) for f in address_type.fields]),
    )
    return unique.unionByName(manual, allowMissingColumns=True), drops


def multi_location(df: DataFrame, name: Column, order: Sequence[Column | str], threshold: int) -> DataFrame:
    """Names found at ``threshold`` places or more, shown as first seen."""
    ranks = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return (
        df.groupBy(normalize_text(name).alias("key"))
        .agg(F.min_by(name, ranks).alias("name"), F.count("*").alias("count"))
        .filter(F.col("count") >= threshold)
        .select("name", "count")
        .orderBy(F.desc("count"), F.collate(F.col("name"), "UNICODE"))
    )
