"""Labels shown next to a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolex.functions.geo import KM_PER_MILE
from cartolex.functions.numbers import days_between
from cartolex.vocab.countries import COUNTRIES
from cartolex.vocab.enums import FLAVOR_FAMILIES, KINDS, ROAST_LEVELS

GRAMS_PER_OUNCE = 28.3495


def choose(c: Column, labels: dict[str, str]) -> Column:
    out = F
    for value, label in labels.items():
        out = out.when(c == value, F.lit(label))
    return out


def updated_label(last: Column, now: Column) -> Column:
    days = F.floor(days_between(last, now)).cast("int")
    ago = lambda n, unit: F.format_string(f"Updated %d {unit} ago", n.cast("int"))
    return (
        F.when(days.isNull(), "Not updated yet")
        .when(days <= 0, "Updated today")
        .when(days == 1, "Updated yesterday")
        .when(days < 14, ago(days, "days"))
        .when(days < 60, ago(F.floor(days / 7), "weeks"))
        .otherwise(ago(F.floor(days / 30), "months"))
    )


def price_label(price: Column, grams: Column) -> Column:
    whole = price == F.floor(price)
    money = F.when(whole, F.format_string("$%d", price.cast("bigint"))).otherwise(F.format_string("$%.2f", price))
    ounces = grams / F.lit(GRAMS_PER_OUNCE)
    pounds = F.regexp_replace(F.format_string("%.1f", ounces / 16), r"\.0$", "")
    weight = F.when(ounces >= 15.5, F.concat(pounds, F.lit(" lb"))).otherwise(
        F.format_string("%d oz", F.floor(ounces + 0.5).cast("bigint"))
    )
    parts = F.concat_ws(" · ", F.when(price.isNotNull(), money), F.when(grams > 0, weight))
    return F.nullif(parts, F.lit(""))


def roast_step(level: Column) -> Column:
    """Position 1 to 5 on the roast bar; the all-purpose roast sits in the middle."""
    steps = {name: i + 1 for i, name in enumerate(ROAST_LEVELS)} | {"omni": 3}
    out = F
    for name, step in steps.items():
        out = out.when(level == name, F.lit(step))
    return out


def country_label(code: Column) -> Column:
    return F.coalesce(choose(code, {c: name for c, (name, _) in COUNTRIES.items()}), code)


def origin_label(countries: Column, is_blend: Column, region: Column) -> Column:
    names = F.array_join(F.transform(countries, country_label), ", ")
    base = F.when(is_blend & (F.size(countries) > 1), F.concat(F.lit("Blend · "), names)).otherwise(names)
    with_region = F.when(F.coalesce(region, F.lit("")) != "", F.concat_ws(" · ", base, region)).otherwise(base)
    return (
        F.when(F.size(countries) > 0, with_region)
        .when(is_blend, F.lit("Blend"))
        .otherwise(F.lit("Origin not listed"))
    )


def distance_label(km: Column) -> Column:
    miles = km / F.lit(KM_PER_MILE)
    return F.when(miles < 10, F.format_string("%.1f mi", miles)).otherwise(
        F.format_string("%d mi", F.floor(miles + 0.5).cast("bigint"))
    )


def kind_label(kind: Column) -> Column:
    return choose(kind, KINDS)


def row_subtitle(status: Column, count: Column) -> Column:
    counted = F.when(count == 1, F.lit("1 bean")).otherwise(F.format_string("%d beans", count.cast("bigint")))
    return F.when(status == "beans", counted).when(status == "menu-only", "Menu only").otherwise("No bean info yet")


def top_families(families: Column, most: int = 3) -> Column:
    """Labels of the first few top-level families."""
    tops = F.array_distinct(F.transform(families, lambda f: F.split(f, "/")[0]))
    return F.transform(F.slice(tops, 1, most), lambda f: choose(f, FLAVOR_FAMILIES))
