"""Run reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.vocab.enums import MENU_CATEGORIES


def count_by(df: DataFrame, section: str, key: Column) -> DataFrame:
    """(section, key, value): rows per key."""
    return df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("value")).select(
        F.lit(section).alias("section"), "key", "value"
    )


def failed_ratio(crawls: DataFrame, status: str = "status") -> DataFrame:
    """Share of failed crawls among the entities that have a site."""
    sited = F.col(status) != "no-site"
    return crawls.agg(
        F.count_if(F.col(status) == "error").alias("failed"), F.count_if(sited).alias("with_site")
    ).withColumn(
        "ratio", F.when(F.col("with_site") > 0, F.col("failed") / F.col("with_site")).otherwise(F.lit(0.0))
    )


def run_report(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of (section, key, value) metric rows."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def report_markdown(title: str, report: DataFrame, listed: dict[str, DataFrame] | None = None, lines_each: int = 40) -> str:
    """Markdown for people; ``listed`` tables (one text column) show ``lines_each`` lines and say how many there are.

    The report itself has a few rows per section, fixed by the vocabularies, and is shown whole.
    """
    lines = [f"## {title}", ""]
    sections: dict[str, list[str]] = {}
    for row in report.orderBy("section", F.desc("value"), "key").collect():
        sections.setdefault(row.section, []).append(f"{row.key} {row.value}")
    lines += [f"- **{name}:** {' · '.join(values)}" for name, values in sections.items()]
    for name, table in (listed or {}).items():
        total = table.count()
        if total:
            shown = [str(r[0]) for r in table.limit(lines_each).collect()]
            lines += ["", f"### {name} ({total})", *[f"- {s}" for s in shown]]
            lines += [f"- and {total - len(shown)} more"] * (total > len(shown))
    return "\n".join(lines)


def group_menu(menu: DataFrame, within: Sequence[str], order: Sequence[str], category: str = "category") -> DataFrame:
    """Menu rows in the fixed category order, with ``category_label``; empty categories do not appear."""
    place, label = F, F
    for i, (c, text) in enumerate(MENU_CATEGORIES.items()):
        place = place.when(F.col(category) == c, F.lit(i))
        label = label.when(F.col(category) == c, F.lit(text))
    placed = menu.withColumns({"category_ord": place, "category_label": label}).filter("category_ord IS NOT NULL")
    return placed.orderBy(*within, "category_ord", *order)
