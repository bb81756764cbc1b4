"""Running totals that hold when one group owns most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolex.session import durable


def with_running(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    value: Column | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Add ``position`` (0-based) and ``before`` (sum of ``value`` over earlier rows).

    A plain window would sort each group in one task. Here rows are cut into
    contiguous chunks of the order, each chunk is scanned by its own task, and
    only the chunk totals (one row per group and chunk) are scanned across.

    ``chunk`` is an expression that never decreases along ``order``, such as a
    day or ``id DIV 100000``; its values should hold a task's worth of rows.
    Without it the rows are range-partitioned and kept in the checkpoint
    folder, so that both uses of the chunk numbers see the same cut.
    ``order`` must be a total order within each group.
    """
    by = list(by)
    tagged = df.withColumn("_value", F.lit(1).cast("bigint") if value is None else value)
    if chunk is None:
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ranged = tagged.repartitionByRange(parts, *by, *order)
        tagged = durable(ranged.withColumn("_chunk", F.spark_partition_id()))
    else:
        tagged = tagged.withColumn("_chunk", chunk)

    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*by, "_chunk").orderBy(*order)
    scanned = tagged.withColumns(
        {
            "_row": F.row_number().over(inside) - 1,
            "_sum": F.coalesce(F.sum("_value").over(inside.rowsBetween(*earlier)), F.lit(0)),
        }
    )
    totals = tagged.groupBy(*by, "_chunk").agg(F.count("*").alias("_rows"), F.sum("_value").alias("_total"))
    across = Window.partitionBy(*by).orderBy("_chunk").rowsBetween(*earlier)
    offsets = totals.select(
        *by,
        "_chunk",
        F.coalesce(F.sum("_rows").over(across), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_total_before"),
    )
    return (
        scanned.join(offsets, [*by, "_chunk"])
        .withColumn("position", (F.col("_rows_before") + F.col("_row")).cast("bigint"))
        .withColumn("before", F.col("_total_before") + F.col("_sum"))
        .drop("_value", "_chunk", "_row", "_sum", "_rows_before", "_total_before")
    )
