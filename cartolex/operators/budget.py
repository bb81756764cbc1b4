"""Write budgets and documents that must fit a byte limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolex.operators.running import with_running
from cartolex.vocab.enums import MAX_DOCUMENT_BYTES


def write_budget(
    changes: DataFrame, order: Sequence[str], budget: int, cost: Column | None = None, chunk: Column | None = None
) -> DataFrame:
    """Add ``accepted``: writes in order until the first that would exceed the budget; none after it."""
    priced = changes.withColumn("_cost", F.lit(1).cast("bigint") if cost is None else cost.cast("bigint"))
    run = with_running(priced, order, value=F.col("_cost"), chunk=chunk)
    return run.withColumn("accepted", F.col("before") + F.col("_cost") <= budget).drop("_cost", "position", "before")


def fit_counts(base_bytes: Column, sizes: Sequence[Column], max_bytes: int = MAX_DOCUMENT_BYTES) -> Column:
    """How many members of each nested list to keep so that the document fits.

    ``sizes`` are arrays of member sizes in bytes; ``base_bytes`` is the
    document with all lists empty. All lists shrink to four fifths, rounded
    down, until the document fits or the lists are empty.
    """
    zero = F.lit(0).cast("bigint")

    def list_bytes(lens: Column, n: Column) -> Column:
        total = F.aggregate(F.slice(lens, F.lit(1), n), zero, lambda a, x: a + x.cast("bigint"))
        return total + F.greatest(n - 1, F.lit(0))

    names = [f"n{i}" for i in range(len(sizes))]
    start = F.struct(*[F.size(s).alias(n) for n, s in zip(names, sizes)], F.lit(False).alias("fits"))

    def shrink(state: Column, _: Column) -> Column:
        size = base_bytes.cast("bigint")
        for n, s in zip(names, sizes):
            size = size + list_bytes(s, state[n])
        kept = [state[n].alias(n) for n in names]
        smaller = [F.floor(state[n] * F.lit(0.8)).cast("int").alias(n) for n in names]
        return (
            F.when(state["fits"], state)
            .when(size > max_bytes, F.struct(*smaller, F.lit(False).alias("fits")))
            .otherwise(F.struct(*kept, F.lit(True).alias("fits")))
        )

    # A list of n members is empty after fewer steps than this, whatever n is; the sums of all steps are five lists at most.
    longest = F.greatest(F.lit(1), *[F.size(s) for s in sizes])
    steps = (4 * F.ceil(F.log2(longest + 1)) + 8).cast("int")
    return F.aggregate(F.sequence(F.lit(1), steps), start, shrink)


def fit_bytes(
    docs: DataFrame, lists: Sequence[str], base_bytes: Column, max_bytes: int = MAX_DOCUMENT_BYTES
) -> DataFrame:
    """Trim the nested ``lists`` of each document; add ``trimmed``."""
    sizes = [F.transform(F.col(c), lambda x: F.octet_length(F.to_json(x)).cast("bigint")) for c in lists]
    fitted = docs.withColumn("_fit", fit_counts(base_bytes, sizes, max_bytes))
    lost = F.lit(False)
    for i, c in enumerate(lists):
        lost = lost | (F.col(f"_fit.n{i}") < F.size(c))
    fitted = fitted.withColumn("trimmed", lost)
    return fitted.withColumns(
        {c: F.slice(F.col(c), F.lit(1), F.col(f"_fit.n{i}")) for i, c in enumerate(lists)}
    ).drop("_fit")
