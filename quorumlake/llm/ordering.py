"""Global positions of sorted rows by DataFrame operations only: prefix sums over totals of partitions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import fit_partitions, written


def positions(df: DataFrame, order: list[Column], sums: dict[str, str], within: list[str] | None = None, name: str = "positions") -> DataFrame:
    """df with prefix sums in the given order.

    sums: a new column for each, with the sum of the named column over all rows before this one (of the same values of
    within, if given). The rows are range-partitioned and written once with the number of their partition, so that the
    totals and the rows agree on it; only one row for each partition (and value of within) meets in the second step.
    Rows equal in all of order lie in any order.
    """
    within = within or []
    parts = fit_partitions(df)
    kept = [f"_s{i}" for i in range(len(sums))]
    table = df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    here = Window.partitionBy("_part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumns({k: F.coalesce(F.sum(v).over(here), F.lit(0)) for k, v in zip(kept, sums.values(), strict=True)})
    table = written(table, name)
    totals = table.groupBy("_part", *within).agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(f"_t{i}") for i, v in enumerate(sums.values())])
    if within:
        before = Window.partitionBy(*within)
    else:
        before = Window.partitionBy(F.lit(0))
    before = before.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("_part").alias("_of"), *[F.col(w).alias(f"_w{i}") for i, w in enumerate(within)],
        *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))],
    )
    same = table["_part"] == totals["_of"]
    for i, w in enumerate(within):
        same = same & table[w].eqNullSafe(totals[f"_w{i}"])
    joined = table.join(totals, same)
    return joined.select(*df.columns, *[(F.col(k) + F.col(f"_b{i}")).alias(new) for i, (k, new) in enumerate(zip(kept, sums, strict=True))])
