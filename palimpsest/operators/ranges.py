"""Ranges of an ordered column, by which work on one long key is dealt over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def default_cells(spark) -> int:
    return 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def cell_of(rows: DataFrame, column: str, cells: int | None = None) -> Column:
    """The number of the range of a numeric column that a row lies in; ranges hold about equally many rows, null is in
    the first. The driver holds one number a range."""
    cells = cells or default_cells(rows.sparkSession)
    cuts = sorted(set(rows.approxQuantile(column, [k / cells for k in range(1, cells)], 0.1 / cells))) if cells > 1 else []
    if not cuts:
        return F.lit(0)

    @F.pandas_udf("int")
    def cell(x):
        import numpy as np
        import pandas as pd

        return pd.Series(np.where(x.isna(), 0, np.searchsorted(np.array(cuts), x.to_numpy(np.float64, na_value=-np.inf), side="right")).astype(np.int32))

    return cell(F.col(column).cast("double"))


def running_total(rows: DataFrame, key: str, order: str, value: Column, name: str, cells: int | None = None) -> DataFrame:
    """The rows with ``name``: the sum of ``value`` over a key's rows before, by a numeric column without ties.

    A key's total before a range comes from one row a range, so no task sums a whole key.
    """
    own = rows.withColumns({"__value": value, "__cell": cell_of(rows, order, cells)})
    sums = own.groupBy(F.col(key).alias("__key"), F.col("__cell").alias("__c")).agg(F.sum("__value").alias("__sum"))
    before = sums.select("__key", "__c", (F.sum("__sum").over(Window.partitionBy("__key").orderBy("__c")) - F.col("__sum")).alias("__before"))
    local = F.sum("__value").over(Window.partitionBy(key, "__cell").orderBy(order)) - F.col("__value")
    met = own.withColumn("__local", local).join(before, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__cell") == F.col("__c")))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__before") + F.col("__local")).alias(name))
