"""Numbering of rows in a total order by many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut


def with_ordinal(rows: DataFrame, out: str, *order: str | Column) -> DataFrame:
    """``rows`` with their place from 0 in the given order as ``out``.

    Rows are range-sorted over the tasks; each task numbers its own and is told
    how many lie before it, in a table with one row a task.
    """
    base = rows.drop(out)
    ranged = cut(base.repartitionByRange(*order).withColumn("_task", F.spark_partition_id()))
    inside = Window.partitionBy("_task").orderBy(*order)
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = ranged.groupBy("_task").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    placed = ranged.withColumn("_inside", F.row_number().over(inside) - 1).join(F.broadcast(tasks), "_task")
    return placed.select(*base.columns, (F.col("_before") + F.col("_inside")).alias(out))
