"""Global order without a single task: row numbers, prefix sums, ranks, and exact top-k of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom.session import stored

#: Rows up to which a top-k is taken by heaps in memory; larger ones by range partitions.
HEAP_ROWS = 10_000


def running(df: DataFrame, order: list[Column], value: Column | None = None, pos: str = "pos", cum: str = "cum") -> DataFrame:
    """Adds ``pos`` (row number from 1) and, for a value, ``cum`` (its inclusive prefix sum), in a total order.

    Rows are range-partitioned by the order and numbered within partitions; the sums of the
    partitions, one row each, are added. The partitions are written once, because their borders are sampled.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part, off = "__part", "__off"
    cols = {part: F.spark_partition_id()}
    parts = stored(df.withColumn("__value", value if value is not None else F.lit(0.0)).repartitionByRange(n, *order).withColumns(cols), "running")
    sums = parts.groupBy(part).agg(F.count("*").alias("n"), F.sum("__value").alias("s"))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(off), F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias(off + "s"))
    w = Window.partitionBy(part).orderBy(*order)
    out = parts.join(F.broadcast(offs), part).withColumn(pos, F.col(off) + F.row_number().over(w))
    if value is not None:
        out = out.withColumn(cum, F.col(off + "s") + F.sum("__value").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop(part, off, off + "s", "__value")


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of a total order."""
    if k <= 0:
        return df.limit(0)
    if k <= HEAP_ROWS:
        return df.orderBy(*order).limit(k)
    return running(df, order, pos="__pos").where(F.col("__pos") <= k).drop("__pos")


def average_percentile(df: DataFrame, score: str, out: str = "pct") -> DataFrame:
    """Average rank of equal scores, scaled to 0..1 by ``(rank - 1) / (n - 1)``; 0.5 for one row."""
    counts = df.groupBy(score).agg(F.count("*").alias("__c"))
    ranks = running(counts, [F.col(score).asc()], F.col("__c").cast("double"), "__p", "__cum")
    n = df.count()
    pct = F.lit(0.5) if n <= 1 else (F.col("__cum") - (F.col("__c") - 1) / 2 - 1) / F.lit(n - 1)
    return df.join(ranks.withColumn(out, pct).select(score, out), score)
