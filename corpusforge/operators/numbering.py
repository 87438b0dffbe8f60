"""Row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.session import checkpointed


def numbered(rows: DataFrame, group: list[str], order: list[str | Column], name: str = "n") -> DataFrame:
    """Numbers from 1 within each group, by ``order``, which must tell rows apart.

    Rows are dealt by ranges of group and order, so a large group lies in several parts; each part numbers its own
    rows, and the counts of the parts before are added.
    """
    dealt = checkpointed(rows.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return dealt.withColumn("_own", own).join(first, same).select(*[dealt[c] for c in rows.columns], (F.col("_first") + F.col("_own")).cast("int").alias(name))
