"""Order, ids, batches, top rows per group."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, group: str, order: list[Column], k: int = 20, total: str = "total", rank: str = "rank") -> DataFrame:
    """The first k rows of each group, their rank, and how many rows the group has.

    Totals are a separate aggregate, so that only k rows of a group per task are sorted and shuffled (a group limit).
    """
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col(rank) <= k)
    totals = df.groupBy(group).agg(F.count("*").alias(total))
    return ranked.join(totals, group)


def ditto(value: Column, group: list[str], order: list[Column], mark: str = "↳") -> Column:
    """The mark where the row before in the group has the same value."""
    before = F.lag(value).over(W.partitionBy(*group).orderBy(*order))
    return F.when(before.eqNullSafe(value) & value.isNotNull(), mark).otherwise(value)


def _kept(df: DataFrame) -> DataFrame:
    """A checkpoint in spark.checkpoint.dir; in a temporary folder only where that is unset and Spark is local."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="harrow-checkpoint-"))
    return df.checkpoint(eager=True)


def assign_ids(df: DataFrame, start: int, order: list[Column], ident: str = "id") -> DataFrame:
    """Consecutive ids from start + 1 in order. Rows are dealt by ranges of the order, and each range is numbered from where the one before ends.

    df is a checkpoint first, as sampling it for the ranges would compute it (and ask a model) twice; so are the dealt rows, as other samples give other ranges.
    """
    dealt = _kept(_kept(df).repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    sizes = dealt.groupBy("__p").agg(F.count("*").alias("__n"))  # a row per range
    before = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__before"))
    n = F.row_number().over(W.partitionBy("__p").orderBy(*order)).cast("long")
    numbered = dealt.withColumn(ident, n).join(F.broadcast(before), "__p")
    return numbered.withColumn(ident, F.col(ident) + F.col("__before") + int(start)).drop("__p", "__before")


def current_id(history: DataFrame, order: str = "seq") -> int:
    """The id of the latest row that has one, else 0."""
    row = history.where("id is not null").agg(F.max_by("id", order).alias("id")).first()
    return int(row.id or 0)


def batches(df: DataFrame, key: list[str], order: list[Column], size: int = 50) -> DataFrame:
    """df with batch and index (from 0) within it, numbered inside each key."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1
    return df.withColumn("__n", n).withColumn("batch", F.floor(F.col("__n") / size).cast("long")).withColumn("index", (F.col("__n") % size).cast("long")).drop("__n")


def category_order(found: list[str], wanted: list[str]) -> list[str]:
    """Wanted categories first, in their order, then the others by name; none is last."""
    rest = sorted(c for c in found if c not in wanted and c != "None")
    return [c for c in wanted if c in found] + rest + (["None"] if "None" in found else [])
