"""Change feeds between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def added(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of new that old has fewer of, as often as that."""
    return new.exceptAll(old)


def added_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return new.join(old.select(*keys).distinct(), keys, "left_anti")


def run_stats(results: DataFrame) -> DataFrame:
    """One row: how many results there are, were skipped, what they cost, whether a deadline stopped the run."""
    skipped = F.col("status").isin("idempotent", "filtered", "invalid", "ineligible")
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(skipped).alias("skipped"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"),
        F.coalesce(F.bool_or(F.col("status") == "deadline"), F.lit(False)).alias("force_stopped"),
    )


def scan_stats(scans: DataFrame, slow_after: float = 10.0) -> DataFrame:
    """(ats, companies, failed, slow, seconds) of (ats, identifier, seconds, failed)."""
    return scans.groupBy("ats").agg(F.count("*").alias("companies"), F.count_if("failed").alias("failed"), F.count_if(F.col("seconds") >= slow_after).alias("slow"), F.sum("seconds").alias("seconds"))


def slowest(scans: DataFrame, slow_after: float = 10.0, k: int = 20) -> DataFrame:
    return scans.where(F.col("seconds") >= slow_after).orderBy(F.desc("seconds"), "identifier").limit(k)
