"""Keys, groups and first-wins deduplication. What is first is an explicit order column."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.functions import urls


def with_key(df: DataFrame, link: str = "link", key: str = "job_key", parity: bool = True) -> DataFrame:
    return df.withColumn("__p", urls.parts(link)).withColumn(key, urls.job_key(F.col("__p"), F.col(link), parity)).drop("__p")


def group_urls(df: DataFrame, key: str, url: str, order: str) -> DataFrame:
    """(key, urls): all of a key's URLs in order. A key's list is as long as its group; see first_by_key for large ones."""
    held = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, url))).alias("g"))
    return held.select(key, F.transform("g", lambda x: x[url]).alias("urls"))


def first_by_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by order; aggregated before it is shuffled."""
    cols = [c for c in df.columns if c != key]
    held = df.groupBy(key).agg(F.min_by(F.struct(*cols), order).alias("r"))
    return held.select(key, "r.*").select(*df.columns)


def unseen(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't known. Spark broadcasts the keys if they are few, by their size."""
    return df.join(known.select(*keys).distinct(), keys, "left_anti")


def new_jobs(jobs: DataFrame, history: DataFrame, parity: bool = True, once: bool | None = None, order: str = "seq") -> DataFrame:
    """Jobs (with job_key) whose key isn't in history (link). Duplicates inside the batch go unless `parity`."""
    keyed = with_key(jobs, parity=parity)
    out = unseen(keyed, with_key(history.select("link"), parity=parity), ["job_key"])
    return out if (parity if once is None else not once) else first_by_key(out, "job_key", order)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def drop_dead(urls_: DataFrame, landed: DataFrame) -> DataFrame:
    """Known URLs without those whose document is an error; those that weren't reached stay."""
    dead = landed.where("code >= 400").select("url").distinct()
    return urls_.join(dead, "url", "left_anti")


def lookup(df: DataFrame, key: str, table: dict[str, str], out: str, default) -> DataFrame:
    """df with `out` from a small constant table, else `default` (a Column)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return df.withColumn(out, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(key)), default))
