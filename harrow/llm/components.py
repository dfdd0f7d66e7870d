"""Connected components of a links table, as joins and aggregates; of few links, by one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import cut

#: Links (16 bytes each) that one task unites at most, counted first; more go round by round.
LOCAL = 1 << 20


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links, and for each the smallest one that it reaches."""
    ids, ends = np.unique(np.stack([a, b]), return_inverse=True)
    x, y = ends.reshape(2, -1)
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            return ids, ids[label]


def _by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        node, least = least_reached(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b", local: int = LOCAL) -> DataFrame:
    """(node, component): the smallest node that each node of the links reaches, itself included.

    Every round takes the smallest label among a node's neighbours and then that label's own label, so chains halve;
    it ends when a round changes nothing. Links with a null end are left out; repeated links and loops do no harm; no
    links give no rows. Labels are aggregated before they are shuffled, so a hub with many links is not one task's work.
    """
    both = cut(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null"))
    if both.count() <= local:
        return both.coalesce(1).mapInArrow(_by_one, "node long, component long")
    both = cut(both.union(both.select("v", "u")).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("label").alias("l2")), "v").groupBy("u").agg(F.min("l2").alias("l2"))
        hop = labels.join(near, "u", "left").select("u", F.col("label").alias("old"), F.least("label", "l2").alias("label"))
        root = labels.select(F.col("u").alias("label"), F.col("label").alias("l3"))
        new = cut(hop.join(root, "label", "left").select("u", F.least("label", "l3").alias("label"), "old"))
        if new.where("label <> old").limit(1).count() == 0:
            return new.select(F.col("u").alias("node"), F.col("label").alias("component"))
        labels = new.select("u", "label")
