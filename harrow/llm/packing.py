"""Sum-of-squares packing of token sequences.

Each piece goes to the open bin after which the sum over residual gaps of (bins open with that gap) squared is least; a
new bin is opened when none has room. The heuristic needs counts of bins by gap only, so a task keeps max_len counters
and lists, and a piece costs one vector operation. Pieces are dealt out at random over tasks, long ones first within a
task, and each task packs by itself; its open bins at the end are what dealing costs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import bpe
from harrow.llm.common import cut, map_arrow, partitions

MAX_LEN = 1024
EOS = 2
#: Pieces that one packing task takes, about: 24 bytes each.
PER_TASK = 400_000


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, eos: int = EOS) -> DataFrame:
    """(id, row_key, piece, start, length, ids) for each piece of each row; ids are little-endian unsigned 32-bit integers.

    A text's ids are followed by `eos`; one longer than max_len is cut into pieces of max_len, of which the first
    may be shorter. A null text is an empty one. row_key tells rows apart that share an id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end = np.array([eos], "<u4")
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                rows, no, start, length, ids = [], [], [], [], []
                for i, x in enumerate(encoder.batch(bpe.texts_of(batch.column(2)))):
                    x = np.concatenate([x.astype("<u4"), end])
                    a = 0
                    b = len(x) % max_len or min(len(x), max_len)
                    while a < len(x):
                        rows.append(i)
                        no.append(0 if a == 0 else no[-1] + 1)
                        start.append(a)
                        length.append(b - a)
                        ids.append(x[a:b].tobytes())
                        a, b = b, b + max_len
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(no, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    names=["id", "row_key", "piece", "start", "length", "ids"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row_key"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"id {kind}, row_key long, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


_encoders: dict[str, bpe.Encoder] = {}


def _encoder(path: str) -> bpe.Encoder:
    if path not in _encoders:
        _encoders[path] = bpe.Encoder(path)
    return _encoders[path]


_NEVER = np.iinfo(np.int64).max


def sum_of_squares(lengths: np.ndarray, max_len: int = MAX_LEN) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, placed in the given order.

    Putting a piece of length s into a bin of gap g changes the sum of squares by 1 - 2 N(g) for the gap that goes and
    by 1 + 2 N(g - s) for the gap that comes (no gap comes if it fills the bin); of equal changes the smallest gap left is taken.
    A bin is opened only when no open one has room: with long pieces first this takes fewer bins than weighing a new bin
    like the others.
    """
    count = np.zeros(max_len + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(max_len + 1)]
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n_bins = 0
    for k, s in enumerate(lengths.tolist()):
        # gaps s..max_len - 1 before the piece, 0..max_len - 1 - s after it
        before, after = count[s:max_len], count[: max_len - s]
        change = np.where(before > 0, 2 * (after - before + 1), _NEVER)
        if s < max_len and before[0]:
            change[0] = 1 - 2 * before[0]  # a full bin has no gap that would count
        left = int(change.argmin()) if len(change) else 0
        gap = left + s
        if not len(change) or change[left] == _NEVER:
            left, gap, b = max_len - s, max_len, n_bins
            n_bins += 1
        else:
            b = stacks[gap].pop()
            count[gap] -= 1
        bins[k], offsets[k] = b, max_len - gap
        if left:
            stacks[left].append(b)
            count[left] += 1
    return bins, offsets


def place(parts: DataFrame, max_len: int = MAX_LEN, length_col: str = "length", order: list[str] | None = None) -> DataFrame:
    """parts, with all their columns, and sequence_id and offset of each. Lengths are 1 to max_len; full pieces are sequences of their own.

    `order` names columns that settle the order among pieces of one length, so that a task that runs again packs alike.
    """
    spark = parts.sparkSession
    n = max(1, -(-parts.count() // PER_TASK))
    order = order or [c for c in parts.columns if c != length_col]
    dealt = parts.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(n))).repartition(n, "__salt").drop("__salt")
    at = dealt.columns.index(length_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        got = list(batches)
        if not got:
            return
        t = pa.Table.from_batches(got)
        t = t.sort_by([(length_col, "descending"), *((c, "ascending") for c in order)])
        bins, offsets = sum_of_squares(t.column(at).to_numpy(), max_len)
        base = TaskContext.get().partitionId() << 40
        for b in t.append_column("sequence_id", pa.array(bins + base)).append_column("offset", pa.array(offsets)).to_batches():
            yield b

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return map_arrow(dealt, run, f"{ddl}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, eos: int = EOS, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and the ids themselves if asked for.

    Every row of docs is packed, repeated rows and rows with null ids or texts too (a null or empty text is its `eos`
    alone). Other columns are left behind. An empty table gives no rows.
    """
    parts = pieces(docs, tokenizer, id_col, text_col, max_len, eos).withColumn("ids_crc32", F.crc32("ids"))
    parts = cut(parts if with_ids else parts.drop("ids"))
    out = place(parts, max_len, order=[id_col, "row_key", "piece"])
    return out.select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, input_ids, n_tokens) of pack(with_ids=True): the pieces' ids one after the other, little-endian."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("n_tokens"))
    return held.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("input_ids"), "n_tokens")
