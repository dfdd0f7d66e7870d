"""Benchmark decontamination: binary search of every test suffix in suffix arrays of the training shards.

Words are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters. A training shard (a run of texts in
one task) gets a word-level suffix array, sparse in that it holds only the suffixes whose first words occur in the
benchmark at all: no other can be reached by the search. Each suffix of each benchmark item is then searched for in it, word
by word, which narrows the range of equal suffixes; ranges that reach the window length are verbatim matches, and
runs of matches on one diagonal are merged to the longest ones.

Nothing is shuffled: the benchmark is the stated query set, sent out in blocks of a bounded size, and training texts
stay in their tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import textvec
from harrow.llm.common import chunks, map_arrow

WINDOW = 10
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 32 << 20
_HEAD = 4
_NO_DOC, _NO_ITEM = np.uint64(0), np.uint64(1)


class Suffixes:
    """The test suffixes of one block: `need` first words of each must match."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = [t.encode() for _, t in items]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        buf = np.frombuffer(b"".join(texts), np.uint8)
        starts, ends, first = textvec.word_spans(buf, offs, textvec.ALNUM)
        h = textvec.span_hashes(buf, starts, ends, lower=True)
        n = np.diff(first)
        item = np.repeat(np.arange(len(items)), n)
        place = np.arange(len(h)) - first[:-1][item]
        short = n[item] < window
        keep = np.where(short, place == 0, place <= n[item] - window)
        self.ids = [i for i, _ in items]
        self.item, self.place = item[keep], place[keep]
        self.need = np.where(short, n[item], window)[keep]
        at = np.flatnonzero(keep)
        self.words = np.full((window, len(at)), _NO_ITEM, np.uint64)
        for d in range(window):
            ok = d < self.need
            self.words[d, ok] = h[at[ok] + d]
        long = self.need >= _HEAD
        head = self.words[0].copy()
        for d in range(1, min(_HEAD, window)):
            head = head * textvec.R + self.words[d]
        self.heads = np.unique(textvec.mix(head[long])) if window >= _HEAD else np.zeros(0, np.uint64)
        self.short_heads = np.unique(self.words[0][~long]) if window >= _HEAD else np.unique(self.words[0])
        self.window = window


def _among(values: np.ndarray, sorted_set: np.ndarray) -> np.ndarray:
    if not len(sorted_set):
        return np.zeros(len(values), bool)
    at = np.searchsorted(sorted_set, values)
    at[at == len(sorted_set)] = 0
    return sorted_set[at] == values


def shard_matches(h: np.ndarray, first: np.ndarray, s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word place in the shard, test suffix) where the suffix's needed words stand verbatim."""
    end = np.repeat(first[1:], np.diff(first))
    pick = _among(h, s.short_heads)
    if len(h) >= _HEAD:
        g = textvec.ngrams(h, _HEAD)
        pick[: len(g)] |= _among(g, s.heads)
    at = np.flatnonzero(pick)
    none = np.zeros(0, np.int64)
    if not len(at) or not len(s.need):
        return none, none
    columns = []
    for d in range(s.window):
        i = np.minimum(at + d, len(h) - 1)
        columns.append(np.where(at + d < end[at], h[i], _NO_DOC))
    order = np.lexsort(columns[::-1])
    at, columns = at[order], [c[order] for c in columns]
    lo, hi = np.zeros(len(s.need), np.int64), np.full(len(s.need), len(at), np.int64)
    live = np.arange(len(s.need))
    for d in range(s.window):
        live = live[(s.need[live] > d) & (hi[live] > lo[live])]
        if not len(live):
            break
        lo[live], hi[live] = _narrow(columns[d], lo[live], hi[live], s.words[d, live])
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return at[np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]], which


def _narrow(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each sorted range of the column that equals the word; binary search of all ranges in step."""
    out = []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while True:
            open_ = a < b
            if not open_.any():
                break
            mid = (a + b) >> 1
            v = column[np.minimum(mid, len(column) - 1)]
            below = ((v <= word) if right else (v < word)) & open_
            a = np.where(below, mid + 1, a)
            b = np.where(open_ & ~below, mid, b)
        out.append(a)
    return out[0], out[1]


def _scan(batch_text: pa.Array, blocks: list[Suffixes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, list]]:
    """For each run of rows: its first row, words of each document, hit flags per word, matches of each block."""
    for lo, _, buf, offs in chunks(batch_text, 1 << 20):
        starts, ends, first = textvec.word_spans(buf, offs, textvec.ALNUM)
        h = textvec.span_hashes(buf, starts, ends, lower=True)
        edge = np.zeros(len(h) + 1, np.int64)
        found = []
        for s in blocks:
            at, which = shard_matches(h, first, s)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + s.need[which], -1)
            found.append((s, at, which))
        yield lo, first, np.cumsum(edge[:-1]) > 0, found


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The benchmark in blocks of BLOCK_BYTES at most; it is read through an iterator, partition by partition."""
    block, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where(F.col("t").isNotNull())
    for r in rows.toLocalIterator():
        if size and size + len(r.t) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(("null" if r.i is None else r.i, r.t))
        size += len(r.t)
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, item_ids (distinct, sorted as strings), contaminated, matches.

    matches: array of (item_id, doc_word, item_word, length), the longest verbatim matches of `window` words or more
    (or of a whole shorter item). Null and empty texts have no words, and nothing is hit; an empty benchmark hits
    nothing; repeated rows are judged each; a null item_id counts as the id "null"; other columns are left behind.
    A benchmark over BLOCK_BYTES is searched for block by block, within the same pass over the texts.
    """
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(b) for b in _items(benchmark, item_id, item_text)]
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Suffixes(b.value, window) for b in sent]
        kind = pa.list_(pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            n = batch.num_rows
            words, hits = np.zeros(n, np.int64), np.zeros(n, np.int64)
            matches: list[list[dict]] = [[] for _ in range(n)]
            for lo, first, hit, found in _scan(batch.column(1), blocks):
                k = len(first) - 1
                words[lo : lo + k] = np.diff(first)
                hits[lo : lo + k] = np.diff(np.concatenate([[0], np.cumsum(hit)])[first])
                for s, at, which in found:
                    for row, m in _longest(s, at, which, first):
                        matches[lo + row].append(m)
            ids = [sorted({m["item_id"] for m in ms}) for ms in matches]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(hits), pa.array(ids, pa.list_(pa.string())), pa.array(hits > 0), pa.array(matches, kind)], names=["id", "n_words", "n_hit", "item_ids", "contaminated", "matches"])

    out = map_arrow(docs.select(F.col(id_col), F.col(text_col)), run, f"id {id_type}, n_words long, n_hit long, item_ids array<string>, contaminated boolean, matches array<struct<item_id:string,doc_word:long,item_word:long,length:long>>")
    return out.withColumnRenamed("id", id_col)


def _longest(s: Suffixes, at: np.ndarray, which: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, dict]]:
    if not len(at):
        return
    item, place = s.item[which], s.place[which]
    doc = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((at, at - place, item, doc))
    at, item, place, doc, need = at[order], item[order], place[order], doc[order], s.need[which][order]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (at[1:] != at[:-1] + 1) | (place[1:] != place[:-1] + 1)
    begin = np.flatnonzero(new)
    last = np.concatenate([begin[1:], [len(at)]]) - 1
    for b, e in zip(begin, last, strict=True):
        yield int(doc[b]), {"item_id": s.ids[item[b]], "doc_word": int(at[b] - first[doc[b]]), "item_word": int(place[b]), "length": int(at[e] - at[b] + need[e])}


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, that no benchmark window occurs in. Texts without words stay."""
    sc = docs.sparkSession.sparkContext
    sent = [sc.broadcast(b) for b in _items(benchmark, item_id, item_text)]
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Suffixes(b.value, window) for b in sent]
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for lo, first, hit, _ in _scan(batch.column(at), blocks):
                clean[lo : lo + len(first) - 1] = np.diff(np.concatenate([[0], np.cumsum(hit)])[first]) == 0
            yield batch.filter(pa.array(clean))

    return map_arrow(docs, run, docs.schema)


def items_digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
