"""N-gram Jaccard join by PartEnum signatures, and the groups of near copies that it links.

A text's set holds its distinct shingles of n words (hashed to 64 bits). Sets are dealt into size bands; two sets of
Jaccard similarity t or more lie in one band or in neighbouring ones, and differ in at most k elements, where k follows
from the band (the union is at most the smaller size / t, so the difference is at most size * (1 - t) / t). The domain of
hashes is cut into n1 * n2 ranges. By the pigeonhole principle one of the n1 groups of ranges holds at most K2 of the
differences, and hence n2 - K2 of its ranges hold none: the enumerated subset of these ranges is a signature that both
sets share. Subsets in which a set has no element say nothing. With s groups more than needed, similar sets share s + 1 subsets, of
which a set with empty subsets in s groups or fewer has a full one. A set with more is partitioned again under another seed,
and only the last seed keeps signatures of empty subsets, so no pair is lost.

Equal sets are one class from the start, and a class is looked at once, by its first document. Signatures travel packed: to each range of
them a block of many texts' signatures, cut to what tells them apart there, with the ids as differences, about six bytes a signature where
texts that lie together have ids that do (see _Packer). Families are what shared signatures connect. A family travels as its members' texts, one row each, and is joined where it arrives: a member looks up those that
hold one of its rarest shingles, overlaps are counted exactly, and links unite components as they are found, so members of the
largest component need no look of their own. What comes out is a row per member, never a row per pair. A family of more than
SLICE shingles, which passages that many texts share bring about, is taken apart once more by prefix filtering: two members can
only link if they share one of so many first shingles, common ones last (see prefix_rows). What is still larger is dealt into
slices of so many shingles: see _large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm import textvec
from harrow.llm.common import BITMAP_WORDS, chunks, cut, map_arrow, might_hold, partitions, without
from harrow.llm.components import components, least_reached

#: Differences that a group of ranges may hold, and ranges of a group.
K2, N2 = 1, 3
SEEDS = 3
#: Shingles of a slice of a family, which is what one task holds at a time.
SLICE = 1 << 21
#: Signatures that a task reads, about.
PER_TASK = 1 << 22
#: Bytes of text that are looked at together.
CHUNK = 1 << 19
#: Signatures that are packed at a time, and bytes kept of each beside its range.
PACK, SIG_BYTES = 1 << 19, 5


@dataclass(frozen=True)
class Params:
    n: int = 5
    percent: int = 80
    slice_: int = SLICE


def sets(buf: np.ndarray, offs: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document; fewer than n words are one shingle, none are no set."""
    starts, ends, first = textvec.word_spans(buf, offs, textvec.NOT_SPACE)
    h = textvec.span_hashes(buf, starts, ends, lower=True)
    g = textvec.ngrams(h, n)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            s = g[a : b - n + 1].copy()
            s.sort()
            yield s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif b > a:
            yield textvec.mix(textvec.ngrams(h[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


_bands: dict[int, list[int]] = {}


def bands(percent: int, size: int) -> list[int]:
    """Upper ends of the size bands, up to one that holds `size`."""
    ends = _bands.setdefault(percent, [0])
    while ends[-1] < size:
        ends.append((ends[-1] + 1) * 100 // percent)
    return ends


_groups: dict[tuple[int, int], tuple[int, int]] = {}


def ranges(percent: int, band: int) -> tuple[int, int]:
    """Groups of ranges that a band's sets are cut into, and how many of these are more than the pigeonhole principle needs.

    Each spare group costs N2 signatures, and makes it rarer that a set has to be partitioned again. The number taken is the one with
    the fewest signatures to be expected of a set of the band's size with random hashes; it follows from percent and band alone.
    """
    if (percent, band) not in _groups:
        ends = bands(percent, 0)
        k = ends[band] * (100 - percent) // percent if band else 0
        least = -(-(k + 1) // (K2 + 1))
        size = (ends[band] + ends[band - 1]) / 2 if band else 0

        def cost(spare: int) -> float:
            n = least + spare
            empty = n * N2 * math.exp(-(N2 - K2) * size / (n * N2))
            again = math.erfc((spare + 0.5 - empty) / math.sqrt(2 * empty + 1e-9)) / 2
            return n * (1 + again + again**2)

        spare = min(range(0, least, max(1, least // 64)), key=cost) if k else 0
        _groups[percent, band] = (least + spare if k else 0, spare)
    return _groups[percent, band]


def signatures(s: np.ndarray, percent: int) -> np.ndarray:
    """The PartEnum signatures of a sorted set."""
    out = []
    ends = bands(percent, len(s))
    band = int(np.searchsorted(ends, len(s)))
    for k_seed in range(SEEDS):
        if k_seed:
            s = textvec.mix(s ^ np.uint64(k_seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            s.sort()
        total = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(textvec.mix(s + textvec.R), out=total[1:])
        empty = False
        for b in (band, band - 1):
            n1, slack = ranges(percent, b)
            if n1 == 0:
                continue  # equal sets only
            units = n1 * N2
            cuts = (np.arange(1, units, dtype=np.float64) * (2.0**64 / units)).astype(np.uint64)
            at = np.concatenate([[0], np.searchsorted(s, cuts), [len(s)]])
            part = (total[at[1:]] - total[at[:-1]]).reshape(n1, N2)
            size = np.diff(at).reshape(n1, N2)
            # K2 is 1: a subset is all ranges of a group but one
            subset = part.sum(axis=1, keepdims=True, dtype=np.uint64) - part
            full = (size.sum(axis=1, keepdims=True) - size) > 0
            tag = np.arange(units, dtype=np.uint64).reshape(n1, N2) + np.uint64(b << 32) + np.uint64(k_seed << 56)
            sig = textvec.mix(textvec.mix(subset) + tag * textvec.R)
            if k_seed < SEEDS - 1:
                empty |= int((~full).any(axis=1).sum()) > slack
                sig = sig[full]
            out.append(sig.ravel())
        if not empty:
            break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _digest(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    a, b = textvec.mix(s + textvec.R), textvec.mix(s ^ textvec.R)
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(b.sum(dtype=np.uint64).view(np.int64))


def digests(docs: DataFrame, p: Params) -> DataFrame:
    """(doc_id, n_shingles, d1, d2) of (doc_id, text); d1 and d2 are a 128-bit digest of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(len(s), *_digest(s)) for _, _, buf, offs in chunks(batch.column(1), CHUNK) for s in sets(buf, offs, p.n)]
            a = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(a[:, i]) for i in range(3))], names=["doc_id", "n_shingles", "d1", "d2"])

    return map_arrow(docs, run, f"doc_id {docs.schema[0].dataType.simpleString()}, n_shingles long, d1 long, d2 long")


class _Packer:
    """Signatures and the ids of their texts, dealt into `parts` ranges of signatures: (part, ids, sigs) of each range once in PACK signatures.

    ids are the distinct ids in order, as differences, with the number of signatures of each, in planes of bytes, compressed; sigs are the
    signatures' low 40 bits in the same order. A range has some 2^22 signatures however many there are in all, so 40 bits
    tell them apart as well at any size; two that are taken for one only bring texts into a family that are then compared in vain.
    """

    def __init__(self, parts: int):
        self.parts, self.size, self.held = parts, 0, []
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, doc: int, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((doc, sig))
        self.size += len(sig)
        if self.size >= PACK:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            return
        self.held.sort(key=lambda x: x[0])
        sig = np.concatenate([x for _, x in self.held])
        doc = np.repeat(np.array([x for x, _ in self.held], np.int64), [len(x) for _, x in self.held])
        self.held, self.size = [], 0
        part = (sig >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)
        order = np.argsort(part.astype(np.uint16 if self.parts <= 1 << 16 else np.uint32), kind="stable")
        sig, doc, part = sig[order], doc[order], part[order]
        low = np.ascontiguousarray(sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIG_BYTES])
        at = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (doc[1:] != doc[:-1])]))
        ids, count = doc[at].view(np.uint64), np.diff(at, append=len(sig)).astype("<u4")
        begin = np.flatnonzero(np.concatenate([[True], part[at][1:] != part[at][:-1]]))
        packed = []
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(at)], strict=True):
            gap = np.diff(ids[a:b], prepend=np.uint64(0)).astype("<u8")
            planes = np.concatenate([gap.view(np.uint8).reshape(-1, 8), count[a:b].view(np.uint8).reshape(-1, 4)], axis=1).T
            packed.append((self.zip.compress(planes.tobytes()), low[at[a] : at[b] if b < len(at) else len(low)].tobytes()))
        cols = [pa.array(part[at[begin]].astype(np.int32)), *(pa.array([x[i] for x in packed], pa.binary()) for i in (0, 1))]
        for k in range(0, len(packed), 256):
            yield pa.RecordBatch.from_arrays([c[k : k + 256] for c in cols], names=["part", "ids", "sigs"])


_PACKED = "part int, ids binary, sigs binary"


def _unpacked(part: int, ids: bytes, sigs: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, of which those of two ranges never meet, and the id of each."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(ids), np.uint8).reshape(12, -1).T
    gap, count = (np.ascontiguousarray(x) for x in (planes[:, :8], planes[:, 8:]))
    out = np.zeros((len(sigs) // SIG_BYTES, 8), np.uint8)
    out[:, :SIG_BYTES] = np.frombuffer(sigs, np.uint8).reshape(-1, SIG_BYTES)
    sig = out.view("<u8").ravel() | np.uint64(part << 8 * SIG_BYTES)
    return sig, np.repeat(np.cumsum(gap.view("<u8").ravel(), dtype=np.uint64).view(np.int64), count.view("<u4").ravel())


def signature_rows(docs: DataFrame, p: Params, parts: int) -> DataFrame:
    """Packed signatures of (doc_id, text): a class's signatures, from each task that has the class once, under its first document there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pack = _Packer(parts)
        for batch in batches:
            ids = batch.column(0)
            for lo, _, buf, offs in chunks(batch.column(1), CHUNK):
                for i, s in enumerate(sets(buf, offs, p.n)):
                    key = _digest(s)[0]
                    if not len(s) or key in seen or not ids[lo + i].is_valid:
                        continue
                    seen.add(key)
                    yield from pack.add(ids[lo + i].as_py(), signatures(s, p.percent))
        yield from pack.rows()

    return map_arrow(docs, run, _PACKED)


def stars(rows: DataFrame, parts: int) -> DataFrame:
    """(a, b), a < b: ids that signatures connect; what is connected here is what shares signatures, in one step or in several.

    A task gives a spanning forest of its range, so a row per id at most, however many signatures it shares there.
    Over the tasks' rows each id then names its smallest neighbour only, and the others name that one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [_unpacked(*row) for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if not got:
            return
        sig, doc = (np.concatenate(x) for x in zip(*got, strict=True))
        got.clear()
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        shared = np.zeros(len(sig) + 1, bool)  # most stand alone
        shared[1:-1] = sig[1:] == sig[:-1]
        shared = shared[1:] | shared[:-1]
        sig, doc = sig[shared], doc[order[shared]]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        hub = doc[np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))]
        other = doc != hub
        node, least = least_reached(hub[other], doc[other])
        b = node != least
        yield pa.RecordBatch.from_arrays([pa.array(least[b]), pa.array(node[b])], names=["a", "b"])

    forest = map_arrow(rows.repartitionById(parts, "part"), run, "a long, b long").distinct()
    named = forest.withColumn("m", F.min("a").over(Window.partitionBy("b")))
    edges = named.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e"))
    return edges.select("e.a", "e.b").where("a <> b").distinct()


def joined(members: list[np.ndarray], label: np.ndarray, probes: np.ndarray, percent: int) -> np.ndarray:
    """The component of each set: its label, united along links of the sets in `probes` with any other one.

    A set that reaches the similarity with x holds one of the len(x) - percent * len(x) / 100 + 1 shingles of x that are rarest here.
    Overlaps with those that do are counted over all shingles. Sets of the component that is largest by then are looked at last,
    and only if another one has become larger or sets outside it are no probes; two sets of one component are never compared.
    """
    size = np.array([len(s) for s in members])
    off = np.concatenate([[0], np.cumsum(size)])
    _, token, often = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(often[token] > 1)
    order = np.argsort(token[shared], kind="stable")
    post = np.repeat(np.arange(len(members)), size)[shared][order]
    begin = np.concatenate([[0], np.cumsum(np.where(often > 1, often, 0))])
    up = np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]]  # a first set of each label
    weight = np.bincount(up, minlength=len(up))

    def root(x: np.ndarray) -> np.ndarray:
        while True:
            y = up[x]
            if (up[y] == y).all():
                up[x] = y
                return y
            x = y

    def holders(t: np.ndarray) -> np.ndarray:
        n = begin[t + 1] - begin[t]
        return post[np.repeat(begin[t] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    main = int(np.argmax(weight))
    others = np.setdiff1d(np.arange(len(members)), probes)
    queue, last = probes, False
    while len(queue):
        later = []
        for x in queue.tolist():
            own = int(root(np.array([x]))[0])
            if own == main and weight[main] > 1 and not last:
                later.append(x)
                continue
            t = token[off[x] : off[x + 1]]
            need = -(-percent * len(t) // 100)
            rare = t[np.argpartition(often[t], len(t) - need)[: len(t) - need + 1]]
            rare = rare[often[rare] > 1]
            if not len(rare):
                continue
            near = np.unique(holders(rare))
            few, many = np.minimum(size[near], len(t)), np.maximum(size[near], len(t))
            near = near[(100 * few >= percent * many) & (root(near) != own)]
            if not len(near):
                continue
            t = t[often[t] > 1]
            if len(near) < 8:
                both = np.array([np.isin(token[off[y] : off[y + 1]], t, assume_unique=True).sum() for y in near.tolist()])
            else:
                both = np.bincount(holders(t), minlength=len(members))[near]
            near = near[100 * both >= percent * (size[near] + size[x] - both)]
            for y in np.unique(root(near)).tolist():
                a, b = sorted((own, y), key=lambda k: (-weight[k], k))
                up[b] = a
                weight[a] += weight[b]
                own = a
            if weight[own] > weight[main]:
                main = own
        later = np.array(later, np.int64)
        queue = later[root(later) != main]
        if not len(queue) and len(later) and (root(others) != main).any():
            queue, last = later, True
    return root(np.arange(len(members)))


_MEMBER = "slice long, doc_id long, label long, probe boolean, d1 long, d2 long, body binary"


def _components(rows: DataFrame, p: Params) -> DataFrame:
    """(label, component): labels of each slice's members that links unite, with the smallest of them. One slice at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, np.ndarray]] = []
        current = None
        out: list[tuple[int, int]] = []

        def end() -> None:
            if len(held) > 1:
                label = np.array([x[0] for x in held], np.int64)
                of = joined([x[2] for x in held], label, np.flatnonzero([x[1] for x in held]), p.percent)
                order = np.lexsort((label, of))
                first = np.concatenate([[True], of[order][1:] != of[order][:-1]])
                least = label[order][np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))]
                pairs = np.unique(np.stack([label[order], least], axis=1), axis=0)
                out.extend(map(tuple, pairs[pairs[:, 0] != pairs[:, 1]].tolist()))
            held.clear()

        def rows_out() -> pa.RecordBatch:
            a = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a[:, 0]), pa.array(a[:, 1])], names=["label", "component"])

        for s, _, (at, _, label, probe, *_) in _sets_of(batches, p, 6):
            if at != current:
                end()
                current = at
                if len(out) > 50_000:
                    yield rows_out()
            held.append((label, probe, s))
        end()
        yield rows_out()

    dealt = rows.repartition(partitions(rows.sparkSession), "slice").sortWithinPartitions("slice", "doc_id")
    return map_arrow(dealt, run, "label long, component long")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for whole in batches:
        for k in range(0, whole.num_rows, 512):
            b = whole.slice(k, 512)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([pack.compress((x or "").encode()) for x in b.column(1).to_pylist()], pa.binary())], names=["doc_id", "body"])


def _common(bodies: DataFrame, p: Params) -> np.ndarray:
    """A bitmap, BITMAP_WORDS words whatever the input, of shingles that some task finds in three texts or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def often() -> pa.RecordBatch:
            token, n = np.unique(np.concatenate(held or [np.zeros(0, np.uint64)]), return_counts=True)
            bit = token[n > 2] % np.uint64(BITMAP_WORDS * 64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.unique(bit).astype(np.int64))], names=["bit"])

        for s, *_ in _sets_of(batches, p, 3):
            held.append(s)
            size += len(s)
            if size > p.slice_:
                yield often()
                size = 0
        yield often()

    words = map_arrow(bodies, run, "bit long").groupBy(F.shiftrightunsigned("bit", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("m"))
    out = np.zeros(BITMAP_WORDS, np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return out.view(np.uint64)


def prefix_rows(bodies: DataFrame, common: np.ndarray, p: Params, parts: int) -> DataFrame:
    """Packed, of each class the shingles that come first where those in `common` come last, as many as a link must share one of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _Packer(parts)
        for s, _, (doc, *_) in _sets_of(batches, p, 3):
            bit = s % np.uint64(BITMAP_WORDS * 64)
            known = (common[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)
            first = s[np.lexsort((s, known))][: len(s) - -(-p.percent * len(s) // 100) + 1]
            yield from pack.add(doc, textvec.mix(first + textvec.R))  # sorted hashes come first, and would all fall into few ranges
        yield from pack.rows()

    return map_arrow(bodies, run, _PACKED)


def _sets_of(batches: Iterator[pa.RecordBatch], p: Params, at: int) -> Iterator[tuple[np.ndarray, int, tuple]]:
    """Sets of packed texts, with d1 and the row; rows whose id another text has too, of another class, are left out. d1, d2 and the text stand from `at` - 2 on."""
    unzip = zstandard.ZstdDecompressor()
    for whole in batches:
        for k in range(0, whole.num_rows, 256):
            batch = whole.slice(k, 256)
            texts = pa.array([unzip.decompress(x) for x in batch.column(at).to_pylist()], pa.large_binary()).cast(pa.large_string())
            found = (s for _, _, buf, offs in chunks(texts, CHUNK) for s in sets(buf, offs, p.n))
            for s, *row in zip(found, *(batch.column(i).to_pylist() for i in range(at)), strict=True):
                if _digest(s) == (row[at - 2], row[at - 1]):
                    yield s, row[at - 2], row


def _large(members: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """(label, component) of families of more than a slice.

    Members go by pairs of neighbouring size bands, which alone can be similar. Each such part is dealt into slices of p.slice_
    shingles, which are joined by themselves; then the members outside a part's largest component meet all its slices, each by each.
    """

    def by_size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_numpy()
            ends = np.array(bands(p.percent, int(n.max(initial=1))))
            band = np.searchsorted(ends, n)
            family = batch.column(0).to_numpy().view(np.uint64)
            for back in (0, 1):
                s = textvec.mix(family + (band - back).astype(np.uint64) * textvec.R).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(s), *batch.columns[1:]], names=["part", *batch.schema.names[1:]])

    of = lambda c, n: F.pmod(F.xxhash64(c), n)
    cuts = lambda weight: F.ceil(F.sum(weight) / p.slice_)
    rows = members.select("family", "doc_id", "n_shingles", "d1", "d2").mapInArrow(by_size, "part long, doc_id long, n_shingles long, d1 long, d2 long")
    rows = cut(rows.join(rows.groupBy("part").agg(cuts("n_shingles").alias("cuts")), "part"))
    body = lambda x: x.join(texts, "doc_id").selectExpr(*(c.split()[0] for c in _MEMBER.split(", ")))
    own = rows.withColumn("slice", F.xxhash64("part", of("doc_id", F.col("cuts")))).withColumn("label", F.col("doc_id")).withColumn("probe", F.lit(True))
    first = cut(_components(body(own), p).union(rows.selectExpr("doc_id as label", "doc_id as component").distinct()))
    labels = cut(components(first, "label", "component").withColumnRenamed("node", "doc_id").withColumnRenamed("component", "label"))
    many = rows.where("cuts > 1").join(labels, "doc_id")
    by = many.groupBy("part", "label").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("weight"))
    main = by.groupBy("part").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    outside = by.join(main, "part").where("label <> main").groupBy("part").agg(cuts("weight").alias("probes"), F.first("main").alias("main"))
    many = cut(many.join(outside, "part"))  # parts that are one component by now are done
    met = lambda mine, others: F.explode(F.sequence(F.lit(0).cast("long"), others - 1))
    a = many.where("label <> main").withColumn("x", of("doc_id", F.col("probes"))).withColumn("y", met(None, F.col("cuts"))).withColumn("probe", F.lit(True))
    b = many.withColumn("y", of("doc_id", F.col("cuts"))).withColumn("x", met(None, F.col("probes"))).withColumn("probe", F.lit(False))
    second = a.unionByName(b).withColumn("slice", F.xxhash64("part", "x", "y"))
    return first.union(labels.select("label", F.col("doc_id").alias("component"))).union(_components(body(second), p))


def _families(own: DataFrame, star: DataFrame) -> DataFrame:
    """(n_shingles, d1, d2, family, doc_id): classes that have signatures in common with others; doc_id is the smallest of a class.

    Any document of a class may be the one that signatures went under, and one id may have texts of several classes; where a class
    so comes to be in two families, they are one.
    """
    key = ["n_shingles", "d1", "d2"]
    own = own.select(*key, "doc_id")
    least = own.groupBy(*key).agg(F.min("doc_id").alias("doc_id"))
    of = own.join(components(star).withColumnRenamed("node", "doc_id"), "doc_id")
    found = cut(of.groupBy(*key).agg(F.min("component").alias("family"), F.max("component").alias("last")))
    if found.where("family < last").limit(1).count():
        links = of.join(found.select(*key, "family"), key).select("family", "component").distinct()
        one = components(links, "family", "component").withColumnRenamed("node", "family")
        found = found.join(one, "family").drop("family").withColumnRenamed("component", "family")
    return found.drop("last").join(least, key)


def _by_family(own: DataFrame, star: DataFrame, docs: DataFrame, p: Params) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(label, component) of families of a slice at most; the members of the others, if any, and their texts. Texts travel compressed."""
    members = cut(_families(own, star))
    members = cut(members.join(members.groupBy("family").agg(F.sum("n_shingles").alias("weight")), "family"))

    def texts(wanted: DataFrame) -> DataFrame:
        found = might_hold(docs, "doc_id", wanted.select("doc_id"))
        return found.select("doc_id", "body") if "body" in docs.columns else map_arrow(found, _packed, "doc_id long, body binary")

    small, large = members.where(F.col("weight") <= p.slice_), members.where(F.col("weight") > p.slice_)
    rows = small.join(texts(small), "doc_id")
    rows = rows.select(F.col("family").alias("slice"), "doc_id", F.col("doc_id").alias("label"), F.lit(True).alias("probe"), "d1", "d2", "body")
    return cut(_components(rows, p)), large if large.limit(1).count() else None, texts(large)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90, slice_: int = SLICE) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id (the smallest id that links reach, itself included).

    Two texts link when 100 * shared shingles >= percent * shingles of either. Null or empty texts, and those without
    words, have no set, and link with nothing. A null id is linked with nothing and has a null component. Rows that
    share an id are one node: links of any of them are its links. Repeated rows are copies of one class. A very long text is one
    row throughout and is held whole by one task. Ties go to the smallest id. Other columns are left behind; an empty table gives no rows.
    Shingles are compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    p = Params(n, percent, slice_)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    own = cut(digests(docs, p))
    key = ["n_shingles", "d1", "d2"]
    full = own.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    stats = full.agg(F.sum("n_shingles")).first()[0] or 0
    parts = int(max(partitions(spark), stats // PER_TASK))
    star = cut(stars(signature_rows(docs, p, parts), parts))
    labels, large, texts = _by_family(full, star, docs, p)
    if large is not None:
        bodies = cut(large.join(texts, "doc_id").select("doc_id", "d1", "d2", "body"))
        star = cut(stars(prefix_rows(bodies, _common(bodies, p), p, parts), parts))
        found, large, texts = _by_family(large, star, bodies, p)
        labels = labels.union(found)
        if large is not None:
            found = components(_large(large, texts, p), "label", "component")
            labels = labels.union(found.select(F.col("node").alias("label"), "component"))
    moved = classes.join(labels.select(F.col("label").alias("rep"), "component"), "rep", "left").where("copies > 1 or component <> rep")
    moved = moved.select(*key, F.coalesce("component", "rep").alias("component"))
    out = cut(own.join(moved, key, "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    if out.groupBy("doc_id").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).where("lo < hi").limit(1).count():
        whole = components(out, "doc_id", "component_id").withColumnRenamed("component", "least")
        out = out.join(whole, out["doc_id"] == whole["node"], "left").select("doc_id", "n_shingles", F.col("least").alias("component_id"))
    return out.withColumnRenamed("doc_id", id_col)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """docs, with all its columns, without the rows whose text is linked to one of a smaller id.

    Rows that share an id stay or go together; rows with a null id stay.
    """
    found = groups(docs, id_col, text_col, n, percent)
    return without(docs, id_col, found.where(F.col("component_id") < F.col(id_col)).select(id_col))
