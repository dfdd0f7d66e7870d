"""Suffix-array deduplication of byte strings of LENGTH bytes, by bucket-pointer refinement.

A string that repeats across documents holds one anchor at the same place wherever it stands: of its 8-byte grams the
leftmost with the least hash names, modulo a step, the start of a 30-byte gram (a mod-minimizer). So

1. each task lists the anchors of its texts (about one in 15 bytes) as hashes, and anchors with two different texts or more
   are found by hash ranges;
2. around these anchors only, texts give the suffixes whose first LENGTH bytes belong to the anchor, and the suffixes of one
   range of anchors are sorted by bucket-pointer refinement up to that depth: buckets of equal 8-byte grams are refined by
   sorting on the bucket pointers of the suffixes 8, 16 and 18 bytes later, each pass on what the one before has updated;
3. in a final bucket the document with the smallest id keeps its bytes, and the others' are marked.

Equal texts are one text from the start. A task sends an anchor, and a suffix range with its surroundings, once however many of its texts
hold it, and answers for the others itself; so a passage that a third of all documents share is a few rows a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import chunks, cut, might_hold, partitions
from harrow.llm.textvec import R, mix

LENGTH = 50
GRAM, STEP = 8, 21
ANCHOR = LENGTH - STEP + 1
#: Bytes around an anchor's start that its strings can reach.
BEFORE, AFTER = STEP - 1, LENGTH
WIDTH = BEFORE + AFTER
#: Anchors that a task gathers before it sends them.
FLUSH = 1_500_000
#: Bytes of text for which there is a range of anchors to list, and one to sort. So many ranges, and rows, come from the data alone.
LISTED, SORTED = 32 << 20, 8 << 20
#: Parts of a range that a task sorts one after the other.
SUB = 4
#: Parts of which each copy of a text joins one.
SALTS = 16
KEY = 16
#: Bytes of a digest that listings carry; should two texts share them, both get a needless look.
SHORT = 8


def grams(buf: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one integer; zeros follow the end."""
    padded = np.concatenate([buf, np.zeros(GRAM, np.uint8)])
    return np.ndarray(len(buf), "<u8", padded, strides=(1,)).copy()


#: Places of which the least hash is sought at a time.
MOST_PLACES = 1 << 28
_BACK = np.arange(LENGTH) % STEP


def anchor_of_windows(code: np.ndarray) -> np.ndarray:
    """For each place the anchor's start of the LENGTH bytes from there on; short by LENGTH - 1 places."""
    n = len(code) - GRAM + 1
    need = LENGTH - GRAM + 1
    if n < need:
        return np.zeros(0, np.int64)
    out = np.empty(n - need + 1, np.int64)
    low = np.uint64(MOST_PLACES - 1)
    for first in range(0, len(out), MOST_PLACES - need):
        # the place stands below the hash, so that the least is the leftmost of the least
        v = (code[first : min(n, first + MOST_PLACES)] + R) * R
        v ^= v >> np.uint64(31)
        v *= R
        v &= ~low
        v |= np.arange(len(v), dtype=np.uint64)
        span = 1
        while span < need:
            s = min(span, need - span)
            v = np.minimum(v[s:], v[:-s])
            span += s
        p = np.arange(len(v))
        back = (v & low).astype(np.int64) - p
        part = out[first : first + MOST_PLACES - need]
        part[:] = (first + p + _BACK[back])[: len(part)]
    return out


def anchors(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors of all strings inside documents, their hashes, and for each place its window's anchor and whether there is one."""
    code = grams(buf)
    a = anchor_of_windows(code)
    doc_end = np.repeat(offs[1:], np.diff(offs))[: len(a)]
    inside = np.arange(len(a)) + LENGTH <= doc_end
    mask = np.zeros(len(buf), bool)
    mask[a[inside]] = True
    at = np.flatnonzero(mask)
    h = mix(code[at])
    for d in (8, 16, ANCHOR - 8):
        h = mix(h * R + code[at + d])
    return at, h, a, inside


def _digest(buf: np.ndarray) -> bytes:
    return hashlib.sha256(buf).digest()[:KEY]


def _cut6(h: np.ndarray) -> np.ndarray:
    """The upper 48 bits: what is kept of an anchor's hash."""
    return h >> np.uint64(16)


def _to6(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from6(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _low(h48: np.ndarray) -> np.ndarray:
    """What an answer says of an anchor's hash: enough among those of one text, where a mistake only means a needless look."""
    return (h48 & np.uint64(0xFFFFFFFF)).astype("<u4")


def _range(h48: np.ndarray, n: int) -> np.ndarray:
    return ((h48 >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _by_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """h in the order of doc, the documents, and how many each has."""
    order = np.argsort(doc, kind="stable")
    which, n = np.unique(doc, return_counts=True)
    return h[order], which, n


_LISTS = pa.schema([("p", pa.int32()), ("known", pa.bool_()), ("digests", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])


def _listing(docs: DataFrame, n: int) -> DataFrame:
    """Anchors of (text), by range of hashes; rows with `known` are answers: anchors that two texts of the task hold."""

    def rows(keys: list[bytes], doc: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        many = np.zeros(len(h), bool)
        many[:-1] |= ~first[1:]
        many |= ~first
        out: list[tuple] = []

        def put(p: int, known: bool, d: np.ndarray, x: np.ndarray) -> None:
            x, which, count = _by_doc(d, x)
            out.append((p, known, b"".join([keys[k][:SHORT] for k in which]), np.minimum(count, 65535).astype("<u2").tobytes() + count[count >= 65535].astype("<i4").tobytes(), _low(x).tobytes() if known else _to6(x)))

        if many.any():
            put(int(h[0] % np.uint64(n)), True, doc[many], h[many])
        part = _range(h, n)  # grows with h
        cuts = np.searchsorted(part, np.arange(n + 1))
        for p in range(n):
            s = slice(cuts[p], cuts[p + 1])
            if first[s].any():
                put(p, False, doc[s][first[s]], h[s][first[s]])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _LISTS.types, strict=True)], schema=_LISTS) if out else pa.RecordBatch.from_pylist([], schema=_LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        keys: list[bytes] = []
        got: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column(0), 1 << 20):
                at, h, _, _ = anchors(buf, offs)
                doc = np.searchsorted(offs, at, side="right") - 1
                name = np.full(len(offs) - 1, -1)
                for i in np.unique(doc).tolist():
                    k = _digest(buf[offs[i] : offs[i + 1]])
                    if k not in seen:
                        seen.add(k)
                        name[i] = len(keys)
                        keys.append(k)
                new = name[doc] >= 0
                got.append((name[doc[new]].astype(np.int32), _cut6(h[new])))
                size += int(new.sum())
                if size > FLUSH:
                    yield rows(keys, *(np.concatenate(x) for x in zip(*got, strict=True)))
                    keys, got, size = [], [], 0
        if size:
            yield rows(keys, *(np.concatenate(x) for x in zip(*got, strict=True)))

    return docs.mapInArrow(run, "p int, known boolean, digests binary, counts binary, hashes binary")


def _shared(listing: DataFrame, blocks: int, n: int) -> DataFrame:
    """(short, hashes): of each text, by the first bytes of its digest, anchors that another text holds too; one row a text.

    Answers go from ranges of hashes to blocks of texts, whose number follows the bytes of text, so that a row holds the answers
    for all texts of a block; there are never more rows than texts with answers in a range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, int] = {}
        doc, h = [], []
        for batch in batches:
            for r in batch.to_pylist():
                keys = [r["digests"][i : i + SHORT] for i in range(0, len(r["digests"]), SHORT)]
                count = np.frombuffer(r["counts"][: 2 * len(keys)], "<u2").astype(np.int64)
                count[count == 65535] = np.frombuffer(r["counts"][2 * len(keys) :], "<i4")
                if r["known"]:
                    yield answers(keys, np.repeat(np.arange(len(keys)), count), np.frombuffer(r["hashes"], "<u4"))
                else:
                    x = _from6(r["hashes"])
                    own = np.array([names.setdefault(k, len(names)) for k in keys], np.int32)
                    doc.append(np.repeat(own, count))
                    h.append(x)
        if doc:
            d, x = np.concatenate(doc), np.concatenate(h)
            order = np.argsort(x)
            d, x = d[order], x[order]
            begin = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
            many = np.repeat(np.minimum.reduceat(d, begin) != np.maximum.reduceat(d, begin), np.diff(np.append(begin, len(x))))
            if many.any():
                yield answers(list(names), d[many], _low(x[many]))

    def answers(keys: list[bytes], doc: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        block = np.frombuffer(b"".join(k[:4] for k in keys), ">u4").astype(np.int64) * blocks >> 32
        order = np.argsort(block, kind="stable")
        rank = np.empty(len(keys), np.int64)
        rank[order] = np.arange(len(keys))
        h, which, count = _by_doc(rank[doc], h)
        which = order[which]
        b, first = np.unique(block[which], return_index=True)
        edges, at = np.append(first, len(which)), np.concatenate([[0], np.cumsum(count)])
        cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))
        columns = [
            pa.array(b, pa.int64()), pa.array([b"".join(keys[k][:SHORT] for k in which[x:y]) for x, y in cuts], pa.binary()),
            pa.array([count[x:y].astype("<u4").tobytes() for x, y in cuts], pa.binary()), pa.array([h[at[x] : at[y]].tobytes() for x, y in cuts], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["b", "digests", "counts", "hashes"])

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                held.setdefault(r.pop("b"), []).append(r)
        for b in sorted(held):
            texts: dict[bytes, list[bytes]] = {}
            for r in held.pop(b):
                at = np.concatenate([[0], np.cumsum(np.frombuffer(r["counts"], "<u4"), dtype=np.int64)]) * 4
                for i, (x, y) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    texts.setdefault(r["digests"][i * SHORT : (i + 1) * SHORT], []).append(r["hashes"][x:y])
            yield pa.RecordBatch.from_arrays([pa.array([k.hex() for k in texts]), pa.array([[b"".join(x)] for x in texts.values()], pa.list_(pa.binary()))], names=["short", "hashes"])

    found = listing.repartition(n, "p").mapInArrow(run, "b long, digests binary, counts binary, hashes binary")
    return found.repartition(n, "b").mapInArrow(regroup, "short string, hashes array<binary>")


_POWER = 2.0 ** np.arange(STEP)
_SUFFIXES = pa.schema([("p", pa.int32()), ("known", pa.bool_()), ("digests", pa.binary()), ("reps", pa.binary()), ("doc", pa.binary()), ("place", pa.binary()), ("windows", pa.binary()), ("cuts", pa.binary()), ("around", pa.list_(pa.binary()))])


def _suffixes(held: DataFrame, n: int) -> DataFrame:
    """Of (digest, rep, text, hashes): the surroundings of shared anchors, by range; rows with `known` are answers."""

    def rows(keys: list[bytes], reps: list[int], parts: list[tuple]) -> pa.RecordBatch:
        doc, place, h, windows, around = (np.concatenate(x) for x in zip(*parts, strict=True))
        rep = np.array(reps, np.int64)
        # what stands in the same surroundings as in a smaller document of the task is answered here
        same = mix(h ^ windows.astype(np.uint64))
        for c in range(0, WIDTH - 7, 8):
            same = mix(same * R + np.ascontiguousarray(around[:, c : c + 8]).view("<u8").ravel())
        same = mix(same * R + np.ascontiguousarray(around[:, WIDTH - 8 :]).view("<u8").ravel())
        order = np.lexsort((rep[doc], same, h))
        doc, place, h, windows, around, same = (x[order] for x in (doc, place, h, windows, around, same))
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (same[1:] != same[:-1])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        answered = rep[doc] > rep[doc[lead]]
        out = []
        cuts = np.searchsorted(_range(h, n), np.arange(n + 1))
        zip_ = zstandard.ZstdCompressor(level=1)
        if answered.any():
            row, o = _bits(windows[answered])
            of, run = _runs(doc[answered][row], place[answered][row] - o)
            which, count = np.unique(of, return_counts=True)
            out.append((int(h[0] % np.uint64(n)), True, b"".join(keys[k] for k in which), b"", count.astype("<i4").tobytes(), run.tobytes(), b"", b"", []))
        for p in range(n):
            pick = np.arange(cuts[p], cuts[p + 1])
            pick = pick[~answered[pick]]
            if len(pick):
                which, local = np.unique(doc[pick], return_inverse=True)
                ends = np.searchsorted(_range(h[pick], n * SUB), p * SUB + np.arange(SUB + 1))
                bodies = [zip_.compress(around[pick[x:y]].tobytes()) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                out.append((p, False, b"".join(keys[k] for k in which), rep[which].tobytes(), local.astype("<i4").tobytes(), place[pick].astype("<u4").tobytes(), windows[pick].astype("<u4").tobytes(), ends.astype("<u4").tobytes(), bodies))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _SUFFIXES.types, strict=True)], schema=_SUFFIXES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        keys, reps, parts, size = [], [], [], 0
        unzip = zstandard.ZstdDecompressor()
        for batch in (whole.slice(k, 500) for whole in batches for k in range(0, whole.num_rows, 500)):
            digest, rep, lists = (batch.column(i).to_pylist() for i in (0, 1, 3))
            texts = pa.array([unzip.decompress(x) for x in batch.column(2).to_pylist()], pa.large_binary()).cast(pa.large_string())
            for lo, _, buf, offs in chunks(texts, 1 << 20):
                at, h, a, inside = anchors(buf, offs)
                if not len(at):
                    continue
                h = _cut6(h)
                doc = np.searchsorted(offs, at, side="right") - 1
                name = np.full(len(offs) - 1, -1)
                wanted = []
                for i in range(len(offs) - 1):
                    if digest[lo + i] not in seen:
                        seen.add(digest[lo + i])
                        name[i] = len(keys)
                        keys.append(bytes.fromhex(digest[lo + i]))
                        reps.append(rep[lo + i])
                        wanted.append(np.frombuffer(b"".join(lists[lo + i]), "<u4").astype(np.uint64) | np.uint64(i << 32))
                if not wanted:
                    continue
                mine = np.isin(_low(h) | (doc.astype(np.uint64) << np.uint64(32)), np.concatenate(wanted))
                if not mine.any():
                    continue
                # bit o: the string that starts o bytes before the anchor is the anchor's
                p = np.flatnonzero(inside)
                windows = np.bincount(np.searchsorted(at, a[p]), weights=_POWER[a[p] - p], minlength=len(at)).astype(np.int64)[mine]
                x, hx, doc = at[mine], h[mine], doc[mine]
                padded = np.concatenate([np.zeros(BEFORE, np.uint8), buf, np.zeros(AFTER, np.uint8)])
                around = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[x]
                edge = np.flatnonzero((x - BEFORE < offs[doc]) | (x + AFTER > offs[doc + 1]))
                column = x[edge, None] + np.arange(-BEFORE, AFTER)[None, :]
                around[edge] = np.where((column < offs[doc[edge], None]) | (column >= offs[doc[edge] + 1, None]), 0, around[edge])
                parts.append((name[doc].astype(np.int32), x - offs[doc], hx, windows, around))
                size += len(x)
                if size > FLUSH // 6:
                    yield rows(keys, reps, parts)
                    keys, reps, parts, size = [], [], [], 0
        if size:
            yield rows(keys, reps, parts)

    return held.mapInArrow(run, "p int, known boolean, digests binary, reps binary, doc binary, place binary, windows binary, cuts binary, around array<binary>")


def refine(code: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """Bucket-pointer refinement of the suffixes that begin at `start`, up to `depth` bytes: bucket numbers, -1 where a bucket has one suffix.

    `code` holds the 8-byte grams of all places, and is looked at once, for the initial buckets. From then on a suffix has a pointer,
    the place of its bucket's first one in sorted order. Suffixes that agree on n bytes are refined by sorting on the pointers of
    the suffixes n bytes later; the new pointers are written back, and the next pass, at twice the offset, sorts on those. The last
    offset is such that depth is met exactly. Places that later passes look up are refined along with `start`.
    """
    lengths = [GRAM]
    while lengths[-1] < depth:
        lengths.append(min(depth, 2 * lengths[-1]))
    needed = [np.zeros(len(code), bool)]
    needed[0][start] = True
    for short, long in zip(lengths[-2::-1], lengths[:0:-1], strict=True):
        more = needed[-1].copy()
        more[long - short :] |= needed[-1][: len(code) - (long - short)]
        needed.append(more)
    pointer = np.zeros(len(code), np.int64)
    for short, long in zip([0, *lengths], lengths, strict=False):
        live = np.flatnonzero(needed.pop())
        key = pointer[live] * len(code) + pointer[live + long - short] if short else code[live]
        order = np.argsort(key)
        at, key = live[order], key[order]
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        pointer[at] = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    own = pointer[start]
    return np.where(np.bincount(own, minlength=1)[own] > 1, own, -1) if len(own) else own


def _runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of consecutive starts of each document: the document, and start * 256 + length."""
    both = np.sort(doc.astype(np.int64) << 32 | start.astype(np.int64))
    doc, start = (both >> 32).astype(np.int32), both & 0xFFFFFFFF
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(doc)) - 1
    length = start[last] - start[at] + 1
    more = -(-length // 255)  # longer runs are several
    part = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    head, left = np.repeat(start[at], more) + 255 * part, np.repeat(length, more) - 255 * part
    return np.repeat(doc[at], more), (head.astype(np.int64) << 8) | np.minimum(left, 255)


def _marks(suffixes: DataFrame, n: int) -> DataFrame:
    """(digest, starts): where in a text strings of LENGTH bytes begin that a document with a smaller id holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                keys = [r["digests"][i : i + KEY] for i in range(0, len(r["digests"]), KEY)]
                if r["known"]:
                    cuts = np.concatenate([[0], np.cumsum(np.frombuffer(r["doc"], "<i4"))])
                    runs = np.frombuffer(r["place"], np.int64)
                    yield answers(keys, [runs[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
                else:
                    held.setdefault(r["p"], []).append(r | {"keys": keys})
        for p in sorted(held):  # a part of a range at a time; the others wait compressed
            rows = held.pop(p)
            for k in range(SUB):
                yield from sort(rows, k)

    def sort(rows: list[dict], k: int) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, int] = {}
        reps: list[int] = []
        parts: list[tuple] = []
        for r in rows:
            x, y = np.frombuffer(r["cuts"], "<u4")[k : k + 2].tolist()
            if x == y:
                continue
            for name, rep in zip(r["keys"], np.frombuffer(r["reps"], np.int64).tolist(), strict=True):
                if name not in names:
                    names[name] = len(names)
                    reps.append(rep)
            own = np.array([names[name] for name in r["keys"]], np.int32)
            around = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["around"][k]), np.uint8)
            parts.append((own[np.frombuffer(r["doc"], "<i4")[x:y]], np.frombuffer(r["place"], "<u4")[x:y].astype(np.int64), np.frombuffer(r["windows"], "<u4")[x:y], around))
        if not parts:
            return
        doc, place, windows, buf = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        row, o = _bits(windows)
        bucket = refine(grams(buf), row * WIDTH + BEFORE - o, LENGTH)
        kept = bucket >= 0
        row, o, bucket = row[kept], o[kept], bucket[kept]
        rep = np.array(reps, np.int64)[doc[row]]
        least = np.full(len(buf), np.iinfo(np.int64).max)
        np.minimum.at(least, bucket, rep)
        gone = rep > least[bucket]
        if gone.any():
            of, runs = _runs(doc[row[gone]], place[row[gone]] - o[gone])
            which, at = np.unique(of, return_index=True)
            keys = list(names)
            yield answers([keys[k] for k in which], np.split(runs, at[1:]))

    def answers(keys: list[bytes], runs: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k.hex() for k in keys], pa.string()), pa.array([x.tobytes() for x in runs], pa.binary())], names=["digest", "starts"])

    return suffixes.repartition(n, "p").mapInArrow(run, "digest string, starts binary")


def _bits(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero((windows[:, None] >> np.arange(STEP, dtype=np.uint32)) & 1)


def cover(text: bytes, runs: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of the text, and the maximal runs (start, end) that strings cover whose starts are in `runs`, see _runs()."""
    start, length = runs >> 8, runs & 255
    edge = np.zeros(len(text) + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length - 1 + LENGTH, -1)
    gone = np.cumsum(edge[:-1]) > 0
    flip = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    spans = list(zip(flip[::2].tolist(), flip[1::2].tolist(), strict=True))
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), spans


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    zip_ = zstandard.ZstdCompressor(level=3)
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            b = whole.slice(k, 500)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([zip_.compress(x.encode()) for x in b.column(2).to_pylist()], pa.binary())], names=["id", "digest", "text"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept_sha256, and spans: array of (start, end), in bytes.

    A byte is removed if a string of LENGTH bytes covers it that also begins in a row with a smaller id; matches don't cross rows,
    and are judged on the input. A null text is an empty one. A row with a null id is left whole and removes nothing;
    rows that share an id remove nothing of one another. Other columns are left behind.
    """
    n = partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("sha", F.sha2("text", 256)).withColumn("digest", F.substring("sha", 1, 2 * KEY))
    own = cut(rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "sha", "digest"))
    long_rows = rows.where((F.octet_length("text") >= LENGTH) & F.col("id").isNotNull())
    reps = cut(own.where((F.col("n_bytes") >= LENGTH) & F.col("id").isNotNull()).groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.max("n_bytes").alias("n_bytes")))
    size = reps.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = -(-size // LISTED) or 1
    answers = _shared(_listing(long_rows.select("text"), ranges), ranges, n)
    shared = cut(answers.join(reps.select("digest", F.substring("digest", 1, 2 * SHORT).alias("short"), F.col("rep").alias("id")), "short").drop("short"))
    # the first text of each class travels, compressed, and once: both joins below read one exchange, by id, which copies don't share
    texts = might_hold(long_rows.select("id", "digest", "text"), "id", shared.select("id")).mapInArrow(_packed, "id long, digest string, text binary")
    held = texts.join(shared, ["id", "digest"]).select("digest", F.col("id").alias("rep"), "text", "hashes")
    marks = _marks(_suffixes(held, -(-size // SORTED) or 1), n).groupBy("digest").agg(F.collect_list("starts").alias("starts"))
    marks = marks.join(reps.select("digest", F.col("rep").alias("id")), "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for digest, text, starts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if digest in seen:
                    continue
                seen.add(digest)
                left, spans = cover(unzip.decompress(text), np.frombuffer(b"".join(starts), "<i8"))
                out.append((digest, sum(e - s for s, e in spans), hashlib.sha256(left).hexdigest(), [{"start": s, "end": e} for s, e in spans]))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), kind))], names=["digest", "n_removed", "kept", "spans"])

    touched = texts.join(marks, ["id", "digest"]).select("digest", "text", "starts")
    changed = touched.mapInArrow(run, "digest string, n_removed long, kept string, spans array<struct<start:long,end:long>>").dropDuplicates(["digest"])
    # copies join one of SALTS parts of their class; texts that are too short have no class and are dealt out by id
    salt = F.when(F.col("n_bytes") >= LENGTH, F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.xxhash64("id"))
    many = reps.where("copies > 1").select("digest", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    first = changed.join(reps.select("digest", F.col("rep").alias("first")), "digest").select("first", F.col("digest").alias("of"), "n_removed", "kept", "spans")
    out = own.withColumn("salt", salt).join(many, ["digest", "salt"], "left")
    out = out.join(first, (F.col("id") == F.col("first")) & (F.col("digest") == F.col("of")), "left")
    copy = F.col("id") > F.col("rep")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:long,end:long>>")
    mine = F.col("kept").isNotNull()
    return out.select(
        F.col("id").alias(id_col),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).when(mine, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(copy, 1).when(mine, F.size("spans")).otherwise(0).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit(""), 256)).when(mine, F.col("kept")).otherwise(F.col("sha")).alias("kept_sha256"),
        F.when(copy, whole).when(mine, F.col("spans")).otherwise(none).alias("spans"),
    )


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all their columns, whose texts have lost the repeats; bytes that are no whole character after a cut are dropped.

    Ids must be unique here; null texts stay null.
    """
    found = repeats(docs, id_col, text_col).where("n_removed > 0").select(F.col(id_col).alias("__id"), "spans").distinct()
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out = []
            for t, s in zip(texts, spans, strict=True):
                if s:
                    b, parts, last = t.encode(), [], 0
                    for x in s:
                        parts.append(b[last : x["start"]])
                        last = x["end"]
                    t = b"".join([*parts, b[last:]]).decode(errors="ignore")
                out.append(t)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) if i != at else pa.array(out, pa.string()) for i in range(batch.num_columns - 1))], names=names)

    both = docs.join(found, docs[id_col] == F.col("__id"), "left").drop("__id")
    return both.mapInArrow(run, docs.schema)
