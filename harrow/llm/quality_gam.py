"""Quality classifier: a generalised additive model with pairwise interactions.

Each text has a row of features. A feature is cut into bins at its quantiles; boosting goes round the features in turn,
and each turn grows one shallow tree (a few cuts) on that feature's bins by gradients and hessians of the log loss and adds its
leaf values to the feature's lookup table. Pairs of features whose cut planes lessen the remaining loss most then get
two-dimensional tables in the same way. A score is a sum of table entries by bin numbers.

Features are computed once for all rows and kept as a small table; labels are joined to that, not to texts. The fit sees
MAX_FIT labelled rows at most, spread by a hash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import textvec
from harrow.llm.common import chunks, cut

#: Labelled rows that a fit takes at most (about: by a hash of the id).
MAX_FIT = 40_000
BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAVES, SMOOTH = 32, 120, 60, 6, 0.1, 3, 4.0

FEATURES = (
    "log_words", "mean_word", "sd_word", "upper", "digit", "symbol", "punct", "exclaim", "bar", "space", "non_ascii", "line_words", "dup_lines",
    "short_lines", "distinct_words", "repeat_next", "repeat_trigrams", "stopped_lines", "title_words",
)

_CODE = np.zeros(256, np.uint8)  # 1 upper, 2 digit, 3 symbol, 4 other punctuation, 5 exclamation mark, 6 bar, 7 white space, 8 not ASCII
_CODE[65:91], _CODE[48:58], _CODE[128:] = 1, 2, 8
for _c, _k in (("#*$%&<>@^~{}[]\\=+_", 3), (".,;:?()'\"-/", 4), ("!", 5), ("|", 6), (" \t\n\v\f\r", 7)):
    for _x in _c:
        _CODE[ord(_x)] = _k


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row for each document; an empty text has zeros."""
    n = len(offs) - 1
    size = np.maximum(np.diff(offs), 1).astype(float)
    doc_of = lambda at: np.searchsorted(offs, at, side="right") - 1
    code = _CODE[buf]
    count = np.zeros((9, n))
    for k in range(1, 9):
        count[k] = np.diff(np.concatenate([[0], np.cumsum(code == k)])[offs])
    starts, ends, first = textvec.word_spans(buf, offs, textvec.NOT_SPACE)
    words = np.diff(first)
    wd = np.repeat(np.arange(n), words)
    per_word = np.maximum(words, 1).astype(float)
    length = (ends - starts).astype(float)
    total = np.bincount(wd, length, n) / per_word
    square = np.bincount(wd, length**2, n) / per_word
    h = textvec.span_hashes(buf, starts, ends, lower=True)

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of))
        v, d = values[order], of[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
        return np.bincount(d[new], minlength=n).astype(float)

    tri = textvec.ngrams(h, 3)
    whole = wd[: len(tri)] == wd[2:] if len(tri) else np.zeros(0, bool)
    tri, td = tri[whole], wd[: len(tri)][whole]
    n_tri = np.maximum(np.bincount(td, minlength=n), 1).astype(float)
    same = np.zeros(n)
    if len(h) > 1:
        again = (h[1:] == h[:-1]) & (wd[1:] == wd[:-1])
        same = np.bincount(wd[1:][again], minlength=n).astype(float)
    line_s, line_e, line_first = textvec.word_spans(buf, offs, _NOT_BREAK)
    lines = np.diff(line_first)
    ld = np.repeat(np.arange(n), lines)
    per_line = np.maximum(lines, 1).astype(float)
    lh = textvec.span_hashes(buf, line_s, line_e)
    stops = np.isin(buf[line_e - 1], _STOPS) if len(line_e) else np.zeros(0, bool)
    titled = code[starts] == 1 if len(starts) else np.zeros(0, bool)
    out = np.column_stack(
        [
            np.log1p(words), total, np.sqrt(np.maximum(square - total**2, 0)), *(count[k] / size for k in (1, 2, 3, 4, 5, 6, 7, 8)), words / per_line,
            (lines - distinct(lh, ld)) / per_line, np.bincount(ld[line_e - line_s < 30], minlength=n) / per_line, distinct(h, wd) / per_word,
            same / per_word, 1 - np.where(words > 2, distinct(tri, td) / n_tri, 1.0), np.bincount(ld[stops], minlength=n) / per_line,
            np.bincount(wd[titled], minlength=n) / per_word,
        ]
    )
    out[words == 0] = 0
    return out.astype(np.float32)


_NOT_BREAK = np.arange(256) != 10
_STOPS = np.frombuffer(b".!?", np.uint8)


@dataclass
class Model:
    edges: list[np.ndarray]
    base: float
    tables: np.ndarray  # features x bins
    pairs: list[tuple[int, int]]
    planes: list[np.ndarray]  # bins x bins each

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for f in range(b.shape[1]):
            z += self.tables[f, b[:, f]]
        for (f, g), plane in zip(self.pairs, self.planes, strict=True):
            z += plane[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps by bin of a tree that cuts the bins into `leaves` runs, best cut first."""
    runs = [(0, len(g))]
    gain = lambda a, b: a * a / (b + SMOOTH)
    for _ in range(leaves - 1):
        best = (1e-9, None, 0)
        for r in runs:
            cg, ch = np.cumsum(g[r[0] : r[1]]), np.cumsum(h[r[0] : r[1]])
            if len(cg) < 2:
                continue
            v = gain(cg[:-1], ch[:-1]) + gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1]) - gain(cg[-1], ch[-1])
            k = int(v.argmax())
            if v[k] > best[0]:
                best = (float(v[k]), r, r[0] + k + 1)
        if best[1] is None:
            break
        runs.remove(best[1])
        runs += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in runs:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + SMOOTH)
    return out


def _plane(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of one feature, and of the other on either side of it, on a plane of bins: gain and Newton steps."""
    best, out = 0.0, np.zeros_like(g)
    gain = lambda a, b: a * a / (b + SMOOTH)
    whole = gain(g.sum(), h.sum())
    for turn in (False, True):
        gg, hh = (g.T, h.T) if turn else (g, h)
        cg, ch = np.cumsum(gg, 0), np.cumsum(hh, 0)
        for k in range(len(gg) - 1):
            value, cuts = 0.0, []
            for a, b in ((cg[k], ch[k]), (cg[-1] - cg[k], ch[-1] - ch[k])):
                ca, cb = np.cumsum(a), np.cumsum(b)
                v = gain(ca[:-1], cb[:-1]) + gain(ca[-1] - ca[:-1], cb[-1] - cb[:-1])
                j = int(v.argmax())
                value += float(v[j])
                cuts.append((j + 1, ca[j] / (cb[j] + SMOOTH), (ca[-1] - ca[j]) / (cb[-1] - cb[j] + SMOOTH)))
            if value - whole > best:
                best = value - whole
                step = np.zeros_like(gg)
                for rows, (j, left, right) in zip((slice(0, k + 1), slice(k + 1, None)), cuts, strict=True):
                    step[rows, :j], step[rows, j:] = left, right
                out = step.T if turn else step
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of features x and labels y (0 or 1). With one label or no rows it gives that label's (smoothed) share."""
    n_features = len(FEATURES)
    x = x.reshape(-1, n_features)
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(0) for f in range(n_features)]
    m = Model(edges, float(np.log(share / (1 - share))), np.zeros((n_features, BINS)), [], [])
    if not len(y) or y.min() == y.max():
        return m
    b = m.bins(x)
    z = np.full(len(y), m.base)
    for _ in range(ROUNDS):
        for f in range(n_features):
            q = 1 / (1 + np.exp(-z))
            step = RATE * _shallow(np.bincount(b[:, f], y - q, BINS), np.bincount(b[:, f], q * (1 - q), BINS), LEAVES)
            m.tables[f] += step
            z += step[b[:, f]]
    flat = {(f, g): b[:, f] * BINS + b[:, g] for f, g in itertools.combinations(range(n_features), 2)}
    sums = lambda at, v: np.bincount(at, v, BINS * BINS).reshape(BINS, BINS)
    q = 1 / (1 + np.exp(-z))
    gains = {fg: _plane(sums(at, y - q), sums(at, q * (1 - q)))[0] for fg, at in flat.items()}
    m.pairs = sorted(gains, key=lambda fg: (-gains[fg], fg))[:PAIRS]
    m.planes = [np.zeros((BINS, BINS)) for _ in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, fg in enumerate(m.pairs):
            q = 1 / (1 + np.exp(-z))
            step = RATE * _plane(sums(flat[fg], y - q), sums(flat[fg], q * (1 - q)))[1]
            m.planes[k] += step
            z += step.ravel()[flat[fg]]
    return m


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", held_out_mod: int = 5, held_out_rest: int = 0, threshold: float = 0.3, max_fit: int = MAX_FIT) -> DataFrame:
    """One row per row of docs: id, held_out, score (0 to 1), predicted (1 where score >= threshold).

    A row is held out if crc32 of its id as text leaves `held_out_rest` modulo `held_out_mod` (a null id: as an empty text); the fit sees
    the others that have a label (null labels are none; an id with several labels counts with each). Scores come from the text alone; null
    and empty texts have features of zero and are scored as such. Without usable labels every score is the smoothed share.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(buf, offs) for _, _, buf, offs in chunks(batch.column(1), 1 << 20)]
            a = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a.tobytes()[i * a.itemsize * a.shape[1] : (i + 1) * a.itemsize * a.shape[1]] for i in range(len(a)))], schema=pa.schema([("id", batch.schema.field(0).type), ("x", pa.binary())]))

    side = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rest = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(held_out_mod))
    own = cut(side.mapInArrow(run, f"id {kind}, x binary").withColumn("held_out", rest == held_out_rest))
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1)")
    seen = own.where("not held_out").join(marks, "id")
    n = seen.count()
    if n > max_fit:
        seen = seen.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < int((1 << 20) * max_fit / n))
    sample = seen.select("x", "y", F.xxhash64("id", "x").alias("o")).toArrow().sort_by([("o", "ascending"), ("y", "ascending")])
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float32)
    model = side.sparkSession.sparkContext.broadcast(fit(x.astype(float), sample.column("y").to_numpy().astype(float)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, len(FEATURES))
            s = model.value.score(a.astype(float))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s)], names=["id", "held_out", "score"])

    out = own.mapInArrow(score, f"id {kind}, held_out boolean, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
