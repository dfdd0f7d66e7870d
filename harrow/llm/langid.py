"""Language identification of mixed-language text.

The scripts of a text's letters (code point ranges) narrow the languages that come into question. Each word then has a score
in each of them, the log probability of its character n-grams as counted in labelled texts (characters, not bytes, so that a letter pair is one in
each script), and a Viterbi pass over the words, with
a penalty for each switch, labels spans. The language with most letters is the text's.

A pass is only run where a switch can pay: without one the best path stays in the language with the best sum, which a test by
cumulative sums proves for most texts. The n-grams of a word that comes again in a chunk of texts are taken once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow.llm import textvec
from harrow.llm.common import chunks

#: Hash buckets of n-grams, and the n-grams' lengths in characters.
BUCKETS, LENGTHS = 1 << 15, (2, 3, 4)
#: Log probability that a switch of language costs.
PENALTY = 12.0
#: Words of the texts that are gone through together, at most.
LONG = 2048

# Scripts by code point ranges (first, last).
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0xD6), (0xD8, 0xF6), (0xF8, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x373), (0x376, 0x37D), (0x37F, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x481), (0x48A, 0x52F)),
    "armenian": ((0x531, 0x556), (0x561, 0x587)),
    "hebrew": ((0x5D0, 0x5EA),),
    "arabic": ((0x620, 0x64A), (0x66E, 0x6D3), (0x6FA, 0x6FC), (0x750, 0x77F)),
    "devanagari": ((0x904, 0x939), (0x958, 0x961), (0x971, 0x97F)),
    "bengali": ((0x985, 0x9B9),),
    "tamil": ((0xB83, 0xBB9),),
    "thai": ((0xE01, 0xE30), (0xE40, 0xE46)),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7A3)),
    "kana": ((0x3041, 0x3096), (0x30A1, 0x30FA)),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
_NAMES = [*SCRIPTS]
_OF = np.zeros(0x10000, np.uint8)  # script number + 1 of each code point
for _k, _ranges in enumerate(SCRIPTS.values()):
    for _a, _b in _ranges:
        _OF[_a : _b + 1] = _k + 1


def _letters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte places and script numbers (from 1) of letters; other letters than SCRIPTS knows are in script 0 and left out."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    b = buf[at].astype(np.uint32)
    pad = np.concatenate([buf, np.zeros(3, np.uint8)])
    c1, c2 = pad[at + 1].astype(np.uint32) & 63, pad[at + 2].astype(np.uint32) & 63
    cp = np.where(b < 0x80, b, np.where(b < 0xE0, (b & 31) << 6 | c1, np.where(b < 0xF0, (b & 15) << 12 | c1 << 6 | c2, 0)))
    script = _OF[cp]
    keep = script > 0
    return at[keep], script[keep]


def _other_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


_NOT_LETTER = np.isin(np.arange(256), [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_WORD = ~_NOT_LETTER


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (starts, ends, first of each document), and a hash of each word that leaves out ASCII case."""
    starts, ends, first = textvec.word_spans(buf, offs, _WORD)
    return starts, ends, first, textvec.span_hashes(buf, starts, ends, lower=True)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of one word of each hash, and which of them each word is."""
    of, seen = pd.factorize(h)
    at = np.zeros(len(seen), np.int64)
    at[of] = np.arange(len(h))
    return at, of


def _grams(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the words' n-grams with the word of each."""
    n = ends - starts
    # each word is read with a blank before and after it
    at = np.repeat(starts - 1, n + 2) + np.arange((n + 2).sum()) - np.repeat(np.cumsum(n + 2) - (n + 2), n + 2)
    word = np.repeat(np.arange(len(n)), n + 2)
    b = np.append(textvec.LOWER[buf], np.uint8(32))[np.maximum(at, 0)].astype(np.uint64)
    edge = np.cumsum(n + 2)
    b[edge - 1] = 32
    b[edge - n - 2] = 32
    # a character is its bytes as one number
    more = np.append((b & np.uint64(0xC0)) == 0x80, [False] * 3)
    lead = np.flatnonzero(~more[: len(b)])
    ch, inside, b = b[lead], np.ones(len(lead), bool), np.append(b, np.zeros(3, np.uint64))
    for i in (1, 2, 3):
        inside &= more[lead + i]
        ch = np.where(inside, ch << np.uint64(8) | b[lead + i], ch)
    word = word[lead]
    grams, of = [], []
    for k in LENGTHS:
        if len(ch) < k:
            continue
        code = np.full(len(ch) - k + 1, k, np.uint64)
        for i in range(k):
            code = code * textvec.R + ch[i : len(ch) - k + 1 + i]
        ok = word[: len(code)] == word[k - 1 :]
        grams.append((textvec.mix(code[ok]) % np.uint64(BUCKETS)).astype(np.int64))
        of.append(word[: len(code)][ok])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(grams), cat(of)


class Model:
    """Log probabilities by bucket and language, and the scripts that each language is written in."""

    def __init__(self, counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        if not self.langs:
            return
        c = np.stack([counts[k] for k in self.langs]).astype(float) + 0.2
        self.log = np.log(c / c.sum(axis=1, keepdims=True)).T.astype(np.float32)
        s = np.stack([scripts[k] for k in self.langs]).astype(float)
        self.writes = s >= 0.02 * np.maximum(s.sum(axis=1, keepdims=True), 1)

    def word_scores(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, first, h = _words(buf, offs)
        at, kind = _distinct(h)
        gram, of = _grams(buf, starts[at], ends[at])
        out = np.zeros((len(at), len(self.langs)))
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(of, self.log[gram, k], len(at))
        return starts, ends, first, out[kind]


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The best labels of the words: the sum of their scores less `penalty` for each switch is largest; ties stay."""
    return paths([scores], penalty)[0]


def paths(texts: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """viterbi() of each text's scores.

    The recursion is run only where a switch can pay (see _Places), step by step for all texts of as many languages together. Texts of
    more than LONG words, with which few others would keep step, are gone through by themselves.
    """
    out, together = [], {}
    for scores in texts:
        n, k = scores.shape
        best = int(scores.sum(axis=0).argmax()) if n else 0
        labels = np.full(n, best)
        out.append(labels)
        if n < 2 or k < 2:
            continue
        places = _Places(scores, best, penalty)
        a = places.after(None)
        if n <= LONG and a is not None:
            together.setdefault(k, []).append((scores, best, places, labels))
        while n > LONG and a is not None:
            a = places.after(_run(scores, best, penalty, a, labels))
    for some in together.values():
        _run_together(some, penalty)
    return out


class _Places:
    """Where the recursion has to be run in a text.

    A stretch of words that gain `penalty` or less (half of it at the start or end) in every other language than `best`, the one with
    the best sum, stays in that, as each language on the way costs a switch. So the recursion is run from the start, if any stretch gains more, until
    `best` leads all others by a switch, and then only from where no language has gained anything, before a stretch that gains more.
    """

    def __init__(self, scores: np.ndarray, best: int, penalty: float):
        n, k = scores.shape
        total = np.zeros((n + 1, k))
        np.cumsum(scores - scores[:, best : best + 1], axis=0, out=total[1:])
        gain = total - np.minimum.accumulate(total, axis=0)
        may = (gain > penalty).any(axis=1) | (total > penalty / 2).any(axis=1)
        may[n] |= (gain[n] > penalty / 2).any()  # a path of other languages from start to end has one switch fewer than languages
        self.pays = np.flatnonzero(may)
        self.level = np.flatnonzero((gain == 0).all(axis=1)) if len(self.pays) else self.pays

    def after(self, at: int | None) -> int | None:
        """The word to run from next, if any, where `best` leads by a switch before word `at` (None: at the start of the text)."""
        if at is None:
            return 0 if len(self.pays) else None
        i = int(np.searchsorted(self.pays, at + 1))
        if i == len(self.pays):
            return None
        return max(at, int(self.level[np.searchsorted(self.level, self.pays[i], side="right") - 1]))


def _run(scores: np.ndarray, best: int, penalty: float, a: int, out: np.ndarray) -> int:
    """Labels from word a on, until `best` leads by a switch; where that is. Before a, if not at the start, the label is `best`."""
    k = scores.shape[1]
    stay = list(range(k))
    v = [0.0 if a == 0 or j == best else -penalty for j in stay]
    back: list[list[int]] = []
    t = a
    for row in (row for lo in range(a, len(scores), 64) for row in scores[lo : lo + 64].tolist()):
        m = max(stay, key=v.__getitem__)
        jump = v[m] - penalty
        back.append([j if v[j] >= jump else m for j in stay])
        v = [max(x, jump) + s for x, s in zip(v, row, strict=True)]
        t += 1
        if t > a + 1 and all(v[j] <= v[best] - penalty for j in stay if j != best):
            break
    j = max(stay, key=v.__getitem__)
    for i in range(len(back) - 1, -1, -1):
        out[a + i] = j
        j = back[i][j]
    return t


def _run_together(texts: list[tuple[np.ndarray, int, _Places, np.ndarray]], penalty: float) -> None:
    """As _run() of (scores, best, places, labels) from the start of each text on, and then from each place after that; all texts with as many languages."""
    scores = np.concatenate([x[0] for x in texts])
    k = scores.shape[1]
    stay = np.arange(k)
    stop = np.cumsum([len(x[0]) for x in texts])
    start = stop - [len(x[0]) for x in texts]
    back = np.zeros(scores.shape, np.min_scalar_type(k))
    # of the texts that are still run: which, its best language, the run's first word, the next word, the values
    which, best, first = np.arange(len(texts)), np.array([x[1] for x in texts]), start.copy()
    at, v = first.copy(), np.zeros((len(texts), k))
    runs: list[tuple[int, int, int]] = []  # the words, and the last label
    while len(which):
        top = v.argmax(axis=1)
        jump = v[np.arange(len(v)), top][:, None] - penalty
        back[at] = np.where(v >= jump, stay, top[:, None])
        v = np.maximum(v, jump) + scores[at]
        at += 1
        leads = (v <= v[np.arange(len(v)), best][:, None] - penalty).sum(axis=1) == k - 1
        done = np.flatnonzero(leads & (at > first + 1) | (at == stop[which]))
        if not len(done):
            continue
        over = []
        for i, j in zip(done.tolist(), v[done].argmax(axis=1).tolist(), strict=True):
            runs.append((int(first[i]), int(at[i]), j))
            text = which[i]
            a = texts[text][2].after(int(at[i] - start[text])) if at[i] < stop[text] else None
            if a is None:
                over.append(i)
                continue
            first[i] = at[i] = start[text] + a
            v[i] = -penalty
            v[i, best[i]] = 0.0
        if over:
            which, best, first, at, v = (np.delete(x, over, axis=0) for x in (which, best, first, at, v))
    labels = np.concatenate([x[3] for x in texts])
    run = np.array(sorted(runs, key=lambda x: x[0] - x[1]))
    size, j = run[:, 1] - run[:, 0], run[:, 2]
    for t, m in enumerate(np.searchsorted(-size, -np.arange(size[0]), side="left").tolist()):  # m runs are longer than t
        row = run[:m, 1] - 1 - t
        labels[row] = j[:m]
        j[:m] = back[row, j[:m]]
    for x, a, b in zip(texts, start.tolist(), stop.tolist(), strict=True):
        x[3][:] = labels[a:b]


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """Counts over all texts with a language: each task adds up its own, and the sums by bucket are added after one shuffle.

    What reaches the driver are BUCKETS counts a language, whatever the number of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lo, hi, buf, offs in chunks(batch.column(1), 1 << 20):
                starts, ends, first, h = _words(buf, offs)
                names = sorted({*langs[lo:hi]})
                of_doc = np.array([names.index(x) for x in langs[lo:hi]])
                size = BUCKETS + len(_NAMES) + 1
                word_lang = np.repeat(of_doc, np.diff(first))
                one, kind = _distinct(h + textvec.mix(word_lang.astype(np.uint64) + textvec.R))  # words of a language
                gram, of = _grams(buf, starts[one], ends[one])
                times = np.bincount(kind, minlength=len(one))
                c = np.bincount(word_lang[one][of] * size + gram, times[of], size * len(names)).astype(np.int64)
                at, script = _letters(buf)
                doc = np.searchsorted(offs, at, side="right") - 1
                c += np.bincount(of_doc[doc] * size + BUCKETS + script, minlength=size * len(names))
                for k, name in enumerate(names):
                    part = c[k * size : (k + 1) * size]
                    counts[name] = counts[name] + part if name in counts else part.copy()
        for name, c in counts.items():
            b = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(c[b].astype(np.int64))], names=["lang", "b", "c"])

    rows = docs.select(F.col(lang_col), F.col(text_col)).where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sums = rows.mapInArrow(run, "lang string, b int, c long").groupBy("lang", "b").agg(F.sum("c").alias("c"))
    found = sums.toPandas()
    counts, scripts = {}, {}
    for name, g in found.groupby("lang"):
        c = np.zeros(BUCKETS + len(_NAMES) + 1)
        c[g["b"].to_numpy()] = g["c"].to_numpy()
        counts[name], scripts[name] = c[:BUCKETS], c[BUCKETS + 1 :]
    return Model(counts, scripts)


def identify_batch(m: Model, buf: np.ndarray, offs: np.ndarray, penalty: float) -> Iterator[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, score, spans (first byte, byte after the last, language)) of each document."""
    at, script = _letters(buf)
    cuts = np.searchsorted(at, offs)
    starts, ends, first, scores = m.word_scores(buf, offs) if m.langs else (np.zeros(0, int),) * 4
    fit: list[np.ndarray | None] = []
    for i in range(len(offs) - 1):
        letters = cuts[i + 1] - cuts[i]
        if letters == 0 and not _other_letter(bytes(buf[offs[i] : offs[i + 1]]).decode(errors="ignore")) or not m.langs:
            fit.append(None)
            continue
        share = np.bincount(script[cuts[i] : cuts[i + 1]], minlength=len(_NAMES) + 1)[1:]
        fits = m.writes[:, share >= 0.02 * max(1, letters)].any(axis=1)
        fit.append(np.flatnonzero(fits) if fits.any() else np.arange(len(m.langs)))
    own_scores = [scores[first[i] : first[i + 1]] if len(may) == len(m.langs) else scores[first[i] : first[i + 1]][:, may] for i, may in enumerate(fit) if may is not None]
    found = zip(own_scores, paths(own_scores, penalty), strict=True)
    for i, may in enumerate(fit):
        if may is None:
            yield "und", 0.0, []
            continue
        a, b = first[i], first[i + 1]
        s, labels = next(found)
        labels = may[labels]
        size = ends[a:b] - starts[a:b]
        weight = np.bincount(labels, size, len(m.langs))
        lead = int(weight.argmax())
        change = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
        own = (s if len(change) == 1 else s[labels == lead]).sum(axis=0)
        p = float(1 / np.exp(np.clip(own - own[np.flatnonzero(may == lead)[0]], -700, 700)).sum()) if len(own) else 0.0
        last = np.concatenate([change[1:], [len(labels)]]) - 1
        spans = [(int(starts[a + x] - offs[i]), int(ends[a + y] - offs[i]), m.langs[labels[x]]) for x, y in zip(change, last, strict=True)]
        yield m.langs[lead], min(1.0, p * float(weight[lead] / max(1, weight.sum()))), spans


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """The columns `keep` (doc_id) of each row, lang_pred, score (0 to 1) and spans: array of (start, end, lang), in bytes.

    A null text and one without letters are `und` with score 0 and no spans, as is every text if the model learned
    nothing. Repeated rows are labelled each; other columns are left behind.
    """
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [x for _, _, buf, offs in chunks(batch.column(len(keep)), 1 << 20) for x in identify_batch(sent.value, buf, offs, penalty)]
            spans = pa.array([[{"start": a, "end": b, "lang": k} for a, b, k in s] for _, _, s in got], kind)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64()), spans], names=[*(f"k{i}" for i in range(len(keep))), "lang_pred", "score", "spans"])

    ddl = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    side = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text_col).alias("t"))
    out = side.mapInArrow(run, f"{ddl}, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score", "spans")
