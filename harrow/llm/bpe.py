"""Byte-level BPE ids of many texts: pieces are found and looked up in numpy, only new pieces are encoded.

The pieces are those of the vocabulary's pre-tokenizer. Texts whose characters are all below SIMPLE and hold no
apostrophe are split by character classes, many at once; others go to the library whole. Ids are the same either way.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa

from harrow.llm.textvec import R, mix, powers

SIMPLE = 0x250
#: Pieces kept at most in a worker's memory.
CACHE = 400_000
_SPECIAL = "<|endoftext|>"

_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _class(c: int) -> int:
    ch = chr(c)
    if ch in "\t\n\v\f\r \x85\xa0":
        return _SPACE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(ch)[0], _OTHER)


CLASSES = np.array([_class(c) for c in range(SIMPLE)], np.uint8)
VALUES = np.random.default_rng(7).integers(1, 1 << 63, SIMPLE, dtype=np.uint64)


class Encoder:
    """Ids as the vocabulary file at `path` gives them. Its merges must be in the order of their ids."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        # the file writes bytes as printable characters
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*visible}))}
        ranks = {bytes(byte[c] for c in word): i for word, i in self.whole.get_vocab(with_added_tokens=False).items() if word != _SPECIAL}
        self.piece = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._clear()

    def _clear(self) -> None:
        """Slots of known pieces: where their ids begin in `flat`, and how many they are."""
        self.slot: dict[int, int] = {}
        self.begin, self.count = np.zeros(2 * CACHE, np.int64), np.zeros(2 * CACHE, np.int64)
        self.flat, self.used = np.zeros(16 * CACHE, np.uint32), 0

    def _learn(self, keys: list[int], pieces: list[str]) -> None:
        got = [self.piece(p.encode()) for p in pieces]
        n = np.fromiter(map(len, got), np.int64, len(got))
        if len(self.slot) + len(got) > len(self.begin) or self.used + n.sum() > len(self.flat):
            grow = lambda a, k: np.concatenate([a, np.zeros(k, a.dtype)])
            self.begin, self.count, self.flat = grow(self.begin, len(got)), grow(self.count, len(got)), grow(self.flat, int(n.sum()))
        first = len(self.slot)
        self.slot.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.begin[first : first + len(n)] = self.used + np.cumsum(n) - n
        self.count[first : first + len(n)] = n
        self.flat[self.used : self.used + n.sum()] = np.fromiter((i for g in got for i in g), np.uint32, int(n.sum()))
        self.used += int(n.sum())

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without added special tokens."""
        out: list[np.ndarray | None] = [None] * len(texts)
        run, size = [], 0
        for i, t in enumerate(texts):
            if "'" in t or _SPECIAL in t or (not t.isascii() and max(t) >= chr(SIMPLE)):
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
                continue
            run.append(i)
            size += len(t)
            if size > 1 << 20:
                self._simple(texts, run, out)
                run, size = [], 0
        if run:
            self._simple(texts, run, out)
        return out

    def _simple(self, texts: list[str], run: list[int], out: list) -> None:
        joined = "".join([texts[i] for i in run])
        offs = np.concatenate([[0], np.cumsum([len(texts[i]) for i in run])]).astype(np.int64)
        if not joined:
            for i in run:
                out[i] = np.zeros(0, np.uint32)
            return
        chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        cls = CLASSES[chars]
        n = len(cls)
        start = np.ones(n, bool)
        np.not_equal(cls[1:], cls[:-1], out=start[1:])
        begins = offs[:-1][offs[1:] > offs[:-1]]
        start[begins] = True
        # a run of white space before other characters of the text gives its last one away: a blank joins the next piece
        last = np.zeros(n, bool)
        last[:-1] = (cls[:-1] == _SPACE) & (cls[1:] != _SPACE)
        last[begins[1:] - 1] = False
        at = np.flatnonzero(last)
        start[at] = True
        start[at[chars[at] == 32] + 1] = False
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
        p, inv = powers(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(VALUES[chars] * p[:n], out=total[1:])
        keys = mix((total[e] - total[s]) * inv[s] + (e - s).astype(np.uint64) * R)
        which, distinct = pd.factorize(keys)
        where = np.empty(len(distinct), np.int64)
        where[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        if len(self.slot) > CACHE:
            self._clear()
        names = distinct.tolist()
        slots = np.fromiter((self.slot.get(k, -1) for k in names), np.int64, len(names))
        new = np.flatnonzero(slots < 0)
        if len(new):
            self._learn([names[k] for k in new], [joined[s[k] : e[k]] for k in where[new]])
            slots[new] = np.arange(len(self.slot) - len(new), len(self.slot))
        n_of, flat_at = self.count[slots][which], self.begin[slots][which]
        ends = np.cumsum(n_of)
        index = np.arange(ends[-1]) + np.repeat(flat_at - (ends - n_of), n_of)
        result = self.flat[index]
        piece_at = np.searchsorted(s, offs)
        cuts = np.concatenate([[0], ends])[piece_at]
        for k, i in enumerate(run):
            out[i] = result[cuts[k] : cuts[k + 1]]


def texts_of(col: pa.Array) -> list[str]:
    return [t or "" for t in col.to_pylist()]
