"""Levels of posting titles. Each word list is one pattern, so a test is one regular expression a list."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow import vocab


def pattern(words: list[str]) -> str:
    """Any of the words between non-word characters or ends; a hyphen may be a blank or nothing, a blank any white space. No words match nothing."""
    if not words:
        return r"(?!)"
    quoted = (re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", w) for w in words)
    return r"(?i)(?:^|\W)(?:" + "|".join(w.replace("-", "[- ]?").replace(" ", r"\s+").replace(r"[-\s+]?", "[- ]?") for w in quoted) + r")(?:\z|\W)"


def has(title: Column, words: list[str]) -> Column:
    return F.coalesce(F.trim(F.lower(title)).rlike(pattern(words)), F.lit(False))


class Levels:
    """Predicates of titles; `domain` are the configured keywords (an empty list means that no title is technical)."""

    def __init__(self, domain: list[str] | None = None, engineering: list[str] = vocab.ENGINEERING, non_tech: list[str] = vocab.NON_TECH):
        self.domain = vocab.DOMAIN if domain is None else domain
        self.engineering, self.non_tech_words = engineering, non_tech

    def tech(self, t: Column) -> Column:
        return has(t, self.engineering) & has(t, self.domain)

    def _base(self, t: Column) -> Column:
        return self.tech(t) & ~has(t, self.non_tech_words)

    def intern(self, t: Column) -> Column:
        return self._base(t) & has(t, vocab.INTERN)

    def entry(self, t: Column) -> Column:
        return self._base(t) & ~has(t, vocab.INTERN) & ~has(t, vocab.MID) & ~has(t, vocab.SENIOR)

    def mid(self, t: Column) -> Column:
        return self._base(t) & ~has(t, vocab.INTERN) & (has(t, vocab.MID) | ~(has(t, vocab.ENTRY) | has(t, vocab.SENIOR)))

    def senior(self, t: Column) -> Column:
        return self._base(t) & ~has(t, vocab.INTERN) & (has(t, vocab.SENIOR) | ~(has(t, vocab.ENTRY) | has(t, vocab.MID)))

    def target(self, t: Column, categories: list[str]) -> Column:
        """Any of the categories; both kinds of internships are one test."""
        tests = {"summer intern": self.intern, "off-season intern": self.intern, "entry level": self.entry, "mid level": self.mid, "senior level": self.senior}
        return reduce(lambda a, b: a | b, (tests[c](t) for c in categories), F.lit(False))
