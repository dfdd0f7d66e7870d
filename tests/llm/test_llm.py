from __future__ import annotations

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from harrow.llm import bpe, components, decontam, html_extract, jaccard_join, langid, packing, pii, quality_gam, quality_rules, suffix_dedup, textvec, tree, warc
from harrow.llm.common import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rng_text(seed: int, n: int, words: int = 300) -> str:
    r = np.random.default_rng(seed)
    return " ".join(f"w{k}" for k in r.integers(0, words, n))


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def awkward():
    """Nulls, empties, white space, repeats, a long one and odd characters."""
    return [None, "", "   \n ", "one", "one two", "É!! 日本 \x00 a", "x " * 30_000, rng_text(1, 80), rng_text(1, 80)]


# PII


def test_pii(spark):
    texts = [
        "Mail Ann.Bee@mail3.Example.com or ann.bee@mail3.example.com.", "Card 4111 1111 1111 1111, 4111111111111111", "Call +1 (741) 555-3069 or +1 741 555 3069",
        "Mr. John Smith, Mrs. Anna Smith, Dr. Smith", "Господин Иванов", 'token = "f32ab9ba2834a0d390df92664b1272635dbc0e11" 10.1.2.3 123-45-6789', None, "", "clean 12 text. v1.2.3",
    ]
    docs = frame(spark, texts).withColumn("n_entities", F.lit("x"))
    got = {r.doc_id: r for r in pii.surrogates(docs, "k").collect()}
    assert [got[i].n_entities for i in range(9)] == [2, 2, 2, 3, 1, 3, 0, 0, 0]
    assert [got[i].text for i in (6, 7, 8)] == texts[6:]
    a, b = re.findall(r"\S+@[\w.]+\w", got[0].text)
    assert a.lower() == b and a[0].isupper() and b.endswith(".com") and "bee" not in b
    digits = [re.sub(r"\D", "", x) for x in got[1].text[5:].split(",")]
    assert digits[0] == digits[1] != "4" + "1" * 15 and re.fullmatch(r"Card \d{4} \d{4} \d{4} \d{4}, \d{16}", got[1].text)
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4} or \+1 \d{3} \d{3} \d{4}", got[2].text)
    names = re.fullmatch(r"Mr\. (\w+n) (\w+), Mrs\. (\w+a) (\w+), Dr\. (\w+)", got[3].text)
    assert names[2] == names[4] == names[5] != "Smith"
    assert re.fullmatch(r"Господин [А-Я][а-я]+", got[4].text) and got[4].text != texts[4]
    assert {r.doc_id: r.text for r in pii.surrogates(docs, "k").collect()} == {i: r.text for i, r in got.items()}
    assert pii.surrogates(docs, "other").where("doc_id = 0").first().text != got[0].text
    assert pii.surrogates(frame(spark, [None]).limit(0), "k").count() == 0


def test_pii_distinct(spark):
    texts = [f"Mr. {''.join(p).capitalize()}" for p in itertools.product("abcdefgh", repeat=3)]
    got = pii.surrogates(frame(spark, texts), "k").select("text").distinct().count()
    assert got == len(texts)
    plan = pii.surrogates(frame(spark, texts), "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_more_short_names_than_short_replacements(spark):
    given = ["".join(p).capitalize() for p in itertools.product("abcdefghijklm", repeat=3)]
    texts = [*(f"Mr {x} Smith" for x in given), *(f"{a}@{b}.com" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"), "张@例.com"]
    got = [r.text for r in pii.surrogates(frame(spark, texts), "k").select("text").collect()]
    assert len({*got}) == len(texts) and not {*got} & {*texts} and all("张" not in x and "例" not in x for x in got)
    names = [x for x in got if x.startswith("Mr ")]
    assert len(names) == len(given) > 2000 and all(re.fullmatch(r"Mr [A-Z][a-z]*n [A-Z][a-z]+", x) for x in names)
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.com", x) for x in got if "@" in x)


def test_pii_after_punctuation(spark):
    sha = "f32ab9ba2834a0d390df92664b1272635dbc0e11"
    kinds = {"741-555-3069": "._-%+", "4111111111111111": "._-%+", "DE89370400440532013000": "._-%+", "Mr Smith": "._-%+", sha: ".-%+", "10.1.2.3": "_-%+", "123-45-6789": "._%+"}
    texts = [f"see x{c}{e} here" for e, marks in kinds.items() for c in marks]
    got = pii.surrogates(frame(spark, texts), "k").collect()
    assert len(got) == len(texts) and all(r.n_entities == 1 and r.text.startswith(texts[r.doc_id][:6]) and r.text.endswith(" here") for r in got)
    assert not [r.text for r in got for e in kinds if e in r.text]
    kept = [f"see x_{sha} here", "see x.10.1.2.3 here", "see x-123-45-6789 here"]
    assert [r.text for r in pii.surrogates(frame(spark, kept), "k").orderBy("doc_id").collect()] == kept


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def iban(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_pii_check_digits(spark):
    good = [f"4{k:014d}" for k in range(7, 700, 77)]
    cards = [g + next(c for c in "0123456789" if luhn(g + c)) for g in good] + ["4111111111111112"]
    ibans = ["DE89370400440532013000", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "DE00370400440532013000"]
    got = [r.text for r in pii.surrogates(frame(spark, cards + ibans), "k").orderBy("doc_id").collect()]
    assert len({*got}) == len(got) and not {*got} & {*cards, *ibans}
    assert all(luhn(x) and len(x) == 16 and x[0] == "4" for x in got[: len(good)])
    for a, b in zip(ibans[:3], got[len(cards) :], strict=False):
        assert iban(b) and b[:2] == a[:2] and [c.isdigit() for c in a] == [c.isdigit() for c in b]
    same = [r.text for r in pii.surrogates(frame(spark, ["GB29 NWBK 6016 1331 9268 19 or GB29NWBK60161331926819"]), "k").collect()][0].split(" or ")
    assert same[0].replace(" ", "") == same[1] and iban(same[1])


def test_pii_names_without_title(spark):
    texts = [
        "Mr. John Smith met us. Later Smith left; John Smith wrote, and Smith’s SMITH. Smithson stayed, a smith too", "Smith of another text",
        "Господин Иванов и госпожа Иванова, Иванова и Иванов", "Dr. O'Brien; O'Brien's dog", "Mr. James James and Ms. James James. James", "x Mr. Smith",
    ]
    got = {r.doc_id: r for r in pii.surrogates(frame(spark, texts), "k").collect()}
    a = re.fullmatch(r"Mr\. (\w+n) (\w+) met us\. Later (\w+) left; (\w+) (\w+) wrote, and (\w+)’s SMITH\. Smithson stayed, a smith too", got[0].text)
    assert a and a[1] == a[4] and a[2] == a[3] == a[5] == a[6] != "Smith" and got[0].n_entities == 5
    assert got[1].text == texts[1] and got[1].n_entities == 0
    b = re.fullmatch(r"Господин (\w+ов) и госпожа (\w+), (\w+) и (\w+)", got[2].text)
    assert b and b[1] == b[4] != "Иванов" and b[2] == b[3] == b[1] + "а" and got[2].n_entities == 4
    c = re.fullmatch(r"Dr\. (\w+); (\w+)'s dog", got[3].text)
    assert c and c[1] == c[2]
    assert "James" not in got[4].text and got[5].text == f"x Mr. {a[2]}"


def test_pii_ipv6(spark):
    texts = ["at 2001:db8:85a3:0:0:8a2e:370:7334 and 2001:DB8:85A3:0:0:8A2E:370:7334, fe80:0:0::1", "std::vector a::b 12:30:45 at 10:20"]
    got = {r.doc_id: r for r in pii.surrogates(frame(spark, texts), "k").collect()}
    a = re.fullmatch(r"at ([0-9a-f:]+) and ([0-9A-F:]+), ([0-9a-f:]+)", got[0].text)
    assert a and a[1] == a[2].lower() != texts[0][3:34] and a[1].count(":") == 7 and "::" in a[3] and got[0].n_entities == 3
    assert got[1].text == texts[1]


# suffix array


def removed_by_force(texts):
    seen, out = set(), []
    for t in texts:
        b = (t or "").encode()
        gone, new = np.zeros(len(b), bool), []
        for p in range(len(b) - 49):
            if b[p : p + 50] in seen:
                gone[p : p + 50] = True
            new.append(b[p : p + 50])
        seen.update(new)
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def test_suffix_dedup(spark):
    shared = rng_text(5, 40)
    texts = [*awkward(), *(f"{rng_text(10 + k, 30)} {shared} {rng_text(40 + k, 30)}" for k in range(6)), shared, "ab" * 60, "ba" * 80, "é" * 100, rng_text(1, 80)[7:130], shared[:49]]
    docs = frame(spark, texts).withColumn("rep", F.lit(1))
    got = [tuple(r) for r in suffix_dedup.repeats(docs).orderBy("doc_id").select("n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert got == removed_by_force(texts)
    assert suffix_dedup.repeats(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, shared), (3, shared), (3, shared), (4, shared)], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.repeats(odd).collect()) == [(-1, 0), (3, 0), (3, 0), (4, len(shared))]
    assert suffix_dedup.removed(docs).where("doc_id = 8").first().text == ""


def test_suffix_dedup_by_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LISTED", 1 << 10)
    monkeypatch.setattr(suffix_dedup, "SORTED", 1 << 10)
    test_suffix_dedup(spark)


def test_rows_follow_the_data_not_the_partitions(spark):
    docs = frame(spark, [f"{rng_text(k, 60)} {rng_text(5, 40)}" for k in range(40)]).select("text").coalesce(1)
    assert [suffix_dedup._listing(docs.repartition(1), k).count() for k in (1, 1)] == [2, 2]
    assert suffix_dedup._listing(docs, 3).count() <= 6
    before = spark.conf.get("spark.sql.shuffle.partitions")
    plans = []
    for k in ("2", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", k)
        plans.append(sorted(tuple(r) for r in suffix_dedup.repeats(frame(spark, [rng_text(5, 40)] * 3 + [rng_text(6, 40) + rng_text(5, 30)])).drop("spans").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert plans[0] == plans[1]


@pytest.mark.parametrize("depth", [9, 16, 20, 50, 64])
def test_refinement_by_updated_pointers(depth):
    """Equal to grouping by the strings themselves; grams are read for the first buckets only, all else comes from pointers."""
    r = np.random.default_rng(depth)
    for letters in (1, 2, 3):
        b = np.concatenate([r.integers(97, 97 + letters, 150), np.tile(r.integers(97, 99, 13), 20)]).astype(np.uint8)
        start = r.permutation(len(b) - depth + 1)
        got = suffix_dedup.refine(suffix_dedup.grams(b), start, depth)
        strings = [b[p : p + depth].tobytes() for p in start.tolist()]
        often = Counter(strings)
        assert all((g >= 0) == (often[x] > 1) for g, x in zip(got.tolist(), strings, strict=True))
        assert len({(g, x) for g, x in zip(got.tolist(), strings, strict=True) if g >= 0}) == len({g for g in got.tolist() if g >= 0}) == sum(v > 1 for v in often.values())
    assert len(suffix_dedup.refine(np.zeros(0, np.uint64), np.zeros(0, np.int64), depth)) == 0


def test_refinement_groups_equal_suffixes():
    b = np.frombuffer((b"abcdefghij" * 20)[:150] + b"x" * 60, np.uint8)
    start = np.arange(len(b) - 49)
    bucket = suffix_dedup.refine(suffix_dedup.grams(b), start, 50)
    by = Counter(bytes(b[s : s + 50]) for s in start)
    assert all((by[bytes(b[s : s + 50])] > 1) == (k >= 0) for s, k in zip(start, bucket, strict=True))
    assert all((bucket[i] == bucket[j]) == (bytes(b[i : i + 50]) == bytes(b[j : j + 50])) for i, j in itertools.combinations(range(0, len(start), 3), 2) if bucket[i] >= 0)


# packing


def test_bpe_equals_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    texts = [t or "" for t in awkward()] + ["", "  a  b\n\n c", " ", "\n\na\n b", "it's 'tis don't", "é 12  ,.. x\t\ty\n", "a\xa0\xa0b", "<|endoftext|> x", "1²3½ aª", " \n x", "x \n"]
    whole = Tokenizer.from_file(path)
    assert [x.tolist() for x in bpe.Encoder(path).batch(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(spark):
    path = tokenizer_path("byte_bpe_50k.json")
    docs = frame(spark, awkward()).union(frame(spark, ["dup"])).withColumn("length", F.lit("x"))
    got = packing.pack(docs, path, max_len=100, with_ids=True).toPandas()
    ids = bpe.Encoder(path).batch([t or "" for t in awkward()])
    long = got[got.doc_id == 6].sort_values("piece")
    assert long.length.sum() == len(ids[6]) + 1 and (long.length[1:] == 100).all() and long.length.iloc[0] == (len(ids[6]) + 1) % 100
    assert (np.concatenate([np.frombuffer(x, "<u4") for x in long.ids])[:-1] == ids[6]).all()
    assert all(zlib.crc32(x) == c for x, c in zip(got.ids, got.ids_crc32, strict=True))
    order = got.sort_values(["sequence_id", "offset"])
    assert (order.groupby("sequence_id").length.cumsum() - order.length == order.offset).all() and got.groupby("sequence_id").length.sum().max() <= 100
    assert len(got[got.doc_id == 0]) == 2
    assert packing.sequences(packing.pack(docs, path, max_len=100, with_ids=True)).agg(F.sum(F.length("input_ids"))).first()[0] == 4 * got.length.sum()
    assert packing.pack(docs.limit(0), path).count() == 0


def test_sum_of_squares_is_the_rule():
    lengths = np.random.default_rng(3).integers(1, 41, 300)
    bins, offsets = packing.sum_of_squares(lengths, 40)
    gaps: list[int] = []
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
        square = lambda g: sum(c * c for k, c in Counter(g).items() if 0 < k < 40)
        fits = [square(gaps[:k] + [g - s] + gaps[k + 1 :]) for k, g in enumerate(gaps) if s <= g]
        if b == len(gaps):
            assert not fits and o == 0
            gaps.append(40 - s)
        else:
            assert o == 40 - gaps[b]
            gaps[b] -= s
            assert square(gaps) == min(fits)


# decontamination


def test_decontamination(spark):
    items = [(1, rng_text(7, 14)), (2, "Short ITEM here"), (3, rng_text(7, 14)), (10, None), (11, ""), (12, "!!")]
    texts = [*awkward(), f"a b {rng_text(7, 14)} c", rng_text(7, 9), "so short, item; HERE too", f"{rng_text(7, 12).upper()} z {rng_text(7, 14)}"]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    docs = frame(spark, texts).withColumn("item_id", F.lit(1))
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows: dict[tuple, set[str]] = {}
    for i, t in items:
        w = word.findall((t or "").lower())
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    for r in decontam.contamination(docs, bench).collect():
        w = word.findall((texts[r.doc_id] or "").lower())
        hit, ids = set(), set()
        for win, who in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids |= who
        assert (r.n_words, r.n_hit, r.item_ids, r.contaminated) == (len(w), len(hit), sorted(ids), bool(hit))
        if r.doc_id == 9:
            assert sorted((m.item_id, m.doc_word, m.item_word, m.length) for m in r.matches) == [("1", 2, 0, 14), ("3", 2, 0, 14)]
    assert sorted(r.doc_id for r in decontam.decontaminate(docs, bench).collect()) == [*range(9), 10]
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(texts)
    assert decontam.contamination(docs.limit(0), bench).count() == 0


# quality


def test_gam():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) | (x[:, 1] * x[:, 2] > 0.3)).astype(float)
    m = quality_gam.fit(x[:2000], y[:2000])
    assert (1, 2) in m.pairs and ((m.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.9
    assert quality_gam.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_classify(spark):
    good, bad = [rng_text(k, 60) + "." for k in range(150)], ["spam!! " * 40 + str(k) for k in range(150)]
    docs = frame(spark, [*good, *bad, None, ""]).withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, int(i < 150), None) for i in range(300)], "doc_id long, quality int, toxic int").union(spark.createDataFrame([(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"))
    got = quality_gam.classify(docs, labels).toPandas().set_index("doc_id")
    assert [bool(zlib.crc32(str(i).encode()) % 5 == 0) for i in got.index] == got.held_out.tolist()
    held = got[got.held_out & (got.index < 300)]
    assert (held.predicted == (held.index < 150)).mean() == 1 and got.score.between(0, 1).all() and len(got) == 302
    assert quality_gam.classify(docs, labels.limit(0)).select("score").distinct().count() == 1


def test_quality_statistics(spark):
    texts = [*awkward(), "a b c a b c a", "l1\n\nl1 x\nl1\nl1", "## $$ x|y"]
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, texts).withColumn("n_words", F.lit("x"))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        c = Counter(win)
        rep = {j for k, x in enumerate(win) if c[x] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(rep))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert quality_rules.judge(frame(spark, texts).limit(0)).count() == 0


def brute_mcd(v: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Squared distances by the same method in numpy, and the least determinant (its logarithm) that each start comes to."""
    low = lambda a, s: np.sort(a)[int(np.ceil(len(a) * s)) - 1]
    q = quality_rules
    floors = np.array([q.FLOOR[n] for n in q.VECTOR])
    med = np.array([low(c, 0.5) for c in v.T], float)
    sd = np.array([1.4826 * low(np.abs(c - k), 0.5) for c, k in zip(v.T, med, strict=True)])
    z = (v - med) / (sd + floors)
    length = (z * z).sum(1)
    u = np.where(length[:, None, None] > 0, np.einsum("ki,kj->kij", z, z) / np.where(length > 0, length, 1)[:, None, None], 0)
    starts = [(med, np.diag(sd**2)), (v.mean(0), np.cov(v.T, bias=True)), (med, np.round(u * 1e6).mean(0) / 1e6 * len(med) * np.outer(sd + floors, sd + floors))]
    found, least = [], []
    for k, (m, s) in enumerate(starts):
        before = np.inf
        for step in range(q.MOST_STEPS):
            d = np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(s + np.diag(floors**2)), v - m)
            b = np.floor(np.log2(d + 1) * q._BINS)
            near = v[b <= low(b, q.COVERAGE)]
            m, s = near.mean(0), np.cov(near.T, bias=True) * q.CONSISTENCY
            now = np.linalg.slogdet(s + np.diag(floors**2))[1]
            found.append((round(now, 9), k, step, m, s))
            if now >= before - q.FALLS:
                break
            before = now
        least.append(min(x[0] for x in found if x[1] == k))
    _, _, _, m, s = min(found, key=lambda x: x[:3])
    return np.einsum("ij,jk,ik->i", v - m, np.linalg.inv(s + np.diag(floors**2)), v - m), least


def test_outliers_equal_brute_force(spark):
    r = np.random.default_rng(2)
    texts = [rng_text(k, int(r.integers(60, 120)), 4000) for k in range(120)] + [" ".join(f"{x}###" for x in rng_text(500 + k, 70, 4000).split()) for k in range(12)]
    rows = [(i, t, None if i % 2 else "en", "a" if i % 3 else None, 1) for i, t in enumerate(texts)]
    got = quality_rules.judge(spark.createDataFrame(rows, DOCS), keep=["doc_id", "lang", "source"]).toPandas()
    for _, g in got.groupby([got.lang.fillna("-"), got.source.fillna("-")]):
        if len(g) >= quality_rules.LEAST_ROWS:
            assert np.allclose(g.distance, brute_mcd(g[list(quality_rules.VECTOR)].to_numpy(float))[0])
    assert set(got[~got.kept].doc_id) == set(range(120, 132))
    kept = quality_rules.keep_good(spark.createDataFrame(rows, DOCS))
    assert sorted(x.doc_id for x in kept.collect()) == list(range(120)) and kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert "Python" not in kept._jdf.queryExecution().toString()


def test_least_determinant_of_several_starts(spark):
    """Two clouds on a slanted line and far outliers: starts end at different determinants, and the least is taken."""
    r = np.random.default_rng(5)
    p = len(quality_rules.VECTOR)
    groups, least = {}, []
    for g in range(6):
        a = r.normal(0, 1, (150, p)) @ np.diag([300, 10, 200, 20, 10]) + np.outer(r.normal(0, 600, 150), np.ones(p))
        b = r.normal(0, 150, (60 + 10 * g, p)) + np.array([4000, -500, 300 * g, 2500, 0])
        groups[f"g{g}"] = np.round(np.concatenate([a, b])).astype(int)
    rows = spark.createDataFrame([(g, *x) for g, v in groups.items() for x in v.tolist()], "grp string, " + ", ".join(f"{c} long" for c in quality_rules.VECTOR))
    est = {e.grp: e for e in quality_rules.estimates(rows).collect()}
    for g, v in groups.items():
        d, each = brute_mcd(v.astype(float))
        l = np.array([[est[g][f"l_{i}_{j}"] if j <= i else 0 for j in range(p)] for i in range(p)])
        z = np.linalg.solve(l, (v - np.array([est[g][f"m_{i}"] for i in range(p)])).T)
        assert np.allclose((z * z).sum(0), d) and np.isclose(2 * np.log(np.diag(l)).sum(), min(each))
        least.append(max(each) - min(each))
    assert max(least) > 0.01


# language


def test_viterbi_equals_plain():
    r = np.random.default_rng(0)

    def plain(s, p):
        v = s[0].copy()
        for row in s[1:]:
            v = np.maximum(v, v.max() - p) + row
        return v.max()

    for _ in range(4000):
        n, k = r.integers(1, 60), r.integers(1, 5)
        s = r.normal(0, 2, (n, k))
        s[:, 0] += r.uniform(0, 2)
        a = r.integers(0, n)
        s[a : a + r.integers(1, 15), r.integers(0, k)] += 2.5
        o = langid.viterbi(s, 6.0)
        assert np.isclose(s[np.arange(n), o].sum() - 6.0 * (o[1:] != o[:-1]).sum(), plain(s, 6.0))


@pytest.mark.parametrize("long", [langid.LONG, 20])
def test_paths_of_many_texts(monkeypatch, long):
    """Texts of different lengths and numbers of languages together have each the path that it has alone, and a best one."""
    monkeypatch.setattr(langid, "LONG", long)
    r = np.random.default_rng(1)
    texts = [r.normal(0, 2, (n, k)) for n, k in zip(r.integers(0, 60, 400), r.integers(1, 5, 400), strict=True)]
    for s in texts:
        s[:, 0] += 1.5
        s[len(s) // 2 :][:12, -1] += 3
    for s, o in zip(texts, langid.paths(texts, 6.0), strict=True):
        assert o.tolist() == langid.viterbi(s, 6.0).tolist()
        v = s[0].copy() if len(s) else np.zeros(1)
        for row in s[1:]:
            v = np.maximum(v, v.max() - 6.0) + row
        assert np.isclose(s[np.arange(len(s)), o].sum() - 6.0 * (o[1:] != o[:-1]).sum(), v.max())


def test_viterbi_of_many_switches_takes_linear_time():
    """A text of 200,000 words that changes its language every 25 of them."""
    s = np.zeros((200_000, 3))
    lang = np.where(np.arange(len(s)) // 25 % 2, 1, 0)
    lang[:1000] = 0
    s[np.arange(len(s)), lang] = 2.0
    s[:, 0] += 0.01
    t = time.process_time()
    assert (langid.viterbi(s, 12.0) == lang).all() and time.process_time() - t < 5


def test_langid(spark):
    en, de, ru = "the house and the garden with that thing ", "der schöne Garten und das große Haus nicht ", "дом и сад что это было "
    docs = spark.createDataFrame([(i, t and t * 20, k, "s", 1) for i, (t, k) in enumerate([(en, "en"), (de, "de"), (ru, "ru"), (en, None), (None, "en")])], DOCS)
    m = langid.train(docs)
    assert m.langs == ["de", "en", "ru"]
    test = frame(spark, [en, de, ru, en * 3 + de * 3, None, "", "12 !!", "日本", "x" * 50_000]).withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in langid.identify(test, m).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["en", "de", "ru"]
    assert [s.lang for s in got[3].spans] == ["en", "de"] and abs(got[3].spans[1].start - len((en * 3).encode())) < 3
    assert [(got[i].lang_pred, got[i].score) for i in (4, 5, 6)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(test, langid.train(docs.limit(0))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_langid_by_letter_pairs(spark):
    """Two languages of one script, of three bytes a letter, whose words have the same letters in another order."""
    r = np.random.default_rng(3)
    inner = [["ბგ", "დვ", "ზთ", "კლ"], ["გბ", "ვდ", "თზ", "ლკ"]]
    texts = [" ".join("ა" + "".join(inner[k][j] for j in r.permutation(4)) + "ა" for _ in range(60)) for k in (0, 1) * 20]
    docs = spark.createDataFrame([(i, t, "ab"[i % 2], "s", 1) for i, t in enumerate(texts)], DOCS)
    m = langid.train(docs.where("doc_id < 30"))
    got = langid.identify(docs.where("doc_id >= 30").withColumn("text", F.substring_index("text", " ", 2)), m).collect()
    assert len(got) == 10 and all(x.lang_pred == "ab"[x.doc_id % 2] and x.score > 0.9 and len(x.spans) == 1 for x in got)


def test_grams_are_of_characters():
    buf = np.frombuffer("ab Ж 日本 ab".encode(), np.uint8)
    starts, ends, first, h = langid._words(buf, np.array([0, len(buf)]))
    at, kind = langid._distinct(h)
    _, of = langid._grams(buf, starts[at], ends[at])
    assert np.bincount(of).tolist() == [6, 3, 6] and kind.tolist() == [0, 1, 2, 0]


# pages


def test_html(spark):
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>menu</a></ul></nav>"
        "<div class='cookie-banner'>We use cookies on this site</div><article><h1>Title &amp; more</h1><p><b>First\n  text.<br><p>Second.<div class=ad>Buy</div></article>"
        "<section id=comments><p>great post indeed my friend</p></section><footer>&copy; x</footer></body></html>"
    )
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b>"), (None, "u", "<article>" + "<p>word " * 20_000)]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got[1].text == "Title & more\nFirst text.\nSecond." and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[3].text) == ("", "") and got[None].text.count("\n") == 19_999


def test_html_as_it_is_written():
    main = html_extract.main_text
    long = "words of a paragraph that goes on for long enough to be the text of a page and then some more of it"
    assert main('<article><p>Intro <span class="x">in</span> and out</p><p>Second</p></article>') == "Intro in and out\nSecond"
    assert main(f"<head><title>T</title><meta charset=x><body><article><p>{long}</p></article>") == long
    assert main(f'<div class="layout has-sidebar"><article><p>{long}</p></article></div>') == long
    assert main(f'<div class="content ad-free"><article><p>{long}</p></article></div>') == long
    assert main(f"<article><a name=x><p>{long}</article>") == long
    assert main('<article><p class="cookie-notice">We use cookies<ul><li class="ad">Buy<li>Item</ul><p>Rest</article>') == "Item\nRest"
    for hostile in ("<a " * 330_000, '<p class="a' * 90_000, "<b>" * 100_000 + "</i>" * 100_000 + "</b>" * 1000):
        began = time.process_time()
        main(hostile)
        assert time.process_time() - began < 3


def test_tree_fits_its_table():
    t = np.array(html_extract.TABLE, float)
    assert ((tree.decide(html_extract.model(), t[:, :-1]) >= 0.5) == t[:, -1]).all()


# near copies


def components_by_force(sets, percent):
    par = {i: i for i in sets}

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            u, v = sorted((root(a), root(b)))
            par[v] = u
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("n", "percent", "slice_"), [(3, 90, jaccard_join.SLICE), (5, 80, jaccard_join.SLICE), (5, 80, 300)])
def test_jaccard_join(spark, n, percent, slice_):
    r = np.random.default_rng(9)
    texts = awkward()
    for k in range(8):
        base = rng_text(100 + k, int(r.integers(8, 200))).split()
        for _ in range(8):
            w = list(base)
            for _ in range(int(r.integers(0, max(1, len(w) // 40) + 2))):
                w[int(r.integers(0, len(w)))] = f"e{r.integers(0, 10**6)}"
            texts.append(" ".join(w))
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    docs = frame(spark, texts).withColumn("component", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(docs, n=n, percent=percent, slice_=slice_).collect()}
    want = components_by_force(sets, percent)
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    if n == 3:
        assert sorted(r.doc_id for r in jaccard_join.keep_one(docs, n=n, percent=percent).collect()) == sorted(i for i in want if want[i] == i)
        odd = spark.createDataFrame([(None, texts[7]), (7, texts[7]), (7, texts[7])], "doc_id long, text string")
        assert sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard_join.groups(odd).collect()) == [(-1, -1), (7, 7), (7, 7)]
        assert jaccard_join.groups(odd.limit(0)).count() == 0


def test_joined_equals_all_pairs():
    """Families of near copies of one another, of copies that share boilerplate only, and both; with and without labels to begin with."""
    r = np.random.default_rng(11)
    for k in range(40):
        base = r.integers(0, 1 << 62, int(r.integers(5, 80)), dtype=np.uint64)
        members = []
        for _ in range(int(r.integers(2, 60))):
            own = base.copy()
            at = r.choice(len(own), int(r.integers(0, 1 + len(own) // (2 + k % 9))), replace=False)
            own[at] = r.integers(0, 1 << 62, len(at), dtype=np.uint64)
            members.append(np.unique(own))
        want = components_by_force({i: {*s.tolist()} for i, s in enumerate(members)}, 80)
        got = jaccard_join.joined(members, np.arange(len(members)), np.arange(len(members)), 80)
        assert [{*np.flatnonzero(got == g).tolist()} for g in dict.fromkeys(got.tolist())] == [{i for i in want if want[i] == g} for g in dict.fromkeys(want.values())]
        half = jaccard_join.joined(members[::2], np.arange(0, len(members), 2), np.arange(len(members[::2])), 80)
        label = np.arange(len(members))
        label[::2] = half
        label[::2] *= 2
        rest = jaccard_join.joined(members, label, np.arange(1, len(members), 2), 80)
        assert len({*zip(got.tolist(), rest.tolist(), strict=True)}) == len({*got.tolist()}) == len({*rest.tolist()})


def test_signatures_lose_no_pair():
    r = np.random.default_rng(4)
    for _ in range(300):
        size = int(r.integers(3, 400))
        a = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
        b = a.copy()
        k = int(r.integers(0, len(a) // 9 + 1))
        gone = r.choice(len(b), k // 2, replace=False)
        b = np.unique(np.concatenate([np.delete(b, gone), r.integers(0, 1 << 63, k - k // 2, dtype=np.uint64)]))
        i = len(np.intersect1d(a, b))
        if 100 * i >= 90 * (len(a) + len(b) - i) and not np.array_equal(a, b):
            assert len(np.intersect1d(jaccard_join.signatures(a, 90), jaccard_join.signatures(b, 90)))


@pytest.mark.parametrize("parts", [1, 50, 70_000])
def test_packed_signatures(parts):
    r = np.random.default_rng(6)
    ids = [3, -(1 << 63), (1 << 63) - 1, 0, 4, 3]
    sent = [(i, r.integers(0, 1 << 64, n, dtype=np.uint64)) for i, n in zip(ids, [300, 1, 40, 0, 700, 2], strict=True)]
    pack = jaccard_join._Packer(parts)
    rows = [row for b in [x for doc, sig in sent for x in pack.add(doc, sig)] + [*pack.rows()] for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len({row[0] for row in rows}) == len(rows) and all(0 <= row[0] < parts for row in rows)
    got = Counter(x for row in rows for x in zip(*(a.tolist() for a in jaccard_join._unpacked(*row)), strict=True))
    short = lambda x: ((x >> 32) * parts >> 32) << 40 | x & (1 << 40) - 1
    assert got == Counter((short(x), doc) for doc, sig in sent for x in sig.tolist())


def test_signatures_travel_in_few_bytes(spark):
    docs = spark.createDataFrame([(i, rng_text(i, 300, 10**6)) for i in range(2000)], "doc_id long, text string").coalesce(1)
    p = jaccard_join.Params(5, 80)
    n = sum(len(jaccard_join.signatures(s, 80)) for i in (0, 1, 2) for s in jaccard_join.sets(*textvec_buffers(rng_text(i, 300, 10**6)), 5)) / 3 * 2000
    for parts, most in ((50, 6), (1000, 8)):
        rows = jaccard_join.signature_rows(docs, p, parts).collect()
        assert sum(len(x) for row in rows for x in row if not isinstance(x, int)) < most * n


def textvec_buffers(text):
    b = np.frombuffer(text.encode(), np.uint8)
    return b, np.array([0, len(b)])


def test_jaccard_join_of_shared_ids(spark):
    """Classes whose signatures go under other ids in other tasks, one of which has the text of another class, too."""
    a, b = rng_text(1, 100, 10**6), rng_text(2, 100, 10**6)
    near = lambda t: t + " e"
    rows = [[(5, a), (6, a), (6, b)], [(7, a), (6, near(a))], [(8, near(b)), (9, b)], [(1, near(near(a))), (20, "z " * 9)]]
    docs = spark.sparkContext.parallelize(rows, 4).flatMap(lambda x: x).toDF("doc_id long, text string")
    got = {(x.doc_id, x.component_id) for x in jaccard_join.groups(docs, n=3, percent=90).collect()}
    assert got == {(i, 1) for i in (1, 5, 6, 7, 8, 9)} | {(20, 20)}


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(50, 60), (60, 60), (70, None)], "a long, b long")
    for most in (components.LOCAL, 3):
        got = {r.node: r.component for r in components.components(links, local=most).collect()}
        assert got == {k: 1 for k in range(1, 41)} | {50: 50, 60: 50}
        assert components.components(links.limit(0), local=most).count() == 0


# web archives


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/x", "<title>T &amp; U</title><p>Hello <a href='/y'>there</a><script>x</script>"), (2, None, None), (3, "http://a.b/z", "é")], "page_id long, url string, html string")
    records = warc.responses(pages)
    warc.write(records, str(tmp_path / "w"))
    back = warc.read(spark, str(tmp_path / "w"))
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(bytes(r.record) for r in records.collect())
    got = warc.derivatives(back).collect()
    assert Counter(r.record_type for r in got) == {"metadata": 3, "conversion": 3} and all(r.error is None for r in got)
    ids = {dict(warc.parse(bytes(r.record))[0])["WARC-Record-ID"] for r in records.collect()}
    assert {r.refers_to for r in got} == ids
    for r in got:
        headers, block = warc.parse(bytes(r.record))
        assert block.decode() == r.block and dict(headers)["WARC-Block-Digest"] == warc.digest(block) == r.block_digest
    text = [r.block for r in got if r.record_type == "conversion" and r.target_uri == "http://a.b/x"]
    assert text == ["T & U\nHello there"] or text == ["Hello there"]
    meta = next(r.block for r in got if r.record_type == "metadata" and r.target_uri == "http://a.b/x")
    assert '"http://a.b/y"' in meta and '"T & U"' in meta
    broken = spark.createDataFrame([(bytearray(b"nope"),), (None,)], "record binary")
    assert [r.error is not None for r in warc.derivatives(broken).collect()] == [True, True]
    assert warc.derivatives(broken.limit(0)).count() == 0


def test_warc_files_are_read_in_one_go():
    import gzip

    made = [b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(x), x) for x in (b"%d\r\n\r\n" % k + b"x" * 2000 for k in range(8000))]
    for whole in (b"".join(made), b"".join(map(gzip.compress, made)), gzip.compress(b"".join(made))):
        began = time.process_time()
        assert list(warc.split(whole)) == made
        assert time.process_time() - began < 2
    assert list(warc.split(b"")) == [] == list(warc.split(b"\r\n"))
    for broken in (made[0][:-20], b"nope\r\n\r\n", gzip.compress(made[0])[:-9]):
        with pytest.raises(ValueError):
            list(warc.split(broken))


def test_words_by_bytes():
    t = "Ab cé \t1x\n\x0bz"
    buf = np.frombuffer((t * 2).encode(), np.uint8)
    n = len(t.encode())
    s, e, first = textvec.word_spans(buf, np.array([0, n, n, 2 * n]), textvec.NOT_SPACE)
    assert first.tolist() == [0, 4, 4, 8]
    h = textvec.span_hashes(buf, s, e)
    assert (h[:4] == h[4:]).all() and len(set(h[:4].tolist())) == 4


# pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    item = rng_text(77, 12, 5000)
    good = [rng_text(700 + k, 90, 5000) for k in range(60)]
    texts = [
        *good, good[0] + " tail", good[1], f"{rng_text(900, 80, 5000)} {item}", f"{rng_text(901, 80, 5000)} ann.bee@mail3.example.com {rng_text(902, 20, 5000)}",
        "short one", None, " ".join(f"{x}###" for x in rng_text(903, 80, 5000).split()), "again and again " * 60,
    ]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = [{*range(60), 60, 61, 62, 63}, {*range(60), 62, 63}, {*range(60), 63}, {*range(60), 63}]
    for (_, stage), want in zip(corpus_pipeline.STAGES, left, strict=False):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS) and {r.doc_id for r in docs.select("doc_id").collect()} == want
    replaced = docs.where("doc_id = 63").first()
    assert "ann.bee" not in replaced.text and replaced.n_chars == len(replaced.text)
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    encoder = bpe.Encoder(tokenizer_path("byte_bpe_50k.json"))
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert packed.groupby("doc_id").length.sum().to_dict() == {i: len(encoder.batch([t])[0]) + 1 for i, t in kept.items()}
