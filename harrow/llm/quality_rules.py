"""Quality rules: robust multivariate outliers by minimum covariance determinant, per language and source.

Everything here is DataFrame expressions and aggregates. Each text gives a vector of transformed statistics (shares and
log ratios, in whole thousandths, so sums over a group are exact whatever their order). In each group of language and
source, concentration steps look for the share COVERAGE of vectors whose covariance has the least determinant: keep the vectors
nearest by Mahalanobis distance, estimate again from these, until the determinant falls no more. Three deterministic starts do so (medians and
median deviations; mean and covariance of all; spatial signs round the medians), and of all estimates on the way the one with the least
determinant is the group's. A text is rejected when its distance from that is beyond a fixed cutoff, or by the base rules.

Group sums and counts of values (for the quantiles) are aggregated before they are shuffled, so a source with a third of
all rows is no task's own; the estimates (a row per group and start) are joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.common import cut

SPACES = r"[ \t\n\x0B\f\r]"
SYMBOLS = "[#*$%&|<>]"
VECTOR = ("x_symbols", "x_upper", "x_length", "x_dup", "x_repeat")
#: Standard deviations (thousandths) that are added to each dimension's own: less than that is nobody's fault.
FLOOR = {"x_symbols": 60.0, "x_upper": 40.0, "x_length": 60.0, "x_dup": 150.0, "x_repeat": 100.0}
COVERAGE = 0.75
#: The logarithm of a determinant falls by less when steps have converged, which takes some five; quantised distances could go round for ever.
FALLS, MOST_STEPS = 1e-4, 30
#: Rows that a group needs for an estimate of its own, eight for each dimension: with fewer, what is nearest is chance. Smaller groups of a language are one group, and so on.
LEAST_ROWS = 40
#: Squared distance beyond which a vector is an outlier: the chi-square quantile of 0.999 for 5 dimensions.
CUTOFF = 20.5
#: What a covariance of the nearest 3/4 in 5 normal dimensions is short of (the share within the quantile, by the next chi-square).
CONSISTENCY = 1.68
#: Groups (of some 200 bytes) that are broadcast at most; more are shuffled.
MOST_BROADCAST = 50_000
_BINS = 32


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and n_upper; a null text has none of anything."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, SPACES + "+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(SPACES.replace("[", "[^")))
    out = docs.withColumns(
        {
            "__w": words,
            "__l": lines,
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long"),
        }
    )
    # the last two windows hold fewer words, and equal no other
    out = out.withColumn("__h", F.expr("transform(__w, (x, i) -> if(i < size(__w) - 2, xxhash64(x, get(__w, i + 1), get(__w, i + 2)), null))"))
    out = out.withColumn("__h", F.expr("if(size(__w) < 3, array(), slice(__h, 1, size(__w) - 2))"))
    out = out.withColumn("__s", F.expr("if(size(array_distinct(__h)) = size(__h), null, sort_array(transform(__h, (h, i) -> struct(h, i))))"))
    out = out.withColumn("__p", F.expr("sort_array(transform(filter(__s, (p, k) -> p.h = get(__s, k - 1).h or p.h = get(__s, k + 1).h), p -> p.i))"))
    return out.withColumns(
        {
            "n_words": F.size("__w").cast("long"),
            "word_chars": F.length(F.array_join("__w", "")).cast("long"),
            "n_lines": F.size("__l").cast("long"),
            "n_dup_lines": (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long"),
            "n_repeat_words": F.expr("coalesce(aggregate(transform(__p, (p, k) -> least(3, coalesce(get(__p, k + 1), p + 3) - p)), 0L, (a, x) -> a + x), 0L)"),
        }
    ).drop("__w", "__l", "__h", "__s", "__p")


def _share(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def vectors(stats: DataFrame) -> DataFrame:
    milli = lambda c: F.round(c * 1000).cast("long")
    return stats.withColumns(
        {
            "x_symbols": milli(F.log1p(_share("n_symbols", "n_words"))),
            "x_upper": milli(_share("n_upper", "word_chars")),
            "x_length": milli(F.log1p(_share("word_chars", "n_words"))),
            "x_dup": milli(_share("n_dup_lines", "n_lines")),
            "x_repeat": milli(_share("n_repeat_words", "n_words")),
        }
    )


def _bin(c: Column) -> Column:
    return F.floor(F.log2(c + 1) * _BINS).cast("int")


def _whitened(rows: DataFrame, x: tuple[str, ...]) -> DataFrame:
    """rows with d2. A z refers to those before it, so no expression grows with the square of the dimensions."""
    z = []
    for i, name in enumerate(x):
        r = F.col(name) - F.col(f"m_{i}")
        for j in range(i):
            r = r - F.col(f"l_{i}_{j}") * F.col(f"z_{j}")
        z.append((r / F.col(f"l_{i}_{i}")).alias(f"z_{i}"))
    d2 = reduce(lambda a, c: a + c, (F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(len(x))))
    return rows.select("*", *z, d2.alias("d2"))


def _names(p: int) -> list[str]:
    return [*(f"m_{i}" for i in range(p)), *(f"l_{i}_{j}" for i in range(p) for j in range(i + 1))]


def _factor(cov: DataFrame, x: tuple[str, ...]) -> DataFrame:
    """(grp, start, m_i, l_i_j, logdet) of (grp, start, m_i, s_i_j), with the floors added to the diagonal."""
    factor = []
    for i in range(len(x)):
        for j in range(i + 1):
            r = F.col(f"s_{i}_{j}") + (F.lit(FLOOR[x[i]] ** 2) if i == j else F.lit(0.0))
            for k in range(j):
                r = r - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            factor.append((F.sqrt(r) if i == j else r / F.col(f"l_{j}_{j}")).alias(f"l_{i}_{j}"))
    logdet = reduce(lambda a, c: a + c, (2 * F.log(f"l_{i}_{i}") for i in range(len(x))))
    return cov.select("grp", "start", *(f"m_{i}" for i in range(len(x))), *factor, logdet.alias("logdet"))


def _sums(x: tuple[str, ...]) -> list[Column]:
    return [
        F.count("*").alias("n"),
        *(F.sum(c).alias(f"t_{i}") for i, c in enumerate(x)),
        *(F.sum(F.col(x[i]) * F.col(x[j])).alias(f"t_{i}_{j}") for i in range(len(x)) for j in range(i + 1)),
    ]


def _covariance(p: int, times: float) -> list[Column]:
    mean = [F.col(f"t_{i}") / F.col("n") for i in range(p)]
    return [*(mean[i].alias(f"m_{i}") for i in range(p)), *(((F.col(f"t_{i}_{j}") / F.col("n") - mean[i] * mean[j]) * times).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1))]


def _low(column: str, share: float) -> Column:
    """The smallest value that `share` of the rows reach."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {column})")


def _starts(rows: DataFrame, x: tuple[str, ...], few: bool) -> DataFrame:
    """(grp, start, m_i, s_i_j): where the concentration steps begin."""
    p = len(x)
    pairs = [(i, j) for i in range(p) for j in range(i + 1)]
    base = cut(rows.groupBy("grp").agg(*(_low(c, 0.5).alias(f"med_{i}") for i, c in enumerate(x)), *_sums(x)))
    far = _with_groups(rows, base.select("grp", *(f"med_{i}" for i in range(p))), ["grp"], few).select("grp", *(F.abs(F.col(c) - F.col(f"med_{i}")).alias(f"a_{i}") for i, c in enumerate(x)))
    base = cut(base.join(far.groupBy("grp").agg(*(_low(f"a_{i}", 0.5).alias(f"mad_{i}") for i in range(p))), "grp"))
    sd = [F.col(f"mad_{i}") * 1.4826 for i in range(p)]
    z = _with_groups(rows, base.select("grp", *(f"{k}_{i}" for i in range(p) for k in ("med", "mad"))), ["grp"], few)
    z = z.select("grp", *(((F.col(c) - F.col(f"med_{i}")) / (sd[i] + FLOOR[c])).alias(f"z_{i}") for i, c in enumerate(x)))
    q = reduce(lambda a, c: a + c, (F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(p)))
    sign = z.withColumn("q", q).groupBy("grp").agg(*(F.sum(F.when(F.col("q") > 0, F.round(F.col(f"z_{i}") * F.col(f"z_{j}") / F.col("q") * 1e6)).otherwise(0).cast("long")).alias(f"u_{i}_{j}") for i, j in pairs))
    medians = [F.col(f"med_{i}").cast("double").alias(f"m_{i}") for i in range(p)]
    diagonal = base.select("grp", F.lit(0).alias("start"), *medians, *((F.pow(sd[i], 2) if i == j else F.lit(0.0)).alias(f"s_{i}_{j}") for i, j in pairs))
    whole = base.select("grp", F.lit(1).alias("start"), *_covariance(p, 1.0))
    signs = base.join(sign, "grp").select("grp", F.lit(2).alias("start"), *medians, *((F.col(f"u_{i}_{j}") / F.col("n") / 1e6 * p * (sd[i] + FLOOR[x[i]]) * (sd[j] + FLOOR[x[j]])).alias(f"s_{i}_{j}") for i, j in pairs))
    return diagonal.union(whole).union(signs)


def estimates(rows: DataFrame, x: tuple[str, ...] = VECTOR, few: bool = True) -> DataFrame:
    """(grp, m_i, l_i_j): location and Cholesky factor of the scatter of each group of (grp, x...), of the least determinant found."""
    p = len(x)
    going = cut(_factor(_starts(rows, x, few), x).withColumn("logdet", F.lit(float("inf"))))
    found = []
    for step in range(MOST_STEPS):
        near = _whitened(_with_groups(rows, going.drop("logdet"), ["grp"], few, "inner"), x).select("grp", "start", *x, _bin(F.col("d2")).alias("b"))
        limit = near.groupBy("grp", "start").agg(_low("b", COVERAGE).alias("limit"))
        held = _with_groups(near, limit, ["grp", "start"], few).where(F.col("b") <= F.col("limit"))
        new = _factor(held.groupBy("grp", "start").agg(*_sums(x)).select("grp", "start", *_covariance(p, CONSISTENCY)), x)
        new = cut(new.join(going.select("grp", "start", F.col("logdet").alias("before")), ["grp", "start"]))
        found.append(new.select("grp", "start", F.lit(step).alias("step"), *_names(p), "logdet"))
        going = new.where(F.col("logdet") < F.col("before") - FALLS).drop("before")
        if not going.limit(1).count():
            break
    best = reduce(DataFrame.union, found).groupBy("grp").agg(F.min_by(F.struct(*_names(p)), F.struct("logdet", "start", "step")).alias("e"))
    return cut(best.select("grp", "e.*"))


def _measured(rows: DataFrame) -> DataFrame:
    """rows (of __lang, __source, __text and others) with statistics, vectors and base_failed, without __text."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    stats = vectors(statistics(rows, "__text")).drop("__text")
    return stats.withColumns({"base_failed": F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"), "__lang": part("__lang"), "__source": part("__source")})


def _fitted(stats: DataFrame, least_rows: int) -> tuple[DataFrame, bool]:
    """(__lang, __source, m_i, l_i_j) of those that have an estimate, by the rows that pass the base rules; whether these are few."""
    passed = stats.where("not base_failed").select("__lang", "__source", *VECTOR)
    sizes = passed.groupBy("__lang", "__source").agg(F.count("*").alias("n"))
    small = sizes.where(F.col("n") < least_rows).groupBy("__lang").agg(F.sum("n").alias("n_small"))
    by_lang = F.when(F.col("n_small") >= least_rows, F.to_json(F.array("__lang"))).otherwise("[]")
    named = cut(sizes.join(small, "__lang", "left").select("__lang", "__source", "n", F.when(F.col("n") >= least_rows, F.to_json(F.array("__lang", "__source"))).otherwise(by_lang).alias("grp")))
    few = named.count() <= MOST_BROADCAST
    enough = named.groupBy("grp").agg(F.sum("n").alias("n")).where(F.col("n") >= least_rows).select("grp")
    named = named.join(enough, "grp", "left_semi").select("__lang", "__source", "grp")
    rows = cut(_with_groups(passed, named, ["__lang", "__source"], few, "inner").select("grp", *VECTOR))
    return cut(named.join(estimates(rows, VECTOR, few), "grp").drop("grp")), few


def _with_groups(rows: DataFrame, groups: DataFrame, on: list[str], few: bool, how: str = "left") -> DataFrame:
    """rows, joined with a row per group, which is broadcast if groups are few (MOST_BROADCAST), counted beforehand."""
    return rows.join(F.broadcast(groups) if few else groups, on, how)


def _verdict() -> Column:
    return ~F.col("base_failed") & (F.col("d2").isNull() | (F.col("d2") <= CUTOFF))


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None, least_rows: int = LEAST_ROWS) -> DataFrame:
    """One row per row of docs: the columns `keep` (doc_id), the statistics, base_failed, kept, distance (squared; null without an estimate).

    base_failed: fewer than 50 words, or more than half of them in 3-word windows that repeat. Only rows that pass the
    base rules are in the estimates. A null language or source is a group of its own. A null text has no words and
    fails the base rules. A group too small for an estimate joins the other small ones of its language, then those of all
    languages; fewer than least_rows in all are not judged by distance, and pass. Repeated rows count each, and ties in distance are kept
    or rejected together. Very long texts are measured whole. An empty table gives no rows. Other columns, whatever their names, are left behind.
    """
    keep = keep or ["doc_id"]
    rows = docs.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)), F.col(lang_col).alias("__lang"), F.col(source_col).alias("__source"), F.col(text_col).alias("__text"))
    stats = cut(_measured(rows))
    fitted, few = _fitted(stats, least_rows)
    out = _whitened(_with_groups(stats, fitted, ["__lang", "__source"], few), VECTOR)
    return out.select(
        *(F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)),
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"),
        _verdict().alias("kept"),
        F.col("d2").alias("distance"),
        *VECTOR,
    )


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_rows: int = LEAST_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that judge() keeps; nulls, ties, repeats and empty tables as there. Each text is measured once."""
    side = [F.col(lang_col).alias("__lang"), F.col(source_col).alias("__source"), F.col(text_col).alias("__text")]
    rows = cut(_measured(docs.select(F.struct(*docs.columns).alias("__row"), *side))).where("not base_failed")  # above the checkpoint: below it, a text would be measured anew for every use of a statistic
    fitted, few = _fitted(rows, least_rows)
    return _whitened(_with_groups(rows, fitted, ["__lang", "__source"], few), VECTOR).where(_verdict()).select("__row.*")
