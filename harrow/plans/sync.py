"""One synchronisation: from new postings to the rows that are kept, seen and told about."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow import models
from harrow.config import Config
from harrow.operators import dedup, eligibility, ranking
from harrow.sources import documents


@dataclass
class Result:
    results: DataFrame  # every incoming job with its status
    jobs: DataFrame  # kept ones, with ids
    opportunities: DataFrame  # what counts as seen and is listed
    seen: DataFrame  # (url) to add to history


def process(
    incoming: DataFrame,
    history: DataFrame,
    landed: DataFrame,
    as_of: Column,
    config: Config,
    provider: models.Provider | None,
    skip: Callable[[DataFrame], Column] | None = None,
    last_id: int = 0,
    most: int | None = None,
    parity: bool = True,
) -> Result:
    """The state machine of a batch (company, role, link, location, seq) against history (link).

    status, the first that holds: idempotent (the key is known), deadline (beyond the `most` first jobs; tried again next
    time), filtered (`skip` says so), invalid (the document or its analysis is an error; tried again), ineligible, kept. A kept job
    without a description has no id. Known keys go before documents are joined and models asked, and the state after that is
    checkpointed: all four outputs come from the same rows.
    """
    keyed = dedup.with_key(incoming, parity=parity)
    known = dedup.with_key(history.select("link"), parity=parity).select("job_key").distinct().withColumn("__known", F.lit(True))
    keyed = keyed.join(known, "job_key", "left")
    idempotent = keyed.where("__known").drop("__known")
    todo = keyed.where("__known is null").drop("__known")
    if not parity:
        once = dedup.first_by_key(todo, "job_key", "seq")
        idempotent = idempotent.unionByName(todo.join(once.select("seq"), "seq", "left_anti"))
        todo = once
    late = todo.limit(0)
    if most is not None:
        first = todo.orderBy("seq").limit(most)
        late = todo.join(first.select("seq"), "seq", "left_anti")
        todo = first
    filtered = skip(todo) if skip else F.lit(False)
    todo = todo.withColumn("__skip", F.coalesce(filtered, F.lit(False)))
    asked = documents.document_text(todo.where("not __skip"), landed)
    asked = models.analyze(asked, provider)
    code = F.when(F.coalesce(F.col("err_code") >= 400, F.lit(False)) & (F.col("err_code") != 404), F.col("err_code")).otherwise(F.coalesce("parse_code", F.when(F.col("err_code") == 404, 200), "err_code"))
    asked = asked.withColumn("code", code)
    why = eligibility.reason(F.col("jd.country"), F.col("jd.category"), F.col("jd.citizenship"), F.col("jd.sponsorship"), config)
    asked = asked.withColumn("reason", F.when(F.col("jd").isNotNull(), why))
    status = F.when(F.col("code") >= 400, "invalid").when(F.col("reason").isNotNull(), "ineligible").otherwise("kept")
    base = ["company", "role", "link", "location", "seq", "job_key"]
    asked = asked.select(*base, "jd", "cost", "code", "reason", status.alias("status"))
    plain = lambda df, s: df.select(*base, F.lit(s).alias("status"))
    results = asked
    for df, s in ((idempotent, "idempotent"), (late, "deadline"), (todo.where("__skip"), "filtered")):
        results = results.unionByName(plain(df, s), allowMissingColumns=True)
    results = results.checkpoint()
    kept = results.where("status = 'kept'")
    numbered = ranking.assign_ids(kept.where("jd is not null"), last_id, [F.col("seq")])
    jobs = numbered.unionByName(kept.where("jd is null"), allowMissingColumns=True)
    jobs = jobs.select("id", "company", "role", "link", "location", "jd", "seq")
    listed = results.where("status in ('kept', 'ineligible', 'filtered')").join(jobs.select("seq", "id"), "seq", "left")
    listed = listed.select("id", "company", "role", "link", "location", "jd", F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("postedAt"), "seq")
    return Result(results, jobs, listed, listed.select(F.col("link").alias("url")).distinct())


def country_filter(allowed: list[str]) -> Callable[[DataFrame], Column]:
    """Skips jobs whose country isn't allowed; for jobs that models.locate has seen."""
    return lambda df: ~eligibility.in_countries(F.col("country"), allowed)
