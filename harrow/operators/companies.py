"""Companies of posting URLs, and their merge with the last snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow import vocab
from harrow.functions import pages, urls


def _named(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def _row(ats: str, name: Column, identifier: Column, domain: Column, page: Column) -> Column:
    return F.struct(name.alias("name"), F.lit(ats).alias("ats"), identifier.alias("identifier"), domain.alias("domain"), page.alias("page"))


def company_of(p: Column, body: Column | None = None, site_name: Column | None = None) -> Column:
    """struct(name, ats, identifier, domain, page) of a URL's parts; null where the URL doesn't tell one.

    `body` is the landed page behind the URL, for boards that are embedded in a company's site; `site_name` is an Oracle site's name.
    """
    none = F.lit(None).cast("string")
    body = none if body is None else body
    s, host, label = urls.segments(p), urls.bare_host(p), urls.host_label(p)
    first = F.get(s, F.lit(0))
    api = lambda base, ident, end="": F.concat(F.lit(f"{base}/"), ident, F.lit(end))

    by_for = F.coalesce(urls.param(p, "for"), label)
    slug = F.when(host.endswith("careerpuck.com"), F.coalesce(_named(F.get(s, F.lit(1)), vocab.GREENHOUSE_NAMES), F.get(s, F.lit(1))))
    board = F.when(urls.is_greenhouse_board(p), F.when(first == "embed", by_for).otherwise(first))
    green = F.coalesce(_named(host, vocab.GREENHOUSE_NAMES), board, slug, pages.greenhouse_board(body), label)
    ash = F.coalesce(_named(host, vocab.ASHBY_NAMES), urls.ashby_board(p), pages.ashby_board(body), label)

    tenant = F.split_part(p["host"], F.lit("."), F.lit(1))
    at = F.array_position(F.transform(s, F.lower), F.lit("job"))
    outside = F.filter(s, lambda x: ~F.lower(x).rlike(r"\A[a-z]{2}-[a-z]{2}\z"))
    page = F.lower(F.coalesce(F.when(at > 1, F.get(s, F.greatest(at - 2, F.lit(0)).cast("int"))), F.get(outside, F.lit(0)), F.lit("external")))
    work = F.coalesce(_named(tenant, vocab.WORKDAY_NAMES), tenant)

    parent = F.regexp_replace(p["path"], r"/[^/]*\z", "")
    n = F.array_position(s, F.lit("sites"))
    number = F.when((n > 0) & F.array_contains(s, "CandidateExperience"), F.get(s, n.cast("int")))
    oracle_page = F.concat(
        p["origin"], F.lit("/hcmRestApi/resources/latest/recruitingCEJobRequisitions?onlyData=true&finder=findReqs%3BsiteNumber%3D"), number,
        F.lit("%2Climit%3D25%2CsortBy%3DPOSTING_DATES_DESC&expand=requisitionList.secondaryLocations%2CrequisitionList.otherWorkLocations"),
    )
    oracle_name = F.coalesce(site_name if site_name is not None else none, _named(p["host"], vocab.ORACLE_NAMES), host)

    eu = F.when(F.contains(p["origin"], F.lit("eu")), "https://api.eu.lever.co/v0/postings").otherwise("https://api.lever.co/v0/postings")
    icims_search = F.when(urls.is_icims_search(p), p["href"]).otherwise(F.concat(p["origin"], F.lit("/jobs/search?ss=1&in_iframe=1")))
    known = urls.custom_company(p)
    site_page = F.coalesce(_named(known, vocab.API), F.when(known == "microsoft", F.concat(p["origin"], F.lit("/api/pcsx/search"))), F.lit(""))
    rows = {
        "greenhouse": _row("greenhouse", green, green, p["origin"], api(vocab.API["greenhouse"], green, "/jobs")),
        "lever": F.when(first.isNotNull(), _row("lever", first, first, p["origin"], F.concat(eu, F.lit("/"), first, F.lit("?mode=json")))),
        "workday": _row("workday", work, F.concat(work, F.lit("-"), page), F.concat(p["origin"], F.lit("/"), page), F.concat(p["origin"], F.lit("/wday/cxs/"), tenant, F.lit("/"), page, F.lit("/jobs"))),
        "ashby": _row("ashby", ash, ash, p["origin"], api(vocab.API["ashby"], ash)),
        "smartrecruiters": F.when(first.isNotNull(), _row("smartrecruiters", first, first, p["origin"], api(vocab.API["smartrecruiters"], first, "/postings"))),
        "oraclecloud": F.when(number.isNotNull(), _row("oraclecloud", oracle_name, host, F.concat(p["origin"], parent), oracle_page)),
        "icims": _row("icims", urls.icims_company(p), urls.icims_company(p), p["origin"], icims_search),
        "custom": _row("custom", F.coalesce(_named(known, vocab.CUSTOM_NAMES), host), F.coalesce(known, host), p["origin"], site_page),
    }
    out = F.lit(None)
    for ats, row in rows.items():
        out = F.when(urls.classify(p) == ats, row).otherwise(out)
    return out


def company_key(ats: Column, identifier: Column, domain: Column, page: Column) -> Column:
    return F.when(F.coalesce(identifier, F.lit("")) != "", F.concat_ws(":", ats, identifier)).otherwise(F.concat_ws(":", ats, domain, page))


def build(links: DataFrame, url: str = "url", order: str = "seq", body: str | None = None) -> DataFrame:
    """Companies of (url, order): attributes of a company's first URL, and all of its URLs in order."""
    c = links.withColumn("__c", company_of(urls.parts(url), F.col(body) if body else None)).where("__c is not null")
    key = company_key(*(F.col("__c")[k] for k in ("ats", "identifier", "domain", "page")))
    held = c.groupBy(key.alias("key")).agg(F.min_by("__c", order).alias("c"), F.sort_array(F.collect_list(F.struct(order, url))).alias("u"))
    return held.select("c.*", F.transform("u", lambda x: x[url]).alias("urls"))


def merge(new: DataFrame, old: DataFrame, keys: list[str], emptied: list[str]) -> DataFrame:
    """New rows, and old ones without a new one, which lose what is in the `emptied` array columns."""
    kept = old.join(new.select(*keys).distinct(), keys, "left_anti")
    for c in emptied:
        kept = kept.withColumn(c, F.array().cast(new.schema[c].dataType))
    return new.unionByName(kept.select(*new.columns))


def merge_companies(new: DataFrame, old: DataFrame) -> DataFrame:
    k = company_key(F.col("ats"), F.col("identifier"), F.col("domain"), F.col("page"))
    return merge(new.withColumn("__k", k), old.withColumn("__k", k), ["__k"], ["urls"]).drop("__k")


def by_name(companies: DataFrame) -> DataFrame:
    return companies.orderBy(F.collate(F.col("name"), "UNICODE"))
