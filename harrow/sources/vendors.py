"""Postings of applicant-tracking systems and company sites, from landed payloads.

A landed row is (name, ats, identifier, domain, page, body) of one company, and for paged ones (page_no). Each vendor is
one projection of its payload; what isn't a payload gives no rows, so one company's failure is its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrow import vocab
from harrow.functions import dates, pages, payloads, text, urls
from harrow.functions.titles import Levels

OUT = ("identifier", "company", "role", "location", "link", "posted_at")


def _instant(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd")))


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _rows(landed: DataFrame, vendor: str, path: str) -> DataFrame:
    p = payloads.parsed(F.col("body"), vendor)
    inner = p if path == "" else None
    if inner is None:
        inner = p
        for step in path.split("."):
            inner = F.get(inner[step[:-2]], F.lit(0)) if step.endswith("[]") else inner[step]
    return landed.withColumn("j", F.explode(inner))


def _project(rows: DataFrame, company: Column, role: Column, location: Column, link: Column, posted: Column | None, fresh: Column) -> DataFrame:
    out = rows.where(fresh).select(
        F.col("identifier"), company.alias("company"), role.alias("role"), location.alias("location"), link.alias("link"), (posted if posted is not None else F.lit(None).cast("timestamp")).alias("posted_at")
    )
    return out.where(F.col("link").isNotNull() & F.col("role").isNotNull())


def _fresh(as_of: Column, *ts: Column) -> Column:
    out = F.lit(False)
    for t in ts:
        out = out | dates.within_days(t, as_of)
    return out


def greenhouse(landed: DataFrame, as_of: Column) -> DataFrame:
    j = F.col("j")
    a, b = _instant(j["first_published"]), _instant(j["updated_at"])
    return _project(_rows(landed, "greenhouse", "jobs"), F.coalesce(j["company_name"], "identifier"), j["title"], _or_empty(j["location"]["name"]), j["absolute_url"], F.coalesce(a, b), _fresh(as_of, a, b))


def lever(landed: DataFrame, as_of: Column) -> DataFrame:
    j = F.col("j")
    t = F.timestamp_millis(j["createdAt"])
    return _project(_rows(landed, "lever", ""), text.capitalize(F.col("identifier")), j["text"], _or_empty(j["categories"]["location"]), j["hostedUrl"], t, _fresh(as_of, t))


def workday(landed: DataFrame, as_of: Column) -> DataFrame:
    """Pages go on while one is full and its last row is from today; a bad page discards the company's rows."""
    p = payloads.parsed(F.col("body"), "workday")["jobPostings"]
    n = F.size(p)
    w = W.partitionBy("identifier")
    goes_on = (n == 20) & (F.element_at(p, -1)["postedOn"] == "Posted Today")
    held = landed.withColumn("p", p).withColumn("bad", F.max(F.col("p").isNull().cast("int")).over(w))
    before = F.min(F.coalesce(goes_on, F.lit(False)).cast("int")).over(w.orderBy("page_no").rowsBetween(W.unboundedPreceding, -1))
    held = held.withColumn("reached", F.coalesce(before, F.lit(1))).where("bad = 0 and reached = 1 and page_no < 20")
    j = F.col("j")
    rows = held.withColumn("j", F.explode("p"))
    return _project(rows, text.capitalize(F.col("name")), j["title"], _or_empty(j["locationsText"]), F.concat("domain", j["externalPath"]), as_of, j["postedOn"] == "Posted Today")


def ashby(landed: DataFrame, as_of: Column) -> DataFrame:
    j = F.col("j")
    t = _instant(j["publishedAt"])
    return _project(_rows(landed, "ashby", "jobs"), text.capitalize(F.col("identifier")), j["title"], _or_empty(j["location"]), j["jobUrl"], t, _fresh(as_of, t))


def smartrecruiters(landed: DataFrame, as_of: Column) -> DataFrame:
    j = F.col("j")
    t = _instant(j["releasedDate"])
    return _project(_rows(landed, "smartrecruiters", "content"), text.capitalize(j["company"]["name"]), j["name"], _or_empty(j["location"]["fullLocation"]), F.concat_ws("/", "domain", "name", j["id"]), t, _fresh(as_of, t))


def oraclecloud(landed: DataFrame, as_of: Column) -> DataFrame:
    j = F.col("j")
    t = _instant(j["PostedDate"])
    return _project(_rows(landed, "oraclecloud", "items[].requisitionList"), text.capitalize(F.col("name")), j["Title"], _or_empty(j["PrimaryLocation"]), F.concat_ws("/", "domain", j["Id"]), t, _fresh(as_of, t))


def icims(landed: DataFrame, as_of: Column) -> DataFrame:
    """Cards of a search page; no date, each link once."""
    rows = landed.withColumn("j", F.explode(pages.search_cards("body")))
    j = F.col("j")
    at = urls.parts(F.when(j["href"].startswith("/"), F.concat("domain", j["href"])).otherwise(j["href"]))
    rows = rows.withColumn("u", at).where(F.col("u")["path"].rlike(r"(?i)/jobs/\d+/.*job\z"))
    link = urls.without_params(F.col("u"), vocab.ICIMS_PARAMS)
    return _project(rows, text.capitalize(F.col("identifier")), j["title"], text.card_location(j["meta"]), link, None, F.lit(True)).dropDuplicates(["link"])


def amazon(landed: DataFrame, as_of: Column) -> DataFrame:
    j = F.col("j")["fields"]
    first = lambda c: F.get(c, F.lit(0))
    a, b = F.timestamp_seconds(first(j["createdDate"])), F.timestamp_seconds(first(j["updatedDate"]))
    return _project(_rows(landed, "amazon", "searchHits"), F.lit("Amazon"), first(j["title"]), _or_empty(first(j["location"])), F.concat(F.lit("https://amazon.jobs/en/jobs/"), first(j["icimsJobId"])), F.coalesce(a, b), _fresh(as_of, a, b))


def microsoft(landed: DataFrame, as_of: Column) -> DataFrame:
    j = F.col("j")
    a, b = F.timestamp_seconds(j["creationTs"]), F.timestamp_seconds(j["postedTs"])
    link = F.concat_ws("/", "domain", F.regexp_replace(j["url"], r"\A/", ""))
    return _project(_rows(landed, "microsoft", "data.positions"), F.col("name"), j["name"], _or_empty(F.get(j["location"], F.lit(0))), link, F.coalesce(b, a), _fresh(as_of, a, b))


def google(landed: DataFrame, as_of: Column) -> DataFrame:
    """Cards with a meta line 'company | location'."""
    j = F.col("j")
    rows = landed.withColumn("j", F.explode(pages.search_cards("body"))).where(F.contains(j["meta"], F.lit("|")))
    company, place = F.trim(F.split_part(j["meta"], F.lit("|"), F.lit(1))), F.trim(F.regexp_extract(j["meta"], r"\|(.*)\z", 1))
    return _project(rows, company, j["title"], place, F.concat(F.lit(vocab.API["google"] + "/"), F.regexp_replace(j["href"], r"\A\./", "")), None, F.lit(True))


def meta(landed: DataFrame, as_of: Column) -> DataFrame:
    j = F.col("j")
    places = F.array_join(F.filter(j["locations"], lambda x: x != ""), ", ")
    link = F.concat(F.lit("https://www.metacareers.com/profile/job_details/"), j["id"])
    return _project(_rows(landed, "meta", "data.job_search_with_featured_jobs.all_jobs"), text.capitalize(F.col("name")), j["title"], _or_empty(places), link, None, j["id"].isNotNull())


def apple(landed: DataFrame, as_of: Column, days: int = 3) -> DataFrame:
    """Cards with a posting date; older than `days` go, and those without one."""
    j = F.col("j")
    t = F.try_to_timestamp(F.regexp_extract(j["meta"], r"([A-Z][a-z]{2} \d{2}, \d{4})", 1), F.lit("MMM dd, yyyy"))
    place = F.trim(F.regexp_extract(j["meta"], r"Location\s*(.*)\z", 1))
    link = F.when(j["href"].startswith("/"), F.concat(F.lit("https://jobs.apple.com"), j["href"])).otherwise(j["href"])
    return _project(landed.withColumn("j", F.explode(pages.search_cards("body"))), F.lit("Apple"), j["title"], place, link, t, F.coalesce(dates.age_in_days(t, as_of) <= days, F.lit(False)))


def netflix(landed: DataFrame, as_of: Column) -> DataFrame:
    j = F.col("j")
    return _project(_rows(landed, "netflix", "positions"), F.lit("Netflix"), j["posting_name"], _or_empty(j["location"]), j["canonicalPositionUrl"], None, F.lit(True))


def tiktok(landed: DataFrame, as_of: Column) -> DataFrame:
    j = F.col("j")
    rows = _rows(landed.where(payloads.parsed(F.col("body"), "tiktok")["code"] == 0), "tiktok", "data.job_post_list")
    city = j["city_info"]
    return _project(rows, F.col("name"), j["title"], F.coalesce(city["en_name"], city["name"], F.lit("Unsure")), F.concat(F.lit("https://lifeattiktok.com/search/"), j["id"]), None, F.lit(True))


def amd(landed: DataFrame, as_of: Column) -> DataFrame:
    """Pages go on while every row of one is from today (UTC)."""
    j = F.col("j")["data"]
    t = _instant(j["posted_date"])
    rows = _rows(landed, "amd", "jobs").withColumn("today", dates.same_utc_day(t, as_of))
    stop = F.min(F.when(~F.col("today"), F.col("page_no"))).over(W.partitionBy("identifier"))
    rows = rows.withColumn("stop", stop).where("stop is null or page_no <= stop")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    place = F.coalesce(some(j["full_location"]), some(j["short_location"]), some(j["location_name"]), F.nullif(F.concat_ws(", ", some(j["city"]), some(j["state"]), some(j["country"])), F.lit("")), F.lit(""))
    link = F.concat(F.lit("https://careers.amd.com/careers-home/jobs/"), j["req_id"], F.lit("?lang=en-us"))
    return _project(rows, F.lit("AMD"), j["title"], place, link, t, F.col("today"))


VENDORS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {
    "greenhouse": greenhouse, "lever": lever, "workday": workday, "ashby": ashby, "smartrecruiters": smartrecruiters, "oraclecloud": oraclecloud, "icims": icims,
}
CUSTOM: dict[str, Callable[[DataFrame, Column], DataFrame]] = {"amazon": amazon, "microsoft": microsoft, "google": google, "meta": meta, "apple": apple, "netflix": netflix, "tiktok": tiktok, "amd": amd}


def discover(landed: DataFrame, as_of: Column, categories: list[str], levels: Levels | None = None, known: DataFrame | None = None) -> DataFrame:
    """Jobs of all companies whose title is a target, without those whose exact link is known (`known`: link).

    A company's own site is told by its page; one without a page has no rows.
    """
    levels = levels or Levels()
    out = None
    for ats, fn in VENDORS.items():
        jobs = fn(landed.where(F.col("ats") == ats), as_of).withColumn("ats", F.lit(ats))
        out = jobs if out is None else out.unionByName(jobs)
    site = urls.custom_company(urls.parts("page"))
    custom = landed.where("ats = 'custom' and page <> ''").withColumn("__site", site)
    for name, fn in CUSTOM.items():
        out = out.unionByName(fn(custom.where(F.col("__site") == name), as_of).withColumn("ats", F.lit("custom")))
    out = out.where(levels.target(F.col("role"), categories))
    return out if known is None else out.join(known.select("link").distinct(), "link", "left_anti")
