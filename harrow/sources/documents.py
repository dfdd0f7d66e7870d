"""Descriptions of postings, from landed documents: which address to fetch, and the text of what came."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow import vocab
from harrow.functions import pages, text, urls


def _after_job(p: Column) -> Column:
    s = urls.segments(p)
    at = F.array_position(F.transform(s, F.lower), F.lit("job"))
    return F.when(at > 0, F.array_join(F.slice(s, at + 1, F.greatest(F.size(s) - at, F.lit(0)).cast("int")), "/"))


def document_url(p: Column, raw: Column) -> Column:
    """Where a posting's description is fetched; null if the posting's URL doesn't tell."""
    kind = urls.classify(p)
    s = urls.segments(p)
    number = urls.last_number(p["path"])
    board = F.coalesce(F.when(urls.is_greenhouse_board(p), F.get(s, F.lit(0))), urls.host_label(p))
    greenhouse = F.concat(F.lit(vocab.API["greenhouse"] + "/"), board, F.lit("/jobs/"), F.coalesce(urls.param(p, "gh_jid"), F.nullif(F.regexp_extract(p["path"], r"/jobs/(\d+)", 1), F.lit(""))))
    smart = F.concat(F.lit(vocab.API["smartrecruiters"] + "/"), F.get(s, F.lit(0)), F.lit("/postings/"), number)
    tenant = F.split_part(p["host"], F.lit("."), F.lit(1))
    locale = F.filter(s, lambda x: ~x.rlike(r"\A[a-z]{2}-[A-Z]{2}\z"))
    workday = F.concat(p["origin"], F.lit("/wday/cxs/"), tenant, F.lit("/"), F.get(locale, F.lit(0)), F.lit("/job/"), _after_job(p))
    ashby = F.concat(F.lit(vocab.API["ashby"] + "/"), F.get(s, F.lit(0)))
    site, ident = F.regexp_extract(p["path"], r"/sites/([^/]+)/job/(\d+)", 1), F.regexp_extract(p["path"], r"/sites/([^/]+)/job/(\d+)", 2)
    oracle = F.when(
        site != "",
        F.concat(p["origin"], F.lit('/hcmRestApi/resources/latest/recruitingCEJobRequisitionDetails?expand=all&onlyData=true&finder=ById;Id="'), ident, F.lit('",siteNumber='), site),
    )
    netflix = F.concat(F.lit(vocab.API["netflix"] + "/"), F.coalesce(urls.param(p, "pid"), number))
    custom = F.when(urls.custom_company(p) == "netflix", netflix).otherwise(raw)
    return (
        F.when(kind == "greenhouse", greenhouse).when(kind == "smartrecruiters", smart).when(kind == "workday", workday)
        .when(kind == "ashby", ashby).when(kind == "oraclecloud", oracle).otherwise(custom)
    )


def _json(body: Column, *paths: str) -> Column:
    return F.concat_ws("\n\n", *(F.get_json_object(body, p) for p in paths))


def document_text(jobs: DataFrame, landed: DataFrame, link: str = "link") -> DataFrame:
    """jobs with raw_jd, err_code and err_desc: the landed document of each, as text.

    A job without an address is code 400; one that wasn't landed is code 0 (a network failure); a document without text is 404; a
    text says code 200, whatever was landed. Ashby's board is one document for many postings, looked up by id.
    """
    j = jobs.withColumn("__p", urls.parts(link)).withColumn("__doc", document_url(F.col("__p"), F.col(link))).withColumn("__kind", urls.classify(F.col("__p")))
    d = landed.select(F.col("url").alias("__doc"), F.col("code").alias("__code"), F.col("desc").alias("__desc"), F.col("body").alias("__body"))
    both = j.join(d, "__doc", "left")
    body = F.col("__body")
    posting = F.get(urls.segments(F.col("__p")), F.lit(1))
    found = F.filter(F.from_json(body, "jobs array<struct<id:string,title:string,descriptionHtml:string,descriptionPlain:string>>")["jobs"], lambda x: x["id"] == posting)
    ashby = F.coalesce(F.get(found, F.lit(0))["descriptionPlain"], pages.html_to_text(F.get(found, F.lit(0))["descriptionHtml"]))
    html_json = {
        "greenhouse": _json(body, "$.title", "$.location.name", "$.content"), "workday": _json(body, "$.jobPostingInfo.title", "$.jobPostingInfo.location", "$.jobPostingInfo.jobDescription"),
        "smartrecruiters": _json(body, "$.name", "$.jobAd.sections.jobDescription.text", "$.jobAd.sections.qualifications.text", "$.jobAd.sections.additionalInformation.text"),
        "oraclecloud": _json(body, "$.items[0].Title", "$.items[0].PrimaryLocation", "$.items[0].ExternalDescriptionStr", "$.items[0].ExternalQualificationsStr", "$.items[0].ExternalResponsibilitiesStr"),
    }
    kind = F.col("__kind")
    plain = F.lit(None).cast("string")
    for k, c in html_json.items():
        plain = F.when(kind == k, F.when(F.try_parse_json(body).isNotNull(), text.decode_entities(c))).otherwise(plain)
    site = urls.custom_company(F.col("__p"))
    scraped = F.when(kind == "icims", pages.icims_description(body)).when(site == "apple", pages.apple_description(body)).when(site == "netflix", _json(body, "$.name", "$.job_description")).otherwise(pages.page_description(body))
    scraped = F.when(~F.contains(F.lower(scraped), F.lit("not found")), scraped)
    raw = F.when(kind == "ashby", ashby).when(kind.isin(*html_json), pages.html_to_text(plain)).otherwise(scraped)
    raw = text.normalize_lines(raw)
    fetched = F.coalesce(F.col("__code"), F.lit(0))
    code = F.when(F.col("__doc").isNull(), 400).when((fetched == 0) | (fetched >= 400), fetched).when(raw.isNull(), 404).otherwise(200)
    desc = F.when(F.col("__doc").isNull(), "invalid URL").otherwise(F.coalesce(F.col("__desc"), F.lit("")))
    out = both.withColumn("raw_jd", F.when((fetched > 0) & (fetched < 400), raw)).withColumn("err_code", code).withColumn("err_desc", desc)
    return out.drop("__p", "__doc", "__kind", "__code", "__desc", "__body")
