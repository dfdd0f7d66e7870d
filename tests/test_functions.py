from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harrow import models
from harrow.functions import dates, pages, payloads, text, titles, urls

KEYS = [
    ("https://job-boards.greenhouse.io/acme/jobs/123456?gh_jid=999999", "greenhouse:999999"),
    ("https://job-boards.greenhouse.io/acme/jobs/123456", "greenhouse:123456"),
    ("https://boards.greenhouse.io/embed/job_app?token=8577877002", "greenhouse:8577877002"),
    ("https://acme.wd1.myworkdayjobs.com/x/job/US-Arizona-Phoenix/AI-Software-Engineering-Intern_JR0282641", "workday:JR0282641"),
    ("https://acme.wd1.myworkdayjobs.com/x/job/Software-Engineer_R-12345?source=LinkedIn", "workday:R-12345"),
    ("https://acme.wd1.myworkdayjobs.com/x/job/Software-Engineer_R-12345-1", "workday:R-12345"),
    ("https://jobs.ashbyhq.com/acme/ABC-DEF-123", "ashby:abc-def-123"),
    ("https://jobs.lever.co/acme/ABC-DEF-123", "lever:abc-def-123"),
    ("https://jobs.smartrecruiters.com/SmartRecruiters-Inc/743999999999999-software-engineer-intern", "smartrecruiters:743999999999999"),
    ("https://x.fa.oraclecloud.com/careers/JOB/123456789/software-engineer", "oraclecloud:123456789"),
    ("https://x.icims.com/JOBS/123456/software-engineer-intern/job", "icims:123456"),
    ("https://www.google.com/about/careers/applications/jobs/results/101633639661347526-data-center-facilities-technician", "google:101633639661347526"),
    ("https://www.microsoft.com/en-us/careers/job/software-engineer", "microsoft:https://www.microsoft.com/en-us/careers/job/software-engineer"),
    ("https://careers.salesforce.com/en/jobs?jobReq=REQ-123456&source=LinkedIn", "custom:REQ-123456"),
    ("https://example.com/jobs?jobReq=REQ_123456", "custom:REQ_123456"),
    ("https://example.com/jobs/software-engineer?id=987654", "custom:987654"),
    ("https://example.com/jobs/software-engineer?foo=abc&bar=job-123456&baz=999999", "custom:123456"),
    ("https://example.com/jobs/software-engineer?id=123", "custom:https://example.com/jobs/software-engineer?id=123"),
    ("https://example.com/jobs/software-engineer", "custom:https://example.com/jobs/software-engineer?"),
    ("https://semgrep.dev/about/careers/?ashby_jid=1", "ashby:careers"),
    ("https://job-boards.greenhouse.io/acme/jobs/software-engineer", "greenhouse:https://job-boards.greenhouse.io/acme/jobs/software-engineer"),
    ("nope", "url:nope"),
]


def test_job_keys(spark):
    df = spark.createDataFrame(KEYS, "url string, want string").withColumn("p", urls.parts("url"))
    got = df.select("url", "want", urls.job_key(F.col("p"), F.col("url")).alias("got")).collect()
    assert [(r.url, r.got) for r in got] == [(r.url, r.want) for r in got]
    fixed = spark.createDataFrame([("https://semgrep.dev/about/careers/?ashby_jid=A1",)], "url string").select(urls.job_key(urls.parts("url"), F.col("url"), parity=False).alias("k"))
    assert fixed.first().k == "ashby:a1"


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("https://a.b/c?utm_source=x&id=1&ref=y#/z", "https://a.b/c?id=1"), ("https://a.b/c?utm_source=x", "https://a.b/c"), ("https://a.b/c?q=a%20b", "https://a.b/c?q=a+b"),
        ("nope", "nope"), ("https://A.b:443/x/../y?;UTM_a=1&~=1", "https://a.b/y?%7E=1"), (None, None),
    ],
)
def test_clean_link(url, want):
    assert urls.clean(url) == want


@settings(max_examples=200, deadline=None)
@given(st.from_regex(r"https?://[a-z]{1,8}\.com(/[a-zA-Z0-9~._-]{0,6}){0,3}(\?[a-z]{1,6}=[a-z0-9%+]{0,5}(&[a-z_]{1,8}=[a-z0-9]{0,4}){0,3})?(#[a-z]{0,4})?", fullmatch=True))
def test_clean_link_twice_is_once(url):
    assert urls.clean(urls.clean(url)) == urls.clean(url)


def test_normalize_and_classify(spark):
    rows = [("http://A.b:80/x/?q#h", "https://a.b/x", "custom"), ("https://a.b/", "https://a.b/", "custom"), ("https://evilgreenhouse.io", "https://evilgreenhouse.io/", "greenhouse"), ("https://stripe.com/x", "https://stripe.com/x", "greenhouse"), ("https://www.stripe.com", "https://www.stripe.com/", "custom"), ("https://acme.com/?gh_jid=1", "https://acme.com/", "greenhouse")]
    df = spark.createDataFrame(rows, "u string, n string, k string").withColumn("p", urls.parts("u"))
    for r in df.select("n", "k", urls.normalize(F.col("p")).alias("gn"), urls.classify(F.col("p")).alias("gk")).collect():
        assert (r.gn, r.gk) == (r.n, r.k)


LEVELS = {
    "intern": (["Software Engineer Intern", "Backend Engineering Internship"], ["Marketing Intern", "HR Internship", "Software Engineer"]),
    "entry": (["Software Engineer I", "Junior Backend Engineer", "Entry Level Software Developer", "Software Engineer", "Platform Engineer"], ["Software Engineer II", "Senior Software Engineer", "Sr. Spclst , Software Engineering", "Software Engineer Intern", "Sales Associate", "Teammate Endzone & Loyalty (Front End)"]),
    "mid": (["Software Engineer II", "Mid Level Backend Engineer", "Software Engineer"], ["Software Engineer I", "Software Engineer III", "Sr. Spclst , Software Engineering", "Software Engineer Intern"]),
    "senior": (["Software Engineer III", "Senior Platform Engineer", "Sr. Spclst , Software Engineering", "Frontend Developer"], ["Software Engineer I", "Software Engineer II", "Software Engineer Intern"]),
}


def test_title_levels(spark):
    levels = titles.Levels()
    rows = [(name, t, want) for name, (yes, no) in LEVELS.items() for want, ts in ((True, yes), (False, no)) for t in ts]
    df = spark.createDataFrame(rows, "level string, t string, want boolean")
    got = F.coalesce(*(F.when(F.col("level") == k, getattr(levels, k)(F.col("t"))) for k in LEVELS))
    assert df.withColumn("got", got).where("got <> want").collect() == []
    assert df.where(titles.Levels(domain=[]).tech(F.col("t"))).count() == 0


def test_text(spark):
    rows = [("Hello     World", "Hello World"), ("Hello\n\tWorld", "Hello World"), ("   Hello World   ", "Hello World"), (" \n\t  ", ""), ("a  ﻿b", "a b"), (None, None)]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("got", text.clean_text(F.col("t")))
    assert df.where("not (got <=> want)").collect() == []
    one = spark.createDataFrame([("hELLO wORLD", "&amp;lt;", "New York, NY, USA", None, ["a", "b", "c"])], "a string, b string, c string, d string, e array<string>")
    r = one.select(text.capitalize(F.col("a")).alias("a"), text.decode_entities(F.col("b")).alias("b"), text.location_label(F.col("d"), F.col("c")).alias("c"), text.location_label(F.col("d"), F.lit(" ")).alias("d"), text.human_list(F.col("e")).alias("e"), text.season_label(F.lit("summer 2026")).alias("f"), text.has_excluded_symbol(F.lit("x 🔒")).alias("g"), text.category_title(F.lit("off-season intern")).alias("h")).first()
    assert tuple(r) == ("Hello world", "<", "New York, NY", "-", "a, b & c", "2026 Summer", True, "Off Season Intern")
    lines = spark.createDataFrame([(" a \n\n b  c ",), (" \n ",)], "t string").select(text.normalize_lines(F.col("t")).alias("x")).collect()
    assert [r.x for r in lines] == ["a\nb c", None]


def test_dates(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 7, 2, 3),)], "t timestamp")
    r = df.select(dates.la_day(F.col("t")).alias("a"), dates.la_date(F.col("t"), F.lit("x")).alias("b"), dates.la_date(F.lit(None).cast("timestamp"), F.lit("x")).alias("c"), dates.within_days(F.col("t"), F.expr("t + interval 1 day")).alias("d"), dates.within_days(F.lit(None).cast("timestamp"), F.col("t")).alias("e")).first()
    assert tuple(r) == ("Jul 01", "July 1", "x", True, False)
    for day, want in (("2026-10-01", (2027, 2027, 2027, 2027)), ("2026-07-01", (2027, 2026, 2027, 2027)), ("2026-03-01", (2026, 2026, 2027, 2027))):
        assert tuple(df.select(dates.season_years(F.lit(day).cast("date")).alias("s")).first().s) == want


def test_pages():
    body = "Responsibilities: " + "build things " * 40
    assert pages.description(f"<html><nav>menu</nav><main><p>{body}</main><script>x()</script></html>").startswith("Responsibilities: build")
    ld = '<script type="application/ld+json">[{"@type":["JobPosting"],"title":"Dev","jobLocation":{"address":{"addressLocality":"Rome","addressCountry":{"name":"IT"}}},"description":"<p>Do</p>"}]</script>'
    assert pages.description(ld) == "Title: Dev\n\nLocation: Rome, IT\n\nDescription: Do"
    assert pages.description(None) is None
    assert pages.hydration('x = JSON.parse("{\\"a\\":[{\\"jobsData\\":{\\"postingTitle\\":\\"T\\"}}]}")') == {"postingTitle": "T"}
    rows = pages.table_rows("<table><tbody><tr><td>A<td>R<td>L<td><a href='u?x=1'>go</a><td>0d</tr></tbody></table>")
    assert rows == [{"line": 0, "company": "A", "role": "R", "location": "L", "link": "u?x=1", "age": "0d"}]


def test_payloads(spark):
    rows = [('["USA","Canada"]', 2, ["USA", "Canada"]), ('["USA"]', 2, ["Unsure"] * 2), ('["USA","Mars"]', 2, ["Unsure"] * 2), ("x", 1, ["Unsure"]), (None, 1, ["Unsure"])]
    df = spark.createDataFrame(rows, "r string, n int, want array<string>").withColumn("got", payloads.location_batch(F.col("r"), F.col("n")))
    assert df.where("got <> want").collect() == []


def test_model_calls():
    class Flaky:
        n = 0

        def generate(self, prompt, schema):
            self.n += 1
            if self.n < 3:
                raise models.Retryable(429)
            return '{"result": ["USA"]}', 1, 2

    waits: list[float] = []
    assert models.call(Flaky(), "x", models.location_schema(1), sleep=waits.append) == ('["USA"]', 1, 2)
    assert waits == [1.0, 2.0]
    assert models.prompt("a @@B@@", B="c") == "a c"
    with pytest.raises(KeyError):
        models.prompt("@@B@@")
    assert models.Rules.country("Berlin, Germany") == "Germany"
