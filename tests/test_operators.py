from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from harrow import config, models, queries, schemas
from harrow.functions import urls
from harrow.operators import changes, companies, dedup, eligibility, ranking
from harrow.plans import board, sync
from harrow.sources import files, lists, vendors
from harrow.streaming import feed

SF = "/root/testdata/sf0.001"


def as_of():
    return F.lit("2026-07-02 20:00:00").cast("timestamp")


CONFIG = config.Config(["summer intern", "entry level"], ["USA"], rules={"USA": {"allow_citizenship_required": False, "allow_no_sponsorship": False}})


SHIPPED = {
    "target": {
        "intern": ["summer intern", "off-season intern"], "full-time": ["entry level"], "countries": ["USA"],
        "filter": {"USA": {"allow_citizenship_required": False, "allow_no_sponsorship": False}}, "keywords": ["software"],
    },
    "ai": {"enabled": True, "provider": "google", "model": "gemini-2.5-flash"},
    "sender": {"host": "smtp.example.com", "port": 587, "user": "a@example.com", "email": "a@example.com"},
    "receiver": {"email": "b@example.com"},
}


def test_config(tmp_path):
    c = config.Config.of(SHIPPED)
    assert c.allowed == ["USA", "Unsure"] and c.rules == SHIPPED["target"]["filter"] and (c.sender, c.receiver) == (SHIPPED["sender"], SHIPPED["receiver"])
    with pytest.raises(ValueError, match='"USA" filter requires "USA" to exist in target.countries'):
        config.Config.of(SHIPPED | {"target": SHIPPED["target"] | {"countries": ["Canada"]}})
    with pytest.raises(ValueError, match="port"):
        config.Config.of(SHIPPED | {"sender": SHIPPED["sender"] | {"port": 99999}})
    with pytest.raises(ValueError, match="receiver.email"):
        config.Config.of(SHIPPED | {"receiver": {"email": "nobody"}})
    files.save_config(SHIPPED, str(tmp_path / "config.json"))
    assert files.load_config(str(tmp_path / "config.json")) == c
    form = (
        "### Internship targets\n\n- [x] summer intern\n- [X] off-season intern\n\n### Full-time targets\n\n- [x] entry level\n- [ ] mid level\n\n### Countries\n\n- [x] USA\n- [ ] Canada\n\n"
        "### Allow citizenship-required jobs?\n\nNo\n\n### Allow jobs without sponsorship?\n\nno\n\n### Keywords\n\nsoftware\n\n### AI enabled\n\n- [x] Enable\n\n### AI provider\n\ngoogle\n\n### AI model\n\ngemini-2.5-flash\n\n"
        "### SMTP host\n\nsmtp.example.com\n\n### SMTP port\n\n587\n\n### SMTP user\n\na@example.com\n\n### Sender email\n\na@example.com\n\n### Receiver email\n\nb@example.com\n"
    )
    assert config.of_form(form) == SHIPPED
    with pytest.raises(ValueError, match="SMTP host is required"):
        config.of_form(form.replace("smtp.example.com", "_No response_"))


def test_state_survives_a_run(spark, tmp_path):
    urls = ["https://b.co/é?q=\"1\"", "https://a.co/2", "https://a.co/10", "https://a.co/2", None]
    for some in (urls, []):
        files.save_urls(spark.createDataFrame([(u,) for u in some], "url string"), str(tmp_path / "urls.json"))
        assert sorted(r.url for r in files.load_urls(spark, str(tmp_path / "urls.json")).collect()) == sorted({u for u in some if u})
    written = json.loads(next((tmp_path / "urls.json").glob("part-*")).read_text())
    assert written == []
    files.save_documents(spark.createDataFrame([(7, '{"a": 1}'), (263, "plain\ntext"), (8, None)], "id long, text string"), str(tmp_path / "docs"))
    get = lambda i: [(r.kind, r.text) for r in files.load_document(spark, str(tmp_path / "docs"), i).collect()]
    assert (get(7), get(263), get(8), get(9)) == ([("json", '{"a": 1}')], [("txt", "plain\ntext")], [("txt", None)], [])


def test_rules_reject_by_an_explicit_no_only(spark):
    c = config.Config(["entry level"], ["USA", "Canada"], rules={"USA": {}, "Canada": {"allow_citizenship_required": True, "allow_no_sponsorship": False}})
    rows = [("USA", "entry level", True, False, None), ("Canada", None, True, True, None), ("Canada", "", None, False, "no sponsorship"), ("Canada", "mid level", None, None, "category"), (None, None, None, None, "country")]
    df = spark.createDataFrame(rows, "c string, k string, z boolean, s boolean, want string")
    got = df.withColumn("got", eligibility.reason(F.col("c"), F.col("k"), F.col("z"), F.col("s"), c))
    assert got.where("not (got <=> want)").collect() == []


def test_eligibility(spark):
    rows = [("USA", "entry level", True, None, "citizenship required"), ("USA", "entry level", None, False, "no sponsorship"), ("USA", "entry level", None, None, None), ("Unsure", "entry level", True, None, None), ("Canada", "entry level", None, None, "country"), ("USA", "mid level", None, None, "category")]
    df = spark.createDataFrame(rows, "c string, k string, z boolean, s boolean, want string")
    got = df.withColumn("got", eligibility.reason(F.col("c"), F.col("k"), F.col("z"), F.col("s"), CONFIG))
    assert got.where("not (got <=> want)").collect() == []


def test_markdown_and_html_fill_differ(spark):
    row = lambda c, day, link='<a href="https://x.co/1?utm_a=1">a</a>': f"| {c} | Dev | Rome | {link} | {day} |"
    md = "\n".join(["| Company | Role | Location | Link | Date |", "|---|---|---|---|---|", row("A", "Jul 01"), row("↳", "Jul 02"), row("B", "Jul 02"), row("↳", "Jul 02"), row("C 🔒", "Jul 02")])
    landed = spark.createDataFrame([("m", md)], "name string, body string")
    assert [(r.company, r.link) for r in lists.parse_markdown(landed, as_of()).orderBy("line").collect()] == [("Unknown", "https://x.co/1"), ("B", "https://x.co/1"), ("B", "https://x.co/1")]
    assert [r.company for r in lists.parse_markdown(landed, as_of(), fill_all=True).orderBy("line").collect()] == ["A", "B", "B"]
    tr = lambda c, age: f"<tr><td>{c}</td><td>R</td><td>L</td><td><a href='https://x.co/2'>go</a></td><td>{age}</td></tr>"
    page = "<h2>Software Engineering Internship Roles</h2><table><tbody>" + tr("🔥 A", "1d") + tr("↳", "0d") + "</tbody></table>"
    assert [r.company for r in lists.parse_html(spark.createDataFrame([("h", page)], "name string, body string")).collect()] == ["A"]


def _landed(spark, rows):
    return spark.createDataFrame([(i, i, a, dom, p, json.dumps(b) if not isinstance(b, str) else b, n) for i, a, dom, p, b, n in rows], "name string, identifier string, ats string, domain string, page string, body string, page_no int")


def test_vendors(spark):
    now = 1783022400000
    rows = [
        ("acme", "greenhouse", "", "", {"jobs": [{"title": "Software Engineer", "absolute_url": "g1", "first_published": "2026-07-02T01:00:00Z", "location": {"name": "X"}}, {"title": "Software Engineer", "absolute_url": "old", "updated_at": "2020-01-01"}]}, 0),
        ("lev", "lever", "", "", [{"text": "Backend Developer", "hostedUrl": "l1", "createdAt": now - 3600000, "categories": {}}], 0),
        ("wd", "workday", "https://w", "", {"jobPostings": [{"title": "Data Engineer", "postedOn": "Posted Today", "externalPath": "/p1"}]}, 0),
        ("ash", "ashby", "", "", {"jobs": [{"title": "ML Engineer", "jobUrl": "a1", "publishedAt": "2026-07-02T10:00:00Z"}]}, 0),
        ("broken", "ashby", "", "", "<html>", 0),
        ("sr", "smartrecruiters", "https://s", "", {"content": [{"id": "9", "name": "Web Developer", "company": {"name": "sr CO"}, "releasedDate": "2026-07-02T10:00:00Z"}]}, 0),
        ("or", "oraclecloud", "https://o", "", {"items": [{"requisitionList": [{"Id": "5", "Title": "Cloud Engineer", "PostedDate": "2026-07-02"}]}]}, 0),
        ("ic", "icims", "https://x.icims.com", "", '<div><a href="/jobs/1/dev/job?mobile=1&amp;k=2"><h3>iOS Developer</h3></a> US-NC-Cary</div>', 0),
        ("am", "custom", "", "https://amazon.jobs/api", {"searchHits": [{"fields": {"title": ["Security Engineer"], "icimsJobId": ["7"], "createdDate": [now // 1000], "location": ["L"]}}]}, 0),
        ("tt", "custom", "", "https://api.lifeattiktok.com/x", {"code": 0, "data": {"job_post_list": [{"id": "3", "title": "Platform Engineer", "city_info": None}]}}, 0),
        ("amd", "custom", "", "https://careers.amd.com/x", {"jobs": [{"data": {"req_id": "4", "title": "Systems Engineer", "city": "Austin", "country": "US", "posted_date": "2026-07-02T09:00:00Z"}}]}, 1),
        ("mt", "custom", "", "https://www.metacareers.com/x", 'for (;;);{"data":{"job_search_with_featured_jobs":{"all_jobs":[{"id":"8","title":"Software Engineer","locations":["A","B"]}]}}}', 0),
        ("nf", "custom", "", "https://explore.jobs.netflix.net/api", {"positions": [{"posting_name": "UI Engineer", "canonicalPositionUrl": "n1", "location": "LA"}]}, 0),
        ("sales", "ashby", "", "", {"jobs": [{"title": "Sales Lead", "jobUrl": "s1", "publishedAt": "2026-07-02T10:00:00Z"}]}, 0),
    ]
    known = spark.createDataFrame([("a1",)], "link string")
    got = {r.link: (r.company, r.location) for r in vendors.discover(_landed(spark, rows), as_of(), ["entry level"], known=known).collect()}
    assert got == {
        "g1": ("acme", "X"), "l1": ("Lev", ""), "https://w/p1": ("Wd", ""), "https://s/sr/9": ("Sr co", ""), "https://o/5": ("Or", ""), "https://x.icims.com/jobs/1/dev/job?k=2": ("Ic", "US-NC-Cary"),
        "https://amazon.jobs/en/jobs/7": ("Amazon", "L"), "https://lifeattiktok.com/search/3": ("tt", "Unsure"), "https://careers.amd.com/careers-home/jobs/4?lang=en-us": ("AMD", "Austin, US"),
        "https://www.metacareers.com/profile/job_details/8": ("Mt", "A, B"), "n1": ("Netflix", "LA"),
    }


def test_companies(spark):
    rows = [("https://jobs.lever.co/acme/1", 1), ("https://jobs.lever.co/acme/2", 2), ("https://talentmanagementsolution.wd5.myworkdayjobs.com/en-US/Ext/job/x_R1", 3), ("https://mlb.com/x?gh_jid=1", 4), ("https://jobs.ashbyhq.com/semgrep/1", 5), ("https://ekaw.fa.us2.oraclecloud.com/hcmUI/CandidateExperience/en/sites/CX/job/5", 6), ("https://shop.example.com/j", 7), ("nope", 8)]
    new = companies.build(spark.createDataFrame(rows, "url string, seq int"))
    got = {r.identifier: (r.name, r.ats, len(r.urls)) for r in new.collect()}
    assert got == {"acme": ("acme", "lever", 2), "jonas-ext": ("jonas", "workday", 1), "majorleaguebaseball": ("majorleaguebaseball", "greenhouse", 1), "semgrep": ("semgrep", "ashby", 1), "ekaw.fa.us2.oraclecloud.com": ("Securitas", "oraclecloud", 1), "shop.example.com": ("shop.example.com", "custom", 1)}
    old = spark.createDataFrame([("gone", "lever", "gone", "d", "p", ["u"])], schemas.COMPANY)
    assert {r.identifier: len(r.urls) for r in companies.merge_companies(new, old).collect()}["gone"] == 0


def test_process_status_table(spark):
    body = json.dumps({"title": "t", "content": "Requirements: no visa sponsorship. USA"})
    text = json.dumps({"title": "t", "content": "Great entry role in USA"})
    base = "https://boards.greenhouse.io/acme/jobs/"
    api = "https://boards-api.greenhouse.io/v1/boards/acme/jobs/"
    jobs = [(k, "Software Engineer", f"{base}{n}", "L", k) for k, n in enumerate(["1", "2", "3", "4", "5", "5", "6"])]
    incoming = spark.createDataFrame([(f"c{s}", r, u, p, s) for _, r, u, p, s in jobs], "company string, role string, link string, location string, seq int")
    history = spark.createDataFrame([(base + "1?x=1",)], "link string")
    landed = spark.createDataFrame([(api + "2", None, 500, "", None), (api + "3", None, 200, "", body), (api + "4", None, 200, "", text), (api + "5", None, 200, "", text)], schemas.LANDED)
    got = sync.process(incoming, history, landed, as_of(), CONFIG, models.Rules(), skip=lambda df: F.col("company") == "c6", last_id=10)
    assert {r.company: r.status for r in got.results.collect()} == {"c0": "idempotent", "c1": "invalid", "c2": "ineligible", "c3": "kept", "c4": "kept", "c5": "kept", "c6": "filtered"}
    assert sorted((r.company, r.id) for r in got.jobs.collect()) == [("c3", 11), ("c4", 12), ("c5", 13)]
    assert sorted(r.company for r in got.opportunities.collect()) == ["c2", "c3", "c4", "c5", "c6"]
    fixed = sync.process(incoming, history, landed, as_of(), CONFIG, models.Rules(), parity=False)
    assert [r.status for r in fixed.results.where("company = 'c5'").collect()] == ["idempotent"]
    off = sync.process(incoming.where("seq in (3, 6)"), history, landed, as_of(), CONFIG, None)
    assert {r.company: (r.status, r.code) for r in off.results.collect()} == {"c3": ("invalid", 404), "c6": ("kept", 0)}
    late = sync.process(incoming, history, landed, as_of(), CONFIG, None, most=1)
    assert late.results.where("status = 'deadline'").count() == 5


def test_dedup_and_changes(spark):
    df = spark.createDataFrame([("https://jobs.lever.co/a/1", 2), ("https://jobs.lever.co/b/1", 1), ("https://x.co/", 3)], "link string, seq int")
    keyed = dedup.with_key(df)
    once = dedup.first_by_key(keyed, "job_key", "seq")
    assert sorted(r.seq for r in once.collect()) == [1, 3]
    assert dedup.first_by_key(once, "job_key", "seq").count() == 2
    assert [r.urls for r in dedup.group_urls(keyed, "job_key", "link", "seq").where("size(urls) > 1").collect()] == [["https://jobs.lever.co/b/1", "https://jobs.lever.co/a/1"]]
    assert dedup.new_jobs(df, df.limit(1)).count() == 1
    assert changes.added(df.limit(0), df.union(df)).count() == 6


def _opportunities(spark):
    jd = lambda c: (None, None, [], "USA", None, c, "None")
    rows = [(k, "Acme" if k % 3 else "Beta", f"Dev {k}", f"https://x/{k}", "Rome, IT, EU", jd("entry level" if k % 2 else "other"), "2026-07-01T20:00:00.000Z", k) for k in range(60)]
    return spark.createDataFrame([*rows, (99, "", "x", "l", "", jd("entry level"), "p", 99)], f"{schemas.OPPORTUNITY}, seq bigint")


def test_board(spark):
    df = _opportunities(spark)
    rows = board.board_rows(df, CONFIG, k=5)
    got = sorted(rows.collect(), key=lambda r: r["rank"])
    assert [(r.total, r.company, r.posted) for r in got] == [(30, "Acme", "July 1"), (30, "Beta", "July 1"), (30, "Acme", "July 1"), (30, "↳", "July 1"), (30, "Beta", "July 1")]
    assert "## Entry Level (30)" in board.render(rows, CONFIG)
    plan = ranking.top_per_group(df.select("company", "seq"), "company", [F.desc("seq")], 5)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    assert board.mail({"company": "A", "role": "<R>", "link": "https://x/?a=1&b=2", "jd": {"qualifications": ["q"]}})["html"].count("&amp;") == 1


def test_antijoin_of_few_keys_is_broadcast(spark):
    df = spark.range(1000).selectExpr("id as k")
    assert "BroadcastHashJoin" in dedup.unseen(df, df.limit(3), ["k"])._jdf.queryExecution().executedPlan().toString()


def test_files(spark, tmp_path):
    (tmp_path / "urls.json").write_text('["b", "a", "b"]')
    assert sorted(r.url for r in files.load_urls(spark, str(tmp_path / "urls.json")).collect()) == ["a", "b"]
    (tmp_path / "bad.json").write_text('{"id": 1}\n{oops\n')
    with pytest.raises(Exception):  # noqa: B017
        files.load_jobs(spark, str(tmp_path / "bad.json")).collect()
    body = "### Company\nAcme\n### Role\n<!-- x -->Dev\n### Link\nhttps://a.b/c\n### Location\n_No response_\n"
    r = files.submitted_jobs(spark.createDataFrame([(body,)], "body string")).first()
    assert (r.company, r.role, r.location, r.valid) == ("Acme", "Dev", None, False)
    files.append_jobs(spark.createDataFrame([(1, "a", "r", "l", "p", None)], schemas.JOB), str(tmp_path / "jobs"))
    assert files.load_jobs(spark, str(tmp_path / "jobs")).first().company == "a"


def test_streaming_replay_equals_batch(spark, tmp_path):
    schema = "link string, seq int, posted_at timestamp"
    rows = [(f"https://jobs.lever.co/acme/{k % 7}", k, dt.datetime(2026, 7, 1)) for k in range(20)]
    src = tmp_path / "in"
    src.mkdir()
    for k in range(0, 20, 5):
        (src / f"{k}.json").write_text("\n".join(json.dumps({"link": a, "seq": b, "posted_at": c.isoformat()}) for a, b, c in rows[k : k + 5]))
    stream = feed.read_postings(spark, str(src), schema, files_per_batch=1)
    feed.upsert_unseen(stream, str(tmp_path / "state"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(r.job_key for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = dedup.first_by_key(dedup.with_key(spark.createDataFrame(rows, schema)), "job_key", "seq")
    assert got == sorted(r.job_key for r in want.collect())
    sent: list[dict] = []
    (tmp_path / "jobs").mkdir()
    jobs = spark.readStream.schema(schemas.JOB).json(str(tmp_path / "jobs"))
    (tmp_path / "jobs" / "1.json").write_text('{"company": "A", "role": "R", "link": "https://x"}')
    feed.notify(jobs, sent.append, str(tmp_path / "cp2"), pause=0).awaitTermination()
    assert [m["subject"] for m in sent] == ["New: A: R"]


def test_url_predicates(spark):
    p = urls.parts("u")
    df = spark.createDataFrame([("https://boards.greenhouse.io/x",), ("https://jobs.ashbyhq.com/x",), ("https://a.icims.com/jobs/search?x",)], "u string")
    got = df.select(urls.is_greenhouse_board(p).alias("a"), urls.is_ashby_board(p).alias("b"), urls.is_icims_search(p).alias("c")).collect()
    assert [tuple(r) for r in got] == [(True, False, False), (False, True, False), (False, False, True)]


def test_ids_are_dealt_by_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
        got = ranking.assign_ids(df, 10, [F.desc("k")]).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.k, r.id) for r in got) == [(k, 1010 - k) for k in range(1000)] and len({r.p for r in got}) > 1
    assert queries.QUERIES["id_assignment_orders"](spark, SF).count() == spark.read.parquet(f"{SF}/orders.parquet").count()


def test_merge_of_all_orders(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet")
    got = queries.QUERIES["keyed_merge_all"](spark, SF)
    assert got.count() == o.select("o_custkey").distinct().count()
    assert got.agg(F.sum("n_urls")).first()[0] == o.where("o_orderkey % 3 = 0").count()


def test_union_of_all_documents(spark):
    got = queries.QUERIES["union_sources_all"](spark, SF)
    assert sorted(got.collect()) == sorted(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").distinct().collect())
