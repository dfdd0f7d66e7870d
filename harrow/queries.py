"""Queries over the driver's tables that apply each operator, and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow import models, vocab
from harrow.config import Config
from harrow.functions import dates, pages, payloads, text, titles, urls
from harrow.operators import changes, companies, dedup, eligibility, ranking
from harrow.sources import lists

AS_OF = "2024-01-30 12:00:00"
CONFIG = Config(["entry level", "mid level"], ["USA", "Canada"], rules={"USA": {"allow_citizenship_required": False, "allow_no_sponsorship": False}})
WORDS = titles.Levels(domain=["steel", "copper", "red", "small", "dark-blue", "green"], engineering=["widget", "gear", "bolt", "nut", "plate", "part"], non_tech=["large"])

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _ts(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_CLEAN = r"""concat(regexp_extract(url, '^[a-z]+://[^/?#]+'), coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/'),
  CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END)"""
_PAIRS = r"""list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:utm_[^=]*|ref)='))"""
_NORMAL = r"""concat('https://', regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), coalesce(nullif(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', ''), ''), '/'))"""


@query(f"SELECT page_id, {_CLEAN} AS link FROM (SELECT page_id, url, {_PAIRS} AS q FROM pages)")
def url_clean(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.clean_link("url").alias("link"))


@query(f"SELECT page_id, {_NORMAL} AS link FROM pages")
def url_normalize(spark, d):
    return _t(spark, d, "pages").withColumn("p", urls.parts("url")).select("page_id", urls.normalize(F.col("p")).alias("link"))


@query(
    r"""SELECT page_id, CASE WHEN suffix(h, 'greenhouse.io') THEN 'greenhouse' WHEN suffix(h, 'lever.co') THEN 'lever' ELSE 'custom' END AS ats,
    CASE WHEN suffix(h, 'google.com') THEN 'google' WHEN suffix(h, 'amd.com') THEN 'amd' END AS site
    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS h FROM pages)"""
)
def url_classify(spark, d):
    p = F.col("p")
    return _t(spark, d, "pages").withColumn("p", urls.parts("url")).select("page_id", urls.classify(p).alias("ats"), urls.custom_company(p).alias("site"))


@query(r"SELECT page_id, regexp_extract_all(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/(\d+)', 1)[-1] AS num FROM pages")
def url_last_number(spark, d):
    return _t(spark, d, "pages").withColumn("p", urls.parts("url")).select("page_id", urls.last_number(F.col("p")["path"]).alias("num"))


_KEYED = r"""SELECT page_id, url, CASE WHEN n IS NOT NULL THEN 'custom:' || n ELSE 'custom:' || o || p || '?' || q END AS job_key FROM (
  SELECT *, list_filter(list_transform(string_split(q, '&'), lambda x: regexp_extract(x, '=.*?(\d{4,})', 1)), lambda x: x <> '')[1] AS n FROM (
  SELECT page_id, url, regexp_extract(url, '^[a-z]+://[^/?#]+') AS o, coalesce(nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), ''), '/') AS p,
  regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages))"""


@query(_KEYED.replace("SELECT page_id, url,", "SELECT page_id,", 1))
def url_job_key(spark, d):
    return dedup.with_key(_t(spark, d, "pages"), "url").select("page_id", "job_key")


_LINKS = f"SELECT page_id, url, {_NORMAL} AS link FROM pages"


@query(f"SELECT arg_min(url, page_id) AS url, link FROM ({_LINKS}) GROUP BY link")
def url_dedup(spark, d):
    p = _t(spark, d, "pages").withColumn("link", urls.normalize(urls.parts("url"))).select("page_id", "url", "link")
    return dedup.first_by_key(p, "link", "page_id").select("url", "link")


@query(f"SELECT link, array_to_string(list(url ORDER BY page_id), ' ') AS urls FROM ({_LINKS}) GROUP BY link")
def url_groups(spark, d):
    p = _t(spark, d, "pages").withColumn("link", urls.normalize(urls.parts("url")))
    return dedup.group_urls(p, "link", "url", "page_id").select("link", F.array_join("urls", " ").alias("urls"))


@query(f"SELECT regexp_extract(link, '://([^/]+)', 1) AS host, count(*) AS n FROM (SELECT link, min(page_id) AS page_id FROM ({_LINKS}) GROUP BY link) GROUP BY 1")
def pages_per_host(spark, d):
    """Clean, canonicalise and deduplicate page URLs, then count per host."""
    p = _t(spark, d, "pages").withColumn("link", urls.normalize(urls.parts(urls.clean_link("url"))))
    once = p.groupBy("link").agg(F.min("page_id").alias("page_id"))
    return once.groupBy(F.regexp_extract("link", "://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n"))


@query(f"WITH l AS ({_LINKS}) SELECT page_id, link FROM l WHERE page_id % 2 = 0 AND link NOT IN (SELECT link FROM l WHERE page_id % 2 = 1)")
def known_url_antijoin(spark, d):
    p = _t(spark, d, "pages").withColumn("link", urls.normalize(urls.parts("url")))
    return dedup.unseen(p.where("page_id % 2 = 0"), p.where("page_id % 2 = 1"), ["link"]).select("page_id", "link")


@query(
    """WITH n AS (SELECT o_custkey, min(o_orderkey) AS first, count(*) AS c FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
    o AS (SELECT o_custkey, min(o_orderkey) AS first, count(*) AS c FROM orders WHERE o_orderkey % 3 = 1 GROUP BY 1)
    SELECT o_custkey, first, c AS n_urls FROM n UNION ALL SELECT o_custkey, first, 0 FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n)"""
)
def keyed_merge(spark, d):
    o = _t(spark, d, "orders")
    side = lambda k: o.where(f"o_orderkey % 3 = {k}").groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.collect_list("o_orderkey").alias("urls"))
    return companies.merge(side(0), side(1), ["o_custkey"], ["urls"]).select("o_custkey", "first", F.size("urls").cast("long").alias("n_urls"))


@query(
    """WITH n AS (SELECT o_custkey, min(o_orderkey) AS first, count(o_orderkey) AS c FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1),
    o AS (SELECT o_custkey, min(o_orderkey) AS first FROM orders WHERE o_orderkey % 3 IS DISTINCT FROM 0 GROUP BY 1)
    SELECT o_custkey, first, c AS n_urls FROM n UNION ALL SELECT o_custkey, first, 0 FROM o WHERE o_custkey NOT IN (SELECT o_custkey FROM n)"""
)
def keyed_merge_all(spark, d):
    """Like keyed_merge, over all orders: each is on one of the sides."""
    o = _t(spark, d, "orders")
    side = lambda rows: o.where(rows).groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.collect_list("o_orderkey").alias("urls"))
    return companies.merge(side("o_orderkey % 3 <=> 0"), side("not (o_orderkey % 3 <=> 0)"), ["o_custkey"], ["urls"]).select("o_custkey", "first", F.size("urls").cast("long").alias("n_urls"))


@query("SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'FR' WHEN 'GERMANY' THEN 'DE' ELSE lower(n_name) END AS code FROM nation")
def override_lookup(spark, d):
    return dedup.lookup(_t(spark, d, "nation"), "n_name", {"FRANCE": "FR", "GERMANY": "DE"}, "code", F.lower("n_name")).select("n_nationkey", "code")


def _has(words: list[str]) -> str:
    alts = "|".join(w.replace("-", "[- ]?").replace(" ", r"\s+").replace(".", r"\.") for w in words)
    return rf"regexp_matches(lower(trim(p_name)), '(^|[^a-zA-Z0-9_])({alts})($|[^a-zA-Z0-9_])')"


@query(
    f"""SELECT p_partkey, {_has(WORDS.domain)} AS domain, NOT {_has(WORDS.non_tech_words)} AS plain, {_has(vocab.SENIOR)} AS senior, {_has(vocab.INTERN)} AS intern
    FROM part"""
)
def title_words(spark, d):
    t = F.col("p_name")
    return _t(spark, d, "part").select("p_partkey", titles.has(t, WORDS.domain).alias("domain"), (~titles.has(t, WORDS.non_tech_words)).alias("plain"), titles.has(t, vocab.SENIOR).alias("senior"), titles.has(t, vocab.INTERN).alias("intern"))


@query(
    f"""SELECT p_partkey, p_name FROM part WHERE {_has(WORDS.engineering)} AND {_has(WORDS.domain)} AND NOT {_has(WORDS.non_tech_words)}
    AND NOT {_has(vocab.INTERN)} AND NOT {_has(vocab.MID)} AND NOT {_has(vocab.SENIOR)}"""
)
def title_filter(spark, d):
    return _t(spark, d, "part").where(WORDS.target(F.col("p_name"), ["entry level"])).select("p_partkey", "p_name")


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS clean, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS lines FROM documents")
def text_clean(spark, d):
    t = F.col("text")
    return _t(spark, d, "documents").select("doc_id", text.clean_text(t).alias("clean"), F.coalesce(text.normalize_lines(t), F.lit("")).alias("lines"))


@query("SELECT p_partkey, upper(left(p_name, 1)) || lower(substr(p_name, 2)) AS name FROM part")
def text_capitalize(spark, d):
    return _t(spark, d, "part").select("p_partkey", text.capitalize(F.col("p_name")).alias("name"))


@query(
    """SELECT doc_id, substr(text, greatest(1, coalesce(list_min(list_filter([instr(lower(text), 'the'), instr(lower(text), 'der'), instr(lower(text), 'que')], lambda p: p > 0)), 1) - 20), 100) AS part,
    CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || chr(10) || '[TRUNCATED]' ELSE text END AS short,
    length(text) >= 300 AND (contains(lower(text), 'the') OR contains(lower(text), 'der') OR contains(lower(text), 'que')) AS likely FROM documents"""
)
def text_window(spark, d):
    t, k = F.col("text"), ["the", "der", "que"]
    return _t(spark, d, "documents").select("doc_id", text.keyword_window(t, k, 100, 20).alias("part"), text.limited(t, 500).alias("short"), text.likely_description(t, k).alias("likely"))


@query("""SELECT page_id, array_to_string(regexp_extract_all(html, 'href="([^"]+)"', 1), ' ') AS hrefs, nullif(regexp_extract(html, 'href="([^"]+)"', 1), '') AS first FROM pages""")
def html_hrefs(spark, d):
    h = F.col("html")
    return _t(spark, d, "pages").select("page_id", F.array_join(F.regexp_extract_all(h, F.lit('href="([^"]+)"'), F.lit(1)), " ").alias("hrefs"), text.first_href(h).alias("first"))


@query()
def html_to_text(spark, d):
    return _t(spark, d, "pages").select("page_id", pages.html_to_text("html").alias("text"))


@query()
def html_description(spark, d):
    return _t(spark, d, "pages").select("page_id", pages.page_description("html").alias("text"))


@query("""SELECT page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped FROM pages""")
def html_escape(spark, d):
    return _t(spark, d, "pages").select("page_id", text.escape_html(F.col("html")).alias("escaped"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return _t(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY")
def freshness(spark, d):
    return _t(spark, d, "events").where(dates.within_days(F.col("ts"), F.lit(AS_OF).cast("timestamp_ntz"))).select("event_id")


_LA = "timezone('America/Los_Angeles', timezone('UTC', ts))"


@query(f"SELECT event_id, strftime({_LA}, '%b %d') AS day, strftime({_LA}, '%B %-d') AS long_day FROM events")
def la_today(spark, d):
    ts = F.col("ts")
    return _ts(spark, d).select("event_id", dates.la_day(ts).alias("day"), dates.la_date(ts, F.lit(None)).alias("long_day"))


@query(
    """SELECT o_orderkey, CAST(CASE WHEN m >= 6 THEN y + 1 ELSE y END AS INTEGER) AS summer, CAST(CASE WHEN m >= 9 THEN y + 1 ELSE y END AS INTEGER) AS fall, CAST(y + 1 AS INTEGER) AS spring, CAST(y + 1 AS INTEGER) AS winter
    FROM (SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders)"""
)
def season_years(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", dates.season_years(F.col("o_orderdate")).alias("s")).select("o_orderkey", "s.*")


_FLAGS = "CASE lang WHEN 'en' THEN 'USA' WHEN 'fr' THEN 'Canada' WHEN 'de' THEN 'Germany' ELSE 'Unsure' END"


@query(
    f"""SELECT doc_id, CASE WHEN country NOT IN ('USA', 'Canada', 'Unsure') THEN 'country' WHEN category NOT IN ('entry level', 'mid level') THEN 'category'
    WHEN country = 'USA' AND citizenship IS TRUE THEN 'citizenship required' WHEN country = 'USA' AND sponsorship IS FALSE THEN 'no sponsorship' END AS reason
    FROM (SELECT doc_id, {_FLAGS} AS country, CASE WHEN n_chars > 3000 THEN 'senior level' ELSE 'entry level' END AS category, toxic = 1 AS citizenship, quality = 1 AS sponsorship FROM documents LEFT JOIN labels USING (doc_id))"""
)
def eligibility_reason(spark, d):
    j = _t(spark, d, "documents").select("doc_id", "lang", "n_chars").join(_t(spark, d, "labels"), "doc_id", "left")
    category = F.when(F.col("n_chars") > 3000, "senior level").otherwise("entry level")
    return j.select("doc_id", eligibility.reason(F.expr(_FLAGS), category, F.col("toxic") == 1, F.col("quality") == 1, CONFIG).alias("reason"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS filled FROM conversations WHERE length(text) > 20")
def forward_fill_kept(spark, d):
    c = _t(spark, d, "conversations").where(F.length("text") > 20)
    return c.select("conv_id", "turn", lists.forward_fill(F.col("text"), F.col("role") != "user", ["conv_id"], "turn").alias("filled"))


@query("SELECT conv_id, turn, filled FROM (SELECT conv_id, turn, text, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS filled FROM conversations) WHERE length(text) > 20")
def forward_fill_all(spark, d):
    c = _t(spark, d, "conversations")
    filled = c.select("conv_id", "turn", "text", lists.forward_fill(F.col("text"), F.col("role") != "user", ["conv_id"], "turn").alias("filled"))
    return filled.where(F.length("text") > 20).select("conv_id", "turn", "filled")


@query("SELECT p_partkey, 100 + row_number() OVER (ORDER BY p_retailprice, p_partkey) AS id FROM part WHERE p_size = 1")
def id_assignment(spark, d):
    return ranking.assign_ids(_t(spark, d, "part").where("p_size = 1"), 100, [F.col("p_retailprice"), F.col("p_partkey")]).select("p_partkey", "id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id FROM orders")
def id_assignment_orders(spark, d):
    return ranking.assign_ids(_t(spark, d, "orders").select("o_orderkey", "o_orderdate"), 0, [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_orderkey", "id")


_BOARD = """SELECT event_type, event_id, rn AS rank, total, CASE WHEN user_id = lag(user_id) OVER (PARTITION BY event_type ORDER BY event_id DESC) THEN '↳' ELSE CAST(user_id AS VARCHAR) END AS who FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn, count(*) OVER (PARTITION BY event_type) AS total FROM events) WHERE rn <= 20"""


@query(_BOARD)
def board_topk(spark, d):
    top = ranking.top_per_group(_t(spark, d, "events").select("event_type", "event_id", "user_id"), "event_type", [F.desc("event_id")], 20)
    return top.select("event_type", "event_id", F.col("rank").cast("long").alias("rank"), "total", ranking.ditto(F.col("user_id").cast("string"), ["event_type"], [F.desc("event_id")]).alias("who"))


@query("SELECT source, doc_id, rn AS rank, total FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rn, count(*) OVER (PARTITION BY source) AS total FROM documents) WHERE rn <= 20")
def documents_topk(spark, d):
    top = ranking.top_per_group(_t(spark, d, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 20)
    return top.select("source", "doc_id", F.col("rank").cast("long").alias("rank"), "total")


@query("SELECT DISTINCT c_name FROM customer")
def sorted_names(spark, d):
    return _t(spark, d, "customer").select("c_name").distinct().orderBy(F.collate(F.col("c_name"), "UNICODE"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 7 <> 0 EXCEPT ALL SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END FROM orders")
def change_feed(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    old = o.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, "X").otherwise(F.col("o_orderstatus")))
    return changes.added(old, o.where("o_orderkey % 7 <> 0"))


@query("SELECT count(*) AS total, CAST(count_if(event_type IN ('click', 'view')) AS BIGINT) AS skipped, round(coalesce(sum(value), 0), 2) AS cost, coalesce(bool_or(event_type = 'purchase'), false) AS force_stopped FROM events")
def run_stats(spark, d):
    status = F.when(F.col("event_type").isin("click", "view"), "invalid").when(F.col("event_type") == "purchase", "deadline").otherwise("kept")
    got = changes.run_stats(_t(spark, d, "events").select(status.alias("status"), F.col("value").alias("cost")))
    return got.withColumn("cost", F.round("cost", 2))


@query("SELECT event_type AS ats, count(*) AS companies, CAST(count_if(value < 10) AS BIGINT) AS failed, CAST(count_if(value >= 50) AS BIGINT) AS slow, round(sum(value), 2) AS seconds FROM events GROUP BY 1")
def scan_stats(spark, d):
    e = _t(spark, d, "events").select(F.col("event_type").alias("ats"), F.col("event_id").alias("identifier"), F.col("value").alias("seconds"), (F.col("value") < 10).alias("failed"))
    return changes.scan_stats(e, 50.0).withColumn("seconds", F.round("seconds", 2))


@query("SELECT event_id AS identifier, value AS seconds FROM events WHERE value >= 10 ORDER BY value DESC, event_id LIMIT 20")
def slowest_scans(spark, d):
    e = _t(spark, d, "events").select(F.col("event_id").alias("identifier"), F.col("value").alias("seconds"))
    return changes.slowest(e)


@query("SELECT doc_id, round(n_chars * 0.3 / 1000000 + 500 * 2.5 / 1000000, 9) AS google, round(n_chars * 3.0 / 1000000 + 500 * 15.0 / 1000000, 9) AS anthropic FROM documents")
def llm_cost(spark, d):
    n = F.col("n_chars")
    return _t(spark, d, "documents").select("doc_id", F.round(payloads.cost(n, F.lit(500), "google"), 9).alias("google"), F.round(payloads.cost(n, F.lit(500), "anthropic"), 9).alias("anthropic"))


@query("SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 50 AS batch, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) % 50 AS index FROM documents")
def ai_batches(spark, d):
    return ranking.batches(_t(spark, d, "documents").select("doc_id", "source"), ["source"], [F.col("doc_id")]).select("doc_id", "source", "batch", "index")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'en' UNION SELECT doc_id, lang FROM documents WHERE lang = 'en' OR doc_id % 2 = 0")
def union_sources(spark, d):
    t = _t(spark, d, "documents").select("doc_id", "lang")
    return dedup.union_distinct(t.where("lang = 'en'"), t.where("lang = 'en' or doc_id % 2 = 0"))


@query("SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de') UNION SELECT doc_id, lang FROM documents WHERE lang IS DISTINCT FROM 'en'")
def union_sources_all(spark, d):
    """Like union_sources, over all documents: those of one language are in both operands."""
    t = _t(spark, d, "documents").select("doc_id", "lang")
    return dedup.union_distinct(t.where("lang in ('en', 'de')"), t.where("not (lang <=> 'en')"))


@query("SELECT event_id, ts FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-30'")
def posted_today(spark, d):
    return _t(spark, d, "events").where(dates.same_utc_day(F.col("ts"), F.lit(AS_OF).cast("timestamp_ntz"))).select("event_id", "ts")


@query("SELECT n_nationkey, n_name, CASE WHEN array_length(w) = 1 THEN w[1] ELSE array_to_string(w[1:len(w) - 1], ', ') || ' & ' || w[-1] END AS names FROM (SELECT n_nationkey, n_name, string_split(n_name, ' ') AS w FROM nation)")
def human_list(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", "n_name", text.human_list(F.split("n_name", " ")).alias("names"))


@query(f"SELECT DISTINCT regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '') AS identifier, regexp_extract(url, '^[a-z]+://[^/?#]+') AS domain FROM pages QUALIFY row_number() OVER (PARTITION BY regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^www\\.', '') ORDER BY page_id) = 1")
def company_list(spark, d):
    p = _t(spark, d, "pages").select("url", F.col("page_id").alias("seq"))
    return companies.build(p).select("identifier", "domain")


@query()
def location_batches(spark, d):
    jobs = _t(spark, d, "nation").select(F.col("n_name").alias("role"), F.col("n_name").alias("location"))
    return models.locate(jobs, None)


@query("SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def events_per_day(spark, d):
    from harrow.streaming import feed

    e = _t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return feed.events_per_window(e).select(F.col("day").cast("timestamp_ntz").alias("day"), "event_type", "n", F.round("value", 2).alias("value"))
