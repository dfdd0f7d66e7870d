"""The board: per category the latest postings, as rows and as Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.config import Config
from harrow.functions import dates, text
from harrow.operators import eligibility, ranking


def renderable() -> Column:
    shown = F.lit(True)
    for c in ("company", "role", "link", "postedAt", "jd.country", "jd.category"):
        shown = shown & ~text.blank(F.col(c))
    return shown


def board_rows(opportunities: DataFrame, config: Config, k: int = 20, target: bool = True) -> DataFrame:
    """The k latest rows (by seq) of each target category (of each other one without `target`): category, rank, total, cells."""
    shown = opportunities.where(renderable() & eligibility.in_countries(F.col("jd.country"), config.allowed))
    category = text.normal_category(text.display_category(F.col("jd.category"), F.col("jd.season")))
    shown = shown.withColumn("category", category)
    wanted = F.coalesce(F.col("category").isin(config.categories), F.lit(False))
    top = ranking.top_per_group(shown.where(wanted if target else ~wanted), "category", [F.desc("seq")], k)
    name = text.clean_text(F.col("company"))
    posted = F.try_to_timestamp(F.col("postedAt"))
    return top.select(
        "category", "rank", "total", ranking.ditto(name, ["category"], [F.desc("seq")]).alias("company"), F.concat_ws(" ", text.clean_text(F.col("role")), badges()).alias("role"),
        text.location_label(F.col("jd.location"), F.col("location")).alias("location"), "link", dates.la_date(posted, F.col("postedAt")).alias("posted"),
    )


def badges() -> Column:
    return F.concat_ws(" ", F.when(F.col("jd.citizenship"), "🇺🇸"), F.when(F.col("jd.sponsorship") == F.lit(False), "🛂"))


def render(rows: DataFrame, config: Config) -> str:
    """Markdown of board_rows: categories times k rows at most reach the driver."""
    got = rows.withColumn("cells", F.struct(*(text.escape_html(F.col(c), apostrophe=True).alias(c) for c in ("company", "role", "location", "link", "posted")))).collect()
    out = ["# Board", ""]
    for category in ranking.category_order(sorted({r.category for r in got}), config.categories):
        mine = sorted((r for r in got if r.category == category), key=lambda r: r["rank"])
        title = " ".join(w[:1].upper() + w[1:] for w in category.replace("-", " ").split())
        out += [f"## {title} ({mine[0].total})", "", "| Company | Role | Location | Link | Date |", "|---|---|---|---|---|"]
        out += [f'| {r.cells.company} | {r.cells.role} | {r.cells.location} | <a href="{r.cells.link}">Apply</a> | {r.cells.posted} |' for r in mine] + [""]
    return "\n".join(out)


def mail(job: dict) -> dict[str, str]:
    """Subject, text and HTML of a new job's message."""
    from html import escape

    jd = job.get("jd") or {}
    title = f"{job['company']}: {job['role']}"
    tags = [t for t in (jd.get("category"), jd.get("season"), jd.get("country"), "citizens only" if jd.get("citizenship") else None, "no sponsorship" if jd.get("sponsorship") is False else None) if t and t != "None"]
    place = jd.get("location") or job.get("location") or "-"
    quals = jd.get("qualifications") or []
    body = "\n".join([title, place, ", ".join(tags), *(f"- {q}" for q in quals), job["link"]])
    items = "".join(f"<li>{escape(q)}</li>" for q in quals)
    page = f'<h1>{escape(title)}</h1><p>{escape(place)}</p><p>{escape(", ".join(tags))}</p><ul>{items}</ul><a href="{escape(job["link"], quote=True)}">Apply</a>'
    return {"subject": f"New: {title}", "text": body, "html": page, "title": title}


def preview(jobs: DataFrame) -> DataFrame:
    """The latest job that needs citizenship and isn't sponsored."""
    return jobs.where("jd.citizenship and not jd.sponsorship").orderBy(F.desc("seq")).limit(1)
