"""Community lists: landed Markdown and HTML tables as jobs. A page that wasn't fetched has no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from harrow.functions import dates, pages, text, urls

COLUMNS = ("source", "line", "company", "role", "location", "link")


def forward_fill(value: Column, is_ditto: Column, key: list[str], order: str) -> Column:
    """The last value that is no ditto mark, up to this row."""
    w = W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return F.last(F.when(~is_ditto, value), ignorenulls=True).over(w)


def parse_markdown(landed: DataFrame, as_of: Column, fill_all: bool = False) -> DataFrame:
    """Rows of pipe tables dated today (Los Angeles) without excluded symbols.

    A company cell with '↳' takes the company of the last row that was kept (of the last row at all with `fill_all`), else 'Unknown'.
    """
    lines = landed.select(F.col("name").alias("source"), F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r?\n")).alias("line", "raw"))
    lines = lines.where(F.ltrim("raw").startswith("|") & ~text.has_excluded_symbol(F.col("raw")))
    cells = F.transform(F.split("raw", r"\|"), text.js_trim)
    rows = lines.withColumn("c", F.slice(cells, 2, 100)).where(F.size("c") >= 5)
    rows = rows.select("source", "line", *(F.get("c", F.lit(i)).alias(k) for i, k in enumerate(("company", "role", "location", "cell", "day"))))
    kept = (F.col("day") == dates.la_day(as_of)) & text.first_href(F.col("cell")).isNotNull()
    name = F.regexp_replace(F.regexp_replace("company", r"\[([^\]]*)\]\([^)]*\)", "$1"), r"\*\*|</?[^>]+>", "")
    rows = rows.withColumn("company", text.clean_text(name)).withColumn("kept", F.coalesce(kept, F.lit(False)))
    if not fill_all:
        rows = rows.where("kept")
    filled = forward_fill(F.col("company"), F.contains("company", F.lit("↳")), ["source"], "line")
    rows = rows.withColumn("company", F.coalesce(filled, F.lit("Unknown"))).where("kept")
    return rows.withColumn("link", urls.clean_link(text.first_href(F.col("cell")))).select(*COLUMNS)


_MARKS = r"\A[🔥⭐→↳·•\-–—\s]+"


def parse_html(landed: DataFrame) -> DataFrame:
    """Rows of the software table that are new today ('0d'); '↳' takes the company of the row before, kept or not."""
    rows = landed.select(F.col("name").alias("source"), F.inline(pages.list_rows("body")))
    rows = rows.where(~text.has_excluded_symbol(F.col("company")))
    own = F.trim(F.regexp_replace(pages.nfkc("company"), _MARKS, ""))
    filled = forward_fill(own, F.col("company") == "↳", ["source"], "line")
    rows = rows.withColumn("filled", F.coalesce(filled, F.lit("Unknown")))
    whole = F.concat_ws(" ", "company", "role", "location", "age")
    rows = rows.where(~text.has_excluded_symbol(F.col("role")) & ~text.has_excluded_symbol(whole) & F.col("link").isNotNull() & (F.col("age") == "0d"))
    return rows.withColumn("company", F.col("filled")).withColumn("link", urls.clean_link("link")).select(*COLUMNS)


def fetch_sources(landed: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Jobs of the enabled lists by their format, from landed rows (url, code, body)."""
    body = F.when((F.col("code") >= 200) & (F.col("code") < 300), F.col("body"))
    held = sources.where("not disabled").join(landed.select("url", body.alias("body")), "url")
    return parse_markdown(held.where("format = 'markdown'"), as_of).unionByName(parse_html(held.where("format = 'html'")))
