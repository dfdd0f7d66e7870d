"""Text expressions with the white-space rules of JavaScript."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.vocab import EXCLUDED_SYMBOLS, JD_KEYWORDS, JS_SPACE


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{JS_SPACE}+|{JS_SPACE}+\z", "")


def clean_text(c: Column) -> Column:
    """White space runs become one blank, ends are trimmed."""
    return F.trim(F.regexp_replace(c, f"{JS_SPACE}+", " "))


def normalize_lines(c: Column) -> Column:
    """Each line cleaned, empty ones dropped; null if none is left."""
    lines = F.filter(F.transform(F.split(c, r"\r?\n"), clean_text), lambda x: x != "")
    return F.nullif(F.array_join(lines, "\n"), F.lit(""))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substr(c, F.lit(2))))


def blank(c: Column) -> Column:
    return F.coalesce(js_trim(c), F.lit("")) == ""


def season_label(c: Column) -> Column:
    """'Summer 2026' or '2026 summer' as '2026 Summer'; unsure and entry level in one spelling; others unchanged."""
    low = F.lower(clean_text(c))
    year, name = F.regexp_extract(low, r"(\d{4})", 1), F.regexp_extract(low, r"(summer|fall|spring|winter)", 1)
    whole = low.rlike(r"\A(?:(?:summer|fall|spring|winter) \d{4}|\d{4} (?:summer|fall|spring|winter))\z")
    return F.when(whole, F.concat_ws(" ", year, F.initcap(name))).when(low == "unsure", "unsure").when(low == "entry level", "Entry Level").otherwise(c)


def safe_filename(c: Column) -> Column:
    """ASCII letters, digits, dot, underscore and hyphen; runs of others are one underscore. NFKC first, see names.nfkc."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_"), "_+", "_")


def first_href(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r'href="([^"]+)"', 1), F.lit(""))


def has_excluded_symbol(c: Column) -> Column:
    out = F.lit(False)
    for s in EXCLUDED_SYMBOLS:
        out = out | F.contains(c, F.lit(s))
    return out


def limited(c: Column, most: int = 12_000) -> Column:
    """The first `most` characters and a mark; null stays null."""
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("\n\n[TRUNCATED]"))).otherwise(c)


def keyword_window(c: Column, keywords: list[str] | None = None, most: int = 12_000, before: int = 1000) -> Column:
    """`most` characters from `before` ahead of the earliest keyword on; from the start if none occurs."""
    low = F.lower(c)
    places = F.filter(F.array(*(F.locate(k, low) for k in keywords or JD_KEYWORDS)), lambda p: p > 0)
    first = F.greatest(F.lit(1), F.coalesce(F.array_min(places), F.lit(1)) - before)
    return F.substr(c, first, F.lit(most))


def likely_description(c: Column, keywords: list[str] | None = None, least: int = 300) -> Column:
    low = F.lower(c)
    found = F.lit(False)
    for k in keywords or JD_KEYWORDS:
        found = found | F.contains(low, F.lit(k))
    return F.coalesce((F.length(c) >= least) & found, F.lit(False))


#: Entities in the order in which they are replaced.
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]


def decode_entities(c: Column) -> Column:
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_html(c: Column, apostrophe: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), *((("'", "&#39;"),) if apostrophe else ())):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def location_label(jd_location: Column, location: Column) -> Column:
    """The first two comma parts of the description's location, else of the posting's; '-' if neither has any."""
    pick = F.when(~blank(jd_location), jd_location).otherwise(location)
    parts = F.filter(F.transform(F.split(pick, ","), js_trim), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(F.slice(parts, 1, 2), ", "), F.lit("")), F.lit("-"))


def card_location(c: Column) -> Column:
    """'US-NC-City' forms, 'Remote', or 'Unsure'."""
    code = js_trim(F.regexp_extract(c, r"\b([A-Z]{2}-[A-Z]{2}-[A-Za-z0-9 .,'/-]+)", 1))
    return F.when(code != "", code).when(c.rlike(r"(?i)\bremote\b"), "Remote").otherwise("Unsure")


def titled(title: Column, location: Column, body: Column) -> Column:
    """Labelled title and location before the text; empty parts are left out."""
    part = lambda label, x: F.when(~blank(x), F.concat(F.lit(f"{label}: "), x))
    return F.concat_ws("\n\n", part("Title", title), part("Location", location), F.when(~blank(body), body))


def normal_category(c: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(js_trim(c)), F.lit("")), F.lit("None"))


def normal_company(c: Column) -> Column:
    return clean_text(F.coalesce(c, F.lit("")))


def display_category(category: Column, season: Column) -> Column:
    return F.when(category == "intern", season).otherwise(category)


def category_title(c: Column) -> Column:
    """Words between blanks, hyphens and underscores with a capital each."""
    words = F.filter(F.split(c, r"[\s_-]+"), lambda x: x != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def human_list(c: Column) -> Column:
    """'A', 'A & B', 'A, B & C'."""
    n = F.size(c)
    head = F.array_join(F.slice(c, F.lit(1), F.greatest(n - 1, F.lit(0))), ", ")
    return F.when(n == 0, "").when(n == 1, F.get(c, F.lit(0))).otherwise(F.concat(head, F.lit(" & "), F.element_at(c, -1)))


def json_text(c: Column, is_string: bool) -> Column:
    return c if is_string else F.to_json(c)
