"""JSON and model results as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow import schemas, vocab


def parsed(body: Column, vendor: str) -> Column:
    """A vendor's payload, typed; null where it isn't JSON of that form."""
    body = F.regexp_replace(body, r"\Afor\s*\(;;\);", "") if vendor == "meta" else body
    return F.from_json(body, schemas.PAYLOADS[vendor])


def is_html(body: Column) -> Column:
    low = F.lower(F.ltrim(body))
    return low.startswith("<!doctype") | low.startswith("<html")


def location_batch(result: Column, n: Column) -> Column:
    """Countries of a batch: all as given if they are as many as asked for and all known, else all 'Unsure'."""
    got = F.from_json(result, "array<string>")
    good = (F.size(got) == n) & F.forall(got, lambda x: F.coalesce(x.isin(vocab.COUNTRIES), F.lit(False)))
    return F.when(F.coalesce(good, F.lit(False)), got).otherwise(F.array_repeat(F.lit("Unsure"), n))


def description_result(result: Column) -> Column:
    """A model's answer as the seven attributes; null unless its enumerations hold and qualifications are there."""
    got = F.from_json(result, schemas.JD)
    season = got["season"].isNull() | got["season"].rlike(r"\A(?:\d{4} (?:Summer|Fall|Spring|Winter)|None)\z")
    good = got["qualifications"].isNotNull() & got["country"].isin(vocab.COUNTRIES) & got["category"].isin([*vocab.CATEGORIES, "None"]) & season
    return F.when(F.coalesce(good, F.lit(False)), got)


def cost(tokens_in: Column, tokens_out: Column, provider: str) -> Column:
    """USD of a call at the provider's list price."""
    a, b = vocab.MODEL_PRICES[provider]
    return F.coalesce(tokens_in, F.lit(0)) * a / 1_000_000 + F.coalesce(tokens_out, F.lit(0)) * b / 1_000_000


def http_status(code: Column) -> Column:
    """Of landed rows: code 0 is a network failure, which is no error."""
    return F.when(code == 0, "network").when(code < 400, "ok").otherwise("error")


def is_error(code: Column) -> Column:
    return F.coalesce(code >= 400, F.lit(False))
