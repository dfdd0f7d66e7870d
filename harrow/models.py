"""The external model as a plug: a provider answers prompts; the one that comes along is made of rules and needs no network."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harrow import schemas, vocab
from harrow.functions import payloads

#: JSON schemas of the two kinds of answers.
DESCRIPTION_SCHEMA = {
    "type": "object",
    "properties": {
        "citizenship": {"type": ["boolean", "null"]}, "sponsorship": {"type": ["boolean", "null"]}, "qualifications": {"type": "array", "items": {"type": "string"}},
        "country": {"enum": vocab.COUNTRIES}, "location": {"type": ["string", "null"]}, "category": {"enum": [*vocab.CATEGORIES, "None"]}, "season": {"type": "string"},
    },
    "required": ["citizenship", "sponsorship", "qualifications", "country", "location", "category", "season"],
}


def location_schema(n: int) -> dict:
    return {"type": "array", "items": {"enum": vocab.COUNTRIES}, "minItems": n, "maxItems": n}


class Provider(Protocol):
    def generate(self, prompt: str, schema: dict) -> tuple[str | None, int, int]:
        """An answer and the tokens that went in and came out."""


def prompt(template: str, **values: str) -> str:
    """The template with @@NAME@@ replaced; a name without a value raises."""
    return re.sub(r"@@(\w+)@@", lambda m: values[m[1]], template)


def bullets(items: list[str]) -> str:
    return "\n".join(f"- {x}" for x in items)


class Retryable(Exception):
    def __init__(self, status: int):
        super().__init__(status)
        self.status = status


def with_retry(fn: Callable, retries: int = 5, first: float = 1.0, sleep: Callable[[float], None] = time.sleep):
    """fn(), again after 429, 500 and 503, waiting twice as long each time."""
    for k in range(retries + 1):
        try:
            return fn()
        except Retryable as e:
            if k == retries or e.status not in (429, 500, 503):
                raise
            sleep(first * 2**k)


def call(provider: Provider, text: str, schema: dict, **retry) -> tuple[str | None, int, int]:
    """The provider's answer; any failure is no answer at no cost. Schemas that aren't objects are wrapped in one."""
    wrapped = schema.get("type") != "object"
    asked = {"type": "object", "properties": {"result": schema}, "required": ["result"]} if wrapped else schema
    try:
        got, a, b = with_retry(lambda: provider.generate(text, asked), **retry)
        if got is not None and wrapped:
            data = json.loads(got)
            got = json.dumps(data["result"] if isinstance(data, dict) and "result" in data else data)
        return got, a, b
    except Exception:  # noqa: BLE001  a model's failure is a row's state, not the job's
        return None, 0, 0


class Rules:
    """Attributes of a description by fixed rules: explicit statements only, else unknown."""

    season = re.compile(r"\b(summer|fall|spring|winter)\s+(20\d\d)\b|\b(20\d\d)\s+(summer|fall|spring|winter)\b", re.I)

    def generate(self, prompt: str, schema: dict) -> tuple[str | None, int, int]:
        low = prompt.lower()
        season = self.season.search(prompt)
        intern = re.search(r"\bintern(?:ship)?\b|\bco-?op\b", low)
        named = "None" if not season else f"{season[2] or season[3]} {(season[1] or season[4]).capitalize()}"
        if intern:
            category = "summer intern" if not season or "Summer" in named else "off-season intern"
        elif re.search(r"\b(?:senior|staff|principal|lead)\b|\b(?:[5-9]|1\d)\+? years", low):
            category = "senior level"
        elif re.search(r"\bmid[- ]level\b|\b[2-4]\+? years|\b(?:ii|2)\b", low):
            category = "mid level"
        else:
            category = "entry level"
        out = {
            "citizenship": True if re.search(r"(?:u\.?s\.? )?citizen(?:ship)? (?:is )?(?:required|only)|must be a u\.?s\.? citizen|security clearance required", low) else None,
            "sponsorship": False if re.search(r"(?:no|not|unable to|cannot|without)[^.]{0,40}sponsor", low) else True if re.search(r"sponsorship (?:is )?available|will sponsor", low) else None,
            "qualifications": [x.strip(" -•*") for x in re.findall(r"(?m)^\s*[-•*]\s+(.+)$", prompt)][:10],
            "country": self.country(prompt),
            "location": (m[1].strip() if (m := re.search(r"(?mi)^location:\s*(.+)$", prompt)) else None),
            "category": category,
            "season": named if intern else "None",
        }
        return json.dumps(out), len(prompt) // 4, 120

    @staticmethod
    def country(text: str) -> str:
        for c in vocab.COUNTRIES[:-3]:
            if re.search(rf"\b{re.escape(c)}\b", text, re.I):
                return c
        if re.search(r"\bUnited States\b|\bU\.S\.A?\b|, [A-Z]{2}\b", text):
            return "USA"
        return "United Kingdom" in text and "UK" or (re.search(r"\bremote\b", text, re.I) and "Remote") or "Unsure"


def analyze(docs: DataFrame, provider: Provider | None, text: str = "raw_jd", price: str = "google") -> DataFrame:
    """docs with jd, cost and parse_code (200, or 404 without an answer that fits the schema). No provider: no answers.

    For rows that have passed the key check only; cut the result before it is used twice, as each use would ask again.
    """
    if provider is None:
        return docs.withColumn("jd", F.lit(None).cast(schemas.JD)).withColumn("cost", F.lit(0.0)).withColumn("parse_code", F.when(F.col(text).isNotNull(), 404))

    @F.pandas_udf("struct<result:string,tokens_in:long,tokens_out:long>")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in parts:
            got = [call(provider, x, DESCRIPTION_SCHEMA) if x is not None else (None, 0, 0) for x in s]
            yield pd.DataFrame(got, columns=["result", "tokens_in", "tokens_out"])

    out = docs.withColumn("__a", ask(text))
    out = out.withColumn("jd", payloads.description_result(F.col("__a.result"))).withColumn("cost", payloads.cost(F.col("__a.tokens_in"), F.col("__a.tokens_out"), price))
    return out.withColumn("parse_code", F.when(F.col(text).isNotNull(), F.when(F.col("jd").isNull(), 404).otherwise(200))).drop("__a")


def locate(jobs: DataFrame, provider: Provider | None, size: int = 50) -> DataFrame:
    """jobs (role, location) with country, asked for in batches; a batch without a fitting answer is 'Unsure' as a whole."""
    if provider is None:
        return jobs.withColumn("country", F.lit("Unsure"))
    kinds = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in jobs.schema)}, country string"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in parts:
            for k in range(0, len(whole), size):
                b = whole.iloc[k : k + size]
                asked = json.dumps([{"index": i, "title": t, "location": p} for i, (t, p) in enumerate(zip(b["role"], b["location"], strict=True))])
                got, _, _ = call(provider, asked, location_schema(len(b)))
                try:
                    countries = json.loads(got) if got else None
                except ValueError:
                    countries = None
                good = isinstance(countries, list) and len(countries) == len(b) and all(c in vocab.COUNTRIES for c in countries)
                yield b.assign(country=countries if good else "Unsure")

    return jobs.mapInPandas(run, kinds)
