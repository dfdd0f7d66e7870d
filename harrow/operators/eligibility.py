"""Eligibility of described postings: three-valued attributes, of which only an explicit true or false decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow.config import Config


def reason(country: Column, category: Column, citizenship: Column, sponsorship: Column, config: Config) -> Column:
    """Why a posting is rejected, the first reason that holds; null if it is eligible."""
    allowed = config.allowed
    out = F.lit(None).cast("string")
    rule = lambda name: [c for c, r in config.rules.items() if r.get(name) is False]
    out = F.when(country.isin(rule("allow_no_sponsorship")) & sponsorship.eqNullSafe(F.lit(False)), "no sponsorship").otherwise(out)
    out = F.when(country.isin(rule("allow_citizenship_required")) & citizenship.eqNullSafe(F.lit(True)), "citizenship required").otherwise(out)
    named = F.coalesce(category, F.lit("")) != ""
    out = F.when(named & ~F.coalesce(category.isin(config.categories), F.lit(False)), "category").otherwise(out)
    return F.when(~F.coalesce(country.isin(allowed), F.lit(False)), "country").otherwise(out) if allowed else out


def eligible(country: Column, category: Column, citizenship: Column, sponsorship: Column, config: Config) -> Column:
    return reason(country, category, citizenship, sponsorship, config).isNull()


def in_countries(country: Column, allowed: list[str]) -> Column:
    """No allowed countries: all pass."""
    return country.isin(allowed) if allowed else F.lit(True)
