"""Configuration: what is looked for. Checked on the driver; a wrong one raises with all its messages."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from harrow import vocab

_MAIL = re.compile(r"[^@\s]+@[^@\s]+\.[^@\s]+")


RULES = ("allow_citizenship_required", "allow_no_sponsorship")


@dataclass(frozen=True)
class Config:
    categories: list[str]
    countries: list[str]
    keywords: list[str] | None = None
    #: country -> {"allow_citizenship_required": bool, "allow_no_sponsorship": bool}; only an explicit false rejects
    rules: dict[str, dict[str, bool]] = field(default_factory=dict)
    ai: dict = field(default_factory=lambda: {"enabled": False})
    #: host, port, user and email of the sender; email of the receiver
    sender: dict | None = None
    receiver: dict | None = None

    @property
    def allowed(self) -> list[str]:
        """Countries that pass; 'Unsure' is one if there are any, and none means all."""
        return [*self.countries, "Unsure"] if self.countries else []

    @staticmethod
    def of(data: dict) -> Config:
        wrong: list[str] = []
        target = data.get("target") if isinstance(data.get("target"), dict) else {}
        categories = [*(target.get("intern") or []), *(target.get("full-time") or [])]
        countries = target.get("countries")
        wrong += [f"unknown category {c!r}" for c in categories if c not in vocab.CATEGORIES]
        if not isinstance(countries, list):
            wrong.append("target.countries is required")
            countries = []
        wrong += [f"unknown country {c!r}" for c in countries if c not in vocab.COUNTRIES]
        rules = target.get("filter") or {}
        wrong += [f"target.filter.{c}.{k} is neither true nor false" for c, r in rules.items() for k in RULES if not isinstance(r.get(k, False), bool)]
        wrong += [f'"{c}" filter requires "{c}" to exist in target.countries' for c in rules if c not in countries]
        sender, receiver = data.get("sender"), data.get("receiver")
        for name, part in (("sender", sender), ("receiver", receiver)):
            if part is not None and not _MAIL.fullmatch(str(part.get("email"))):
                wrong.append(f"{name}.email is no address")
        if sender is not None:
            wrong += [f"sender.{k} cannot be empty" for k in ("host", "user") if not sender.get(k)]
            if not (isinstance(sender.get("port"), int) and 0 < sender["port"] < 65536):
                wrong.append("sender.port is out of range")
        ai = data.get("ai", {"enabled": False})
        if ai.get("enabled") and not (ai.get("provider") in vocab.MODEL_PRICES and ai.get("model")):
            wrong.append("ai needs a provider and a model")
        if wrong:
            raise ValueError("; ".join(wrong))
        return Config(categories, countries, target.get("keywords"), rules, ai, sender, receiver)


def _section(body: str, label: str) -> list[str]:
    m = re.search(rf"(?:\A|\n)###\s+{re.escape(label)}\s*\n(.*?)(?=\n###\s|\Z)", body, re.S)
    return [x.strip() for x in (m[1].split("\n") if m else []) if x.strip() and x.strip() != "_No response_"]


def of_form(body: str) -> dict:
    """The configuration that a filled form asks for. The same rules hold for every country; blank keywords are no keywords."""
    ticked = lambda label: [m[1].strip() for x in _section(body, label) if (m := re.match(r"- \[[xX]\] (.*)", x))]
    scalar = lambda label: next(iter(_section(body, label)), None)
    intern, full_time, countries = ticked("Internship targets"), ticked("Full-time targets"), ticked("Countries")
    if not intern and not full_time:
        raise ValueError("at least one internship or full-time target")
    if not countries:
        raise ValueError("at least one country")

    def required(label: str) -> str:
        if (got := scalar(label)) is None:
            raise ValueError(f"{label} is required")
        return got

    def flag(label: str) -> bool:
        got = required(label).lower()
        if got not in ("yes", "true", "no", "false"):
            raise ValueError(f"{label}: {got!r} is neither yes nor no")
        return got in ("yes", "true")

    rule = {"allow_citizenship_required": flag("Allow citizenship-required jobs?"), "allow_no_sponsorship": flag("Allow jobs without sponsorship?")}
    kinds = {k: v for k, v in (("intern", intern), ("full-time", full_time)) if v}
    return {
        "target": kinds | {"countries": countries, "filter": {c: dict(rule) for c in countries}, "keywords": _section(body, "Keywords")},
        "ai": {"enabled": bool(ticked("AI enabled")), "provider": required("AI provider"), "model": required("AI model")},
        "sender": {"host": required("SMTP host"), "port": int(required("SMTP port")), "user": required("SMTP user"), "email": required("Sender email")},
        "receiver": {"email": required("Receiver email")},
    }


#: Community lists (name, address, format, category).
LISTS = [
    ("vansh", "https://raw.githubusercontent.com/vanshb03/Summer2026-Internships/dev/README.md", "markdown", "summer intern"),
    ("vansh-off-season", "https://raw.githubusercontent.com/vanshb03/Summer2026-Internships/refs/heads/dev/OFFSEASON_README.md", "markdown", "off-season intern"),
    ("simplify", "https://raw.githubusercontent.com/SimplifyJobs/Summer2026-Internships/dev/README.md", "html", "summer intern"),
    ("simplify-off-season", "https://raw.githubusercontent.com/SimplifyJobs/Summer2026-Internships/refs/heads/dev/README-Off-Season.md", "html", "off-season intern"),
    ("simplify-new-grad", "https://raw.githubusercontent.com/SimplifyJobs/New-Grad-Positions/refs/heads/dev/README.md", "html", "entry level"),
]


def sources(config: Config) -> list[dict]:
    return [{"name": n, "url": u, "format": f, "type": t, "disabled": t not in config.categories} for n, u, f, t in LISTS]


def check(config: Config) -> list[str]:
    """What is missing for a run, without opening a connection."""
    out = []
    if config.ai.get("enabled") and not config.ai.get("apiKey"):
        out.append("no key for the model provider")
    out += [f"{k} is missing" for k in ("sender", "receiver") if not getattr(config, k)]
    if not config.categories:
        out.append("no target category")
    return out
