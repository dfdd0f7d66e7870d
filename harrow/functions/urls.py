"""URLs as browsers read them: one Arrow UDF gives the parts, and keys are expressions on these."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote_to_bytes

from pyspark.sql import Column
from pyspark.sql import functions as F

from harrow import vocab
from harrow.functions.lazy import arrow

PARTS = "struct<href:string,origin:string,host:string,path:string,query:string,fragment:string,pairs:array<struct<k:string,v:string>>>"
_PORTS = {"http": "80", "https": "443", "ftp": "21", "ws": "80", "wss": "443"}
_URL = re.compile(r"([a-z][a-z0-9+.-]*):[/\\]*(?:[^/\\?#@]*@)?(\[[^\]]*\]|[^:/\\?#]*)(?::(\d*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\Z", re.I | re.S)


def _decode(x: str) -> str:
    return unquote_to_bytes(x.replace("+", " ")).decode("utf-8", "replace")


def form_encode(pairs: list[tuple[str, str]]) -> str:
    e = lambda x: quote(x, safe="*-._ ").replace("~", "%7E").replace(" ", "+")
    return "&".join(f"{e(k)}={e(v)}" for k, v in pairs)


def parse(url: str | None) -> dict | None:
    """The parts of an http, https, ftp or ws URL; null for what is none."""
    if url is None:
        return None
    m = _URL.match(re.sub(r"[\t\n\r]", "", url.strip("".join(map(chr, range(33))))))
    if not m or m[1].lower() not in _PORTS or not m[2]:
        return None
    scheme, host, port = m[1].lower(), m[2].lower(), m[3] or ""
    if any(c in host for c in " <>^|%") and "%" not in host:
        return None
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            return None
    if port == _PORTS[scheme]:
        port = ""
    out: list[str] = []
    parts = m[4].replace("\\", "/").split("/")[1:] or [""]
    for k, part in enumerate(parts):
        low = part.lower().replace("%2e", ".")
        if low == "..":
            del out[-1:]
        if low in (".", ".."):
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(part)
    path = "/" + quote("/".join(out), safe="".join(chr(c) for c in range(33, 127) if chr(c) not in '"#<>?`{}'))
    query = quote(m[5] or "", safe="".join(chr(c) for c in range(33, 127) if chr(c) not in "\"#<>'"))
    origin = f"{scheme}://{host}" + (f":{port}" if port else "")
    pairs = [tuple(map(_decode, (p.split("=", 1) + [""])[:2])) for p in query.split("&") if p]
    href = origin + path + (f"?{query}" if query else "") + (f"#{m[6]}" if m[6] else "")
    return {"href": href, "origin": origin, "host": host, "path": path, "query": query, "fragment": m[6] or "", "pairs": [{"k": k, "v": v} for k, v in pairs]}


parts = arrow(parse, PARTS, ("href", "origin", "host", "path", "query", "fragment", "pairs"))


def clean(url: str | None) -> str | None:
    """Without utm_* and ref parameters and fragment, the rest of the query encoded anew; what is no URL stays."""
    p = parse(url)
    if p is None:
        return url
    left = [(x["k"], x["v"]) for x in p["pairs"] if not re.match(r"utm_", x["k"].lstrip(";"), re.I) and x["k"].lstrip(";").lower() != "ref"]
    return p["origin"] + p["path"] + (f"?{form_encode(left)}" if left else "")


clean_link = arrow(clean, "string")


def param(p: Column, name: str) -> Column:
    """The first value of a parameter; null if it is missing or empty."""
    return F.nullif(F.get(F.filter(p["pairs"], lambda x: x["k"] == name), F.lit(0))["v"], F.lit(""))


def has_param(p: Column, name: str) -> Column:
    return F.exists(p["pairs"], lambda x: x["k"] == name)


def segments(p: Column) -> Column:
    return F.filter(F.split(p["path"], "/"), lambda x: x != "")


def strip_slashes(path: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(path, r"/+\z", ""), F.lit("")), F.lit("/"))


def normalize(p: Column) -> Column:
    """https, no query, no fragment, no slashes at the end; the root stays '/'."""
    return F.concat(F.regexp_replace(p["origin"], r"\A[a-z]+:", "https:"), strip_slashes(p["path"]))


def last_number(path: Column) -> Column:
    """The last digits that begin a path segment."""
    return F.try_element_at(F.regexp_extract_all(path, F.lit(r"/(\d+)"), F.lit(1)), F.lit(-1))


def _suffix(host: Column, table: list[tuple[str, str]]) -> Column:
    out = F.lit(None).cast("string")
    for end, name in reversed(table):
        out = F.when(host.endswith(end), name).otherwise(out)
    return out


def classify(p: Column) -> Column:
    """The kind of system behind a URL: host suffixes, then tell-tale parameters, then known hosts, else custom."""
    known = F.lit("custom")
    for host, name in vocab.HOST_ATS.items():
        known = F.when(p["host"] == host, name).otherwise(known)
    by_param = F.when(has_param(p, "ashby_jid"), "ashby").when(has_param(p, "gh_jid"), "greenhouse")
    return F.when(p["host"].isNotNull(), F.coalesce(_suffix(p["host"], vocab.ATS_HOSTS), by_param, known))


def custom_company(p: Column) -> Column:
    return _suffix(p["host"], vocab.CUSTOM_HOSTS)


def _group(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit(""))


def greenhouse_key(p: Column) -> Column:
    return F.coalesce(param(p, "gh_jid"), last_number(p["path"]), param(p, "token"))


def workday_key(p: Column) -> Column:
    return F.regexp_replace(_group(p["href"], r"_([^/_?]+)(?:\?|\z)"), r"-[0-9]\z", "")


def segment_key(p: Column, parity: bool = True) -> Column:
    """The second path segment in lower case. Unless `parity`, an ashby_jid parameter comes first."""
    third = F.nullif(F.lower(F.get(F.split(p["path"], "/"), F.lit(2))), F.lit(""))
    return third if parity else F.coalesce(F.lower(param(p, "ashby_jid")), third)


def oracle_key(p: Column) -> Column:
    return _group(p["path"], r"(?i)/job/(\d+)(?:/|\z)")


def icims_key(p: Column) -> Column:
    return _group(p["path"], r"(?i)/jobs/(\d+)(?:/|\z)")


def custom_key(p: Column) -> Column:
    known = custom_company(p)
    page = F.concat(p["origin"], p["path"])
    request = _group(F.get(F.filter(p["pairs"], lambda x: x["k"] == "jobReq"), F.lit(0))["v"], r"(?i)(REQ[-_]?\d+)")
    number = F.get(F.filter(F.transform(p["pairs"], lambda x: F.regexp_extract(x["v"], r"(\d{4,})", 1)), lambda x: x != ""), F.lit(0))
    query = F.array_join(F.transform(p["pairs"], lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")
    return F.when(known.isNotNull(), F.concat(known, F.lit(":"), F.coalesce(last_number(p["path"]), page))).otherwise(
        F.concat(F.lit("custom:"), F.coalesce(request, number, F.concat(page, F.lit("?"), query)))
    )


def job_key(p: Column, raw: Column, parity: bool = True) -> Column:
    """The key of a posting's URL. Unless `parity`, keys of Workday, iCIMS and Oracle are told apart by host, and ashby_jid counts."""
    kind = classify(p)
    own = {
        "greenhouse": greenhouse_key(p), "workday": workday_key(p), "ashby": segment_key(p, parity), "lever": segment_key(p),
        "smartrecruiters": last_number(p["path"]), "oraclecloud": oracle_key(p), "icims": icims_key(p),
    }
    key = F.lit(None).cast("string")
    for name, k in own.items():
        if not parity and name in ("workday", "icims", "oraclecloud"):
            k = F.concat(p["host"], F.lit("/"), k)
        key = F.when(kind == name, k).otherwise(key)
    return F.when(p["host"].isNull(), F.concat(F.lit("url:"), raw)).when(kind == "custom", custom_key(p)).otherwise(F.concat(kind, F.lit(":"), F.coalesce(key, normalize(p))))


def bare_host(p: Column) -> Column:
    return F.regexp_replace(p["host"], r"\Awww\.", "")


def host_label(p: Column) -> Column:
    return F.coalesce(F.nullif(F.split_part(bare_host(p), F.lit("."), F.lit(1)), F.lit("")), F.lit("unknown"))


def icims_company(p: Column) -> Column:
    """careers-acme.icims.com and the like: the company's part of the host."""
    return F.coalesce(_group(p["host"], r"\A(?:[a-z0-9]+-)?careers?-([^.]+)\.icims\.com"), _group(p["host"], r"\A(?:careers-|jobs-)?([^.]+)\.icims\.com"), bare_host(p))


def without_params(p: Column, names: list[str]) -> Column:
    left = F.filter(p["pairs"], lambda x: ~x["k"].isin(names))
    query = F.array_join(F.transform(left, lambda x: F.concat(F.url_encode(x["k"]), F.lit("="), F.url_encode(x["v"]))), "&")
    return F.concat(p["origin"], p["path"], F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def is_greenhouse_board(p: Column) -> Column:
    return p["host"].rlike(r"\A(?:job-)?boards\.(?:[^/]+\.)?greenhouse\.io\z")


def is_ashby_board(p: Column) -> Column:
    return bare_host(p).isin("jobs.ashbyhq.com", "job-boards.ashbyhq.com")


def is_icims_search(p: Column) -> Column:
    return F.contains(p["path"], F.lit("/jobs/search"))


def is_icims_job(p: Column) -> Column:
    return p["path"].rlike(r"(?i)/jobs/\d+(?:/|\z)")


def ashby_board(p: Column) -> Column:
    return F.coalesce(F.when(is_ashby_board(p), F.get(segments(p), F.lit(0))), _group(p["path"], r"(?i)/posting-api/job-board/([^/?#]+)"))
