"""Pages: a small tree on the standard parser, the selectors that extraction needs, and Arrow UDFs over them."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

from harrow import vocab
from harrow.functions.lazy import arrow

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
_SPACE = re.compile(r"[\s﻿]+")


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self, without: frozenset[str] = frozenset()) -> str:
        out: list[str] = []
        todo: list[Node | str] = [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in without:
                todo += reversed(n.children)
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag, attrs):
        closes = _CLOSES.get(tag, ())
        n = self.at
        while n is not None and n.tag not in ("table", "ul", "ol", "tbody", "#root"):
            if n.tag in closes:
                self.at = n.parent
            n = n.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def tree(page: str) -> Node:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


def _simple(selector: str):
    m = re.fullmatch(r"([a-z0-9*]*)((?:[.#][\w-]+|\[[^\]]+\])*)", selector)
    if not m:
        raise ValueError(selector)
    tests = []
    for kind, name, attr in re.findall(r"([.#])([\w-]+)|\[([^\]]+)\]", m[2]):
        if attr:
            k, op, v = re.fullmatch(r"([\w-]+)(?:(\*?=)['\"]?(.*?)['\"]?)?", attr).groups()
            tests.append(lambda n, k=k, op=op, v=v: k in n.attrs and (op is None or (n.attrs[k] == v if op == "=" else v in n.attrs[k])))
        elif kind == ".":
            tests.append(lambda n, name=name: name in n.attrs.get("class", "").split())
        else:
            tests.append(lambda n, name=name: n.attrs.get("id") == name)
    return lambda n: m[1] in ("", "*", n.tag) and all(t(n) for t in tests)


def select(root: Node, selector: str) -> Iterator[Node]:
    """Tags, .class, #id, [attr], [attr='v'], [attr*='v'], descendants by blanks, alternatives by commas; in page order."""
    choices = [[_simple(x) for x in s.split()] for s in selector.split(",")]
    for n in root.walk():
        for steps in choices:
            if steps[-1](n):
                up, k = n.parent, len(steps) - 2
                while up is not None and k >= 0:
                    k -= steps[k](up)
                    up = up.parent
                if k < 0:
                    yield n
                    break


def squeeze(x: str) -> str:
    return _SPACE.sub(" ", x).strip()


def to_text(page: str | None) -> str | None:
    return None if page is None else squeeze(tree(page).text())


def _string(v, joint: str = ", ") -> str:
    if isinstance(v, str):
        return v.strip()
    return joint.join(x.strip() for x in v if isinstance(x, str) and x.strip()) if isinstance(v, list) else ""


def _place(v) -> str:
    if isinstance(v, str):
        return v.strip()
    if isinstance(v, list):
        return " | ".join(x for x in map(_place, v) if x)
    if not isinstance(v, dict):
        return ""
    a = v.get("address", v)
    if isinstance(a, str):
        return a.strip()
    if not isinstance(a, dict):
        return ""
    country = a.get("addressCountry")
    country = country.get("name", "") if isinstance(country, dict) else country
    return ", ".join(x for x in (_string(a.get("addressLocality")), _string(a.get("addressRegion")), _string(country)) if x)


def posting_of(raw: str) -> str | None:
    """Labelled text of the first JobPosting of a JSON-LD script; null if it has none. Only the top level is looked at."""
    try:
        data = json.loads(raw)
    except ValueError:
        return None
    for item in data if isinstance(data, list) else [data]:
        kind = item.get("@type") if isinstance(item, dict) else None
        if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
            fields = (
                ("Title", _string(item.get("title"))), ("Company", _string((item.get("hiringOrganization") or {}).get("name") if isinstance(item.get("hiringOrganization"), dict) else None)),
                ("Location", _place(item.get("jobLocation"))), ("Employment Type", _string(item.get("employmentType"))), ("Description", to_text(_string(item.get("description"))) or ""),
                ("Qualifications", to_text(_string(item.get("qualifications"))) or ""), ("Responsibilities", to_text(_string(item.get("responsibilities"))) or ""),
            )
            return "\n\n".join(f"{k}: {v}" for k, v in fields if v) or None
    return None


def json_ld(root: Node) -> str | None:
    for n in select(root, "script[type='application/ld+json']"):
        if got := posting_of(n.text()):
            return got
    return None


# What is taken out of a page first, and where descriptions stand, in this order.
_DROPPED = frozenset("script style noscript svg nav header footer form button input select textarea iframe".split())
SELECTORS = ["[data-automation-id='jobPostingDescription']", "[class*='job-description']", "[id*='job-description']", "[class*='description']", "article", "main", "[role='main']", "body"]
SELECTORS_ICIMS = [".iCIMS_JobContent", ".iCIMS_JobContainer", ".iCIMS_InfoMsg_Job", ".iCIMS_Expandable_Text", "#iCIMS_MainWrapper", ".iCIMS_JobPage", "[class*='job-description']", "[id*='job-description']", "article", "main", "[role='main']", "#content", "body"]


def likely(text: str, keywords: list[str], least: int = 300) -> bool:
    low = text.lower()
    return len(text) >= least and any(k in low for k in keywords)


def window(text: str, keywords: list[str], most: int = 12_000) -> str:
    low = text.lower()
    at = max(0, min((p for p in (low.find(k) for k in keywords) if p >= 0), default=0) - 1000)
    return text[at : at + most]


def limited(text: str, most: int = 12_000) -> str:
    return text if len(text) <= most else text[:most] + "\n\n[TRUNCATED]"


def description(page: str | None, selectors: list[str] = SELECTORS, keywords: list[str] = vocab.JD_KEYWORDS, least: int = 0) -> str | None:
    """A posting's text: structured data, else the first likely selector, else a window of the body; null if too short."""
    if not page:
        return None
    root = tree(page)
    if got := json_ld(root):
        return limited(got)
    for s in selectors:
        for n in select(root, s):
            text = squeeze(n.text(_DROPPED))
            if likely(text, keywords):
                return limited(window(text, keywords))
    text = window(squeeze(root.text(_DROPPED)), keywords)
    return limited(text) if len(text) > max(0, least - 1) and text else None


def hydration(page: str | None) -> dict | None:
    """The posting's data that a page hands to its script, as a JSON string literal; read, never run."""
    m = re.search(r"JSON\.parse\(\s*(\"(?:[^\"\\]|\\.)*\")\s*\)", page or "", re.S)
    try:
        data = json.loads(json.loads(m[1])) if m else None
    except ValueError:
        return None
    todo = [data]
    while todo:  # depth first for the first jobsData
        v = todo.pop()
        if isinstance(v, dict):
            if isinstance(v.get("jobsData"), dict):
                return v["jobsData"]
            todo += reversed(list(v.values()))
        elif isinstance(v, list):
            todo += reversed(v)
    return None


def hydrated_description(page: str | None) -> str | None:
    """Labelled text of such data: the en_US localisation, else the first one."""
    d = hydration(page)
    if d is None:
        return None
    loc = d.get("localizations") or {}
    one = (loc.get("en_US") or next(iter(loc.values()), {})) if isinstance(loc, dict) else {}
    get = lambda k: _string(one.get(k) or d.get(k), "\n")
    places = ", ".join(x for x in (_string(p.get("name")) for p in d.get("locations") or [] if isinstance(p, dict)) if x)
    fields = (("Title", get("postingTitle")), ("Location", places), ("Summary", get("jobSummary")), ("Description", get("description")), ("Minimum Qualifications", get("minimumQualifications")), ("Preferred Qualifications", get("preferredQualifications")))
    return "\n\n".join(f"{k}: {to_text(v) or ''}" for k, v in fields if v) or None


def embedded_board(page: str | None, host: str) -> str | None:
    """The board name in a page's embedded script or frame of that host (greenhouse.io or ashbyhq.com), else in its source."""
    if not page:
        return None
    for n in select(tree(page), f"script[src*='{host}'], iframe[src*='{host}']"):
        if m := re.search(r"[?&]for=([\w-]+)|(?:boards|jobs|job-boards)[\w.-]*/(?!embed)([^/?#\"']+)", n.attrs["src"]):
            return m[1] or m[2]
    m = re.search(rf"https?://(?:jobs|job-boards|boards)\.{re.escape(host)}/(?:embed/job_board(?:/js)?\?for=)?(?!embed)([^/\"'?#\s&]+)", page, re.I)
    return m[1] if m else None


def frame_source(page: str | None) -> str | None:
    """The frame that holds the real page: a frame element, one in <noscript>, or one in the source."""
    if not page:
        return None
    root = tree(page)
    for n in select(root, "iframe[id*='icims'], iframe[src*='icims']"):
        return n.attrs.get("src") or None
    m = re.search(r"<iframe[^>]+src=[\"']([^\"']*in_iframe=1[^\"']*)[\"']", page, re.I) or re.search(r"[\"'](https?:[^\"']*icims\.com[^\"']*in_iframe=1[^\"']*)[\"']", page)
    return m[1].replace("&amp;", "&").replace("\\/", "/") if m else None


ROW = "array<struct<line:int,company:string,role:string,location:string,link:string,age:string>>"
CARD = "array<struct<line:int,title:string,href:string,meta:string>>"


def table_rows(page: str | None) -> list[dict]:
    """Rows of the software table (after a heading of that name, else the first); five-cell rows lack the season."""
    if not page:
        return []
    root = tree(page)
    chosen = first = None
    heading = False
    for n in root.walk():
        if re.fullmatch(r"h[1-6]", n.tag) and "software engineering internship roles" in n.text().lower():
            heading = True
        elif n.tag == "table":
            first = first or n
            if heading:
                chosen = n
                break
    out = []
    for k, row in enumerate(select(chosen or first, "tbody tr") if chosen or first else []):
        cells = [c for c in row.children if isinstance(c, Node) and c.tag == "td"]
        if len(cells) < 5:
            continue
        if len(cells) == 5:
            cells.insert(3, Node("td", {}, None))
        link = next((a.attrs["href"] for a in select(cells[4], "a[href]")), None)
        company, role, place, age = (squeeze(cells[i].text()) for i in (0, 1, 2, 5))
        out.append({"line": k, "company": company, "role": role, "location": place, "link": link, "age": age})
    return out


def cards(page: str | None, heading: str = "h3") -> list[dict]:
    """Postings on a search page: each heading with the nearest link around or inside, and the text of its card."""
    out = []
    for k, h in enumerate(select(tree(page), heading) if page else []):
        n = h
        link = None
        while n is not None and link is None:
            link = n.attrs.get("href") if n.tag == "a" else next((a.attrs["href"] for a in select(n, "a[href]")), None)
            if link is None:
                n = n.parent
        card = n or h
        if card.tag == "a" and card.parent is not None:
            card = card.parent
        rest = squeeze(card.text().replace(h.text(), " ", 1))
        out.append({"line": k, "title": squeeze(h.text()), "href": link, "meta": rest})
    return out


html_to_text = arrow(to_text, "string")
nfkc = arrow(lambda x: None if x is None else unicodedata.normalize("NFKC", x), "string")
page_description = arrow(description, "string")
icims_description = arrow(lambda x: description(x, SELECTORS_ICIMS, vocab.JD_KEYWORDS_ICIMS, 300), "string")
apple_description = arrow(hydrated_description, "string")
ld_posting = arrow(lambda x: json_ld(tree(x)) if x else None, "string")
list_rows = arrow(table_rows, ROW)
search_cards = arrow(cards, CARD)
greenhouse_board = arrow(lambda x: embedded_board(x, "greenhouse.io"), "string")
ashby_board = arrow(lambda x: embedded_board(x, "ashbyhq.com"), "string")
icims_frame = arrow(frame_source, "string")
