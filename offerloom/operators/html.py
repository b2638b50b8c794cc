"""Fields of captured listing and detail pages.

One Arrow UDF walks the markup and returns the nodes that match a few selectors.
Everything after that (choice of node, link cleaning, dates, criteria) is built
from Spark expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offerloom.functions.dates import relative_date
from offerloom.functions.text import parse_count, squeeze
from offerloom.functions.urls import canonical_url


@dataclass(frozen=True)
class Selector:
    """Match ``tag`` (any when empty) with ``css_class`` (any when empty).

    ``inside`` names another selector that must be open around the node.
    """

    kind: str
    tag: str = ""
    css_class: str = ""
    inside: str = ""


# Selectors of the captured job pages.
LISTING_SELECTORS = (
    Selector("total", css_class="results-context-header__job-count"),
    Selector("result_list", "ul", "jobs-search__results-list"),
    Selector("result_item", "li", inside="result_list"),
    Selector("link_in_list", "a", "base-card__full-link", inside="result_item"),
    Selector("link", "a", "base-card__full-link"),
)
DETAIL_SELECTORS = (
    Selector("title", "h1", "top-card-layout__title"),
    Selector("company", "a", "topcard__org-name-link"),
    Selector("bullet", "span", "topcard__flavor--bullet"),
    Selector("subline", "h4", "top-card-layout__second-subline"),
    Selector("flavor", "span", "topcard__flavor", inside="subline"),
    Selector("posted", "span", "posted-time-ago__text"),
    Selector("description", "div", "show-more-less-html__markup"),
    Selector("criterion", "li", "description__job-criteria-item"),
    Selector("criterion_header", "h3", "description__job-criteria-subheader", "criterion"),
    Selector("criterion_text", "span", "description__job-criteria-text", "criterion"),
    Selector("insight", css_class="job-details-jobs-unified-top-card__job-insight"),
)
JOB_LINK_MARKER = "/jobs/view/"
BLOCK_MARKER = "authwall"
BLOCK_URL = "https://www.linkedin.com/authwall"
# Header words of the criteria list, tested in this order.
CRITERIA_HEADERS = (
    ("seniority", ("nivel de antigüedad", "seniority level")),
    ("work_modality_english", ("tipo de empleo", "employment type")),
    ("job_function", ("función laboral", "job function")),
    ("industries", ("sectores", "industries")),
)

_VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_SILENT_TAGS = frozenset(("script", "style", "template"))
_CRITERION = pa.struct([("header", pa.string()), ("value", pa.string())])
_DETAIL = pa.struct(
    [
        ("title", pa.string()),
        ("company", pa.string()),
        ("bullet", pa.string()),
        ("flavors", pa.list_(pa.string())),
        ("posted", pa.string()),
        ("description", pa.string()),
        ("criteria", pa.list_(_CRITERION)),
        ("insight", pa.string()),
    ]
)
_DETAIL_DDL = (
    "title string, company string, bullet string, flavors array<string>, posted string, "
    "description string, criteria array<struct<header:string,value:string>>, insight string"
)
_LISTING = pa.struct([("total", pa.string()), ("hrefs", pa.list_(pa.string()))])
_LISTING_DDL = "total string, hrefs array<string>"


class _NodeFinder(HTMLParser):
    """Collects matching nodes in document order, each with the text below it."""

    def __init__(self, selectors: tuple[Selector, ...]):
        super().__init__(convert_charrefs=True)
        self.selectors = selectors
        self.nodes: list[dict] = []
        self.open_tags: list[tuple[str, list[int]]] = []
        self.open_nodes: dict[str, list[int]] = {s.kind: [] for s in selectors}

    def handle_starttag(self, tag, attrs):
        values = dict(attrs)
        classes = (values.get("class") or "").split()
        matched = []
        for s in self.selectors:
            if (s.tag and s.tag != tag) or (s.css_class and s.css_class not in classes):
                continue
            around = self.open_nodes[s.inside] if s.inside else []
            if s.inside and not around:
                continue
            self.nodes.append(
                {
                    "kind": s.kind,
                    "parent": around[-1] if around else None,
                    "text": [],
                    "href": values.get("href"),
                }
            )
            matched.append((s.kind, len(self.nodes) - 1))
        if tag in _VOID_TAGS:
            return
        self.open_tags.append((tag, matched))
        for kind, at in matched:
            self.open_nodes[kind].append(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if all(name != tag for name, _ in self.open_tags):
            return
        while True:
            name, matched = self.open_tags.pop()
            for kind, _ in matched:
                self.open_nodes[kind].pop()
            if name == tag:
                return

    def handle_data(self, data):
        if self.open_tags and self.open_tags[-1][0] in _SILENT_TAGS:
            return
        for positions in self.open_nodes.values():
            for at in positions:
                self.nodes[at]["text"].append(data)


def _find(page: str, selectors: tuple[Selector, ...]) -> dict[str, list[dict]]:
    """Matching nodes by kind, in document order, each with its position and its text."""
    finder = _NodeFinder(selectors)
    finder.feed(page)
    finder.close()
    found: dict[str, list[dict]] = {s.kind: [] for s in selectors}
    for at, node in enumerate(finder.nodes):
        found[node["kind"]].append({**node, "at": at, "text": "".join(node["text"])})
    return found


def _first(found: dict[str, list[dict]], kind: str, parent: int | None = None) -> str | None:
    for node in found.get(kind, ()):
        if parent is None or node["parent"] == parent:
            return node["text"]
    return None


def _listing_parts(found: dict[str, list[dict]]) -> dict:
    cards = found.get("link_in_list") or found.get("link") or ()
    return {"total": _first(found, "total"), "hrefs": [node["href"] for node in cards]}


def _detail_parts(found: dict[str, list[dict]]) -> dict:
    single = ("title", "company", "bullet", "posted", "description", "insight")
    sublines = found.get("subline", ())
    return {
        **{kind: _first(found, kind) for kind in single},
        "flavors": [
            node["text"] for node in found.get("flavor", ())
            if sublines and node["parent"] == sublines[0]["at"]
        ],
        "criteria": [
            {
                "header": _first(found, "criterion_header", item["at"]),
                "value": _first(found, "criterion_text", item["at"]),
            }
            for item in found.get("criterion", ())
        ],
    }


def _parts(
    body: Column,
    selectors: tuple[Selector, ...],
    pick: Callable[[dict[str, list[dict]]], dict],
    kind: pa.DataType,
    ddl: str,
) -> Column:
    """Raw texts of one page as a struct; null for a null page."""

    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [
                None if page is None else pick(_find(page, selectors))
                for page in batch.to_pylist()
            ]
            yield pa.array(rows, type=kind)

    # Marked nondeterministic so that a filter on the result is not pushed below it,
    # which would parse every page a second time.
    return F.arrow_udf(extract, f"struct<{_typed(ddl)}>").asNondeterministic()(body)


def _typed(ddl: str) -> str:
    """``name type, ...`` in the ``name:type`` form that nested types use."""
    return re.sub(r"(^|, )(\w+) ", r"\1\2:", ddl)


def not_blocked(url: Column, body: Column) -> Column:
    blocked = F.contains(body, F.lit(BLOCK_MARKER)) | F.startswith(url, F.lit(BLOCK_URL))
    return ~F.coalesce(blocked, F.lit(False))


def listing_links(
    pages: DataFrame,
    selectors: tuple[Selector, ...] = LISTING_SELECTORS,
    marker: str = JOB_LINK_MARKER,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Listing pages to ``(url, total, link)``, one row per distinct offer link.

    Links inside the result list are used when there are any, all card links
    otherwise. Links without ``marker`` are skipped and the rest made canonical.
    """
    parts = _parts(F.col("body"), selectors, _listing_parts, _LISTING, _LISTING_DDL)
    parsed = pages.where(not_blocked(F.col("url"), F.col("body"))).select(
        "url", *keep, parts.alias("parts")
    )
    hrefs = F.filter("parts.hrefs", lambda h: F.contains(h, F.lit(marker)))
    links = F.array_distinct(F.transform(hrefs, canonical_url))
    return parsed.select(
        "url", *keep, parse_count(F.col("parts.total")).alias("total"), F.explode(links).alias("link")
    )


def _location(parts: Column) -> Column:
    """Bullet text, else the second flavor unless it is a count or an age, else the first."""
    first = squeeze(F.get(parts["flavors"], F.lit(0)))
    second = squeeze(F.get(parts["flavors"], F.lit(1)))
    no_place = F.lower(second).rlike("solicit|hace")
    return F.when(parts["bullet"].isNotNull(), squeeze(parts["bullet"])).otherwise(
        F.when(second.isNull() | no_place, first).otherwise(second)
    )


def _criteria(parts: Column) -> dict[str, Column]:
    """The four criteria; a later item of the same kind replaces an earlier one.

    Pages without a criteria list may name seniority and type in one line instead.
    """
    complete = F.filter(
        parts["criteria"], lambda c: c["header"].isNotNull() & c["value"].isNotNull()
    )
    dots = F.split(parts["insight"], "·")
    listless = (F.size(parts["criteria"]) == 0) & F.contains(parts["insight"], F.lit(" · "))
    fallback = {
        "seniority": F.when(listless, squeeze(F.get(dots, F.lit(0)))),
        "work_modality_english": F.when(listless, squeeze(F.get(dots, F.lit(1)))),
    }

    def last_value(words: tuple[str, ...], earlier: list[str]) -> Column:
        pattern, taken = "|".join(words), "|".join(earlier)

        def is_field(item: Column) -> Column:
            header = F.lower(item["header"])
            return header.rlike(pattern) & ~header.rlike(taken) if taken else header.rlike(pattern)

        return squeeze(F.try_element_at(F.filter(complete, is_field), F.lit(-1))["value"])

    found, earlier = {}, []
    for field, words in CRITERIA_HEADERS:
        value = last_value(words, earlier)
        found[field] = F.coalesce(value, fallback[field]) if field in fallback else value
        earlier = [*earlier, *words]
    return found


def detail_rows(
    pages: DataFrame,
    as_of: datetime | str,
    selectors: tuple[Selector, ...] = DETAIL_SELECTORS,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Detail pages to the extracted offer columns; a page without a title gives no row.

    Pages that lack the title's class anywhere are dropped before any parsing.
    """
    title_class = next(s.css_class for s in selectors if s.kind == "title")
    body = F.col("body")
    extracted = _parts(body, selectors, _detail_parts, _DETAIL, _DETAIL_DDL)
    parsed = pages.where(
        not_blocked(F.col("url"), body) & F.contains(body, F.lit(title_class))
    ).select("url", *keep, extracted.alias("parts"))
    parts = F.col("parts")
    criteria = _criteria(parts)
    return parsed.where(parts["title"].isNotNull()).select(
        "url",
        *keep,
        squeeze(parts["title"]).alias("vacancy_name"),
        squeeze(parts["company"]).alias("company"),
        _location(parts).alias("location"),
        *[criteria[field].alias(field) for field, _ in CRITERIA_HEADERS],
        squeeze(parts["description"]).alias("description"),
        relative_date(parts["posted"], as_of).alias("publication_date"),
    )
