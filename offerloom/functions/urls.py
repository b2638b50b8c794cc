"""Link cleaning and search-link building."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters of a search and their defaults.
SEARCH_DEFAULTS = {
    "location": "Colombia",
    "geoId": "100876405",
    "f_TPR": "r43200",
    "f_JT": "F",
    "f_WT": "2",
}
SEARCH_ORDER = ("keywords", "location", "geoId", "start", "f_TPR", "f_JT", "f_WT")


def strip_query(link: Column) -> Column:
    """Everything before the first question mark."""
    return F.substring_index(link, "?", 1)


def canonical_url(link: Column) -> Column:
    """Scheme, host and path only: no parameters, query or fragment."""
    bare = F.regexp_replace(link, r"(?s)[?#].*$", "")
    bare = F.regexp_replace(bare, r";[^/]*$", "")
    scheme = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*:)", 1)
    return F.concat(F.lower(scheme), F.substring(bare, F.length(scheme) + 1, F.length(bare)))


def form_encode(value: Column) -> Column:
    """Encode one form value: blanks become ``+``, ``~`` stays, ``*`` does not."""
    encoded = F.url_encode(value)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def search_url(
    base_url: str,
    keyword: Column,
    start: Column | None = None,
    overrides: Mapping[str, str] | None = None,
) -> Column:
    """Search link of one keyword row.

    Empty values are left out, and so is a start of 0. Blanks in the keyword turn
    into ``+`` before encoding, so they arrive as ``%2B``.
    """
    values: dict[str, Column] = {name: F.lit(text) for name, text in SEARCH_DEFAULTS.items()}
    values["keywords"] = keyword
    values["start"] = F.lit(None).cast("string")
    if start is not None:
        values["start"] = F.when(start != 0, start.cast("string"))
    names = list(SEARCH_ORDER)
    for name, text in (overrides or {}).items():
        values[name] = F.lit(text)
        if name not in names:
            names.append(name)
    values["keywords"] = F.replace(values["keywords"], F.lit(" "), F.lit("+"))
    pairs = [
        F.when(
            values[name] != "",
            F.concat(form_encode(F.lit(name)), F.lit("="), form_encode(values[name])),
        )
        for name in names
    ]
    return F.concat(F.lit(f"{base_url}?"), F.concat_ws("&", *pairs))
