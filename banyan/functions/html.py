"""Parts of crawled pages and addresses of pages."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def heading(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " ")), F.lit(""))


def meta(html: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(html, rf'(?is)<meta[^>]*name="{name}"[^>]*content="([^"]*)"', 1), F.lit(""))


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(html, F.lit(r'(?i)href="([^"]+)"'), 1))


def place_url(url: Column) -> Column:
    """True for an address with a two-segment path, no query, and no listing word."""
    path = F.try_parse_url(url, F.lit("PATH"))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.coalesce((F.size(parts) == 2) & F.try_parse_url(url, F.lit("QUERY")).isNull() & ~F.lower(path).rlike("(search|tag|category|login)"), F.lit(False))


def with_param(url: Column, name: str, value: Column) -> Column:
    """url with a query parameter set."""
    base = F.regexp_replace(url, rf"([?&]){name}=[^&]*&?", "$1")
    base = F.regexp_replace(base, "[?&]$", "")
    return F.concat(base, F.when(base.contains("?"), "&").otherwise("?"), F.lit(f"{name}="), value)


def balanced(text: str, start: int) -> str | None:
    """The object from a brace to its partner; braces within strings do not count."""
    depth, quote, skip = 0, "", False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif quote:
            if c == "\\":
                skip = True
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[start : i + 1]
    return None


def js_object(html: Column, variable: str) -> Column:
    """The object that a script gives to a variable, as JSON text: undefined becomes null, trailing commas go."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            m = re.search(rf"\b{re.escape(variable)}\s*=\s*(?=\{{)", t) if t else None
            o = balanced(t, m.end()) if m else None
            out.append(re.sub(r",\s*([}\]])", r"\1", re.sub(r":\s*undefined\b", ": null", o)) if o else None)
        return pd.Series(out, dtype=object)

    return run(html)
