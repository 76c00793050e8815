"""String functions as column expressions: four normalisers, sets of words, lists, ids and clean-up."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _accent_table() -> tuple[str, str]:
    """Letters of the Latin blocks that decompose into a base letter and marks, and their base letters."""
    pairs = []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accent_table()


def strip_accents(c: Column) -> Column:
    """Without accents; d with stroke has none and stays."""
    return F.translate(F.regexp_replace(c, "[\\u0300-\\u036f]", ""), _FROM, _TO)


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def norm_text(c: Column, keep_underscore: bool = True) -> Column:
    """Lower case, no accents, other signs as single blanks."""
    t = squeeze(F.regexp_replace(F.lower(strip_accents(c)), r"[^\p{L}\p{N}_\s]", " "))
    return t if keep_underscore else squeeze(F.regexp_replace(t, "_", " "))


def slugify(c: Column) -> Column:
    return F.regexp_replace(norm_text(c), r"\s+", "_")


def normalize_text(c: Column) -> Column:
    """Trimmed, lower case, single blanks."""
    return squeeze(F.lower(c))


def slug_vn(c: Column) -> Column:
    """ASCII words joined by dashes; d with stroke is d."""
    t = F.translate(strip_accents(normalize_text(c)), "đĐ", "dD")
    return F.trim(F.regexp_replace(t, "[^a-z0-9]+", "-"), F.lit("-"))


#: The named entities that texts of pages hold.
ENTITIES = (("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    return reduce(lambda x, e: F.replace(x, F.lit(e[0]), F.lit(e[1])), ENTITIES, c)


def text_clean(c: Column) -> Column:
    return squeeze(unescape(c))


def match_text(c: Column) -> Column:
    """For matching: unescaped, lower case, ASCII letters and digits only."""
    return squeeze(F.regexp_replace(F.lower(strip_accents(unescape(c))), "[^a-z0-9]+", " "))


def token_set(c: Column, least: int = 2, stop: tuple[str, ...] = ()) -> Column:
    words = F.filter(F.array_distinct(F.split(c, " ")), lambda w: F.length(w) >= least)
    return F.array_except(words, F.array(*map(F.lit, stop))) if stop else words


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays; 0 if either is empty or null."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def overlap(a: Column, target: Column) -> Column:
    """The share of target's words that a has."""
    return F.when(F.size(target) > 0, F.size(F.array_intersect(a, target)) / F.size(F.array_distinct(target))).otherwise(0.0)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all, matching the longest common blocks first; no built-in does this."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def first_non_empty(*cs: Column) -> Column:
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in cs))


def split_multi(c: Column, pattern: str = r"[|;]") -> Column:
    return F.coalesce(F.filter(F.transform(F.split(c, pattern), lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def split_list(c: Column) -> Column:
    """A JSON list if it is one, else parts between ; | , and /."""
    return F.coalesce(F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")), split_multi(c, r"[;|,/]"))


def merge_lists(a: Column, b: Column) -> Column:
    """The distinct entries of both without regard to case; the first writing stays."""
    both = F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))
    return F.aggregate(both, F.array().cast("array<string>"), lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def json_props(*cs: Column | str) -> Column:
    """A JSON object with nulls kept; give the fields in sorted order."""
    return F.to_json(F.struct(*cs), {"ignoreNullFields": "false"})


def map_or_empty(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def short_hash(*cs: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("|", *cs)), 1, 16)


def point_id(c: Column) -> Column:
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("bigint")


def relation_type(c: Column) -> Column:
    """A name that may stand for a relation: upper case, letters, digits and single underscores."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.upper(F.coalesce(c, F.lit(""))), "[^0-9A-Z_]", "_"), "_+", "_"), F.lit("_"))
    return F.when(t == "", "RELATION").when(t.rlike("^[0-9]"), F.concat(F.lit("R_"), t)).otherwise(t)


def as_float(c: Column) -> Column:
    return F.trim(c).try_cast("double")


def as_int(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, ",", "")).try_cast("double").try_cast("bigint")


def to_float(c: Column) -> Column:
    """A number, or one with points for thousands and a comma for the fraction."""
    local = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\.", ""), ",", "."), "[^0-9.-]", "")
    return F.coalesce(as_float(c), local.try_cast("double"))


def count_hits(t: Column, words: tuple[str, ...]) -> Column:
    """The occurrences of all words in t, as substrings that do not overlap."""
    return sum(((F.length(t) - F.length(F.replace(t, F.lit(w), F.lit("")))) / F.lit(len(w)) for w in words), F.lit(0.0)).cast("bigint")


def any_hit(t: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (t.contains(w) for w in words))


def present_hits(t: Column, words: tuple[str, ...]) -> Column:
    return sum((t.contains(w).cast("int") for w in words), F.lit(0))


#: Words that are no house number.
HOUSE_SKIP = ("so", "kiot", "ngo", "ng", "hem", "pho", "p", "duong")


def house_number(c: Column) -> Column:
    """The first word with a digit among the first six of the normalised address."""
    words = F.slice(F.split(norm_text(c), " "), 1, 6)
    return F.try_element_at(F.filter(words, lambda w: ~w.isin(*HOUSE_SKIP) & w.rlike("[0-9]")), F.lit(1))


def without_house(c: Column) -> Column:
    t, h = norm_text(c), house_number(c)
    at = F.instr(F.concat(F.lit(" "), t, F.lit(" ")), F.concat(F.lit(" "), h, F.lit(" ")))
    return F.when(h.isNull(), t).otherwise(squeeze(F.concat(F.substring(t, F.lit(1), at - 1), F.lit(" "), F.substring(t, at + F.length(h), F.length(t)))))


def phone(c: Column) -> Column:
    """Digits only, the country code 84 as a leading 0."""
    d = F.regexp_replace(c, "[^0-9]", "")
    return F.nullif(F.when(d.startswith("84") & (F.length(d) >= 10), F.concat(F.lit("0"), F.substring(d, F.lit(3), F.length(d)))).otherwise(d), F.lit(""))


def clock(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d{1,2}:\d{2})", 1), F.lit(""))


#: The ordered formats of dates; the first that reads a value holds.
DATE_FORMATS = ("H:mm d/M/yyyy", "d/M/yyyy H:mm", "M/d/yyyy H:mm", "d/M/yyyy", "M/d/yyyy", "d/M/yy", "M/d/yy", "d/M/yyyy h:mm")


def mixed_date(c: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(F.trim(c), F.lit(f)) for f in DATE_FORMATS))


def location_parts(c: Column) -> Column:
    """struct(street, district, city) of an address with commas: first, last but one, last part."""
    p = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(F.try_element_at(p, F.lit(1)).alias("street"), F.when(F.size(p) >= 2, F.trim(F.regexp_replace(F.try_element_at(p, F.lit(-2)), "^Quận ", ""))).alias("district"), F.try_element_at(p, F.lit(-1)).alias("city"))


#: Patterns of promotion in normalised text.
PROMO = r"\b(uu dai|voucher|giam|tang|khuyen mai|combo|mua 2 tang 1|shorten asia|link de nhan)\b"


def promo_flag(c: Column) -> Column:
    return F.coalesce(norm_text(c).rlike(PROMO), F.lit(False)).cast("int")


def jsonish(c: Column, path: str) -> Column:
    """The value at a path of a JSON object, or of a literal with single quotes; else the text as it is."""
    return F.coalesce(F.get_json_object(c, path), F.get_json_object(F.translate(c, "'", '"'), path), c)


def join_field(parts: Column) -> Column:
    return F.concat_ws("; ", parts)


def after_word(c: Column, words: str) -> Column:
    """The part of an address, between commas or dashes, that begins with one of the words (a pattern), without it."""
    return F.nullif(F.trim(F.regexp_extract(c, rf"(?iu)(?:^|[,\-])\s*(?:{words})\s*([^,\-]+)", 1)), F.lit(""))
