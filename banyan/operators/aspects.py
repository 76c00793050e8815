"""Aspects of reviews by keywords: three scorers, aggregates and decisions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from banyan.functions.text import any_hit, count_hits, present_hits

#: Keywords of the review-level scorer; a review has an aspect where its normalised text has one of the words.
REVIEW_ASPECTS = {
    "taste": ("ngon", "dở", "do uong", "ca phe", "tra", "freeze", "matcha", "dam vi", "vua mieng", "qua ngot", "nhat", "thom", "mi cay", "banh", "nuoc dung"),
    "space": ("khong gian", "rong", "rong rai", "thoang", "view", "cho ngoi", "on ao", "dong", "chill"),
    "cleanliness": ("sach", "sach se", "ban", "ve sinh", "do rac", "boi ban"),
    "staff_service": ("nhan vien", "phuc vu", "thai do", "chu dao", "nhiet tinh", "chao khach", "ho tro"),
    "delivery_accuracy": ("giao nham", "thieu do", "dong goi", "phan hoi", "ship", "don hang"),
    "value_for_money": ("dang dong tien", "gia", "hop ly", "dat", "re", "phai chang"),
    "work_friendly": ("wifi", "o dien", "laptop", "hoc tap", "lam viec", "deadline", "ngoi hoc"),
}
#: Keywords of the store-level scorer, whose occurrences are counted.
STORE_POSITIVE = {
    "taste": ("ngon", "thom", "de uong", "chat luong", "danh dong tien", "rat ngon"),
    "staff_service": ("phuc vu", "than thien", "nhanh", "tiet chot", "dong goi tot", "sach se"),
    "value_for_money": ("dang dong tien", "re", "gia tot", "gia mem", "phu hop"),
    "space": ("am cung", "thong thuong", "yen tinh", "thoang", "work friendly"),
    "cleanliness": ("sach se", "gon gang", "khong ban"),
    "work_friendly": ("lam viec", "may tinh xach tay", "work", "hoc tap", "phu hop de lam viec"),
}
STORE_NEGATIVE = {
    "taste": ("nhat", "khong hop khau vi", "te", "uoc"),
    "staff_service": ("cham", "thieu", "sai", "khong", "cau"),
    "value_for_money": ("dat", "khong dang", "khong hop gia"),
    "space": ("chat", "on", "nong"),
    "cleanliness": ("ban", "nham", "mau"),
    "work_friendly": ("on", "chat", "khong phu hop"),
}
#: Keywords of the polarity scorer, matched with accents.
POLARITY = {
    "food_quality": (("ngon", "rất ngon", "vừa miệng", "đậm đà", "thơm", "chất lượng", "đáng tiền", "khá ngon"), ("dở", "nhạt", "mặn", "nguội", "ôi", "thiu", "không ngon", "sai", "thiếu món", "không hợp khẩu vị")),
    "service": (("nhanh", "thân thiện", "nhiệt tình", "chu đáo", "lễ phép", "phục vụ tốt"), ("chậm", "lâu", "thái độ", "khó chịu", "cộc", "quát", "không nhiệt tình", "phục vụ chậm")),
    "cleanliness": (("sạch", "sạch sẽ", "thoáng", "gọn", "mát"), ("bẩn", "hôi", "ruồi", "dơ", "ám mùi")),
    "packaging": (("đóng gói tốt", "cẩn thận", "gói kỹ", "không đổ"), ("đổ", "rò", "rách", "thiếu", "vỡ", "bung")),
    "price": (("rẻ", "hợp lý", "đáng tiền", "vừa túi tiền"), ("đắt", "chát", "mắc", "không đáng")),
    "space": (("đẹp", "rộng", "ấm cúng", "yên tĩnh", "thoải mái"), ("chật", "ồn", "nóng", "bí", "đông quá")),
    "speed": (("nhanh", "lẹ", "ra món nhanh"), ("lâu", "chờ lâu", "ra món chậm", "ship lâu")),
}
#: Words that decide a review without a clear rating.
GOOD_WORDS = ("ngon", "dang dong tien", "sach se", "thom", "tot", "danh cho", "de chiu")
BAD_WORDS = ("thieu", "te", "cham", "ban", "khong hop", "nhat", "dat")


def review_aspects(normalised: Column) -> Column:
    """The aspects of a review, as an array."""
    return F.array_compact(F.array(*(F.when(any_hit(normalised, words), F.lit(a)) for a, words in REVIEW_ASPECTS.items())))


def store_hits(normalised: Column) -> Column:
    """array<struct<aspect, pos, neg>>: the occurrences of the store-level words."""
    return F.array(*(F.struct(F.lit(a).alias("aspect_name"), count_hits(normalised, w).alias("pos"), count_hits(normalised, STORE_NEGATIVE[a]).alias("neg")) for a, w in STORE_POSITIVE.items()))


def polarity(t: Column) -> Column:
    """map<aspect, (pos - neg) / (pos + neg)> of the aspects that have a word; t is a column of normalised text."""
    entries = []
    for a, (good, bad) in POLARITY.items():
        p, n = present_hits(t, good), present_hits(t, bad)
        entries.append(F.when(p + n > 0, F.struct(F.lit(a).alias("key"), F.round((p - n) / (p + n), 3).alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def polarity_scores(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, attribute, score) of each aspect that has a word in a text: `polarity` of its normalised text, a row an aspect.

    Over Arrow batches, since seeking 76 words in a text takes the engine ten times as long.
    """
    blanks = re.compile(r"[ \t\n\x0b\f\r]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [blanks.sub(" ", x.lower()).strip(" ") for x in b.column(1).to_pylist()]
            for a, words in POLARITY.items():
                p, n = (sum((np.fromiter((w in x for x in texts), np.int32, len(texts)) for w in ws), np.zeros(len(texts), np.int32)) for ws in words)
                at = np.flatnonzero(p + n)
                if len(at):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([a] * len(at)), pa.array(p[at]), pa.array(n[at])], ["k", "attribute", "p", "n"])

    hits = df.filter(F.col(value).isNotNull()).select(key, value).mapInArrow(run, f"k {dict(df.dtypes)[key]}, attribute string, p int, n int")
    return hits.select(F.col("k").alias(key), "attribute", F.round((F.col("p") - F.col("n")) / (F.col("p") + F.col("n")), 3).alias("score"))


def rating_sentiment(rating: Column) -> Column:
    return F.when(rating.isNull(), "unknown").when(rating >= 4, "positive").when(rating <= 2, "negative").otherwise("neutral")


def review_sentiment(rating: Column, normalised: Column) -> Column:
    t = F.coalesce(normalised, F.lit(""))
    return F.when(rating >= 4, "positive").when(rating <= 2, "negative").when(any_hit(t, GOOD_WORDS), "positive").when(any_hit(t, BAD_WORDS), "negative").otherwise("neutral")


def decide(pos: Column, neg: Column, neutral: Column) -> Column:
    s = pos - neg
    return (
        F.when(s >= 2, "positive").when(s <= -2, "negative").when((neg > 0) & (pos > 0), "mixed")
        .when((neutral > 0) & (pos == 0) & (neg == 0), "neutral").when(s > 0, "mixed_positive").when(s < 0, "mixed_negative").otherwise("mixed")
    )


def aspect_aggregate(mentions: DataFrame) -> DataFrame:
    """(store_id, aspect_name, mention_count, ..., evidence_sources) of rows (store_id, source_name, aspect_name, sentiment)."""
    s = F.col("sentiment")
    a = mentions.groupBy("store_id", "aspect_name").agg(
        F.count("*").alias("mention_count"),
        *(F.count_if(s == x).alias(f"{x}_mentions") for x in ("positive", "negative", "neutral")),
        F.array_join(F.sort_array(F.collect_set("source_name")), "|").alias("evidence_sources"),
    )
    return a.withColumn("aspect_sentiment", decide(F.col("positive_mentions"), F.col("negative_mentions"), F.col("neutral_mentions")))


def store_scores(hits: DataFrame, signal: Column) -> DataFrame:
    """Counts per (store_id, aspect_name) to sentiment; signal is a numeric rating that adds one hit: 4 and up good, under 3 bad."""
    pos = F.col("pos") + F.when(signal >= 4, 1).otherwise(0)
    neg = F.col("neg") + F.when((signal > 0) & (signal < 3), 1).otherwise(0)
    d = hits.select("store_id", "aspect_name", pos.alias("positive_mentions"), neg.alias("negative_mentions"))
    p, n = F.col("positive_mentions"), F.col("negative_mentions")
    d = d.withColumn("aspect_sentiment", F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral"))
    neutral = (F.col("aspect_sentiment") == "neutral").cast("int")
    return d.withColumn("neutral_mentions", neutral).withColumn("mention_count", F.greatest(F.lit(1).cast("bigint"), p + n + neutral))
