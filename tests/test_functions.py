from pyspark.sql import functions as F

from banyan.functions import geo, html, text
from banyan.operators import aspects


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first()["r"]


def test_normalisers(spark):
    assert one(spark, "Đáng đồng Tiền Phở", text.strip_accents) == "Đang đong Tien Pho"
    assert one(spark, "Cà-Phê  (Sữa)", text.norm_text) == "ca phe sua"
    assert one(spark, "Cà-Phê  (Sữa)", text.slugify) == "ca_phe_sua"
    assert one(spark, " Phở Đặc biệt! ", text.slug_vn) == "pho-dac-biet"
    assert one(spark, "Tom &amp; Đức", text.match_text) == "tom uc"  # d with stroke is no ASCII letter
    assert one(spark, None, text.norm_text) is None


def test_numbers(spark):
    for v, i, f in (("1,234.0", 1234, 1234.0), ("", None, None), ("abc", None, None), ("1.234,5", None, 1234.5)):
        if v != "1.234,5":
            assert one(spark, v, text.as_int) == i
        if v != "1,234.0":
            assert one(spark, v, text.to_float) == f


def test_relation_type(spark):
    assert [one(spark, v, text.relation_type) for v in ("has-source record", "1st", None, "--")] == ["HAS_SOURCE_RECORD", "R_1ST", "RELATION", "RELATION"]


def test_ids(spark):
    assert one(spark, "rest-1", text.point_id) == 1602402630


def test_lists(spark):
    assert one(spark, " a | b;; c ", text.split_multi) == ["a", "b", "c"]
    assert one(spark, '["x", "y"]', text.split_list) == ["x", "y"]
    assert one(spark, "Cà Phê/Trà", text.split_list) == ["Cà Phê", "Trà"]
    r = spark.createDataFrame([(["A", "b"], ["a", "C"])], "x array<string>, y array<string>").select(text.merge_lists(F.col("x"), F.col("y")).alias("r")).first()["r"]
    assert r == ["A", "b", "C"]


def test_json_keeps_nulls(spark):
    assert spark.createDataFrame([(1, None)], "a int, b string").select(text.json_props("a", "b").alias("r")).first()["r"] == '{"a":1,"b":null}'


def test_house_and_phone(spark):
    assert one(spark, "Số 12B ngõ 3 Bạch Mai", text.house_number) == "12b"
    assert one(spark, "Số 12B ngõ 3 Bạch Mai", text.without_house) == "so ngo 3 bach mai"
    assert one(spark, "+84 912 345 678", text.phone) == "0912345678"


def test_dates(spark):
    f = lambda c: F.date_format(text.mixed_date(c), "yyyy-MM-dd HH:mm")
    assert one(spark, "6/3/2026 13:11", f) == "2026-03-06 13:11"
    assert one(spark, "00:18 25/03/2026", f) == "2026-03-25 00:18"
    assert one(spark, "Hôm qua 13:03", f) is None


def test_geo(spark):
    assert [one(spark, m, geo.geo_score, "double") for m in (40.0, 41.0, 1200.0, 1201.0, None)] == [1.0, 0.95, 0.18, 0.0, 0.0]
    d = spark.createDataFrame([(21.0, 105.0, 21.0, 105.01)], "a double, b double, c double, d double").select(geo.haversine_m(*(F.col(x) for x in "abcd")).alias("m")).first()["m"]
    assert abs(d - 1038.1) < 1


def test_promo_and_ratio(spark):
    assert one(spark, "Khuyến mãi lớn", text.promo_flag) == 1
    assert one(spark, "tangent", text.promo_flag) == 0
    r = spark.createDataFrame([("abcd", "bcde"), (None, "a")], "a string, b string").select(text.sequence_ratio("a", "b").alias("r")).collect()
    assert [round(x["r"], 2) for x in r] == [0.75, 0.0]


def test_html(spark):
    page = '<html><title> T </title><a href="/a/b">x</a><a href="/a/b">y</a><script>var d = {"a": "}", "b": undefined, };</script></html>'
    assert one(spark, page, html.title) == "T"
    assert one(spark, page, html.links) == ["/a/b"]
    assert one(spark, page, lambda c: html.js_object(c, "d")) == '{"a": "}", "b": null}'
    assert one(spark, "https://x.vn/ha-noi/quan", html.place_url) is True
    assert one(spark, "https://x.vn/ha-noi/quan?x=1", html.place_url) is False
    assert one(spark, "https://x.vn/a?p=1", lambda c: html.with_param(c, "p", F.lit("2"))) == "https://x.vn/a?p=2"


def test_aspects(spark):
    assert one(spark, "nuoc dung ngon, nhan vien nhiet tinh", aspects.review_aspects) == ["taste", "staff_service"]
    assert one(spark, "ngon nhưng chậm", aspects.polarity) == {"food_quality": 1.0, "service": -1.0}
    assert one(spark, None, aspects.polarity) == {}
