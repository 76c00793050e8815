"""Queries on vectors, fusion, evaluation, intents and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from banyan.functions import text
from banyan.operators import fusion, vector
from banyan.operators.conform import first_wins
from banyan.plans.base import query
from banyan.session import durable

_DOT = "list_sum(list_transform(list_zip(a, b), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
_COS = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])) + 1e-9)"
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _scored(t):
    """Cosine of every vector with the first one: the query vector comes as one row."""
    q = t.embeddings.agg(F.min_by("embedding", "vec_id").alias("q"))
    return t.embeddings.crossJoin(F.broadcast(q)).select("vec_id", "label", F.round(vector.cosine(F.col("embedding"), F.col("q")), 4).alias("score"))


_SCORED = f"SELECT vec_id, label, round({_COS.format(a='embedding', b='q')}, 4) AS score FROM embeddings, (SELECT {_Q} AS q)"


@query(f"SELECT vec_id, score FROM ({_SCORED}) ORDER BY score DESC, vec_id LIMIT 10")
def knn_topk(t):
    return _scored(t).select("vec_id", "score").orderBy(F.desc("score"), "vec_id").limit(10)


@query(f"SELECT vec_id, score FROM (SELECT * FROM ({_SCORED}) ORDER BY score DESC, vec_id LIMIT 20) WHERE label IN (1, 3, 5)")
def knn_scoped_postfilter(t):
    """The scope holds after the limit, as in the service that this stands for."""
    return _scored(t).orderBy(F.desc("score"), "vec_id").limit(20).filter("label in (1, 3, 5)").select("vec_id", "score")


_PAIRS = f"SELECT x.vec_id AS a, y.vec_id AS b, round({_COS.format(a='x.embedding', b='y.embedding')}, 4) AS sim FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id"


@query(f"SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS k FROM ({_PAIRS}) WHERE sim >= 0.3) WHERE k <= 8")
def sim_edges_cosine(t):
    """At most eight edges for each vector to later ones."""
    return vector.top_edges(vector.similar_pairs(t.embeddings, "vec_id", "embedding", 0.3, k=8), 8)


_ATTR = "SELECT store_id, source_name AS f, round(avg(rating_5), 4) AS v FROM review_fact WHERE rating_5 IS NOT NULL GROUP BY ALL"


@query(f"""WITH s AS (SELECT s_suppkey AS k, p_brand AS f, count(*)::DOUBLE AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), n AS (SELECT k, sqrt(sum(v * v)) AS n FROM s GROUP BY k),
p AS (SELECT x.k AS a, y.k AS b, sum(x.v * y.v) AS d FROM s x JOIN s y ON x.f = y.f AND x.k < y.k GROUP BY ALL)
SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS i FROM (SELECT a, b, round(d / (na.n * nb.n + 1e-9), 4) AS sim FROM p JOIN n na ON a = na.k JOIN n nb ON b = nb.k) WHERE sim >= 0.45) WHERE i <= 8""")
def sim_edges_attribute(t):
    """At most eight edges of each supplier to later ones, by the cosine of the brands they ship."""
    s = durable(t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_brand").agg(F.count("*").alias("v")))
    return vector.top_edges(vector.similar_pairs(vector.dense(s, "l_suppkey", "p_brand", "v"), "k", "v", 0.45, k=8), 8)


_G = "g AS (SELECT store_id, row_number() OVER (ORDER BY be_rating_avg DESC, store_id) AS rank FROM (SELECT store_id, max(be_rating_avg) AS be_rating_avg FROM store_master GROUP BY 1) QUALIFY rank <= 30)"
_V = "v AS (SELECT store_id, row_number() OVER (ORDER BY n DESC, store_id) AS rank FROM (SELECT store_id, count(*) AS n FROM review_fact GROUP BY 1) QUALIFY rank <= 30)"
_T = "t AS (SELECT store_id, max(score) AS best FROM (SELECT store_id, round(length(review_text) / 1000.0, 4) AS score FROM review_fact WHERE review_text IS NOT NULL ORDER BY score DESC, ingest_id LIMIT 40) GROUP BY 1)"
_R = "r AS (SELECT store_id, max(be_rating_avg) AS rating FROM store_master GROUP BY 1)"


def _lists(t):
    """Three rankings of stores: by rating, by number of reviews, and by their longest texts."""
    r = t.store_master.groupBy("store_id").agg(F.max("be_rating_avg").alias("rating"))
    g = fusion.ranked(r.orderBy(F.desc("rating"), "store_id").limit(30), "rating", "store_id")
    n = t.review_fact.groupBy("store_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "store_id").limit(30)
    tx = t.review_fact.filter("review_text is not null").select("store_id", "ingest_id", F.round(F.length("review_text") / 1000.0, 4).alias("score")).orderBy(F.desc("score"), "ingest_id").limit(40)
    return g, fusion.ranked(n, "n", "store_id"), tx.groupBy("store_id").agg(F.max("score").alias("best")), r


_FUSED = f"""{_G}, {_V}, {_T}, {_R}, x AS (SELECT store_id, 1.0 / (60 + rank) AS s, 'graph' AS flag FROM g UNION ALL SELECT store_id, 1.0 / (60 + rank), 'vector' FROM v UNION ALL SELECT store_id, best / 61, 'text' FROM t),
f AS (SELECT x.store_id, sum(s) + coalesce(any_value(rating), 0) / 5.0 / 61 AS score, string_agg(DISTINCT flag, '|' ORDER BY flag) AS flags FROM x LEFT JOIN r ON x.store_id = r.store_id GROUP BY x.store_id)"""


@query(f"WITH {_FUSED} SELECT store_id, round(score, 8) AS score, flags FROM f")
def rrf_fusion(t):
    g, v, best, r = _lists(t)
    return fusion.fuse_rrf("store_id", {"graph": g, "vector": v}, best, r).withColumn("score", F.round("score", 8))


@query(f"""WITH {_G}, {_V}, {_T}, {_R}, x AS (SELECT store_id, 1.0 AS g, 0.0 AS v, 0.0 AS t FROM g UNION ALL SELECT store_id, 0, 1.0 / rank, 0 FROM v UNION ALL SELECT store_id, 0, 0, best FROM t),
w AS (SELECT store_id, max(g) AS g, max(v) AS v, max(t) AS t FROM x GROUP BY 1), y AS (SELECT w.*, rating FROM w LEFT JOIN r USING (store_id)), b AS (SELECT min(rating) AS lo, max(rating) AS hi FROM y)
SELECT store_id, round(0.22 * g + 0.26 * v + 0.20 * t + 0.10 * (coalesce(rating, 0) - lo) / (hi - lo + 1e-9), 8) AS score FROM y, b""")
def weighted_fusion(t):
    g, v, best, r = _lists(t)
    parts = {"graph": g.select("store_id", F.lit(1.0).alias("score")), "vector": v.select("store_id", (1.0 / F.col("rank")).alias("score")), "text": best.select("store_id", F.col("best").alias("score"))}
    return fusion.fuse_weighted("store_id", parts, r).withColumn("score", F.round("score", 8))


@query("""WITH a AS (SELECT store_id, source_name AS attribute, avg(rating_5) / 2.5 - 1 AS value FROM review_fact WHERE rating_5 IS NOT NULL GROUP BY ALL)
SELECT store_id, round((greatest(0, (coalesce(max(CASE WHEN attribute = 'google' THEN value END), -1) + 1) / 2) + greatest(0, (coalesce(max(CASE WHEN attribute = 'foody' THEN value END), -1) + 1) / 2)) / 2, 6) AS score FROM a GROUP BY store_id""")
def attribute_match(t):
    a = t.review_fact.filter("rating_5 is not null").groupBy("store_id", F.col("source_name").alias("attribute")).agg((F.avg("rating_5") / 2.5 - 1).alias("value"))
    return fusion.attribute_match(a, "store_id", ("google", "foody")).withColumn("score", F.round("score", 6))


_HITS = "SELECT * FROM (SELECT vec_id AS query, item, rank FROM (SELECT x.vec_id, y.vec_id AS item, row_number() OVER (PARTITION BY x.vec_id ORDER BY round(" + _COS.format(a="x.embedding", b="y.embedding") + ", 4) DESC, y.vec_id) AS rank FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 100 = 0)) WHERE rank <= 10"
_EVAL = f"""h AS ({_HITS}), l AS (SELECT q.vec_id AS query, i.vec_id AS item FROM embeddings q JOIN embeddings i ON q.label = i.label AND q.vec_id <> i.vec_id WHERE q.vec_id % 100 = 0), n AS (SELECT query, count(*) AS n FROM l GROUP BY 1),
g AS (SELECT query, count(*) AS found, min(rank) AS first, sum(1.0 / log2(rank + 1)) AS dcg FROM h JOIN l USING (query, item) GROUP BY 1)
SELECT query, round(coalesce(found / n, 0), 6) AS recall, round(coalesce(1.0 / first, 0), 6) AS mrr, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1.0 / log2(i + 1))), 0), 6) AS ndcg FROM n LEFT JOIN g USING (query)"""


def _eval(t):
    """Measures at 10: queries are the vectors whose id is divisible by 100, against all vectors; relevant are those with the same label."""
    e = t.embeddings
    hits = vector.search(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding", 10)
    label = e.select("vec_id", "label")
    good = hits.join(label.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query").join(label.select(F.col("vec_id").alias("item"), "label"), "item").filter("ql = label")
    totals = e.filter("vec_id % 100 = 0").join(e.groupBy("label").agg((F.count("*") - 1).alias("n")), "label").select(F.col("vec_id").alias("query"), "n")
    m = fusion.metrics_of_hits(good, totals, 10)
    return m.select("query", *(F.round(c, 6).alias(c) for c in ("recall", "mrr", "ndcg")))


@query(f"WITH {_EVAL}")
def eval_recall_mrr_ndcg(t):
    return _eval(t)


@query(f"WITH x AS (WITH {_EVAL}), o AS (SELECT 'all' AS run, recall, mrr, ndcg FROM x UNION ALL SELECT 'odd labels', recall, mrr, ndcg FROM x JOIN embeddings ON query = vec_id WHERE label % 2 = 1) SELECT run, round(avg(recall), 4) AS recall, round(avg(mrr), 4) AS mrr, round(avg(ndcg), 4) AS ndcg FROM o GROUP BY run")
def ablation_compare(t):
    """Means of the measures for two sets of queries."""
    m = _eval(t)
    odd = m.join(t.embeddings.filter("label % 2 = 1").select(F.col("vec_id").alias("query")), "query", "left_semi")
    o = m.withColumn("run", F.lit("all")).unionByName(odd.withColumn("run", F.lit("odd labels")))
    return o.groupBy("run").agg(*(F.round(F.avg(c), 4).alias(c) for c in ("recall", "mrr", "ndcg")))


#: Words of a request and the attribute they ask for.
ALIASES = {
    "ngon": "food_quality", "dở": "food_quality", "chất lượng": "food_quality", "phục vụ": "service", "nhân viên": "service", "thái độ": "service", "sạch": "cleanliness", "đóng gói": "packaging",
    "giá": "price", "rẻ": "price", "đắt": "price", "không gian": "space", "ấm cúng": "space", "nhanh": "speed", "chậm": "speed",
}
_ALIAS = " , ".join(f"CASE WHEN contains(x, '{w}') THEN '{a}' END" for w, a in ALIASES.items())


@query(f"""SELECT rating_row, list_sort(list_distinct(list_filter([{_ALIAS}], lambda v: v IS NOT NULL))) AS attributes, contains(x, 'tương tự') OR contains(x, 'giống') AS similar FROM (SELECT rating_row, trim(regexp_replace(lower(feedback), '\\s+', ' ', 'g')) AS x FROM be_ratings WHERE feedback IS NOT NULL)""")
def intent_rules(t):
    """What a request asks for, by rules, over a table of texts."""
    x = text.normalize_text(F.col("feedback"))
    hits = F.array_compact(F.array(*(F.when(x.contains(w), F.lit(a)) for w, a in ALIASES.items())))
    return t.be_ratings.filter("feedback is not null").select("rating_row", F.sort_array(F.array_distinct(hits)).alias("attributes"), (x.contains("tương tự") | x.contains("giống")).alias("similar"))


_S1 = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY row_id) AS rn FROM store_master) WHERE rn = 1)"


@query(f"""WITH {_S1} SELECT store_id, concat_ws('. ', canonical_name, 'Địa chỉ: ' || address, 'Nhóm: ' || primary_category, 'Điểm: ' || printf('%.2f', be_rating_avg)) AS doc FROM s""")
def summary_docs(t):
    s = first_wins(t.store_master, ["store_id"], "row_id")
    return s.select("store_id", F.concat_ws(". ", "canonical_name", F.concat(F.lit("Địa chỉ: "), "address"), F.concat(F.lit("Nhóm: "), "primary_category"), F.concat(F.lit("Điểm: "), F.format_string("%.2f", "be_rating_avg"))).alias("doc"))


@query("""SELECT ingest_id, substr(md5(concat_ws('|', store_id, review_id, ingest_id::VARCHAR)), 1, 16) AS unit_id, concat_ws(' | ', source_name, sentiment, review_text) AS unit FROM review_fact WHERE review_text IS NOT NULL AND trim(review_text) <> ''""")
def textunit_docs(t):
    r = t.review_fact.filter("review_text is not null and trim(review_text) <> ''")
    return r.select("ingest_id", text.short_hash(F.col("store_id"), F.col("review_id"), F.col("ingest_id").cast("string")).alias("unit_id"), F.concat_ws(" | ", "source_name", "sentiment", "review_text").alias("unit"))


@query(f"""WITH {_S1}, r AS (SELECT store_id, string_agg('- ' || review_text, chr(10) ORDER BY k) AS reviews FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY rating_5 DESC NULLS LAST, ingest_id) AS k FROM review_fact WHERE review_text IS NOT NULL) WHERE k <= 10 GROUP BY store_id)
SELECT s.store_id, concat_ws(chr(10), 'Tên quán: ' || canonical_name, 'Nhóm: ' || primary_category, r.reviews) AS doc FROM s LEFT JOIN r ON s.store_id = r.store_id""")
def store_docs(t):
    """One document a store with its ten best reviews."""
    from banyan.graph.query import first_n

    s = first_wins(t.store_master, ["store_id"], "row_id")
    r = first_n(t.review_fact.filter("review_text is not null").select("store_id", "rating_5", "ingest_id", "review_text"), "store_id", 10, F.desc_nulls_last("rating_5"), F.asc("ingest_id"))
    r = r.groupBy("store_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "review_text"))), lambda x: F.concat(F.lit("- "), x["review_text"])), "\n").alias("reviews"))
    return s.join(r, "store_id", "left").select("store_id", F.concat_ws("\n", F.concat(F.lit("Tên quán: "), "canonical_name"), F.concat(F.lit("Nhóm: "), "primary_category"), "reviews").alias("doc"))


def _five(t):
    g, v, best, r = _lists(t)
    f = fusion.fuse_rrf("store_id", {"graph": g, "vector": v}, best, r).withColumn("score", F.round("score", 8)).orderBy(F.desc("score"), "store_id").limit(5)
    return f.join(t.store_master.groupBy("store_id").agg(F.min("canonical_name").alias("name")), "store_id").select("store_id", "name", "score")


@query(f"WITH {_FUSED}, h AS (SELECT f.store_id, name, round(score, 8) AS score FROM f JOIN (SELECT store_id, min(canonical_name) AS name FROM store_master GROUP BY 1) m ON f.store_id = m.store_id ORDER BY round(score, 8) DESC, f.store_id LIMIT 5) SELECT string_agg(row_number || '. ' || name || ' (' || printf('%.4f', score) || ')', chr(10) ORDER BY row_number) AS context FROM (SELECT *, row_number() OVER (ORDER BY score DESC, store_id) AS row_number FROM h)")
def answer_context(t):
    """The text that an answering model gets, from the five best stores."""
    from banyan.operators.docs import context

    return context(_five(t), "score", "store_id", "name")


@query("""WITH d AS (SELECT district, count(DISTINCT store_id)::BIGINT AS stores, round(avg(be_rating_avg), 2) AS rating FROM store_master WHERE district IS NOT NULL GROUP BY 1) SELECT district, 'Khu ' || district || ': ' || stores || ' quán, điểm ' || printf('%.2f', rating) AS report FROM d""")
def community_report(t):
    from banyan.operators.docs import report

    d = t.store_master.filter("district is not null").groupBy("district").agg(F.countDistinct("store_id").alias("stores"), F.round(F.avg("be_rating_avg"), 2).alias("rating"))
    return d.select("district", report(F.col("district"), F.col("stores"), F.col("rating")).alias("report"))


@query(name="embed_texts")
def embed_texts(t):
    """Vectors of texts by a model that is passed in; here one that hashes words."""
    from banyan.operators.docs import embed, hashing_encoder

    return embed(t.documents, "doc_id", "text", hashing_encoder(32))


@query("""SELECT store_id, source_name, ingest_id FROM (SELECT DISTINCT store_id FROM store_master) LEFT JOIN review_fact USING (store_id)""")
def nested_explode_outer(t):
    """Nested reviews of stores, in parts of 1,024 ids, back to rows; a store without reviews keeps one row of nulls."""
    n = t.review_fact.groupBy("store_id", F.floor(F.col("ingest_id") / 1024).alias("part")).agg(F.collect_list(F.struct("source_name", "ingest_id")).alias("reviews"))
    s = t.store_master.select("store_id").distinct().join(n, "store_id", "left")
    return s.select("store_id", F.explode_outer("reviews").alias("r")).select("store_id", "r.source_name", "r.ingest_id")
