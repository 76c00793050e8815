"""Hybrid retrieval over the whole tables: the documents whose id is divisible by 100 are the questions.

The test tables hold vectors without texts, so a question, a store and a review take the vector whose number is their own modulo the number of vectors.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from banyan.functions import text
from banyan.operators import aspects, retrieval, vector
from banyan.plans.base import query
from banyan.plans.conform_queries import _SCORES
from banyan.plans.retrieval_queries import _COS, ALIASES
from banyan.session import durable


def _numbered(t, df, number):
    return df.withColumn("vec_id", F.pmod(number, F.lit(t.embeddings.count())))


def _questions(t):
    q = t.documents.filter("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("query"), text.normalize_text(F.col("text")).alias("x"))
    return _numbered(t, q, F.col("query"))


def _stores(t):
    return t.store_master.filter("store_id is not null").groupBy("store_id").agg(F.max("be_rating_avg").alias("rating"), F.min("district").alias("district"))


def _categories(t):
    return t.store_master.filter("store_id is not null").select("store_id", F.explode(text.split_list(F.col("primary_category"))).alias("category")).distinct()


def _attributes(t):
    s = aspects.polarity_scores(t.review_fact, "store_id", "review_text")
    return s.groupBy("store_id", "attribute").agg(F.round(F.avg("score"), 3).alias("score"))


def _intents(t):
    return retrieval.intents(_questions(t), _stores(t).select("district"), _categories(t).select("category"), ALIASES)


def _edges(t):
    v = _numbered(t, _stores(t).select("store_id"), F.col("store_id").cast("bigint"))
    return vector.top_edges(vector.similar_shared(v, t.embeddings, "store_id", "vec_id", "embedding", 0.3, 8), 8)


_WORDS = r"' ' || array_to_string(list_filter(string_split_regex({}, '[^\p{{L}}\p{{N}}]+'), lambda v: v <> ''), ' ') || ' '"
_ATTRIBUTES = " UNION ALL ".join(f"SELECT query, 'attribute' AS kind, '{a}' AS value FROM q WHERE contains(x, '{w}')" for w, a in ALIASES.items())
_NUM = "(SELECT count(*) FROM embeddings)"
_INTENTS = rf"""q AS (SELECT doc_id AS query, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS x FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL),
p AS (SELECT query, {_WORDS.format('x')} AS x FROM q),
st AS (SELECT store_id, max(be_rating_avg) AS rating, min(district) AS district FROM store_master WHERE store_id IS NOT NULL GROUP BY 1),
ct AS (SELECT DISTINCT store_id, unnest(list_filter(list_transform(string_split_regex(primary_category, '[;|,/]'), lambda x: trim(x)), lambda x: x <> '')) AS category FROM store_master WHERE store_id IS NOT NULL),
i AS (SELECT query, 'district' AS kind, min(district) AS value FROM p JOIN (SELECT DISTINCT district FROM st WHERE district IS NOT NULL) ON contains(x, {_WORDS.format('lower(district)')}) GROUP BY 1
UNION ALL SELECT query, 'category', category FROM p JOIN (SELECT DISTINCT category FROM ct) ON contains(x, {_WORDS.format('lower(category)')})
UNION ALL SELECT DISTINCT * FROM ({_ATTRIBUTES}))"""


@query(f"WITH {_INTENTS} SELECT query, kind, value FROM i")
def intent_constraints(t):
    """What each question asks for: district, categories, attributes."""
    return _intents(t)


@query(f"""WITH {_INTENTS}, g AS (SELECT doc_id AS query, 'category' AS kind, source AS value FROM documents WHERE doc_id % 100 = 0 AND lang = 'vi' AND trim(source) <> '')
SELECT query, kind, value FROM i WHERE (query, kind) NOT IN (SELECT query, kind FROM g) UNION ALL SELECT query, kind, value FROM g""")
def intent_override(t):
    """Constraints that are given from elsewhere in the place of those of the rules."""
    given = t.documents.filter("doc_id % 100 = 0 and lang = 'vi'").select(F.col("doc_id").alias("query"), F.lit("category").alias("kind"), F.col("source").alias("value")).filter("value is not null")
    return retrieval.override(_intents(t), given)


_GRAPH = f"""{_INTENTS}, {_SCORES}, att AS (SELECT store_id, aspect AS attribute, round(avg(score), 3) AS score FROM s GROUP BY 1, 2),
need AS (SELECT query, count(DISTINCT CASE WHEN kind = 'attribute' THEN kind || value ELSE kind END) AS need FROM i GROUP BY 1),
met AS (SELECT query, store_id, kind AS part FROM i JOIN st ON kind = 'district' AND value = district UNION ALL SELECT query, store_id, kind FROM i JOIN ct ON kind = 'category' AND value = category
UNION ALL SELECT query, store_id, kind || value FROM i JOIN att ON kind = 'attribute' AND value = attribute AND att.score >= 0.15),
ful AS (SELECT query, store_id FROM met JOIN need USING (query) GROUP BY query, store_id, need HAVING count(DISTINCT part) = need UNION ALL SELECT q.query, store_id FROM q, st WHERE query NOT IN (SELECT query FROM need)),
g AS (SELECT query, store_id, row_number() OVER (PARTITION BY query ORDER BY rating DESC NULLS LAST, store_id) AS rank FROM ful JOIN st USING (store_id) QUALIFY rank <= 10)"""


@query(f"WITH {_GRAPH} SELECT query, store_id, rank FROM g")
def graph_search(t):
    """Stores that meet all that a question asks for, the best rated first."""
    return retrieval.graph_hits(_questions(t), durable(_intents(t)), _stores(t), _categories(t), _attributes(t), 10)


_HYBRID = f"""{_GRAPH}, qv AS (SELECT query, embedding AS e FROM q JOIN embeddings ON vec_id = query % {_NUM}), sv AS (SELECT store_id, embedding AS e FROM st JOIN embeddings ON vec_id = store_id::BIGINT % {_NUM}),
uv AS (SELECT ingest_id AS unit, store_id, embedding AS e FROM review_fact JOIN embeddings ON vec_id = ingest_id % {_NUM} WHERE review_text IS NOT NULL AND store_id IS NOT NULL),
v AS (SELECT query, store_id, row_number() OVER (PARTITION BY query ORDER BY round({_COS.format(a='qv.e', b='sv.e')}, 4) DESC, store_id) AS rank FROM qv, sv QUALIFY rank <= 10),
pr AS (SELECT x.store_id AS a, y.store_id AS b, round({_COS.format(a='x.e', b='y.e')}, 4) AS sim FROM sv x JOIN sv y ON x.store_id < y.store_id),
ed AS (SELECT a, b, sim FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) AS k FROM pr WHERE sim >= 0.3) WHERE k <= 8),
sd AS (SELECT DISTINCT query, store_id FROM (SELECT * FROM g UNION ALL SELECT * FROM v) WHERE rank <= 3),
n AS (SELECT query, x.store_id, row_number() OVER (PARTITION BY query ORDER BY sim DESC, rating DESC NULLS LAST, x.store_id) AS rank FROM (SELECT query, b AS store_id, max(sim) AS sim FROM sd JOIN (SELECT a, b, sim FROM ed UNION ALL SELECT b, a, sim FROM ed) ON store_id = a GROUP BY 1, 2) x LEFT JOIN st ON x.store_id = st.store_id QUALIFY rank <= 8),
t0 AS (SELECT query, unit, store_id, round({_COS.format(a='qv.e', b='uv.e')}, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY round({_COS.format(a='qv.e', b='uv.e')}, 4) DESC, unit) AS rank FROM qv, uv QUALIFY rank <= 20),
sc AS (SELECT query, store_id FROM g UNION SELECT query, store_id FROM v UNION SELECT query, store_id FROM n),
t1 AS (SELECT * FROM t0 WHERE (query, store_id) IN (SELECT query, store_id FROM sc) OR query NOT IN (SELECT query FROM sc))"""


def _fused(lists: str, texts: str | None, run: str) -> str:
    parts = [f"SELECT query, store_id, 1.0 / (60 + rank) AS s, '{flag}' AS flag FROM {name}" for name, flag in (x.split(":") for x in lists.split())]
    if texts:
        parts.append(f"SELECT query, store_id, max(score) / 61 AS s, 'text' AS flag FROM {texts} GROUP BY 1, 2")
    return f"""SELECT '{run}' AS run, query, store_id, score, flags, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, store_id) AS rank FROM (SELECT query, f.store_id, round(sum(s) + coalesce(any_value(rating), 0) / 5.0 / 61, 8) AS score, string_agg(DISTINCT flag, '|' ORDER BY flag) AS flags
FROM ({' UNION ALL '.join(parts)}) f LEFT JOIN st ON f.store_id = st.store_id GROUP BY query, f.store_id)) WHERE rank <= 5"""


_RUNS = {"graph": ("g:graph", None), "vector": ("v:vector", None), "text": ("", "t0"), "hybrid": ("g:graph n:neighbour v:vector", "t1")}


def _retrieved(t):
    units = _numbered(t, t.review_fact.filter("review_text is not null and store_id is not null").select(F.col("ingest_id").alias("unit"), "store_id"), F.col("unit"))
    stores = durable(_stores(t))
    vectors = _numbered(t, stores.select("store_id"), F.col("store_id").cast("bigint"))
    return retrieval.retrieve(durable(_questions(t)), durable(_intents(t)), stores, _categories(t), _attributes(t), vectors, units, t.embeddings, durable(_edges(t)))


_EVIDENCE = "e AS (SELECT query, store_id, list(unit ORDER BY k) AS evidence FROM (SELECT *, row_number() OVER (PARTITION BY query, store_id ORDER BY score DESC, unit) AS k FROM t1) WHERE k <= 3 GROUP BY 1, 2)"


@query(f"WITH {_HYBRID}, r AS ({_fused(*_RUNS['hybrid'], 'hybrid')}), {_EVIDENCE} SELECT r.query, r.store_id, score, flags, coalesce(evidence, []) AS evidence, rank FROM r LEFT JOIN e ON r.query = e.query AND r.store_id = e.store_id")
def hybrid_retrieve(t):
    """The five best stores of each question by graph, neighbours, vectors and texts, with their evidence."""
    return _retrieved(t)["hybrid"]


@query(f"WITH {_HYBRID} " + " UNION ALL ".join(_fused(*x, n) for n, x in _RUNS.items()))
def ablation_retrieve(t):
    """The same by each way alone and by all together."""
    runs = [d.withColumn("run", F.lit(n)) for n, d in _retrieved(t).items()]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.select("run", "query", "store_id", "score", "flags", "rank")


@query(f"""WITH {_HYBRID}, r AS ({' UNION ALL '.join(_fused(*x, n) for n, x in _RUNS.items())}), rel AS (SELECT doc_id AS query, store_id FROM documents WHERE doc_id % 100 = 0 AND text IS NOT NULL AND store_id IS NOT NULL)
SELECT run, round(avg(CASE WHEN hit IS NULL THEN 0.0 ELSE 1.0 / hit END), 6) AS mrr, count(*)::BIGINT AS questions, count(hit)::BIGINT AS found FROM (SELECT run, query, (SELECT min(rank) FROM r WHERE r.run = u.run AND r.query = rel.query AND r.store_id = rel.store_id) AS hit FROM rel, (SELECT DISTINCT run FROM r) u) GROUP BY run""")
def ablation_metrics(t):
    """How well each way finds the store that a question is about."""
    from banyan.operators.fusion import retrieval_metrics

    rel = t.documents.filter("doc_id % 100 = 0 and text is not null and store_id is not null").select(F.col("doc_id").alias("query"), F.col("store_id").alias("item"))
    out = None
    for n, d in _retrieved(t).items():
        hits = durable(d.select("query", F.col("store_id").alias("item"), "rank"))
        m = retrieval_metrics(hits, rel, 5).agg(F.round(F.avg("mrr"), 6).alias("mrr"), F.count("*").alias("questions"), F.count_if(F.col("recall") > 0).alias("found")).withColumn("run", F.lit(n))
        out = m if out is None else out.unionByName(m)
    return out.select("run", "mrr", "questions", "found")


@query(name="community_levels")
def community_levels(t):
    """Communities of stores over their similarity, level by level, by local moves that raise the modularity; a test plants communities."""
    from banyan.graph.community import levels

    return levels(_stores(t).select(F.col("store_id").alias("node")), durable(_edges(t)), weight="sim")
