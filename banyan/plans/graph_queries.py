"""Queries that build a graph from the store tables and ask it."""

from __future__ import annotations

from pyspark.sql import functions as F

from banyan.functions import text
from banyan.graph import build, community, query as gq
from banyan.operators.conform import first_wins
from banyan.operators.aspects import REVIEW_ASPECTS
from banyan.plans.base import query
from banyan.plans.conform_queries import _REVIEWS, _cases, _mentions
from banyan.plans.scalar_queries import norm_sql
from banyan.session import durable

SLUG = lambda c: f"regexp_replace({norm_sql(c)}, '\\s+', '_', 'g')"


def _nodes(t):
    s = first_wins(t.store_master, ["store_id"], "row_id")
    sid = lambda p, c: F.concat(F.lit(p), F.col(c))
    cat = text.slugify(F.col("primary_category"))
    fam = [
        build.nodes_of(s, sid("store:", "store_id"), "Store", F.col("canonical_name"), text.json_props("district", "status")),
        build.nodes_of(s.filter("primary_category is not null").select("primary_category").distinct(), F.concat(F.lit("category:"), cat), "Category", F.col("primary_category"), F.lit("{}")),
        build.nodes_of(s.select(F.explode(text.split_list(F.col("primary_category"))).alias("c")).distinct(), F.concat(F.lit("category:"), text.slugify(F.col("c"))), "Category", F.col("c"), F.lit("{}")),
        build.nodes_of(s.filter("ward is not null and district is not null").select("ward", "district").distinct(), F.concat(F.lit("area:"), text.slugify(F.col("ward")), F.lit(":"), text.slugify(F.col("district"))), "Area", F.col("ward"), text.json_props("district")),
        build.nodes_of(t.review_fact.groupBy("review_id").agg(F.min("sentiment").alias("sentiment")), sid("review:", "review_id"), "Review", F.col("review_id"), text.json_props("sentiment")),
        build.nodes_of(t.store_source_map.select(F.trim("source_name").alias("source_name")).distinct(), F.concat(F.lit("source:"), text.slugify(F.col("source_name"))), "DataSource", text.slugify(F.col("source_name")), F.lit("{}")),
        build.nodes_of(t.user_session_context.select("user_id").distinct(), sid("user:", "user_id"), "User", F.col("user_id"), F.lit("{}")),
        build.nodes_of(t.user_session_context.select("session_id").distinct(), F.col("session_id"), "UserSession", F.col("session_id"), F.lit("{}")),
        build.nodes_of(t.normalized_location.select("location_id").distinct(), sid("location:", "location_id"), "Location", F.col("location_id"), F.lit("{}")),
        build.nodes_of(t.region.sparkSession.createDataFrame([(a,) for a in REVIEW_ASPECTS], "aspect string"), sid("aspect:", "aspect"), "Aspect", F.col("aspect"), F.lit("{}")),
        build.nodes_of(_contexts(t).select("kind", "value").distinct(), _context_id(), "ContextTag", F.col("value"), text.json_props("kind")),
        build.nodes_of(t.user_session_context.filter("trim(desired_service) <> ''").select("desired_service").distinct(), F.concat(F.lit("service:"), text.slugify(F.col("desired_service"))), "ServiceOption", F.col("desired_service"), F.lit("{}")),
        build.nodes_of(_preferences(t), _preference_id(), "UserPreference", F.col("value"), text.json_props("kind", "weight")),
        build.nodes_of(t.source_match_quality.select("store_id", "source_name").distinct(), _quality_id(), "SourceMatchQuality", F.col("source_name"), F.lit("{}")),
        build.nodes_of(_menu(t).select("store_id", "item").distinct(), _item_id(), "MenuItem", F.col("item"), F.lit("{}")),
    ]
    return fam


def _contexts(t):
    """(session_id, kind, value): what a session asks for, with the parts of its intent."""
    u = t.user_session_context.select("session_id", "weather_context", "time_context", "intent").distinct()
    one = lambda k, c: F.transform(c, lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value")))
    tags = F.concat(one("weather", F.array("weather_context")), one("time", F.array("time_context")), one("intent", text.split_multi(F.col("intent"))))
    return u.select("session_id", F.explode(tags).alias("x")).select("session_id", "x.kind", "x.value").filter("trim(value) <> ''")


def _context_id():
    return F.concat(F.lit("context:"), F.col("kind"), F.lit(":"), text.slugify(F.col("value")))


def _preferences(t):
    """(user_id, kind, value, weight), once each: the parts of the intent weigh .85, the service .65."""
    u = t.user_session_context.select("user_id", "desired_service", "intent").distinct().filter("user_id is not null")
    one = lambda k, w, c: F.transform(c, lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value"), F.lit(w).alias("weight")))
    p = F.concat(one("intent", 0.85, text.split_multi(F.col("intent"))), one("service", 0.65, F.array("desired_service")))
    return u.select("user_id", F.explode(p).alias("x")).select("user_id", "x.kind", "x.value", "x.weight").filter("trim(value) <> ''").distinct()


def _preference_id():
    return F.concat(F.lit("preference:"), F.col("user_id"), F.lit(":"), F.col("kind"), F.lit(":"), text.slugify(F.col("value")))


def _quality_id():
    return F.concat(F.lit("match_quality:"), F.col("store_id"), F.lit(":"), text.slugify(F.col("source_name")))


def _menu(t):
    """(store_id, item, doc_id): the first dish of each line of a menu text."""
    d = t.documents.filter("source = 'menu' and store_id is not null").select("store_id", "doc_id", F.trim(F.split("text", ":")[0]).alias("item"))
    return d.filter("item <> ''")


def _item_id():
    return F.concat(F.lit("menu_item:"), F.col("store_id"), F.lit(":"), text.slugify(F.col("item")))


ASPECTS = ", ".join(f"('{a}')" for a in REVIEW_ASPECTS)
_PARTS = "unnest(list_filter(list_transform(string_split_regex(intent, '[|;]'), lambda x: trim(x)), lambda x: x <> ''))"
_N = f"""cx AS (SELECT DISTINCT session_id, kind, value FROM (SELECT session_id, 'weather' AS kind, weather_context AS value FROM user_session_context UNION ALL SELECT session_id, 'time', time_context FROM user_session_context UNION ALL SELECT session_id, 'intent', {_PARTS} FROM user_session_context) WHERE trim(value) <> ''),
pf AS (SELECT DISTINCT user_id, kind, value FROM (SELECT user_id, 'intent' AS kind, {_PARTS} AS value FROM user_session_context UNION ALL SELECT user_id, 'service', desired_service FROM user_session_context) WHERE trim(value) <> '' AND user_id IS NOT NULL),
mi AS (SELECT store_id, doc_id, trim(string_split(text, ':')[1]) AS item FROM documents WHERE source = 'menu' AND store_id IS NOT NULL AND trim(string_split(text, ':')[1]) <> ''),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY row_id) AS rn FROM store_master) WHERE rn = 1),
q AS (SELECT * FROM (SELECT DISTINCT trim(source_name) AS source_name FROM store_source_map)),
fam AS (SELECT 'store:' || store_id AS node_id, 'Store' AS label, canonical_name AS name, 0 AS f FROM s
UNION ALL SELECT DISTINCT 'category:' || {SLUG('primary_category')}, 'Category', primary_category, 1 FROM s WHERE primary_category IS NOT NULL
UNION ALL SELECT DISTINCT 'category:' || {SLUG('c')}, 'Category', c, 1 FROM (SELECT unnest(list_filter(list_transform(string_split_regex(primary_category, '[;|,/]'), lambda x: trim(x)), lambda x: x <> '')) AS c FROM s)
UNION ALL SELECT DISTINCT 'area:' || {SLUG('ward')} || ':' || {SLUG('district')}, 'Area', ward, 2 FROM s WHERE ward IS NOT NULL AND district IS NOT NULL
UNION ALL SELECT DISTINCT 'review:' || review_id, 'Review', review_id, 3 FROM review_fact WHERE review_id IS NOT NULL
UNION ALL SELECT DISTINCT 'source:' || {SLUG('source_name')}, 'DataSource', {SLUG('source_name')}, 4 FROM q WHERE source_name IS NOT NULL
UNION ALL SELECT DISTINCT 'user:' || user_id, 'User', user_id, 5 FROM user_session_context WHERE user_id IS NOT NULL
UNION ALL SELECT DISTINCT session_id, 'UserSession', session_id, 6 FROM user_session_context WHERE session_id IS NOT NULL
UNION ALL SELECT DISTINCT 'location:' || location_id, 'Location', location_id, 7 FROM normalized_location WHERE location_id IS NOT NULL
UNION ALL SELECT 'aspect:' || a, 'Aspect', a, 8 FROM (VALUES {ASPECTS}) v(a)
UNION ALL SELECT DISTINCT 'context:' || kind || ':' || {SLUG('value')}, 'ContextTag', value, 9 FROM cx
UNION ALL SELECT DISTINCT 'service:' || {SLUG('desired_service')}, 'ServiceOption', desired_service, 10 FROM user_session_context WHERE trim(desired_service) <> ''
UNION ALL SELECT DISTINCT 'preference:' || user_id || ':' || kind || ':' || {SLUG('value')}, 'UserPreference', value, 11 FROM pf
UNION ALL SELECT DISTINCT 'match_quality:' || store_id || ':' || {SLUG('source_name')}, 'SourceMatchQuality', source_name, 12 FROM source_match_quality WHERE store_id IS NOT NULL AND source_name IS NOT NULL
UNION ALL SELECT DISTINCT 'menu_item:' || store_id || ':' || {SLUG('item')}, 'MenuItem', item, 13 FROM mi),
nodes AS (SELECT node_id, label, max(name) AS name FROM fam GROUP BY node_id, label)"""


@query(f"WITH {_N} SELECT node_id, label FROM nodes")
def kg_nodes(t):
    return build.all_nodes(_nodes(t)).select("node_id", "label")


@query(f"WITH {_N} SELECT label, count(*)::BIGINT AS n FROM nodes GROUP BY label")
def kg_label_counts(t):
    return build.all_nodes(_nodes(t)).groupBy("label").agg(F.count("*").alias("n"))


def _edges(t):
    s = first_wins(t.store_master, ["store_id"], "row_id")
    store = F.concat(F.lit("store:"), F.col("store_id"))
    u = t.user_session_context.select("user_id", "session_id").distinct()
    return [
        build.edges_of(s.filter("primary_category is not null"), store, "HAS_PRIMARY_CATEGORY", F.concat(F.lit("category:"), text.slugify(F.col("primary_category")))),
        build.edges_of(s.filter("ward is not null and district is not null"), store, "LOCATED_IN", F.concat(F.lit("area:"), text.slugify(F.col("ward")), F.lit(":"), text.slugify(F.col("district")))),
        build.edges_of(t.review_fact, F.concat(F.lit("review:"), F.col("review_id")), "REVIEWS", store, text.json_props("source_name"), F.col("ingest_id")),
        build.edges_of(t.store_source_map, store, "HAS_SOURCE_RECORD", F.concat(F.lit("source:"), text.slugify(F.col("source_name"))), text.json_props("match_confidence"), F.col("map_id")),
        build.edges_of(u, F.concat(F.lit("user:"), F.col("user_id")), "HAS_SESSION", F.col("session_id")),
        build.edges_of(t.normalized_location.select("store_id", "location_id").distinct(), store, "HAS_NORMALIZED_LOCATION", F.concat(F.lit("location:"), F.col("location_id"))),
        build.edges_of(s.select("store_id", F.explode(text.split_list(F.col("primary_category"))).alias("c")), store, "HAS_CATEGORY", F.concat(F.lit("category:"), text.slugify(F.col("c")))),
        build.edges_of(_mentions(t).groupBy("store_id", "aspect_name").agg(F.count("*").alias("mentions")), store, "HAS_ASPECT_SENTIMENT", F.concat(F.lit("aspect:"), F.col("aspect_name")), text.json_props("mentions")),
        build.edges_of(_contexts(t), F.col("session_id"), "REQUESTS_CONTEXT", _context_id()),
        build.edges_of(_preferences(t), F.concat(F.lit("user:"), F.col("user_id")), "HAS_PREFERENCE", _preference_id(), text.json_props("weight")),
        build.edges_of(t.source_match_quality.select("store_id", "source_name").distinct(), store, "HAS_SOURCE_MATCH_QUALITY", _quality_id()),
        build.edges_of(_menu(t), store, "SELLS_MENU_ITEM", _item_id(), text.json_props("doc_id"), F.col("doc_id")),
    ]


_E = f"""{_REVIEWS}, m AS ({_cases(REVIEW_ASPECTS)}), e AS (SELECT 'store:' || store_id AS source_id, 'HAS_PRIMARY_CATEGORY' AS relation, 'category:' || {SLUG('primary_category')} AS target_id FROM s WHERE primary_category IS NOT NULL
UNION ALL SELECT 'store:' || store_id, 'LOCATED_IN', 'area:' || {SLUG('ward')} || ':' || {SLUG('district')} FROM s WHERE ward IS NOT NULL AND district IS NOT NULL
UNION ALL SELECT 'review:' || review_id, 'REVIEWS', 'store:' || store_id FROM review_fact WHERE review_id IS NOT NULL AND store_id IS NOT NULL
UNION ALL SELECT 'store:' || store_id, 'HAS_SOURCE_RECORD', 'source:' || {SLUG('source_name')} FROM store_source_map WHERE source_name IS NOT NULL
UNION ALL SELECT DISTINCT 'user:' || user_id, 'HAS_SESSION', session_id FROM user_session_context WHERE user_id IS NOT NULL AND session_id IS NOT NULL
UNION ALL SELECT DISTINCT 'store:' || store_id, 'HAS_NORMALIZED_LOCATION', 'location:' || location_id FROM normalized_location WHERE store_id IS NOT NULL AND location_id IS NOT NULL
UNION ALL SELECT 'store:' || store_id, 'HAS_CATEGORY', 'category:' || {SLUG('c')} FROM (SELECT store_id, unnest(list_filter(list_transform(string_split_regex(primary_category, '[;|,/]'), lambda x: trim(x)), lambda x: x <> '')) AS c FROM s)
UNION ALL SELECT DISTINCT 'store:' || store_id, 'HAS_ASPECT_SENTIMENT', 'aspect:' || aspect_name FROM m WHERE store_id IS NOT NULL
UNION ALL SELECT session_id, 'REQUESTS_CONTEXT', 'context:' || kind || ':' || {SLUG('value')} FROM cx WHERE session_id IS NOT NULL
UNION ALL SELECT 'user:' || user_id, 'HAS_PREFERENCE', 'preference:' || user_id || ':' || kind || ':' || {SLUG('value')} FROM pf
UNION ALL SELECT DISTINCT 'store:' || store_id, 'HAS_SOURCE_MATCH_QUALITY', 'match_quality:' || store_id || ':' || {SLUG('source_name')} FROM source_match_quality WHERE store_id IS NOT NULL AND source_name IS NOT NULL
UNION ALL SELECT 'store:' || store_id, 'SELLS_MENU_ITEM', 'menu_item:' || store_id || ':' || {SLUG('item')} FROM mi)"""
_LIVE = f"{_N}, {_E}, live AS (SELECT DISTINCT source_id, relation, target_id FROM e WHERE source_id IN (SELECT node_id FROM nodes) AND target_id IN (SELECT node_id FROM nodes))"


@query(f"WITH {_LIVE} SELECT * FROM live")
def kg_edges(t):
    """Edges both of whose ends exist, once each."""
    return build.connected(build.all_edges(_edges(t)), durable(build.all_nodes(_nodes(t)).select("node_id"))).select("source_id", "relation", "target_id")


@query("""WITH e AS (SELECT 'review:' || review_id AS source_id, 'store:' || store_id AS target_id, ingest_id, json_object('source_name', source_name)::VARCHAR AS properties, (batch_no > 0)::INT AS gen FROM review_fact WHERE review_id IS NOT NULL AND store_id IS NOT NULL)
SELECT source_id, 'REVIEWS' AS relation, target_id, arg_max(properties, (gen, CASE WHEN gen = 1 THEN ingest_id ELSE -1 END, properties)) AS properties FROM e WHERE target_id IN (SELECT 'store:' || store_id FROM store_master) GROUP BY ALL""")
def edge_upsert(t):
    """The reviews of later batches written over the stored edges of the first; the last properties hold."""
    r = t.review_fact
    of = lambda d: build.edges_of(d, F.concat(F.lit("review:"), F.col("review_id")), "REVIEWS", F.concat(F.lit("store:"), F.col("store_id")), text.json_props("source_name"), F.col("ingest_id"))
    nodes = build.all_nodes([n for i, n in enumerate(_nodes(t)) if i in (0, 4)])
    first = of(r.filter("batch_no = 0")).groupBy("source_id", "relation", "target_id").agg(F.max("properties").alias("properties"))
    return build.upsert_edges(first, of(r.filter("batch_no > 0")), nodes)


@query(f"WITH {_N}, {_E} SELECT source_id AS subject, relation AS predicate, target_id AS object FROM e")
def kg_triples(t):
    return build.triples(build.all_edges(_edges(t))).drop("properties")


@query(f"WITH {_N}, {_E} SELECT relation, count(*)::BIGINT AS edges, count(DISTINCT target_id)::BIGINT AS targets FROM e GROUP BY relation")
def kg_relation_histogram(t):
    return build.all_edges(_edges(t)).groupBy("relation").agg(F.count("*").alias("edges"), F.countDistinct("target_id").alias("targets"))


@query(f"WITH {_LIVE} SELECT (SELECT count(*) FROM nodes)::BIGINT AS nodes, (SELECT count(*) FROM live)::BIGINT AS edges, (SELECT count(*) FROM e WHERE target_id NOT IN (SELECT node_id FROM nodes))::BIGINT AS dangling")
def kg_validate(t):
    """Two scalar counts and the edges that dangle; no product of nodes and edges."""
    n, e = durable(build.all_nodes(_nodes(t)).select("node_id")), durable(build.all_edges(_edges(t)))
    gone = e.join(n.select(F.col("node_id").alias("target_id")), "target_id", "left_anti")
    one = lambda d, c: d.agg(F.count("*").alias(c))
    return one(n, "nodes").crossJoin(one(build.connected(e, n), "edges")).crossJoin(one(gone, "dangling"))  # one row each


@query(f"WITH {_LIVE} SELECT target_id AS store, count(*)::BIGINT AS n FROM live WHERE relation = 'REVIEWS' GROUP BY target_id ORDER BY n DESC, store LIMIT 20")
def kg_top_stores(t):
    e = build.connected(_edges(t)[2], build.all_nodes([n for i, n in enumerate(_nodes(t)) if i in (0, 4)]))
    return e.groupBy(F.col("target_id").alias("store")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "store").limit(20)


@query("SELECT s_suppkey AS store, count(*)::BIGINT AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_suppkey ORDER BY n DESC, store LIMIT 20")
def top_edges_star_schema(t):
    e = t.lineitem.select("l_suppkey").join(t.supplier.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    return e.groupBy(F.col("l_suppkey").alias("store")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "store").limit(20)


@query("""SELECT DISTINCT o_custkey AS user_key, l_suppkey AS store_key FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def user_store_edges(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("user_key"), F.col("l_suppkey").alias("store_key")).distinct()


@query("""SELECT l_suppkey AS store_key, p_type AS category, count(*)::BIGINT AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def store_category_edges(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_suppkey").alias("store_key"), F.col("p_type").alias("category")).agg(F.count("*").alias("n"))


_S1 = "s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY row_id) AS rn FROM store_master) WHERE rn = 1)"


@query(f"""WITH {_S1} SELECT store_id, canonical_name, be_rating_avg FROM s WHERE contains(lower(district), 'trà') AND coalesce(be_rating_avg, 0) >= 2.5
AND store_id IN (SELECT store_id FROM review_fact WHERE sentiment = 'positive') AND store_id IN (SELECT store_id FROM store_source_map WHERE lower(trim(source_name)) LIKE '%foody%')
ORDER BY be_rating_avg DESC NULLS LAST, store_id LIMIT 25""")
def pattern_filter(t):
    """A pattern with constraints on the node and on two kinds of edges."""
    s = first_wins(t.store_master, ["store_id"], "row_id").filter(F.lower("district").contains("trà") & (F.coalesce("be_rating_avg", F.lit(0.0)) >= 2.5))
    s = gq.having(s, "store_id", t.review_fact, F.col("sentiment") == "positive")
    s = gq.having(s, "store_id", t.store_source_map, F.lower(F.trim("source_name")).like("%foody%"))
    return gq.top(s.select("store_id", "canonical_name", "be_rating_avg"), "be_rating_avg", "store_id", 25)


@query(f"""WITH {_S1}, r AS (SELECT store_id, count(*)::BIGINT AS reviews FROM review_fact GROUP BY 1), m AS (SELECT store_id, list_sort(list(DISTINCT lower(trim(source_name)))) AS sources FROM store_source_map GROUP BY 1),
x AS (SELECT store_id, list(ingest_id ORDER BY rating_5 DESC NULLS LAST, ingest_id) AS best FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY rating_5 DESC NULLS LAST, ingest_id) AS k FROM review_fact WHERE review_text IS NOT NULL) WHERE k <= 3 GROUP BY 1)
SELECT s.store_id, s.canonical_name, r.reviews, m.sources, x.best FROM s LEFT JOIN r USING (store_id) LEFT JOIN m USING (store_id) LEFT JOIN x USING (store_id)""")
def subgraph_star(t):
    """Each store with its reviews, sources and three best texts; branches are aggregated before the joins."""
    s = first_wins(t.store_master, ["store_id"], "row_id").select("store_id", "canonical_name")
    r = t.review_fact
    best = gq.first_n(r.filter("review_text is not null").select("store_id", "rating_5", "ingest_id"), "store_id", 3, F.desc_nulls_last("rating_5"), F.asc("ingest_id"))
    best = best.groupBy("store_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "ingest_id"))), lambda x: x["ingest_id"]).alias("best"))
    m = t.store_source_map.select("store_id", F.lower(F.trim("source_name")).alias("sources"))
    return gq.star(s, "store_id", [r.groupBy("store_id").agg(F.count("*").alias("reviews")), gq.distinct_list(m, "store_id", "sources"), best])


_NATION = "SELECT least(c_nationkey, s_nationkey) AS a, greatest(c_nationkey, s_nationkey) AS b, count(*)::DOUBLE AS weight FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2"


def _nation_edges(t):
    j = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).filter("c_nationkey <> s_nationkey")
    return j.groupBy(F.least("c_nationkey", "s_nationkey").alias("a"), F.greatest("c_nationkey", "s_nationkey").alias("b")).agg(F.count("*").cast("double").alias("weight"))


@query(f"""WITH e AS ({_NATION}), u AS (SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e) SELECT b AS node, max(weight) AS weight FROM u WHERE a IN (0, 7, 12) GROUP BY b ORDER BY weight DESC, node LIMIT 8""")
def neighbors_expand(t):
    """The strongest neighbours of three seeds over undirected edges."""
    e = _nation_edges(t)
    return gq.neighbours(t.nation.filter("n_nationkey in (0, 7, 12)").select("n_nationkey"), e, "weight", 8)


_CC = """WITH RECURSIVE e AS (SELECT DISTINCT ward AS a, district AS b FROM store_master WHERE ward IS NOT NULL AND district IS NOT NULL),
u AS (SELECT 'w:' || a AS a, 'd:' || b AS b FROM e UNION SELECT 'd:' || b, 'w:' || a FROM e),
c(node, reach) AS (SELECT a, a FROM u UNION SELECT c.node, u.b FROM c JOIN u ON c.reach = u.a)
SELECT node, min(reach) AS component FROM c GROUP BY node"""


@query(_CC)
def community_components(t):
    """Components of the graph of wards and districts."""
    e = t.store_master.filter("ward is not null and district is not null").select(F.concat(F.lit("w:"), "ward").alias("a"), F.concat(F.lit("d:"), "district").alias("b")).distinct()
    n = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    return community.components(n, e)


def _rounds(k: int) -> str:
    out = [f"e AS ({_NATION})", "u AS (SELECT a, b, weight FROM e UNION ALL SELECT b, a, weight FROM e)", "l0 AS (SELECT n_nationkey AS node, n_nationkey AS community FROM nation)"]
    for i in range(k):
        out.append(f"v{i} AS (SELECT u.a AS node, l.community, round(sum(weight), 6) AS w FROM u JOIN l{i} l ON u.b = l.node GROUP BY 1, 2)")
        out.append(f"l{i + 1} AS (SELECT l.node, coalesce(x.community, l.community) AS community FROM l{i} l LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, community) AS k FROM v{i}) WHERE k = 1) x ON l.node = x.node)")
    return "WITH " + ", ".join(out)


@query(f"{_rounds(3)} SELECT node, community FROM l3")
def community_labelprop(t):
    return community.label_propagation(t.nation.select(F.col("n_nationkey").alias("node")), _nation_edges(t), 3)


@query(f"{_rounds(3)} SELECT community, count(*)::BIGINT AS size FROM l3 GROUP BY community")
def community_size(t):
    return community.sizes(community.label_propagation(t.nation.select(F.col("n_nationkey").alias("node")), _nation_edges(t), 3))


_CC_ALL = _CC[: _CC.index("SELECT node, min(reach)")] + ", k AS (SELECT node, min(reach) AS component FROM c GROUP BY node)"


@query(
    f"""{_CC_ALL}, s AS (SELECT district, count(DISTINCT store_id)::BIGINT AS stores, round(avg(be_rating_avg), 4) AS rating FROM store_master GROUP BY district)
SELECT component, count(*)::BIGINT AS districts, sum(stores)::BIGINT AS stores, round(max(rating), 4) AS best FROM k JOIN s ON k.node = 'd:' || s.district GROUP BY component"""
)
def community_context(t):
    """What the stores of each component add up to."""
    k = community_components(t)
    s = t.store_master.groupBy("district").agg(F.countDistinct("store_id").alias("stores"), F.round(F.avg("be_rating_avg"), 4).alias("rating")).withColumn("node", F.concat(F.lit("d:"), "district"))
    return k.join(s, "node").groupBy("component").agg(F.count("*").alias("districts"), F.sum("stores").alias("stores"), F.round(F.max("rating"), 4).alias("best"))


@query(
    f"""{_CC_ALL}, r AS (SELECT store_id, max(be_rating_avg) AS rating, min(district) AS district FROM store_master WHERE store_id IS NOT NULL GROUP BY 1),
w AS (SELECT component, store_id, row_number() OVER (PARTITION BY component ORDER BY rating DESC NULLS LAST, store_id) AS rank FROM k JOIN r ON k.node = 'd:' || r.district QUALIFY rank <= 30),
x AS (SELECT store_id, ingest_id, review_text, row_number() OVER (PARTITION BY store_id ORDER BY rating_5 DESC NULLS LAST, ingest_id) AS n FROM review_fact WHERE review_text IS NOT NULL QUALIFY n <= 2)
SELECT component, w.store_id, rank, n, review_text AS line FROM w LEFT JOIN x ON w.store_id = x.store_id"""
)
def community_texts(t):
    """The thirty best stores of each component with two texts each: what a report is written from."""
    s = t.store_master.filter("store_id is not null").groupBy("store_id").agg(F.max("be_rating_avg").alias("rating"), F.min("district").alias("district")).withColumn("node", F.concat(F.lit("d:"), "district"))
    w = gq.first_n(s.join(community_components(t), "node").select("component", "store_id", "rating"), "component", 30, F.desc_nulls_last("rating"), F.asc("store_id"))
    x = gq.first_n(t.review_fact.filter("review_text is not null").select("store_id", "rating_5", "ingest_id", "review_text"), "store_id", 2, F.desc_nulls_last("rating_5"), F.asc("ingest_id"))
    return w.join(x.select("store_id", F.col("rank").alias("n"), F.col("review_text").alias("line")), "store_id", "left").select("component", "store_id", "rank", "n", "line")
