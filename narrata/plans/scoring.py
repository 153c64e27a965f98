"""Similarity, clustering, matching, scoring and JSON queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from narrata.functions import jsonfix, text
from narrata.operators import score, similarity, verify

from . import lifecycle
from .registry import query, table
from .temporal import FIND_SQL, findings
from .texts import SCORE_SQL, _in

TFIDF_SQL = """docs AS (SELECT p_partkey AS k, p_brand AS brand, {col} AS t FROM part), tk AS (SELECT k, brand, unnest(regexp_extract_all(lower(t), '[a-z0-9]+')) AS token FROM docs),
tf AS (SELECT k, brand, token, count(*) AS tf FROM tk GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
raw AS (SELECT k, brand, token, tf * (ln(((SELECT count(*) FROM docs) + 1) / (df + 1)) + 1) AS raw FROM tf JOIN df USING (token)),
w AS (SELECT k, brand, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY k)) AS weight FROM raw)"""


def _parts(spark, d, col: str):
    return similarity.tfidf(table(spark, d, "part"), ["p_partkey", "p_brand"], col)


@query(f"WITH {TFIDF_SQL.format(col='p_name')} SELECT k AS p_partkey, token, round(weight, 6) AS weight FROM w")
def tfidf_weights(spark, d):
    return _parts(spark, d, "p_name").select("p_partkey", "token", F.round("weight", 6).alias("weight"))


def _classes(spark, d):
    """Parts of a brand with the same words."""
    return similarity.Classes(table(spark, d, "part"), "p_brand", "p_partkey", ["p_name", "p_type"])


def _sims(spark, d):
    """(classes, sims): parts of a brand with the same words, and similarities between these classes."""
    classes = _classes(spark, d)
    name, desc = classes.pairs("p_name").withColumnRenamed("sim", "name_sim"), classes.pairs("p_type").withColumnRenamed("sim", "desc_sim")
    zero = F.lit(0.0)
    both = name.join(desc, ["p_brand", "a", "b"], "full")
    return classes, both.select("p_brand", "a", "b", (0.6 * F.coalesce("name_sim", zero) + 0.4 * F.coalesce("desc_sim", zero)).alias("sim"))


_SIM = "WITH {n}, ns AS (SELECT x.brand, x.k AS a, y.k AS b, sum(x.weight * y.weight) AS s FROM w x JOIN w y ON x.brand = y.brand AND x.token = y.token AND x.k < y.k GROUP BY ALL)"
SIMS_SQL = f"""names AS ({_SIM.format(n=TFIDF_SQL.format(col='p_name'))} SELECT * FROM ns), descs AS ({_SIM.format(n=TFIDF_SQL.format(col='p_type'))} SELECT * FROM ns),
sims AS (SELECT brand, a, b, 0.6 * coalesce(names.s, 0) + 0.4 * coalesce(descs.s, 0) AS sim FROM names FULL JOIN descs USING (brand, a, b))"""


@query(f"WITH {SIMS_SQL} SELECT brand AS p_brand, count(*) AS pairs, round(max(sim), 6) AS best, round(avg(sim), 6) AS mean FROM sims GROUP BY brand")
def dual_similarity(spark, d):
    totals = similarity.pair_totals(_classes(spark, d).vectors(), "p_brand", [0.6, 0.4])
    return totals.select("p_brand", "pairs", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"))


@query(f"WITH {SIMS_SQL} SELECT brand AS p_brand, a, b, round(sim, 6) AS sim FROM sims WHERE sim >= 0.65 + 1e-9")
def floor_pairs(spark, d):
    """Pairs that reach the floor below which no merge is put to the provider."""
    classes, sims = _sims(spark, d)
    return classes.expanded(sims.filter(F.col("sim") >= 0.65 + 1e-9).withColumn("sim", F.round("sim", 6)))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT a.label, a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.e, b.e), 12) AS sim FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbour)::INT AS rank FROM s) SELECT label, vec_id, rank, neighbour, round(sim, 6) AS sim FROM r WHERE rank <= 5""")
def knn_edges(spark, d):
    return similarity.nearest(table(spark, d, "embeddings"), "vec_id", "label", "embedding").select("label", "vec_id", "rank", "neighbour", F.round("sim", 6).alias("sim"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("label").cast("string").alias("story"), "vec_id", "embedding")


@query()
def kmeans_clusters(spark, d):
    """Clusters of the vectors of each label: k by eigengap of their neighbour graph, then k-means."""
    return similarity.cluster(_vectors(spark, d), "story", "vec_id", "embedding").select("story", "vec_id", "k", "cluster")


@query()
def eigengap_k(spark, d):
    return similarity.cluster_numbers(_vectors(spark, d), "story", "vec_id", "embedding")


def _predicted(spark, d):
    """A rule's verdict against the labels: is a text without runs of symbols and long enough good?"""
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    bad = (F.col("n_chars") < 200) | (F.regexp_count("text", F.lit("[#*$%&|<>]")) > F.col("n_chars") / 50)
    return docs.select("lang", "source", F.col("quality").alias("gold"), F.when(bad, 0).otherwise(1).alias("pred"))


RULE_SQL = """p AS (SELECT lang, source, quality AS gold, CASE WHEN n_chars < 200 OR len(regexp_extract_all(text, '[#*$%&|<>]')) > n_chars / 50 THEN 0 ELSE 1 END AS pred FROM documents JOIN labels USING (doc_id)),
c AS (SELECT lang, source, sum(gold * pred)::BIGINT AS tp, sum((1 - gold) * pred)::BIGINT AS fp, sum(gold * (1 - pred))::BIGINT AS fn FROM p GROUP BY ALL)"""
RATES_SQL = """round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4) AS recall,
round(CASE WHEN tp = 0 THEN 0 ELSE 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) END, 4) AS f1"""


def _counts(spark, d):
    g, p = F.col("gold"), F.col("pred")
    return _predicted(spark, d).groupBy("lang", "source").agg(F.sum(g * p).alias("tp"), F.sum((1 - g) * p).alias("fp"), F.sum(g * (1 - p)).alias("fn"))


@query(f"WITH {RULE_SQL} SELECT lang, source, tp, fp, fn, {RATES_SQL} FROM c")
def prf_by_group(spark, d):
    return score.with_rates(_counts(spark, d))


@query(f"WITH {RULE_SQL}, r AS (SELECT lang, coalesce(source, 'AGGREGATE') AS source, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c GROUP BY ROLLUP (lang, source) HAVING lang IS NOT NULL) SELECT lang, source, tp, fp, fn, {RATES_SQL} FROM r")
def micro_rollup(spark, d):
    return score.rollup(_counts(spark, d), "lang", "source")


def _scored(col: str) -> str:
    return SCORE_SQL.replace("lower(text)", f"lower({col})")


_OVERLAP = """CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 WHEN least(len({a}), len({b})) = 0 THEN 0.0 ELSE greatest(
  len(list_intersect({a}, {b}))::DOUBLE / (len({a}) + len({b}) - len(list_intersect({a}, {b}))), len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b}))) END"""


@query(f"""WITH RECURSIVE {FIND_SQL}, t AS (SELECT story_id, pos, previous_scene AS x, scene_no AS y, {_scored('fact')} AS f, {_scored('event')} AS e FROM findings),
s AS (SELECT g.story_id, g.pos AS g, p.pos AS p, least({_OVERLAP.format(a='g.f', b='p.f')}, {_OVERLAP.format(a='g.e', b='p.e')}) AS score FROM t g JOIN t p ON g.story_id = p.story_id AND g.x = p.x AND g.y = p.y AND p.pos % 3 <> 0),
c AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY score DESC, g, p) AS i FROM s WHERE score >= 0.35),
r(story_id, i, gs, ps) AS (SELECT DISTINCT story_id, 0::BIGINT, []::INT[], []::INT[] FROM t
  UNION ALL SELECT r.story_id, c.i, CASE WHEN list_contains(gs, g) OR list_contains(ps, p) THEN gs ELSE list_append(gs, g) END, CASE WHEN list_contains(gs, g) OR list_contains(ps, p) THEN ps ELSE list_append(ps, p) END
  FROM r JOIN c ON c.story_id = r.story_id AND c.i = r.i + 1),
m AS (SELECT story_id, arg_max(len(gs), i) AS tp FROM r GROUP BY story_id), n AS (SELECT story_id, count(*) AS gold, count(*) FILTER (pos % 3 <> 0) AS pred FROM t GROUP BY story_id)
SELECT story_id, gold, pred, tp::BIGINT AS tp, (pred - tp)::BIGINT AS fp, (gold - tp)::BIGINT AS fn FROM n JOIN m USING (story_id)""")
def greedy_match(spark, d):
    """Rendered findings against paraphrases of them: every third is missing, the rest drop the template's ends."""
    f = findings(spark, d)
    full = text.render_finding(F.col("x"), F.col("fact"), F.col("y"), F.col("event"))
    gold = f.select("story_id", "pos", full.alias("hallucination"))
    pred = f.filter("pos % 3 <> 0").select("story_id", "pos", F.regexp_replace(F.replace(full, F.lit(" was established"), F.lit("")), " happens$", "").alias("hallucination"))
    return score.match(gold, pred)


@query(f"""WITH RECURSIVE {FIND_SQL}, f AS (SELECT story_id, previous_scene AS x, scene_no AS y, pos, fact || ' ' || event AS t FROM findings UNION ALL SELECT story_id, previous_scene, scene_no, pos + 100000, fact || ' ' || event || ' again' FROM findings),
k AS (SELECT story_id, x, y, pos, list_distinct(list_filter(regexp_extract_all(lower(t), '[a-z0-9]+'), lambda w: w NOT IN ({_in(text.DEDUPE_STOPWORDS)}))) AS t, row_number() OVER (PARTITION BY story_id, x, y ORDER BY pos) AS i FROM f),
r(story_id, x, y, i, pos, held, kept) AS (SELECT DISTINCT story_id, x, y, 0::BIGINT, 0, []::VARCHAR[][], false FROM k
  UNION ALL SELECT r.story_id, r.x, r.y, k.i, k.pos, CASE WHEN dup THEN held ELSE list_append(held, k.t) END, NOT dup FROM r JOIN k ON k.story_id = r.story_id AND k.x = r.x AND k.y = r.y AND k.i = r.i + 1,
  LATERAL (SELECT len(list_filter(held, lambda h: len(list_intersect(h, k.t)) >= 0.5 * len(list_distinct(list_concat(h, k.t))))) > 0 AS dup))
SELECT story_id, x, y, pos, kept FROM r WHERE i > 0""")
def near_dupe_fold(spark, d):
    f = findings(spark, d)
    again = f.withColumn("pos", F.col("pos") + 100000).withColumn("event", F.concat(F.col("event"), F.lit(" again")))
    return verify.near_duplicates(f.unionByName(again)).select("story_id", "x", "y", "pos", "kept")


DECISION_SQL = """e AS (SELECT user_id AS story_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS index, event_type, json_extract_string(props, '$.k')::INT AS k FROM events)"""


@query(f"""WITH {DECISION_SQL} SELECT story_id, index::INT AS index, CASE WHEN event_type = 'view' THEN 'kept' WHEN event_type = 'error' THEN 'rejected' WHEN k % 2 = 0 THEN 'confirmed' ELSE 'rejected' END AS final_decision,
CASE WHEN event_type = 'view' THEN 'missing' WHEN event_type = 'error' THEN 'reject' ELSE 'confirm' END AS model_decision FROM e""")
def decision_merge(spark, d):
    """Proposals with verifier entries: none for views, a late rejection for errors, confirms with and without an attribute."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).alias("index")
    p = table(spark, d, "events").select(F.col("user_id").alias("story_id"), n, "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    attribute = F.when(F.col("k") % 2 == 0, "colour").otherwise(" ")
    e = p.filter("event_type <> 'view'").select("story_id", "index", F.lit(1).alias("pos"), F.lit("Confirm").alias("decision"), attribute.alias("attribute"), F.lit("a").alias("prior_quote"), F.lit("b").alias("later_quote"))
    late = p.filter("event_type = 'error'").select("story_id", "index", F.lit(2).alias("pos"), F.lit("reject").alias("decision"), F.lit("").alias("attribute"), F.lit("").alias("prior_quote"), F.lit("").alias("later_quote"))
    return verify.decide(p.select("story_id", "index"), e.unionByName(late)).select("story_id", "index", "final_decision", "model_decision")


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_first_rung(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object(jsonfix.first_rung(F.col("props")), "$.k").cast("int").alias("k"))


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def json_repair(spark, d):
    """Objects that were fenced, given trailing commas or comments, or cut before their last bracket, and are whole again."""
    p, n = F.col("props"), F.col("event_id") % 5
    open_ = F.regexp_replace(p, r"\}\s*$", "")
    broken = F.when(n == 0, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(n == 1, F.concat(open_, F.lit(", }"))).when(
        n == 2, F.concat(open_, F.lit(" // a note\n}"))).when(n == 3, open_).otherwise(p)
    rows = table(spark, d, "events").select("event_id", broken.alias("raw"))
    return jsonfix.repaired(rows, "event_id", "raw").select("event_id", F.get_json_object("json", "$.k").cast("int").alias("k"))


@query("SELECT event_id, md5('v4:verify:' || event_id || ':' || event_type) AS cache_key FROM events WHERE event_id % 3 <> 0")
def cache_anti_join(spark, d):
    """Requests without a cached response; the cache is keyed by md5 and probed before anything is sent."""
    e = table(spark, d, "events")
    asked = e.select("event_id", text.cache_key(F.lit("verify"), F.col("event_id"), F.col("event_type")).alias("cache_key"))
    held = e.filter("event_id % 3 = 0").select(text.cache_key(F.lit("verify"), F.col("event_id"), F.col("event_type")).alias("cache_key"))
    return lifecycle.not_held(asked, held).select("event_id", "cache_key")
