"""Queries of rules, decisions and retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import profiles, retrieval, rules
from ..sources.adapters import adapted, oracle_with, read


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct item names with their brand, so that rules' bodies take part."""
    return adapted(spark, sf, "items").select(F.concat_ws(" ", "item_name", "brand").alias("item_name"), "category_code").distinct()


def a21_token_df(spark: SparkSession, sf: str) -> DataFrame:
    return rules.document_frequency(rules.rule_tokens(adapted(spark, sf, "rules")))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    scores = rules.category_scores(_names(spark, sf).select("item_name"), adapted(spark, sf, "rules"), adapted(spark, sf, "profiles"))
    return scores.withColumn("score", F.round("score", 6))


def a22_category_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("item_name", "category_code", "score", F.array_join("evidence", ";").alias("evidence"))


def f60_profile_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = profiles.profile_scores(_names(spark, sf).select("item_name"), adapted(spark, sf, "profiles"))
    return out.select("item_name", "category_code", "score", F.array_join("evidence", ";").alias("evidence"))


def f59_scores_in_context(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of names with a retrieved context: the body of the first rule of their category, by id."""
    table = adapted(spark, sf, "rules")
    context = table.filter("category_code IS NOT NULL").groupBy("category_code").agg(F.min_by("body", "rule_id").alias("context"))
    names = _names(spark, sf).groupBy("item_name").agg(F.min("category_code").alias("category_code")).join(context, "category_code", "left").select("item_name", "context")
    return rules.category_scores(names, table).select("item_name", "category_code", F.round("score", 6).alias("score"))


def d4_profile_hits(spark: SparkSession, sf: str) -> DataFrame:
    out = profiles.profile_hits(_names(spark, sf), adapted(spark, sf, "profiles"))
    return out.select("item_name", "category_code", F.array_join("allow", ";").alias("allow"), F.array_join("disallow", ";").alias("disallow"))


def w7_score_margin(spark: SparkSession, sf: str) -> DataFrame:
    out = rules.score_stats(rules.top_categories(_scores(spark, sf)))
    return out.select("item_name", "category_code", "top", "second", F.round("margin", 4).alias("margin"))


def _matches(spark: SparkSession, sf: str) -> DataFrame:
    out = rules.validator_matches(_names(spark, sf), adapted(spark, sf, "rules"), profiles=adapted(spark, sf, "profiles"))
    return out.withColumn("score", F.round("score", 6))


def o4_validator_matches(spark: SparkSession, sf: str) -> DataFrame:
    return _matches(spark, sf).select("item_name", "category_code", "rule_id", "rule_type", "tier", "score")


def d14_verdict(spark: SparkSession, sf: str) -> DataFrame:
    out = rules.verdict(_matches(spark, sf))
    return out.select("item_name", "category_code", "allow_score", "forbid_score", "n_matches", "confidence", "allowed", "review")


def d3_route(spark: SparkSession, sf: str) -> DataFrame:
    return rules.routed(_matches(spark, sf), adapted(spark, sf, "rules")).select("item_name", "category_code", "route", "rule_id", "rule_type", "score")


def d1_category_decision(spark: SparkSession, sf: str) -> DataFrame:
    scores = _scores(spark, sf)
    stats = rules.score_stats(rules.top_categories(scores))
    given = _names(spark, sf).withColumnRenamed("category_code", "given_code")
    own = scores.select("item_name", F.col("category_code").alias("given_code"), F.col("score").alias("given_score"))
    # A name's chunks are those of the query with its least part number.
    asked = read(spark, sf, "part").groupBy(F.concat_ws(" ", "p_name", "p_brand").alias("item_name")).agg((F.min("p_partkey") % 100).alias("query_id"))
    votes = rules.category_votes(_chunks(spark, sf)).withColumn("votes", F.round("votes", 9)).groupBy("query_id")
    votes = votes.agg(F.min_by("category_code", F.struct(-F.col("votes"), "category_code")).alias("vote_code"), F.round(F.max("votes") / F.sum("votes"), 6).alias("vote_share"))
    rows = given.join(stats, "item_name", "left").join(own, ["item_name", "given_code"], "left").join(asked.join(votes, "query_id").drop("query_id"), "item_name", "left").na.fill({"given_score": 0.0})
    return rules.decided(rows).select("item_name", "given_code", "path", "predicted", "status")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    cite = F.concat(F.lit("제7조제1항제"), (F.col("doc_id") % 12).cast("string"), F.lit("호 [x] 제7조제1항제"), (F.col("n_chars") % 9).cast("string"), F.lit("호"))
    return read(spark, sf, "documents").select((F.col("doc_id") % 100).alias("query_id"), F.floor(F.col("doc_id") / 100).alias("rank"), cite.alias("text"))


def a23_category_votes(spark: SparkSession, sf: str) -> DataFrame:
    return rules.category_votes(_chunks(spark, sf)).select("query_id", "category_code", F.round("votes", 9).alias("votes"))


def r2_bm25(spark: SparkSession, sf: str) -> DataFrame:
    corpus = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    queries = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return retrieval.bm25(corpus, queries, 10).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


def r3_cosine(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    found = retrieval.cosine_topk(rows, rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector"), 5, 0.1)
    return found.select("query_id", "rank", "id", F.round("score", 6).alias("score"))


def r4_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items, by their text against all documents and by the vector of the same number against all vectors."""
    rows, items = _vectors(spark, sf), read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    by_words = retrieval.bm25(read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), items, 10)
    queries = rows.select(F.col("id").alias("query_id"), "vector").join(items.select("query_id").distinct(), "query_id", "left_semi")
    return retrieval.fused(by_words, retrieval.cosine_topk(rows, queries, 10)).select("query_id", "id", F.round("score", 9).alias("score"))


def _others(found: DataFrame, k: int) -> DataFrame:
    """The k best but for the query itself, of k + 1."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return found.filter("id <> query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def r10_fallback(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    queries = rows.filter("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    first = _others(retrieval.cosine_topk(rows, queries, 4, 0.45), 3).select("query_id", "rank", "id")
    out = retrieval.with_fallback(first, queries, lambda q: _others(retrieval.cosine_topk(rows, q, 2), 1).select("query_id", "rank", "id"))
    return out


def r6_sections(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.sections(docs, "^(The|Die|La|Le|Of) ")


def u6_distinct_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.distinct_chunks(read(spark, sf, "documents").select("source", F.col("doc_id").alias("id"), "text")).select("source", "id", "copies")


QUERIES = {
    "a21_token_df": a21_token_df, "a22_category_scores": a22_category_scores, "w7_score_margin": w7_score_margin, "f60_profile_scores": f60_profile_scores, "f59_scores_in_context": f59_scores_in_context, "d4_profile_hits": d4_profile_hits, "d3_item_route": d3_route, "o4_validator_matches": o4_validator_matches, "d14_item_verdict": d14_verdict,
    "d1_category_decision": d1_category_decision, "a23_category_votes": a23_category_votes, "r2_bm25": r2_bm25, "r3_cosine_topk": r3_cosine, "r4_rank_fusion": r4_fusion, "r10_fallback_query": r10_fallback,
    "r6_sections": r6_sections, "u6_distinct_chunks": u6_distinct_chunks,
}

_RULES = f"""{oracle_with('items', 'rules')},
names AS (SELECT DISTINCT item_name || ' ' || brand AS item_name, category_code FROM items),
rt AS (SELECT *, list_distinct(regexp_extract_all(lower(keyword || ' ' || body), '[0-9a-z가-힣]{{2,}}')) AS toks FROM rules),
nt AS (SELECT DISTINCT item_name, list_distinct(regexp_extract_all(lower(item_name), '[0-9a-z가-힣]{{2,}}')) AS toks FROM names)"""
_POINTS = """pt0 AS (SELECT DISTINCT category_code, kind, lower(term) AS term, lower(other) AS other FROM profiles),
pn AS (SELECT DISTINCT item_name, trim(regexp_replace(regexp_replace(lower(item_name), '[^0-9a-z가-힣\\s]+', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM names),
ph AS (SELECT item_name, category_code, kind, term, CASE kind WHEN 'pair' THEN 8.0 WHEN 'strong' THEN 5.0 WHEN 'medium' THEN 2.5 ELSE -2.5 END::DOUBLE AS points,
  CASE kind WHEN 'pair' THEN 0 WHEN 'strong' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS place, kind || ' ' || term || coalesce('+' || other, '') AS label
  FROM pn JOIN pt0 ON contains(plain, term) AND (other IS NULL OR contains(plain, other)) WHERE kind IN ('pair', 'strong', 'medium', 'negative')),
pe AS (SELECT item_name, category_code, place, term, label FROM ph WHERE place < 3 UNION ALL SELECT item_name, category_code, 3, '', 'negative ' || string_agg(DISTINCT term, ', ' ORDER BY term) FROM ph WHERE place = 3 GROUP BY item_name, category_code),
px AS (SELECT item_name, category_code, list(label ORDER BY place, term, label)[1:5] AS evidence FROM pe GROUP BY item_name, category_code),
ps0 AS (SELECT item_name, category_code, sum(points) AS score, any_value(evidence) AS evidence FROM ph JOIN px USING (item_name, category_code) GROUP BY item_name, category_code HAVING sum(points) > 0)"""
_RULE_SCORES = """ct AS (SELECT rule_id, category_code, rule_type, keyword, unnest(toks) AS token FROM rt WHERE category_code IS NOT NULL AND rule_type IN ('category', 'allowed', 'qa_allowed', 'limit', 'qa_limit')),
df AS (SELECT token, count(*) AS df FROM ct GROUP BY token), nn AS (SELECT count(DISTINCT rule_id) AS n FROM ct),
rs AS (SELECT item_name, category_code, rule_id, any_value(keyword) AS keyword, sum(CASE rule_type WHEN 'category' THEN 1.8 WHEN 'allowed' THEN 1.4 WHEN 'qa_allowed' THEN 1.1 WHEN 'limit' THEN 0.8 ELSE 0.7 END::DOUBLE
  * (1.0::DOUBLE + ln((1 + n) / (1 + df.df))) * least(length(token) / 4.0::DOUBLE, 2.0::DOUBLE)) AS score FROM (SELECT item_name, unnest(toks) AS token FROM nt) JOIN ct USING (token) JOIN df USING (token), nn GROUP BY item_name, category_code, rule_id)"""
_SCORES = f"""{_RULES},
{oracle_with('profiles')},
{_POINTS},
{_RULE_SCORES},
cs AS (SELECT item_name, category_code, sum(score) AS score, list(DISTINCT {{'k': rule_id, 'v': keyword}} ORDER BY {{'k': rule_id, 'v': keyword}}) AS kw FROM rs GROUP BY item_name, category_code),
scores AS (SELECT item_name, category_code, round(coalesce(c.score, 0) + coalesce(p.score, 0), 6) AS score,
  list_concat(coalesce(p.evidence, []), coalesce(list_filter(list_transform(kw, lambda e: e.v), lambda v, i: list_position(list_transform(kw, lambda e: e.v), v) = i), [])) AS evidence
  FROM cs c FULL JOIN ps0 p USING (item_name, category_code))"""
_STATS = f"""{_SCORES},
rk AS (SELECT *, row_number() OVER (PARTITION BY item_name ORDER BY score DESC, category_code) AS r FROM scores WHERE score > 0),
stats AS (SELECT item_name, max(category_code) FILTER (WHERE r = 1) AS category_code, max(score) FILTER (WHERE r = 1) AS top, coalesce(max(score) FILTER (WHERE r = 2), 0) AS second FROM rk WHERE r <= 5 GROUP BY item_name)"""
_MATCHES = f"""{_RULES},
pr AS (SELECT n.item_name, n.category_code, rt.rule_id, rt.rule_type, rt.category_code AS rc, list_intersect(nt.toks, rt.toks) AS w FROM names n JOIN nt USING (item_name), rt WHERE len(list_intersect(nt.toks, rt.toks)) > 0),
ps AS (SELECT *, rc IS NULL AND rule_type IN ('disallowed', 'qa_disallowed') AS policy,
  (CASE rule_type WHEN 'disallowed' THEN 3.0 WHEN 'allowed' THEN 2.5 WHEN 'limit' THEN 2.0 WHEN 'category' THEN 2.0 WHEN 'qa_disallowed' THEN 2.2 WHEN 'qa_allowed' THEN 1.8 WHEN 'qa_limit' THEN 1.6 WHEN 'rule_like_disallowed' THEN 0.9 ELSE 0.8 END::DOUBLE * len(w)
   + list_sum(list_transform(w, lambda t: least(length(t) / 3.0::DOUBLE, 2.5::DOUBLE)))) * CASE WHEN rc = category_code THEN 1.2 WHEN rc IS NULL THEN 0.7 ELSE 1.0 END::DOUBLE AS s FROM pr),
pt AS (SELECT item_name, category_code, rule_id, rule_type, round(CASE WHEN policy THEN s * 0.5 ELSE s END, 6) AS score,
  CASE WHEN policy THEN 9 WHEN rule_type IN ('allowed', 'disallowed', 'limit', 'category') THEN 1 WHEN rule_type LIKE 'qa%' THEN 2 ELSE 3 END AS tier FROM ps WHERE policy OR rc = category_code),
pl AS (SELECT *, row_number() OVER (PARTITION BY item_name, category_code, tier ORDER BY score DESC, rule_id) AS place FROM pt),
pc AS (SELECT *, count_if(tier = 1) OVER (PARTITION BY item_name, category_code) AS one, count_if(tier = 2) OVER (PARTITION BY item_name, category_code) AS two FROM pl WHERE place <= 8),
pu AS (SELECT *, row_number() OVER (PARTITION BY item_name, category_code ORDER BY score DESC, tier, rule_id) AS r FROM pc WHERE tier = 1 OR (tier = 2 AND one < 3 AND place <= 8 - one)
  OR (tier = 3 AND one = 0 AND CASE WHEN one < 3 THEN least(two, 8 - one) ELSE 0 END < 2 AND place <= 2) OR (tier = 9 AND place <= 2)),
{oracle_with('profiles')},
pn AS (SELECT DISTINCT item_name, category_code, trim(regexp_replace(regexp_replace(lower(item_name), '[^0-9a-z가-힣\\s]+', '', 'g'), '\\s+', ' ', 'g')) AS plain FROM names),
hits AS (SELECT item_name, category_code, list(DISTINCT lower(term) ORDER BY lower(term)) FILTER (WHERE kind = 'allow') AS allow, list(DISTINCT lower(term) ORDER BY lower(term)) FILTER (WHERE kind = 'disallow') AS disallow
  FROM pn JOIN profiles USING (category_code) WHERE kind IN ('allow', 'disallow') AND contains(plain, lower(term)) GROUP BY item_name, category_code),
tops AS (SELECT item_name, category_code, first(score ORDER BY tier, score DESC, rule_id) AS top FROM pu GROUP BY item_name, category_code),
hx AS (SELECT item_name, category_code, coalesce(len(allow), 0) AS na, coalesce(len(disallow), 0) AS nd, coalesce(top, 0) AS top FROM hits LEFT JOIN tops USING (item_name, category_code)),
pm AS (SELECT item_name, category_code, rule_id, rule_type, tier, score, 0 AS place FROM pu
  UNION ALL SELECT item_name, category_code, NULL, 'profile_disallowed', 10, 4.5::DOUBLE + nd, 0 FROM hx WHERE nd > 0
  UNION ALL SELECT item_name, category_code, NULL, 'profile_allowed', 10, 4.0::DOUBLE + na, 1 FROM hx WHERE nd = 0 AND na > 0 AND top < 3
  UNION ALL SELECT item_name, category_code, NULL, 'profile_allowed', 10, 4.0::DOUBLE, 2 FROM hx WHERE nd = 0 AND na > 0 AND category_code = 'CAT_01'),
matches AS (SELECT *, row_number() OVER (PARTITION BY item_name, category_code ORDER BY score DESC, tier, place, rule_id) AS rank FROM pm QUALIFY rank <= 8)"""
_VOTES = """ch AS (SELECT doc_id % 100 AS query_id, doc_id // 100 AS rank, unnest(list_distinct([doc_id % 12, n_chars % 9])) AS no FROM documents),
votes AS (SELECT query_id, 'CAT_0' || no AS category_code, round(sum(1.0::DOUBLE / (rank + 1)), 9) AS votes FROM ch WHERE no BETWEEN 1 AND 9 GROUP BY 1, 2)"""
_BM25 = """WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[0-9a-z가-힣]{2,}') AS w FROM documents), q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[0-9a-z가-힣]{2,}')) AS term FROM benchmark),
t AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM d), p AS (SELECT id, term, dl, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY id, term, dl), f AS (SELECT term, count(*) AS df FROM p GROUP BY term), n AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM d),
s AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score FROM q JOIN p USING (term) JOIN f USING (term), n GROUP BY query_id, id)
"""
_UNIT = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT id AS query_id, e AS qe FROM v WHERE id % 20 = 0),
s AS (SELECT query_id, id, list_dot_product(qe, e) / sqrt(list_dot_product(qe, qe) * list_dot_product(e, e)) AS score FROM q, v)"""

ORACLES = {
    "a21_token_df": f"WITH {_RULES} SELECT token, count(*) AS df FROM (SELECT unnest(toks) AS token FROM rt) GROUP BY token",
    "a22_category_scores": f"WITH {_SCORES} SELECT item_name, category_code, score, array_to_string(evidence, ';') AS evidence FROM scores",
    "f60_profile_scores": f"WITH {_SCORES} SELECT item_name, category_code, score, array_to_string(evidence, ';') AS evidence FROM ps0",
    "f59_scores_in_context": f"""WITH {_RULES}, {_RULE_SCORES},
cx AS (SELECT category_code, arg_min(body, rule_id) AS context FROM rules WHERE category_code IS NOT NULL GROUP BY category_code),
nx AS (SELECT item_name, list_distinct(regexp_extract_all(lower(coalesce(context, '')), '[0-9a-z가-힣]{{2,}}')) AS ctoks FROM (SELECT item_name, min(category_code) AS category_code FROM names GROUP BY item_name) LEFT JOIN cx USING (category_code)),
be AS (SELECT rs.item_name, rs.category_code, rs.rule_id, rs.score, len(list_filter(rt.toks, lambda t: list_contains(nx.ctoks, t) AND NOT list_contains(nt.toks, t))) AS beside FROM rs JOIN rt USING (rule_id) JOIN nt USING (item_name) JOIN nx USING (item_name))
SELECT item_name, category_code, round(sum(score + 0.15::DOUBLE * least(beside, 3)), 6) AS score FROM be GROUP BY item_name, category_code""",
    "d4_profile_hits": f"WITH {_MATCHES} SELECT item_name, category_code, coalesce(array_to_string(allow, ';'), '') AS allow, coalesce(array_to_string(disallow, ';'), '') AS disallow FROM hits",
    "d3_item_route": f"""WITH {_MATCHES}, m AS (SELECT *, contains(rule_type, 'disallowed') AS bad, rule_type IN ('allowed', 'qa_allowed', 'category', 'rule_like_allowed', 'profile_allowed') AS good FROM matches),
g AS (SELECT item_name, category_code, min({{'r': rank, 'i': rule_id, 't': rule_type, 's': score}}) FILTER (WHERE rule_type = 'profile_allowed') AS p, min({{'r': rank, 'i': rule_id, 't': rule_type, 's': score}}) FILTER (WHERE bad) AS a,
  min({{'r': rank, 'i': rule_id, 't': rule_type, 's': score}}) FILTER (WHERE bad AND score >= 1.5 AND tier <> 3) AS f, min({{'r': rank, 'i': rule_id, 't': rule_type, 's': score}}) FILTER (WHERE good AND (tier IN (1, 2, 9) AND score >= 3.5 OR tier = 10 AND score >= 4)) AS ok,
  coalesce(bool_or(rule_type = 'qa_disallowed' AND score >= 1.5) AND bool_or(rule_type = 'qa_allowed' AND score >= 1.5), false) AS qa FROM m GROUP BY item_name, category_code),
h AS (SELECT *, CASE WHEN coalesce(p.s >= a.s + 0.5, false) THEN 'profile' WHEN f IS NOT NULL AND qa THEN 'qa_conflict' WHEN f IS NOT NULL THEN 'disallowed' WHEN ok IS NOT NULL THEN 'allowed' ELSE 'needs_model' END AS route FROM g),
k AS (SELECT *, CASE route WHEN 'profile' THEN p WHEN 'disallowed' THEN f WHEN 'allowed' THEN ok END AS dec FROM h) SELECT item_name, category_code, route, dec.i AS rule_id, dec.t AS rule_type, dec.s AS score FROM k""",
    "w7_score_margin": f"WITH {_STATS} SELECT item_name, category_code, top, second, round(top - second, 4) AS margin FROM stats",
    "o4_validator_matches": f"WITH {_MATCHES} SELECT item_name, category_code, rule_id, rule_type, tier, score FROM matches",
    "d14_item_verdict": f"""WITH {_MATCHES}, a AS (SELECT item_name, category_code, max(score) FILTER (WHERE rule_type IN ('allowed', 'qa_allowed', 'category', 'rule_like_allowed', 'profile_allowed')) AS a, max(score) FILTER (WHERE contains(rule_type, 'disallowed')) AS d,
  max(score) AS top, count(*) AS n FROM matches GROUP BY item_name, category_code),
b AS (SELECT *, round_even(greatest(0, least(0.3::DOUBLE + 0.45::DOUBLE * (top / (top + least(coalesce(a, 0), coalesce(d, 0)) + 1.0)) + 0.2::DOUBLE * least(top / 18.0, 1.0) + 0.05::DOUBLE * least(n / 3.0, 1.0), 0.95::DOUBLE)), 2) AS confidence FROM a)
SELECT item_name, category_code, a AS allow_score, d AS forbid_score, n AS n_matches, confidence, coalesce(a, 0) >= coalesce(d, 0) AS allowed, CASE WHEN confidence < 0.6 THEN 'weak' WHEN abs(a - d) < 2 THEN 'close' END AS review FROM b""",
    "d1_category_decision": f"""WITH {_STATS}, {_VOTES},
vq AS (SELECT query_id, first(category_code ORDER BY votes DESC, category_code) AS vote_code, round(max(votes) / sum(votes), 6) AS vote_share FROM votes GROUP BY query_id),
vt AS (SELECT item_name, vote_code, vote_share FROM (SELECT p_name || ' ' || p_brand AS item_name, min(p_partkey) % 100 AS query_id FROM part GROUP BY 1) JOIN vq USING (query_id)),
x AS (SELECT n.item_name, n.category_code AS given, s.category_code, top, second, coalesce(o.score, 0) AS given_score, vote_code, vote_share, round_even(greatest(0, least(0.35 + 0.55 * (top / (top + second + 1.0)) * least(top / 6.0, 1.0), 0.95)), 2) AS conf
  FROM names n LEFT JOIN stats s USING (item_name) LEFT JOIN scores o ON o.item_name = n.item_name AND o.category_code = n.category_code LEFT JOIN vt ON vt.item_name = n.item_name),
y AS (SELECT *, CASE WHEN top >= 5 AND top - second >= 2 THEN 'rule_clear' WHEN vote_code = category_code THEN 'rule_and_vote' WHEN vote_share >= 0.6 THEN 'vote' WHEN top >= 2 THEN 'rule_weak' ELSE 'unclassified' END AS path FROM x),
z AS (SELECT *, CASE path WHEN 'vote' THEN vote_code WHEN 'unclassified' THEN NULL ELSE category_code END AS predicted FROM y)
SELECT item_name, given AS given_code, path, predicted, CASE WHEN predicted IS NULL THEN 'needs_model' WHEN predicted = given THEN 'keep' WHEN (given_score > 0 AND top - given_score < 4) OR conf < 0.72 THEN 'keep' ELSE 'change' END AS status FROM z""",
    "a23_category_votes": f"WITH {_VOTES} SELECT query_id, category_code, votes FROM votes",
    "r2_bm25": _BM25 + """SELECT query_id, CAST(rank AS INT) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s) WHERE rank <= 10""",
    "r3_cosine_topk": f"WITH {_UNIT} SELECT query_id, CAST(rank AS INT) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5 AND score >= 0.1",
    "r4_rank_fusion": _BM25.rstrip() + """, v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), vq AS (SELECT id AS query_id, e AS qe FROM v WHERE id IN (SELECT item_id FROM benchmark)),
c AS (SELECT query_id, id, list_dot_product(qe, e) / sqrt(list_dot_product(qe, qe) * list_dot_product(e, e)) AS score FROM vq, v),
ra AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, id) AS rank FROM s), rb AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM c),
u AS (SELECT * FROM ra WHERE rank <= 10 UNION ALL SELECT * FROM rb WHERE rank <= 10), fu AS (SELECT query_id, id, round(sum(0.5::DOUBLE / (60 + rank)), 9) AS score FROM u GROUP BY query_id, id)
SELECT query_id, id, score FROM fu QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""",
    "r10_fallback_query": f"""WITH {_UNIT}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE id <> query_id), a AS (SELECT * FROM r WHERE rank <= 3 AND score >= 0.45)
SELECT query_id, CAST(rank AS INT) AS rank, id, false AS fallback FROM a UNION ALL SELECT query_id, CAST(rank AS INT), id, true FROM r WHERE rank = 1 AND query_id NOT IN (SELECT query_id FROM a)""",
    "r6_sections": """WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), h AS (SELECT *, regexp_matches(line, '^(The|Die|La|Le|Of) ') AS hd FROM l),
n AS (SELECT *, sum(CAST(hd AS INT)) OVER (PARTITION BY id ORDER BY pos) AS section FROM h) SELECT id, CAST(section AS BIGINT) AS section, min(line) FILTER (WHERE hd) AS title, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM n GROUP BY id, section""",
    "u6_distinct_chunks": "SELECT source, min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY source, substr(text, 1, 120)",
}
