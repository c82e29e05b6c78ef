"""Profiles: tables of terms that speak for or against a category, met as substrings of item texts.

A profile row is (category_code, kind, term, other): kind pair (term and other together), strong, medium, negative, allow or disallow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .rules import STOPWORDS

#: Points of a term's kind, and of each token shared with the retrieved context, of which three count. Fixed values.
POINTS = {"pair": 8.0, "strong": 5.0, "medium": 2.5, "negative": -2.5}
CONTEXT_POINTS, CONTEXT_TOKENS = 0.3, 3
CODES = [f"CAT_0{i}" for i in range(1, 10)]
#: Protective equipment named in a text. Fixed values.
EQUIPMENT = ["안전화", "방진마스크", "방독마스크", "귀마개", "귀덮개", "안전모", "안전대", "보안경", "안전장갑", "방열복", "보호복"]
#: A profile's score where its terms are allowed or not, to which each term adds 1; best rule's score under which allowing terms count. Fixed values.
ALLOWED_SCORE, DISALLOWED_SCORE, WEAK_MATCH = 4.0, 4.5, 3.0
#: Words of pay, and of work with a risk of fire. Fixed values.
PAY_WORDS, FIRE_WORDS, EXTINGUISHER = ["급여", "수당", "인건비", "임금"], ["용접", "화재위험", "화재예방"], "소화기"
#: Characters of the pieces by which terms and texts meet.
PIECE = 3


def _pieces(column, n):
    """The distinct pieces of n characters."""
    return F.when(F.length(column) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(column) - n + 1), lambda i: F.substring(column, i, n)))).otherwise(F.array().cast("array<string>"))


def substring_hits(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """The distinct (plain, term) where the text plain (texts) contains the term (terms); empty and null ones meet nothing.

    A term is anchored at its piece of three characters (itself, if shorter) that the fewest texts have, texts are exploded into their distinct pieces, and what
    meets by an equi-join on pieces is looked at. So the work is that of texts with a term's rarest piece, however many terms there are, and a term with
    a piece that no text has costs nothing.
    """
    asked = texts.select("plain").filter("plain <> ''").distinct()
    wanted = terms.select("term").filter("term <> ''").distinct()
    pieces = asked.select("plain", F.explode(F.concat(*[_pieces(F.col("plain"), F.lit(n)) for n in range(1, PIECE + 1)])).alias("piece"))
    own = wanted.select("term", F.explode(_pieces(F.col("term"), F.least(F.length("term"), F.lit(PIECE)))).alias("piece"))
    # Only pieces of terms are counted.
    counts = pieces.join(own.select("piece").distinct(), "piece", "left_semi").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    anchors = own.join(counts, "piece", "left").groupBy("term").agg(F.min_by("piece", F.struct(F.coalesce("n", F.lit(0)), "piece")).alias("piece"), F.min(F.coalesce("n", F.lit(0))).alias("n"))
    met = pieces.join(anchors.filter("n > 0").select("term", "piece"), "piece")
    return met.filter(F.contains("plain", "term")).select("plain", "term").distinct()


def boosts(plain, tokens):
    """(category_code, points, label) of what a text says beyond its terms: an array of structs, null where it doesn't hold. Fixed values."""
    has = lambda *words: [F.contains(plain, F.lit(w)) for w in words]
    both = lambda words: words[0] & words[1]
    named = F.array_sort(F.array_intersect(tokens, F.array(*[F.lit(w) for w in EQUIPMENT])))
    rows = [
        ("CAT_03", 2.0, has("안전인증")[0] & ~has("스티커")[0], None),
        ("CAT_03", 3.0, F.size(named) > 0, F.concat(F.lit("equipment "), F.array_join(named, ", "))),
        ("CAT_06", 6.0, has("kf94")[0], F.lit("kf94")),
        ("CAT_04", 6.0, F.exists(tokens, lambda t: F.endswith(t, F.lit("측정기"))), F.lit("measuring device")),
        ("CAT_02", 4.0, both(has("설치", "인건비")), F.lit("installation labour")),
        ("CAT_05", 2.0, F.array_contains(tokens, "스티커"), F.lit("sticker")),
        ("CAT_06", 5.0, F.arrays_overlap(tokens, F.array(F.lit("코로나19"), F.lit("진단키트"))), F.lit("infection")),
    ]
    empty = F.lit(None).cast("string")
    return F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(c).alias("category_code"), F.lit(p).alias("points"), (empty if label is None else label).alias("label"), F.lit(4 + i).alias("place"))) for i, (c, p, cond, label) in enumerate(rows)]))


def profile_scores(names: DataFrame, profiles: DataFrame) -> DataFrame:
    """item_name, category_code, score and evidence (five at most: pairs, strong, medium, negative terms, then boosts) of names (item_name, and context if
    there is such a column) under the profiles; scores that aren't positive are left out.

    Equal rows of profiles count once; terms are lowered and met in the lower-case text of alphanumerics. Negative terms are one piece of evidence.
    """
    plain = names.select("item_name", *[c for c in ("context",) if c in names.columns]).distinct().withColumn("plain", text.match_text(F.col("item_name")))
    table = profiles.select("category_code", "kind", F.lower("term").alias("term"), F.lower("other").alias("other")).distinct()
    hits = substring_hits(plain, table.select("term").unionByName(table.select(F.col("other").alias("term"))))
    single = table.filter(F.col("kind").isin("strong", "medium", "negative")).join(hits, "term").select("plain", "category_code", "kind", "term", F.lit(None).cast("string").alias("other"))
    pairs = table.filter("kind = 'pair'").join(hits, "term").join(hits.withColumnRenamed("term", "other"), ["plain", "other"]).select("plain", "category_code", "kind", "term", "other")
    points = F.create_map(*[F.lit(x) for kv in POINTS.items() for x in kv])
    place = F.create_map(*[F.lit(x) for kv in zip(POINTS, range(4), strict=True) for x in kv])
    found = single.unionByName(pairs).select("plain", "category_code", points[F.col("kind")].alias("points"), F.concat_ws(" ", "kind", F.concat_ws("+", "term", "other")).alias("label"), place[F.col("kind")].alias("place"), "term")
    tokens = text.rule_tokens(F.col("item_name"), STOPWORDS)
    known = table.select("category_code").distinct()
    by_text = plain.select("item_name", *[c for c in ("context",) if c in plain.columns], "plain", tokens.alias("tokens"))
    more = by_text.select("item_name", F.inline(boosts(F.col("plain"), F.col("tokens")))).join(known, "category_code", "left_semi").withColumn("term", F.lit(""))
    columns = ["item_name", "category_code", "points", "label", "place", "term"]
    rows = plain.select("item_name", "plain").distinct().join(found, "plain").select(columns).unionByName(more.select(columns))
    if "context" in names.columns:
        shared = F.least(F.size(F.array_intersect("tokens", text.rule_tokens(F.col("context"), STOPWORDS))), F.lit(CONTEXT_TOKENS))
        given = by_text.withColumn("_n", shared).filter("_n > 0").select("item_name", F.explode(F.array(*[F.lit(c) for c in CODES])).alias("category_code"), (F.col("_n") * CONTEXT_POINTS).alias("points"))
        rows = rows.unionByName(given.join(known, "category_code", "left_semi").select("item_name", "category_code", "points", F.lit(None).cast("string").alias("label"), F.lit(99).alias("place"), F.lit("").alias("term")))
    label = F.when((F.col("place") != 3) & F.col("label").isNotNull(), F.struct("place", "term", "label"))
    against = F.array_sort(F.collect_set(F.when(F.col("place") == 3, F.col("term"))))
    out = rows.groupBy("item_name", "category_code").agg(F.sum("points").alias("score"), F.collect_set(label).alias("_for"), against.alias("_against"))
    refuting = F.when(F.size("_against") > 0, F.array(F.struct(F.lit(3).alias("place"), F.lit("").alias("term"), F.concat(F.lit("negative "), F.array_join("_against", ", ")).alias("label")))).otherwise(F.array().cast("array<struct<place: int, term: string, label: string>>"))
    evidence = F.slice(F.transform(F.array_sort(F.concat("_for", refuting)), lambda e: e["label"]), 1, 5)
    return out.filter("score > 0").select("item_name", "category_code", "score", evidence.alias("evidence"))


def profile_hits(asked: DataFrame, profiles: DataFrame) -> DataFrame:
    """Distinct (item_name, category_code) with allow and disallow: the terms of its category's profile that the text contains, sorted; without any, no row."""
    plain = asked.select("item_name", "category_code").distinct().withColumn("plain", text.match_text(F.col("item_name")))
    table = profiles.filter(F.col("kind").isin("allow", "disallow")).select("category_code", "kind", F.lower("term").alias("term")).distinct()
    hits = plain.join(substring_hits(plain, table), "plain").join(table, ["category_code", "term"])
    terms = {k: F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("term")))).alias(k) for k in ("allow", "disallow")}
    return hits.groupBy("item_name", "category_code").agg(*terms.values())


def with_profile_matches(matches: DataFrame, hits: DataFrame, limit: int = 8) -> DataFrame:
    """The tiered rule matches (item_name, category_code, rule_id, rule_type, tier, score) with those of profiles, re-sorted, ``limit`` at most.

    Terms that forbid always add a match of 4.5 and one for each term. Without these, terms that allow add one of 4 and one for each term: where the first match of the lowest tier
    scores under 3, for pay of CAT_01 (for other texts of CAT_01, or a second time, with 4 alone), and for extinguishers of CAT_02 at work with a risk of fire. Profile matches have no
    rule_id and tier 10; of equal scores rules come first.
    """
    keys = ["item_name", "category_code"]
    # The first of a list that holds tier 1, then 2, 3 and the policies of no category (9).
    first = matches.groupBy(*keys).agg(F.min_by("score", F.struct("tier", -F.col("score"), "rule_id")).alias("top"))
    found = hits.join(first, keys, "left").withColumn("plain", text.match_text(F.col("item_name")))
    n_allow, n_not = F.size("allow"), F.size("disallow")
    says = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains("plain", w))
    open_ = (n_not == 0) & (n_allow > 0)
    weak = open_ & (F.coalesce("top", F.lit(0.0)) < WEAK_MATCH)
    pay = open_ & (F.col("category_code") == "CAT_01")
    fire = open_ & ~weak & (F.col("category_code") == "CAT_02") & F.contains("plain", F.lit(EXTINGUISHER)) & says(FIRE_WORDS)
    row = lambda kind, score: F.struct(F.lit(kind).alias("rule_type"), score.alias("score"))
    allowed = F.lit(ALLOWED_SCORE) + n_allow
    rows = F.array(
        F.when(n_not > 0, row("profile_disallowed", F.lit(DISALLOWED_SCORE) + n_not)),
        F.when(weak | fire, row("profile_allowed", allowed)),
        F.when(pay, row("profile_allowed", F.when(~weak & says(PAY_WORDS), allowed).otherwise(F.lit(ALLOWED_SCORE)))),
    )
    rule_id, tier = matches.schema["rule_id"].dataType, matches.schema["tier"].dataType
    more = found.select(*keys, F.posexplode(F.array_compact(rows)).alias("place", "m")).select(*keys, F.lit(None).cast(rule_id).alias("rule_id"), "m.rule_type", F.lit(10).cast(tier).alias("tier"), "m.score", "place")
    both = matches.select(*keys, "rule_id", "rule_type", "tier", "score", F.lit(0).alias("place")).unionByName(more)
    ranked = F.row_number().over(_by_score(keys))
    return both.withColumn("rank", ranked).filter(F.col("rank") <= limit).select(*keys, "rank", "rule_id", "rule_type", "tier", "score")


def _by_score(keys: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*keys).orderBy(F.desc("score"), "tier", "place", "rule_id")
