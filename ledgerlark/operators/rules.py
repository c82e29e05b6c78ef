"""Rules: token index, category and validator scores, tiered top matches, citation votes, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amounts, text

#: Tokens that say nothing about a rule. Fixed values.
STOPWORDS = [
    "건설", "건설공사", "건설현장", "현장", "작업장", "근로자", "산업", "안전", "보건", "산업안전", "산업안전보건", "관리비", "비용", "구입", "임대", "설치", "사용", "가능", "가능한지", "항목", "소요", "해당",
    "따른", "법", "규정", "기준", "제", "호", "목", "등", "위한", "위하여", "대한", "경우", "업무", "관련", "실시", "관리", "예방", "필요", "장비", "시설", "현수", "세트", "인건비", "등에", "따라", "위해", "대해", "로서",
    "로써", "에서", "에게", "에도", "으로", "부터", "까지",
]
#: Weights of a rule's type when categories are scored, and when items are validated. Fixed values.
CATEGORY_WEIGHTS = {"category": 1.8, "allowed": 1.4, "qa_allowed": 1.1, "limit": 0.8, "qa_limit": 0.7}
VALIDATOR_WEIGHTS = {"disallowed": 3.0, "allowed": 2.5, "limit": 2.0, "category": 2.0, "qa_disallowed": 2.2, "qa_allowed": 1.8, "qa_limit": 1.6, "rule_like_disallowed": 0.9, "rule_like_allowed": 0.8, "rule_like_limit": 0.8}
TIERS = {1: ["allowed", "disallowed", "limit", "category"], 2: ["qa_allowed", "qa_disallowed", "qa_limit"], 3: ["rule_like_allowed", "rule_like_disallowed", "rule_like_limit"]}
#: Words of exceptions and of allowances in a rule, for which its score is raised. Fixed values.
EXCEPTING, ALLOWING = ["다만", "불가"], ["가능", "허용"]
#: Score from which a match counts, from which one that allows is strong, and by how much an allowing profile must lead. Fixed values.
COUNTS, STRONG, LEADS, REVIEW_CONFIDENCE, REVIEW_MARGIN = 1.5, 3.5, 0.5, 0.6, 2.0
#: Where a decision is clear. Fixed values.
CLEAR_SCORE, CLEAR_MARGIN, LEAST_SCORE, VOTE_SHARE = 5.0, 2.0, 2.0, 0.6
RECLASSIFY_MARGIN, RECLASSIFY_CONFIDENCE = 4.0, 0.72


def _by(column: Column, values: dict, default) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def tier(rule_type: Column) -> Column:
    out = F.lit(0)
    for n, types in TIERS.items():
        out = F.when(rule_type.isin(*types), n).otherwise(out)
    return out


def rule_tokens(rules: DataFrame) -> DataFrame:
    """A row for each token of a rule's keyword and body."""
    words = text.rule_tokens(F.concat_ws(" ", "keyword", "body"), STOPWORDS)
    return rules.select("rule_id", "category_code", "rule_type", F.explode(words).alias("token"))


def document_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def classifying(rules: DataFrame) -> DataFrame:
    """The rules that tell categories: of a category, and of a type that says what belongs to it."""
    return rules.filter(F.col("category_code").isNotNull() & F.col("rule_type").isin(*CATEGORY_WEIGHTS))


def asked_tokens(names: DataFrame, keys: list[str]) -> DataFrame:
    """keys, token and own: the distinct tokens of item_name (own), and those that the column context, if there is one, has beside them."""
    own = text.rule_tokens(F.col("item_name"), STOPWORDS)
    rows = names.select(*keys, F.explode(own).alias("token"), F.lit(True).alias("own"))
    if "context" not in names.columns:
        return rows
    return rows.unionByName(names.select(*keys, F.explode(F.array_except(text.rule_tokens(F.col("context"), STOPWORDS), own)).alias("token"), F.lit(False).alias("own")))


def category_scores(names: DataFrame, rules: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """item_name, category_code, score and evidence of distinct names (item_name, and the retrieved context if there is such a column).

    A rule's score: over the tokens that the name shares with it, type weight times rarity times length; then 0.15 for each other token, three at most,
    that it shares with the context. A category's: its profile's (if positive) and those of its rules. Evidence: the profile's, then the rules' keywords by rule_id.
    Names and rules meet by an equi-join on tokens; names come once however often they are used.
    """
    coded = classifying(rules)
    tokens = rule_tokens(coded)
    n = coded.filter(F.size(text.rule_tokens(F.concat_ws(" ", "keyword", "body"), STOPWORDS)) > 0).agg(F.count(F.lit(1)).alias("n_rules"))
    idf = document_frequency(tokens).crossJoin(F.broadcast(n)).select("token", (1.0 + F.log((1 + F.col("n_rules")) / (1 + F.col("df")))).alias("idf"))
    distinct = names.select("item_name", *[c for c in ("context",) if c in names.columns]).distinct()
    part = _by(F.col("rule_type"), CATEGORY_WEIGHTS, 0.5) * F.col("idf") * F.least(F.length("token") / 4.0, F.lit(2.0))
    met = asked_tokens(distinct, ["item_name"]).join(tokens.join(idf, "token"), "token")
    by_rule = met.groupBy("item_name", "category_code", "rule_id").agg(F.sum(F.when(F.col("own"), part)).alias("base"), F.count_if(~F.col("own")).alias("beside"))
    by_rule = by_rule.filter("base IS NOT NULL").join(coded.select("rule_id", "keyword"), "rule_id")
    score = F.col("base") + 0.15 * F.least("beside", F.lit(3))
    rows = by_rule.select("item_name", "category_code", score.alias("score"), F.struct(F.lit(1).alias("by"), F.col("rule_id").cast("long").alias("at"), F.substring("keyword", 1, 160).alias("label")).alias("e"))
    if profiles is not None:
        from .profiles import profile_scores

        own = profile_scores(distinct, profiles).select("item_name", "category_code", F.posexplode_outer("evidence").alias("at", "label"), "score")
        # The score stands once, with the first piece of evidence.
        rows = rows.unionByName(own.select("item_name", "category_code", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("score")).alias("score"), F.when(F.col("label").isNotNull(), F.struct(F.lit(0).alias("by"), F.col("at").cast("long").alias("at"), "label")).alias("e")))
    evidence = F.array_distinct(F.transform(F.array_sort(F.collect_set("e")), lambda e: e["label"]))
    return rows.groupBy("item_name", "category_code").agg(F.sum("score").alias("score"), evidence.alias("evidence"))


def top_categories(scores: DataFrame, n: int = 5) -> DataFrame:
    order = Window.partitionBy("item_name").orderBy(F.desc("score"), "category_code")
    return scores.filter("score > 0").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def score_stats(ranked: DataFrame) -> DataFrame:
    """By name: the best category, its score, the second's (0 without one), margin and confidence."""
    out = ranked.groupBy("item_name").agg(
        F.max(F.when(F.col("rank") == 1, F.col("category_code"))).alias("category_code"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("score"))), F.lit(0.0)).alias("second")
    )
    return out.withColumns({"margin": F.col("top") - F.col("second"), "confidence": amounts.candidate_confidence(F.col("top"), F.col("second"))})


def validator_scores(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """(item_name, category_code) with the rules (r_ columns) of its category, and policies without one, that share a token with the name, and their scores.

    The type's weight for each shared token and a bonus by its length are summed as names and rules meet by their tokens; then 0.25 for each other token, two at most, shared with the context,
    0.5 and 0.3 for words of exceptions and allowances; 20 % more for the category's own rules, 30 % less for rules of none.
    """
    keys = ["item_name", "category_code"]
    words = F.concat_ws(" ", "keyword", "body")
    right = rules.select(F.col("rule_id").alias("r_rule_id"), F.col("rule_type").alias("r_rule_type"), F.col("category_code").alias("r_category_code"), F.explode(text.rule_tokens(words, STOPWORDS)).alias("token"))
    said = lambda *ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(words, w))
    bonus = rules.select(F.col("rule_id").alias("r_rule_id"), (F.when(said(*EXCEPTING), 0.5).otherwise(0.0) + F.when(said(*ALLOWING), 0.3).otherwise(0.0)).alias("bonus")).filter("bonus > 0")
    left = asked_tokens(asked.select(*keys, *[c for c in ("context",) if c in asked.columns]).distinct(), keys)
    policy = F.col("r_rule_type").isin("disallowed", "qa_disallowed") & F.col("r_category_code").isNull()
    met = left.join(right, "token").filter(policy | F.coalesce(F.col("r_category_code") == F.col("category_code"), F.lit(False)))
    part = _by(F.col("r_rule_type"), VALIDATOR_WEIGHTS, 0.5) + F.least(F.length("token") / 3.0, F.lit(2.5))
    sums = met.groupBy(*keys, "r_rule_id", "r_rule_type", "r_category_code").agg(F.sum(F.when(F.col("own"), part)).alias("base"), F.count_if(~F.col("own")).alias("beside"))
    score = F.col("base") + 0.25 * F.least("beside", F.lit(2)) + F.coalesce("bonus", F.lit(0.0))
    factor = F.when(F.col("r_category_code") == F.col("category_code"), 1.2).when(F.col("r_category_code").isNull(), 0.7).otherwise(1.0)
    return sums.filter("base IS NOT NULL").join(bonus, "r_rule_id", "left").withColumn("policy", policy).withColumn("score", score * factor)


def validator_matches(asked: DataFrame, rules: DataFrame, limit: int = 8, profiles: DataFrame | None = None) -> DataFrame:
    """The tiered best rules of each (item_name, category_code).

    Tier 1 up to the limit; tier 2 only if these are under 3; tier 3, two at most, only if there is no tier 1 and under 2 so far; two
    policies without category at half their score; then, if there are profiles, what their terms say; the best of all by score.
    """
    scored = validator_scores(asked, rules).withColumn("score", F.when(F.col("policy"), F.col("score") * 0.5).otherwise(F.col("score")))
    scored = scored.withColumn("tier", F.when(F.col("policy"), 9).otherwise(tier(F.col("r_rule_type")))).filter("score > 0")
    keys = ["item_name", "category_code"]
    place = F.row_number().over(Window.partitionBy(*keys, "tier").orderBy(F.desc("score"), "r_rule_id"))
    ranked = scored.withColumn("place", place).filter(F.col("place") <= limit)
    one = F.count_if(F.col("tier") == 1).over(Window.partitionBy(*keys))
    two = F.when(one < 3, F.least(F.count_if(F.col("tier") == 2).over(Window.partitionBy(*keys)), F.lit(limit) - one)).otherwise(0)
    used = (
        F.when(F.col("tier") == 1, True)
        .when(F.col("tier") == 2, (F.col("one") < 3) & (F.col("place") <= limit - F.col("one")))
        .when(F.col("tier") == 3, (F.col("one") == 0) & (F.col("one") + F.col("two") < 2) & (F.col("place") <= 2))
        .when(F.col("tier") == 9, F.col("place") <= 2)
        .otherwise(False)
    )
    chosen = ranked.withColumns({"one": one, "two": two}).filter(used)
    if profiles is not None:
        from .profiles import profile_hits, with_profile_matches

        found = chosen.select(*keys, F.col("r_rule_id").alias("rule_id"), F.col("r_rule_type").alias("rule_type"), "tier", "score")
        return with_profile_matches(found, profile_hits(asked, profiles), limit)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "tier", "r_rule_id"))
    return chosen.withColumn("rank", best).filter(F.col("rank") <= limit).select(*keys, "rank", F.col("r_rule_id").alias("rule_id"), F.col("r_rule_type").alias("rule_type"), "tier", "score")


def allowing(rule_type: Column) -> Column:
    """What a match says: true, false, or null for limits. Types that forbid are false; limits say nothing."""
    return F.when(F.contains(rule_type, F.lit("disallowed")), False).when(rule_type.isin("allowed", "qa_allowed", "category", "rule_like_allowed", "profile_allowed"), True)


def verdict(matches: DataFrame) -> DataFrame:
    """By (item_name, category_code): best allowing and forbidding scores, confidence, allowed, and why a person must look at it (null if nobody must).

    The confidence is of the best score against the weaker of the two, and of the number of matches; below 0.6 it is weak, and two sides less than 2 apart are close.
    """
    says = allowing(F.col("rule_type"))
    out = matches.groupBy("item_name", "category_code").agg(
        F.max(F.when(says, F.col("score"))).alias("allow_score"), F.max(F.when(~says, F.col("score"))).alias("forbid_score"), F.max("score").alias("_top"), F.count(F.lit(1)).alias("n_matches")
    )
    a, d = F.coalesce("allow_score", F.lit(0.0)), F.coalesce("forbid_score", F.lit(0.0))
    out = out.withColumn("confidence", amounts.validator_confidence(F.col("_top"), F.least(a, d), F.col("n_matches"))).drop("_top")
    close = F.col("allow_score").isNotNull() & F.col("forbid_score").isNotNull() & (F.abs(a - d) < REVIEW_MARGIN)
    return out.withColumns({"allowed": a >= d, "review": F.when(F.col("confidence") < REVIEW_CONFIDENCE, "weak").when(close, "close")})


def routed(matches: DataFrame, texts: DataFrame) -> DataFrame:
    """The way each (item_name, category_code) with matches is judged, and the match that decides: profile, disallowed, qa_conflict, allowed or needs_model.

    texts (rule_id, body) have the rules' evidence. In this order: an allowing profile that leads the first forbidding match by 0.5; a forbidding match that counts (of laws, answers or
    a profile), unless answers contradict each other or one is the first half of a mixed answer; a strong allowing match; else a model.
    """
    keys = ["item_name", "category_code"]
    says = allowing(F.col("rule_type"))
    profile = F.col("rule_type").isin("profile_allowed", "profile_disallowed")
    trusted = F.col("tier").isin(1, 2, 9)
    half = F.coalesce(F.rlike(F.trim("body"), F.lit(r"이나[,\s]?\s*$")), F.lit(False))
    counts = F.col("score") >= COUNTS
    rows = matches.join(texts.select("rule_id", "body"), "rule_id", "left")
    at = F.struct("rank", "rule_id", "rule_type", "score")
    first = lambda condition: F.min(F.when(condition, at))
    out = rows.groupBy(*keys).agg(
        first(F.col("rule_type") == "profile_allowed").alias("_profile"),
        first(~says).alias("_against"),
        first(~says & counts & (trusted | profile)).alias("_forbids"),
        first(says & ((trusted & (F.col("score") >= STRONG)) | (profile & (F.col("score") >= 4.0)))).alias("_allows"),
        F.max(F.when((F.col("rule_type") == "qa_disallowed") & counts, F.when(half, 2).otherwise(1))).alias("_qa_not"),
        F.max((F.col("rule_type") == "qa_allowed") & counts).alias("_qa"),
    )
    leads = F.coalesce(F.col("_profile.score") >= F.col("_against.score") + LEADS, F.lit(False))
    conflict = F.coalesce((F.col("_qa_not") == 2) | ((F.col("_qa_not") == 1) & F.col("_qa")), F.lit(False))
    route = F.when(leads, "profile").when(F.col("_forbids").isNotNull() & conflict, "qa_conflict").when(F.col("_forbids").isNotNull(), "disallowed").when(F.col("_allows").isNotNull(), "allowed").otherwise("needs_model")
    out = out.withColumn("route", route)
    decides = F.when(F.col("route") == "profile", F.col("_profile")).when(F.col("route") == "disallowed", F.col("_forbids")).when(F.col("route") == "allowed", F.col("_allows"))
    return out.withColumn("_by", decides).select(*keys, "route", F.col("_by.rule_id").alias("rule_id"), F.col("_by.rule_type").alias("rule_type"), F.col("_by.score").alias("score"))


def category_votes(ranked_chunks: DataFrame) -> DataFrame:
    """By query_id: each chunk (rank from 0, text) votes 1 / (rank + 1) for each distinct category that it cites (제7조제1항제n호)."""
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit(r"제7조제1항제(\d+)호"), F.lit(1)))
    votes = ranked_chunks.select("query_id", "rank", F.explode(numbers).alias("no")).filter(F.rlike("no", F.lit("^[1-9]$")))
    return votes.groupBy("query_id", F.concat(F.lit("CAT_0"), "no").alias("category_code")).agg(F.sum(1.0 / (F.col("rank") + 1)).alias("votes"))


def decided(stats: DataFrame) -> DataFrame:
    """The category decision of names (category_code, top, margin, vote_code, vote_share, given_code, given_score): its path, and keep or change.

    Clear rule score, else rule and vote agree, else a clear vote, else a weak rule score, else unclassified, which needs a model.
    """
    path = (
        F.when((F.col("top") >= CLEAR_SCORE) & (F.col("margin") >= CLEAR_MARGIN), "rule_clear")
        .when(F.col("vote_code") == F.col("category_code"), "rule_and_vote")
        .when(F.col("vote_share") >= VOTE_SHARE, "vote")
        .when(F.col("top") >= LEAST_SCORE, "rule_weak")
        .otherwise("unclassified")
    )
    out = stats.withColumn("path", path)
    code = F.when(F.col("path") == "vote", F.col("vote_code")).when(F.col("path") == "unclassified", F.lit(None).cast("string")).otherwise(F.col("category_code"))
    out = out.withColumn("predicted", code)
    low = (F.col("given_score") > 0) & (F.col("top") - F.col("given_score") < RECLASSIFY_MARGIN)
    status = (
        F.when(F.col("predicted").isNull(), "needs_model")
        .when(F.col("predicted") == F.col("given_code"), "keep")
        .when(low | (F.col("confidence") < RECLASSIFY_CONFIDENCE), "keep")
        .otherwise("change")
    )
    return out.withColumn("status", status)
