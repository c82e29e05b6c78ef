from pyspark.sql import functions as F

from ledgerlark.operators import profiles, rules

PROFILES = "category_code string, kind string, term string, other string"
MATCHES = "item_name string, category_code string, rule_id int, rule_type string, tier int, score double"


def scores(spark, names, rows, context=None):
    df = spark.createDataFrame([(n, context) for n in names], "item_name string, context string")
    got = profiles.profile_scores(df if context else df.drop("context"), spark.createDataFrame(rows, PROFILES))
    return {(r.item_name, r.category_code): (round(r.score, 6), list(r.evidence)) for r in got.collect()}


def test_substrings_against_brute_force(spark):
    texts = ["abcabc", "안전모 세트", "a", "ab", "", "xyz abc", "bcd", None, "aaaa"]
    terms = ["abc", "a", "ab", "bc", "안전모", "전모 ", "zzz", "", "x", "aaa", "cab", "z a"]
    got = profiles.substring_hits(spark.createDataFrame([(t,) for t in texts], "plain string"), spark.createDataFrame([(t,) for t in terms], "term string")).collect()
    assert sorted(map(tuple, got)) == sorted({(x, t) for x in texts if x for t in terms if t and t in x})


def test_kinds_of_terms(spark):
    rows = [("CAT_01", "pair", "Red", "bolt"), ("CAT_01", "strong", "bol", None), ("CAT_01", "medium", "d b", None), ("CAT_01", "negative", "red", None), ("CAT_01", "negative", "bolt", None), ("CAT_01", "strong", "gear", None), ("CAT_02", "negative", "red", None), ("CAT_02", "medium", "ed", None), ("CAT_01", "strong", "bol", None)]
    got = scores(spark, ["RED  bolt!", "blue gear", "", None], rows)
    assert got == {("RED  bolt!", "CAT_01"): (8 + 5 + 2.5 - 5, ["pair red+bolt", "strong bol", "medium d b", "negative bolt, red"]), ("blue gear", "CAT_01"): (5.0, ["strong gear"])}


def test_boosts(spark):
    rows = [(f"CAT_0{i}", "strong", "없는말", None) for i in range(1, 10)]
    names = ["안전인증 안전모", "안전인증 스티커", "KF94 마스크", "가스측정기", "난간 설치 인건비", "코로나19 키트", "안전대 귀마개"]
    got = scores(spark, names, rows)
    assert got == {
        ("안전인증 안전모", "CAT_03"): (5.0, ["equipment 안전모"]), ("안전인증 스티커", "CAT_05"): (2.0, ["sticker"]), ("KF94 마스크", "CAT_06"): (6.0, ["kf94"]), ("가스측정기", "CAT_04"): (6.0, ["measuring device"]),
        ("난간 설치 인건비", "CAT_02"): (4.0, ["installation labour"]), ("코로나19 키트", "CAT_06"): (5.0, ["infection"]), ("안전대 귀마개", "CAT_03"): (3.0, ["equipment 귀마개, 안전대"]),
    }
    assert scores(spark, names, [("CAT_09", "strong", "없는말", None)]) == {}


def test_context(spark):
    got = scores(spark, ["steel ladder hook rope"], [("CAT_01", "strong", "ladder", None), ("CAT_02", "strong", "no", None)], context="rope and hook for a steel ladder")
    assert got == {("steel ladder hook rope", "CAT_01"): (5.9, ["strong ladder"]), ("steel ladder hook rope", "CAT_02"): (0.9, [])}


def test_hits_and_matches(spark):
    rows = [("CAT_01", "allow", "수당", None), ("CAT_01", "allow", "안내", None), ("CAT_01", "disallow", "출장", None), ("CAT_02", "allow", "소화기", None), ("CAT_03", "allow", "모자", None)]
    asked = spark.createDataFrame([("업무 수당", "CAT_01"), ("안내 표지", "CAT_01"), ("출장 수당", "CAT_01"), ("용접 소화기", "CAT_02"), ("사무 소화기", "CAT_02"), ("모자", "CAT_03"), ("모자 강", "CAT_03"), ("모자", "CAT_02")], "item_name string, category_code string")
    hits = profiles.profile_hits(asked, spark.createDataFrame(rows, PROFILES))
    assert {(r.item_name, tuple(r.allow), tuple(r.disallow)) for r in hits.collect()} >= {("출장 수당", ("수당",), ("출장",)), ("모자", ("모자",), ())}
    strong = [(n, c, 1, "allowed", 1, 3.0) for n, c in (("업무 수당", "CAT_01"), ("안내 표지", "CAT_01"), ("용접 소화기", "CAT_02"), ("사무 소화기", "CAT_02"), ("모자 강", "CAT_03"))]
    got = profiles.with_profile_matches(spark.createDataFrame(strong + [("모자", "CAT_03", 2, "qa_allowed", 2, 2.0)], MATCHES), hits)
    got = sorted((r.item_name, r.rule_type, r.score, r["rank"]) for r in got.filter("tier = 10").collect())
    # A rule under 3 lets the profile speak; pay of CAT_01 and extinguishers for hot work have their own exceptions; what is forbidden is always said.
    assert got == sorted([("업무 수당", "profile_allowed", 5.0, 1), ("안내 표지", "profile_allowed", 4.0, 1), ("출장 수당", "profile_disallowed", 5.5, 1), ("용접 소화기", "profile_allowed", 5.0, 1), ("모자", "profile_allowed", 5.0, 1)])


def test_routes(spark):
    rows = [
        ("a", "C", 1, "disallowed", 1, 4.0), ("a", "C", None, "profile_allowed", 10, 4.5), ("b", "C", 1, "disallowed", 1, 4.2), ("b", "C", None, "profile_allowed", 10, 4.5),
        ("c", "C", 2, "qa_disallowed", 2, 2.0), ("c", "C", 3, "qa_allowed", 2, 1.6), ("d", "C", 2, "qa_disallowed", 2, 2.0), ("d", "C", 3, "qa_allowed", 2, 1.4), ("e", "C", 4, "qa_disallowed", 2, 1.5),
        ("f", "C", 5, "allowed", 1, 3.5), ("g", "C", 5, "allowed", 1, 3.4), ("h", "C", 6, "rule_like_disallowed", 3, 9.0), ("i", "C", None, "profile_allowed", 10, 5.0), ("j", "C", 7, "limit", 1, 9.0),
    ]
    rank = F.row_number().over(rules.Window.partitionBy("item_name").orderBy(F.desc("score")))
    texts = spark.createDataFrame([(1, "x"), (4, "사무실은 불가하나 현장은 이나, "), (2, "x")], "rule_id int, body string")
    got = {r.item_name: (r.route, r.rule_id) for r in rules.routed(spark.createDataFrame(rows, MATCHES).withColumn("rank", rank), texts).collect()}
    want = {"a": ("profile", None), "b": ("disallowed", 1), "c": ("qa_conflict", None), "d": ("disallowed", 2), "e": ("qa_conflict", None), "f": ("allowed", 5), "g": ("needs_model", None), "h": ("needs_model", None), "i": ("allowed", None), "j": ("needs_model", None)}
    assert got == want


def test_verdicts(spark):
    rows = [("a", "C", 1, "allowed", 1, 9.0), ("a", "C", 2, "disallowed", 1, 8.0), ("a", "C", 3, "limit", 1, 1.0), ("b", "C", 1, "qa_disallowed", 2, 3.0), ("c", "C", 1, "allowed", 1, 18.0)]
    got = {r.item_name: (r.allowed, r.confidence, r.review) for r in rules.verdict(spark.createDataFrame(rows, MATCHES)).collect()}
    assert got == {"a": (True, 0.68, "close"), "b": (False, 0.69, None), "c": (True, 0.94, None)}


def test_context_and_words_of_rules(spark):
    table = spark.createDataFrame([(1, "C", "allowed", "ladder", "steel 가능"), (2, None, "disallowed", "ladder 불가", "x"), (3, "D", "allowed", "ladder", ""), (4, "C", "qa_limit", "hook", "")], "rule_id int, category_code string, rule_type string, keyword string, body string")
    asked = spark.createDataFrame([("ladder", "C", "hook steel rope")], "item_name string, category_code string, context string")
    got = {r.r_rule_id: round(r.score, 6) for r in rules.validator_scores(asked, table).collect()}
    assert got == {1: round((2.5 + 2.0 + 0.25 + 0.3) * 1.2, 6), 2: round((3.0 + 2.0 + 0.5) * 0.7, 6)}
