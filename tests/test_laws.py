import random
import re

from pyspark.sql import functions as F

from ledgerlark.operators import laws

N = laws.NOTICE


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def cited(spark, basis, body, category=None):
    return one(spark, laws.rule_laws(F.col("a"), F.col("b"), F.col("c")), a=basis, b=body, c=category)


def test_laws_of_rules(spark):
    assert cited(spark, None, None) == [] and cited(spark, " ", "", "CAT_03") == [f"{N} 제7조제1항제3호"]
    assert cited(spark, "제4조제2호 | 제72조제1항|별표 2", "") == ["중대재해처벌법 시행령 제4조제2호 | 산업안전보건법 제72조제1항 | 별표 2"]
    assert cited(spark, "제999조", "산업안전보건법 시행규칙 제98조제2항 및 제98조, 제17조와 제17조") == ["제999조", "산업안전보건법 시행규칙 제98조제2항", "산업안전보건법 제17조"]
    assert cited(spark, "", "건설기술  진흥법제62조, 별표 3", "CAT_09") == ["건설기술  진흥법 제62조", "별표 3", f"{N} 제7조제1항제9호"]
    assert cited(spark, f"{N} 제7조제1항제1호", "", "CAT_01") == [f"{N} 제7조제1항제1호"]


def plain_names(reason, own):
    """The names, character by character."""
    full = sorted([x for x in own if re.search(r"[가-힣]{2,}", x)], key=len, reverse=True)
    out, at = "", 0
    for m in re.finditer(laws.BARE, reason):
        out += reason[at : m.start()]
        bare, shown = m[1].replace(" ", ""), m[1]
        if not re.search(r"[가-힣]{2,}", reason[max(0, m.start() - 30) : m.start()]):
            for law in full:
                law_norm = law.replace(" ", "")
                if (bare in law_norm and law_norm != bare) or law_norm.startswith(bare):
                    shown = law
                    break
        out, at = out + shown, m.end()
    return out + reason[at:]


def test_names_in_reasons(spark):
    rnd = random.Random(4)
    pieces = ["제7조 제1항", "제17조", "산업안전보건법 ", "에 따라 ", " x ", ". ", "(", ")", "제7조제1항제2호", "abc " * 9, "가", "은", "제9조"]
    lists = [[f"{N} 제7조제1항제2호", "산업안전보건법 제17조"], ["제7조"], [f"{N} 제7조제1항", f"{N} 제7조제1항제2호", "제17조"], []]
    rows = [("".join(rnd.choices(pieces, k=rnd.randint(0, 8))), rnd.choice(lists)) for _ in range(300)]
    df = spark.createDataFrame(rows, "reason string, own array<string>")
    got = df.select("reason", "own", laws.with_full_names(F.col("reason"), F.col("own")).alias("x")).collect()
    assert [r.x for r in got] == [plain_names(r.reason, r.own) for r in got] and sum(r.x != r.reason for r in got) > 30


def test_logged_reasons(spark):
    reason = lambda text, own: one(spark, laws.item_reason(F.col("a"), F.col("b")), a=text, b=own)
    assert reason("제17조: 허용됩니다. 허용됩니다.", ["산업안전보건법 제17조"]) == "산업안전보건법 제17조: 허용됩니다."
    assert reason("사용이 가능합니다 . 사용이 불가합니다", []) == "사용이 가능합니다." and reason(None, []) == "" and len(reason("a" * 3000, ["x"])) == 1000


def test_order_of_laws(spark):
    own = ["별표 1", "제62조", "제2조제3항", "b law", "제4조", "in text", "별표 3", "제7조제1항", "", "b law", "a law"]
    df = spark.createDataFrame([(own, 0.5, True, "in text", ["제7조제1항"]), (own, None, False, None, [])], "a array<string>, rate double, over boolean, said string, items array<string>")
    got = [r.x for r in df.select(laws.prioritised(F.col("a"), F.col("rate"), F.col("over"), F.col("said"), F.col("items")).alias("x")).collect()]
    assert got[0] == ["별표 3", "제4조", "in text", "제7조제1항", "제2조제3항", "제62조", "별표 1", "b law", "a law"]
    assert got[1] == ["제2조제3항", "제62조", "별표 1", "별표 3", "b law", "제4조", "in text", "제7조제1항", "a law"]
