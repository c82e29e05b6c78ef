"""Names of laws: what a rule cites, full names for bare articles in a reason, and the order in which laws are shown. Column expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Laws, and the articles that stand for them where no law is named. Fixed values.
NOTICE = "건설업 산업안전보건관리비 계상 및 사용기준"
ARTICLES_OF = {
    "산업안전보건법": ["제5조", "제10조", "제11조", "제14조", "제15조", "제16조", "제17조", "제18조", "제19조", "제24조", "제25조", "제29조", "제36조", "제62조", "제63조", "제64조", "제72조", "제73조", "제80조", "제83조", "제84조", "제125조", "제129조"],
    "산업안전보건법 시행령": ["제74조", "제75조", "제77조", "제89조"],
    "산업안전보건법 시행규칙": ["제98조"],
    "중대재해처벌법 시행령": ["제4조", "제4조제2호", "제4조제2호나목"],
    "건설기술진흥법": ["제62조의3"],
    "응급의료에 관한 법률": ["제47조의2"],
}
FULL_NAMES = {a: f"{law} {a}" for law, articles in ARTICLES_OF.items() for a in articles}
CATEGORY_LAWS = {f"CAT_0{i}": f"{NOTICE} 제7조제1항제{i}호" for i in range(1, 10)}
#: Patterns of a named law with its article, of an article or annex by itself, of one that nothing in Hangul stands right before, and of a conclusion said twice. Fixed values.
NAMED = r"(산업안전보건법(?:\s*시행령|\s*시행규칙)?|건설업\s*산업안전보건관리비\s*계상\s*및\s*사용기준|중대재해\s*처벌\s*등에\s*관한\s*법률(?:\s*시행령)?|건설기술\s*진흥법|응급의료에\s*관한\s*법률)\s*(제\d+조(?:제\d+항)?(?:제\d+호)?)"
ARTICLE = r"제\d+조(?:제\d+항)?(?:제\d+호)?|별표\s*\d+"
BARE = r"(?<![가-힣])(제\d+조(?:\s*제\d+항)?(?:\s*제\d+호)?)"
TWICE = r"(허용됩니다|사용이 가능합니다|불허됩니다|사용이 불가합니다)\s*[.\s]+(허용됩니다|사용이 가능합니다|불허됩니다|사용이 불가합니다)[.\s]*$"
#: Characters before an article in which a name may stand, and of a reason that is kept.
NEAR, LONGEST_REASON = 30, 1000


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def full_name(article: Column) -> Column:
    """The article with the name of its law: its own, or that of the article it is part of; else as it is."""
    bare = F.trim(article)
    base = F.regexp_extract(bare, r"^(제\d+조)", 1)
    return F.coalesce(_looked_up(FULL_NAMES, bare), F.concat(_looked_up(FULL_NAMES, base), F.substring(bare, F.length(base) + 1, F.length(bare))), bare)


def rule_laws(basis: Column, body: Column, category: Column) -> Column:
    """The distinct laws of a rule: its basis (parts by |) with full names, laws named in its text, bare articles of the text that no law so far has in it, and the category's own."""
    parts = F.split(F.trim(F.coalesce(basis, F.lit(""))), r"\|")
    first = F.when(F.trim(F.coalesce(basis, F.lit(""))) != "", F.array(F.array_join(F.transform(parts, full_name), " | "))).otherwise(F.array().cast("array<string>"))
    said = F.coalesce(body, F.lit(""))
    named = F.zip_with(F.regexp_extract_all(said, F.lit(NAMED), F.lit(1)), F.regexp_extract_all(said, F.lit(NAMED), F.lit(2)), lambda law, article: F.concat_ws(" ", F.trim(law), article))
    start = F.array_distinct(F.concat(first, named))
    bare = F.regexp_extract_all(said, F.lit(f"({ARTICLE})"), F.lit(1))
    known = lambda laws, article: F.array_contains(laws, full_name(article)) | F.exists(laws, lambda law: F.contains(law, article))
    out = F.aggregate(bare, start, lambda laws, article: F.when(known(laws, article), laws).otherwise(F.array_append(laws, full_name(article))))
    own = _looked_up(CATEGORY_LAWS, F.coalesce(category, F.lit("")))
    return F.when(own.isNotNull(), F.array_union(out, F.array(own))).otherwise(out)


def with_full_names(reason: Column, laws: Column) -> Column:
    """A reason whose bare articles have the name of the longest of its laws that has them; articles with Hangul in the 30 characters before are left."""
    full = F.filter(laws, lambda law: F.rlike(law, F.lit("[가-힣]{2,}")))
    by_length = F.transform(F.array_sort(F.transform(full, lambda law, i: F.struct((-F.length(law)).alias("less"), i.alias("at"), law.alias("law")))), lambda x: x["law"])
    gaps, found = F.split(reason, BARE, -1), F.regexp_extract_all(reason, F.lit(BARE), F.lit(1))

    def step(acc: Column, x: Column) -> Column:
        before = F.concat(acc["seen"], x["gap"])
        bare = F.replace(x["found"], F.lit(" "), F.lit(""))
        plain = lambda law: F.replace(law, F.lit(" "), F.lit(""))
        best = F.get(F.filter(by_length, lambda law: (F.contains(plain(law), bare) & (plain(law) != bare)) | F.startswith(plain(law), bare)), F.lit(0))
        named = F.rlike(F.right(before, F.lit(NEAR)), F.lit("[가-힣]{2,}"))
        shown = F.when(named, x["found"]).otherwise(F.coalesce(best, x["found"]))
        return F.struct(F.concat(before, x["found"]).alias("seen"), F.concat(acc["out"], x["gap"], shown).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("found")))
    empty = F.struct(F.lit("").alias("seen"), F.lit("").alias("out"))
    return F.concat(F.aggregate(pairs, empty, step)["out"], F.element_at(gaps, -1))


def item_reason(reason: Column, laws: Column) -> Column:
    """A reason as it is logged: a conclusion said twice is said once, bare articles have names, 1000 characters at most."""
    once = F.trim(F.regexp_replace(F.coalesce(reason, F.lit("")), TWICE, r"$1."))
    return F.substring(F.when(F.size(F.coalesce(laws, F.array().cast("array<string>"))) > 0, with_full_names(once, laws)).otherwise(once), 1, LONGEST_REASON)


def prioritised(laws: Column, required_rate: Column, exceeded: Column, context: Column, item_laws: Column) -> Column:
    """Distinct laws in the order they are shown: of progress, of an exceeded cap, of the items, of the context, then by kind, then as they came. Empty and null ones are left out."""

    def place(law: Column) -> Column:
        said = F.contains(F.coalesce(context, F.lit("")), law)
        detailed = F.contains(law, F.lit("제")) & (F.contains(law, F.lit("항")) | F.contains(law, F.lit("호")))
        return (
            F.when(required_rate.isNotNull() & (F.contains(law, F.lit("별표 3")) | F.contains(law, F.lit("공사진척"))), 0)
            .when(exceeded & F.startswith(law, F.lit("제4조")), 1)
            .when(exceeded & said, 2)
            .when(F.array_contains(item_laws, law) & detailed, 3)
            .when(said, 4)
            .when(F.startswith(law, F.lit("제2조")), 5)
            .when(F.startswith(law, F.lit("제62조")), 6)
            .when(F.startswith(law, F.lit("별표")), 7)
            .otherwise(8)
        )

    distinct = F.array_distinct(F.filter(laws, lambda law: law != ""))
    return F.transform(F.array_sort(F.transform(distinct, lambda law, i: F.struct(place(law).alias("place"), i.alias("at"), law.alias("law")))), lambda x: x["law"])
