"""Nested values: JSON results of varying shape, vocabularies, usage records, item lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Places in a log's details that may hold a list of results.
RESULT_KEYS = ("results", "items", "item_results", "category_results", "result")
#: What a result code means for an item. Fixed values.
DECISIONS = {
    "appropriate": ["ok", "appropriate", "pass", "success", "적정", "적절"],
    "needs_review": ["warning", "needs_review", "needsreview", "conditional", "hil", "human_in_loop", "review_required", "검토필요", "조건부"],
    "inappropriate": ["error", "fail", "failed", "failure", "inappropriate", "부적정", "부적절"],
}
SEVERITY = {"appropriate": 0, "needs_review": 1, "inappropriate": 2}
ROW = "array<map<string,string>>"


def decision(code: Column) -> Column:
    """appropriate, needs_review or inappropriate; null for an unknown code."""
    plain = F.lower(F.trim(code))
    out = F.lit(None).cast("string")
    for name, codes in DECISIONS.items():
        out = F.when(plain.isin(*codes), name).otherwise(out)
    return out


def severity(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in SEVERITY.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def severity_name(level: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in SEVERITY.items():
        out = F.when(level == v, k).otherwise(out)
    return out


def result_rows(details: Column) -> Column:
    """The rows of every list of results in details, at its root and under payload, in this order."""
    paths = [f"$.{p}{k}" for p in ("", "payload.") for k in RESULT_KEYS]
    empty = F.array().cast(ROW)
    return F.concat(*[F.coalesce(F.from_json(F.get_json_object(details, p), ROW), empty) for p in paths])


def item_id(row: Column) -> Column:
    """The first of three keys that holds a whole number."""
    return F.coalesce(*[F.try_element_at(row, F.lit(k)).try_cast("long") for k in ("usage_statement_item_id", "item_id", "id")])


def tokens_used(usage: Column) -> Column:
    """input, cached, output and total tokens of a usage record in any provider's spelling; cached is part of the input."""

    def first(*keys: str) -> Column:
        return F.coalesce(*[F.get_json_object(usage, f"$.{k}").try_cast("long") for k in keys])

    got_in = F.coalesce(first("input_tokens", "prompt_tokens", "promptTokenCount"), F.lit(0))
    out = F.coalesce(first("output_tokens", "completion_tokens", "candidatesTokenCount"), F.lit(0))
    cached = F.coalesce(first("cached_input_tokens", "prompt_tokens_details.cached_tokens", "cachedContentTokenCount"), F.lit(0))
    total = F.coalesce(first("total_tokens", "totalTokenCount"), got_in + out)
    return F.struct(got_in.alias("input"), F.least(F.greatest(cached, F.lit(0)), got_in).alias("cached"), out.alias("output"), F.greatest(total, got_in + out).alias("total"))


def merged_detail(detail: Column, patch: Column) -> Column:
    """detail with the patch's entries; the patch wins."""
    old = F.coalesce(detail, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(old, lambda k, _: ~F.coalesce(F.map_contains_key(patch, k), F.lit(False)))
    return F.map_concat(kept, F.coalesce(patch, F.create_map().cast("map<string,string>")))


def photo_codes(required: Column, allowed: Column, item_name: Column) -> Column:
    """Required codes that are allowed, sorted: of helmets and belts a wearing photo instead of a site photo, of others no photo."""
    both = F.array_intersect(required, allowed)
    worn = F.rlike(item_name, F.lit("안전모|헬멧|안전벨트|안전대|안전띠|helmet|belt"))
    bare = F.array_except(both, F.array(F.lit("site_photo"), F.lit("wearing_photo")))
    return F.array_sort(F.when(worn, F.array_union(bare, F.array(F.lit("wearing_photo")))).otherwise(bare))
