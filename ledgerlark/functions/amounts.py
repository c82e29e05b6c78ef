"""Amounts: lenient numbers, comparable amounts, VAT, scores, weights, confidences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

VAT_RATE = 0.1
GATE_SHARE = 0.01
#: Weights of a document's scores. Fixed values.
WEIGHTS = {"amount": 0.55, "vendor": 0.25, "item_desc": 0.20}
#: Wage statements have no vendor. Fixed values.
WAGE_WEIGHTS = {"amount": 0.80, "vendor": 0.00, "item_desc": 0.20}
MATCHED, REVIEW = 0.85, 0.75
#: Documents whose amounts may come without VAT.
NET_TYPES = ("delivery_statement", "tax_invoice")


def lenient_amount(text: Column) -> Column:
    """`1,000원` is 1000; dashes, zero and less are null."""
    n = F.nullif(F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9.-]", ""), F.lit(""))
    value = n.try_cast("double").cast("long")
    return F.when(value > 0, value)


def leading_number(text: Column) -> Column:
    """`30개` is 30."""
    return F.nullif(F.regexp_extract(F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("")), r"^\s*(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")


def item_total(amount: Column, price: Column, quantity: Column) -> Column:
    """The stated amount, or else price times quantity."""
    return F.coalesce(amount, F.bround(price * quantity).cast("long"))


def document_amount(doc_type: Column, supply: Column, tax: Column, total: Column) -> Column:
    """Supply and tax of invoices and delivery statements that have both, or else the total."""
    return F.when(doc_type.isin(*NET_TYPES) & supply.isNotNull() & tax.isNotNull(), supply + tax).otherwise(total)


def line_amount(doc_type: Column, supply: Column, amount: Column, tax: Column) -> Column:
    """A line with VAT: its stated tax, or a tenth for invoices and delivery statements. A supply of 0 counts as missing."""
    net = F.coalesce(F.nullif(supply, F.lit(0)), amount)
    return F.when(tax.isNotNull(), net + tax).when(doc_type.isin(*NET_TYPES), F.bround(net * (1 + VAT_RATE)).cast("long")).otherwise(net)


def share_apart(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(a, b)


def within(a: Column, b: Column, share: float = GATE_SHARE) -> Column:
    return (F.greatest(a, b) > 0) & (share_apart(a, b) <= share)


def amount_score(a: Column, b: Column, apart: Column | None = None) -> Column:
    """1, 0.85, 0.65, 0.3 up to 1, 5, 10, 20 % apart; 0.3 if one is missing, null if both are; 1 if the larger is 0. apart is their share_apart, if that is a column already."""
    apart = share_apart(a, b) if apart is None else apart
    return (
        F.when(a.isNull() & b.isNull(), F.lit(None).cast("double"))
        .when(a.isNull() | b.isNull(), 0.3)
        .when(F.greatest(a, b) == 0, 1.0)
        .when(apart <= 0.01, 1.0)
        .when(apart <= 0.05, 0.85)
        .when(apart <= 0.10, 0.65)
        .when(apart <= 0.20, 0.30)
        .otherwise(0.0)
    )


def weighted(scores: dict[str, Column], doc_type: Column) -> Column:
    """The mean of the scores that there are, by the weights of the document's type; 0 without weight. 4 digits."""

    def weight(k: str) -> Column:
        return F.when(doc_type == "wage_statement", WAGE_WEIGHTS[k]).otherwise(WEIGHTS[k])

    used = reduce(lambda x, y: x + y, [F.when(v.isNotNull(), weight(k)).otherwise(0.0) for k, v in scores.items()])
    total = reduce(lambda x, y: x + y, [F.when(v.isNotNull(), weight(k) * v).otherwise(0.0) for k, v in scores.items()])
    return F.when(used == 0, 0.0).otherwise(F.bround(total / used, 4))


def match_status(score: Column) -> Column:
    return F.when(score >= MATCHED, "matched").when(score >= REVIEW, "review_needed").otherwise("unmatched")


def price_integrity(price: Column, quantity: Column, amount: Column) -> Column:
    """Whether price times quantity differs from the amount by more than 1 and 1 %; null if one is missing."""
    return F.abs(F.bround(price * quantity) - amount) > F.greatest(F.lit(1.0), amount * 0.01)


def vat_plausible(total: Column, tax: Column) -> Column:
    return F.abs(tax - F.bround(total / 11)) <= 10


def reconciliation(header: Column, lines: Column, lines_with_tax: Column) -> Column:
    """ok up to 1, warning up to 10, else error: the header's amount from the nearer sum of lines."""
    apart = F.least(F.abs(header - lines), F.abs(header - lines_with_tax))
    return F.when(apart <= 1, "ok").when(apart <= 10, "warning").otherwise("error")


def candidate_confidence(top: Column, second: Column) -> Column:
    value = 0.35 + 0.55 * (top / (top + second + 1.0)) * F.least(top / 6.0, F.lit(1.0))
    return F.when(top.isNull(), 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(value, F.lit(0.95))), 2))


def validator_confidence(top: Column, rival: Column, n_matches: Column) -> Column:
    """Of the best score, the weaker side's and the number of matches."""
    value = 0.3 + 0.45 * (top / (top + rival + 1.0)) + 0.2 * F.least(top / 18.0, F.lit(1.0)) + 0.05 * F.least(n_matches / 3.0, F.lit(1.0))
    return F.when(F.coalesce(top, F.lit(0.0)) <= 0, 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(value, F.lit(0.95))), 2))


def vote_confidence(top: Column, total: Column) -> Column:
    return F.when(total.isNull(), 0.0).otherwise(F.bround(F.greatest(F.lit(0.0), F.least(0.35 + 0.60 * top / total, F.lit(0.95))), 2))


def recognised(amount: Column, cap: Column) -> tuple[Column, Column]:
    """What of an amount a cap leaves, and what it disputes."""
    return F.when(cap.isNull(), amount).otherwise(F.least(amount, cap)), F.when(cap.isNull(), F.lit(0)).otherwise(F.greatest(amount - cap, F.lit(0)))
