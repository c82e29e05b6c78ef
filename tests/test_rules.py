from pyspark.sql import functions as F

from ledgerlark.operators import rules
from ledgerlark.plans import queries
from ledgerlark.sources.adapters import adapted

SF = "/root/testdata/sf0.001"


def test_document_frequency_counts_rules_of_all_types(spark):
    table = adapted(spark, SF, "rules")
    got = queries.QUERIES["a21_token_df"](spark, SF).agg(F.sum("df")).first()[0]
    assert rules.classifying(table).count() < table.count()
    assert got == rules.rule_tokens(table).count()
