"""Operators of the audit: matching, rules, completeness, reports, logs, retrieval, evaluation, cleaning."""
