"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from quakeloom.llm import chat_format, dataset_manifest, decontamination, license_scans, packing, periodic_runs, quality_classifier, quality_rules, secret_scans, simhash, suffix_dedup, url_filters, warc_fixity

MODULES = (url_filters, suffix_dedup, decontamination, secret_scans, quality_rules, chat_format, packing, warc_fixity, license_scans, simhash, dataset_manifest, quality_classifier, periodic_runs)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
