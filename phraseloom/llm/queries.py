"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phraseloom.llm import queries_docs as D
from phraseloom.llm import queries_p1, queries_p2, queries_p3, queries_p4, queries_p6


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": queries_p1.p1_found,
        "p1_entries": queries_p1.p1_entries,
        "p2_found": queries_p2.p2_found,
        "p2_records": queries_p2.p2_records,
        "p3_found": queries_p3.p3_found,
        "p3_items": queries_p3.p3_items,
        "p4_found": queries_p4.p4_found,
        "p4_canonical": queries_p4.p4_canonical,
        "p4_classes": queries_p4.p4_classes,
        "p6_found": queries_p6.p6_found,
        "p6_terms": queries_p6.p6_terms,
        "p7_ids": D.p7_ids,
        "p7_roundtrip": D.p7_roundtrip,
        "p8_assign": D.p8_assign,
        "p8_fill": D.p8_fill,
        "p8_whole": D.p8_whole,
        "p9_found": D.p9_found,
        "p9_cuts": D.p9_cuts,
        "p9_sources": D.p9_sources,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": queries_p1.P1_SQL,
        "p1_entries": queries_p1.P1_ENTRIES_SQL,
        "p2_found": queries_p2.P2_SQL,
        "p2_records": queries_p2.P2_RECORDS_SQL,
        "p3_found": queries_p3.P3_SQL,
        "p4_found": queries_p4.P4_SQL,
        "p4_canonical": queries_p4.P4_CANONICAL_SQL,
        "p4_classes": queries_p4.P4_CLASSES_SQL,
        "p6_found": queries_p6.P6_SQL,
        "p6_terms": queries_p6.P6_TERMS_SQL,
        "p7_roundtrip": "SELECT doc_id, true AS same FROM documents",
        "p8_whole": "SELECT pack_kind, (SELECT count(*) FROM documents) AS documents, 0 AS wrong, 0 AS overfull FROM pack_sizes",
        "p9_found": D.P9_SQL,
        "p9_cuts": D.P9_CUTS_SQL,
        "p9_sources": D.P9_SOURCES_SQL,
    }
