"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.llm import formatting
from phraseloom.sources.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = formatting.copies(table(spark, sf_dir, "raw_lines"), "line_no", "raw_text")
    return found.where("id <> first_id").select(F.col("first_id").alias("first_line_no"), F.col("id").alias("line_no"))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record once, by its first line, with its number of copies."""
    return formatting.distinct_records(table(spark, sf_dir, "raw_lines"), "line_no", "raw_text")


def _squeeze(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[\s\p{{P}}\p{{Z}}\p{{Cc}}\p{{Cf}}`´^~|<>=+$¨]+', '', 'g')"


def _members(x: str) -> str:
    return f"list_transform(json_extract_string({x}, '$[*]'), lambda m: 's' || coalesce({_squeeze('m')}, chr(0)))"


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort({_members(x)}), chr(1))"


def _keys(x: str) -> str:
    """Keys of an object but for those that are null."""
    return f"""list_filter(json_keys({x}), lambda k: json_type({x}, '$."' || k || '"') <> 'NULL')"""


def _at(x: str) -> str:
    return f"""json_extract({x}, '$."' || k || '"')"""


_SENSE = (
    f"array_to_string(list_sort(list_transform({_keys('s')}, lambda k: {_squeeze('k')} || chr(2) || CASE WHEN k IN ('categories', 'tags') "
    f"THEN {_sorted(_at('s'))} ELSE array_to_string({_members(_at('s'))}, chr(1)) END)), chr(3))"
)
# The records' own shape: strings and numbers, lists of strings, lists of lists, and senses.
_MEMBER = (
    f"CASE WHEN k IN ('categories', 'tags') THEN {_sorted(_at('j'))} "
    f"WHEN k = 'senses' THEN array_to_string(list_transform(json_extract({_at('j')}, '$[*]'), lambda s: {_SENSE}), chr(4)) "
    f"WHEN k = 'elements' THEN array_to_string(list_transform(json_extract({_at('j')}, '$[*]'), lambda s: array_to_string({_members('s')}, chr(1))), chr(4)) "
    f"WHEN json_type({_at('j')}) = 'VARCHAR' THEN 's' || {_squeeze(_at('j') + "->>'$'")} ELSE 'n' || {_at('j')}::varchar END"
)
_GROUPS = f"""
WITH r AS (SELECT line_no, raw_text::json AS j FROM raw_lines WHERE json_valid(raw_text) AND json_type(raw_text) = 'OBJECT'),
c AS (SELECT line_no, array_to_string(list_sort(list_transform({_keys('j')}, lambda k: {_squeeze('k')} || chr(5) || {_MEMBER})), chr(6)) AS canon FROM r),
g AS (SELECT line_no, min(line_no) OVER (PARTITION BY canon) AS first_line_no, count(*) OVER (PARTITION BY canon) AS copies FROM c)
"""
P2_SQL = _GROUPS + "SELECT first_line_no, line_no FROM g WHERE line_no <> first_line_no"
P2_RECORDS_SQL = _GROUPS + "SELECT line_no, copies FROM g WHERE line_no = first_line_no"
