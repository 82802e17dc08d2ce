"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.llm.heavy_hitters import frequent
from phraseloom.sources.tables import table

ONE_IN, LEAST_ROWS = 200, 10


def p3_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frequent value with its estimated and its exact count."""
    words = frequent(table(spark, sf_dir, "parsed_tokens").select("word"), "word", ONE_IN, LEAST_ROWS)
    phrases = frequent(table(spark, sf_dir, "mwe_matches").select("phrase"), "phrase", ONE_IN, LEAST_ROWS)
    return words.select(F.lit("word").alias("in_field"), "*").unionByName(phrases.select(F.lit("phrase").alias("in_field"), "*"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_items(spark, sf_dir).select("in_field", "item")


P3_SQL = """
SELECT 'word' AS in_field, word AS item FROM parsed_tokens WHERE word IS NOT NULL GROUP BY word
HAVING count(*) >= 10 AND count(*) * 200 >= (SELECT count(word) FROM parsed_tokens)
UNION ALL
SELECT 'phrase', phrase FROM mwe_matches WHERE phrase IS NOT NULL GROUP BY phrase
HAVING count(*) >= 10 AND count(*) * 200 >= (SELECT count(phrase) FROM mwe_matches)
"""
