"""Queries of problem 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.llm.term_counts import marked, term_counts
from phraseloom.sources.tables import table


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its occurrences, records and mark."""
    tokens = table(spark, sf_dir, "parsed_tokens").select("sent_id", "lemma")
    n_sentences = tokens.select("sent_id").distinct().where("sent_id is not null").count()
    lemmas = marked(term_counts(tokens, "lemma", "sent_id"), n_sentences)
    rows = table(spark, sf_dir, "lexicon_rows")
    elements = rows.select("rec_id", F.explode("elements").alias("e")).where(F.get("e", 0) == "w").select("rec_id", F.get("e", 1).alias("lemma"))
    words = marked(term_counts(elements, "lemma", "rec_id"), rows.count())
    return lemmas.select(F.lit("lemma").alias("in_field"), "*").unionByName(words.select(F.lit("elements").alias("in_field"), "*"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_terms(spark, sf_dir).where("mark is not null").select("in_field", "term", "mark")


_TERMS = """
WITH t AS (
  SELECT 'lemma' AS in_field, lemma AS term, sent_id AS rec FROM parsed_tokens WHERE lemma <> ''
  UNION ALL SELECT 'elements', e[2], rec_id FROM (SELECT rec_id, unnest(elements) AS e FROM lexicon_rows) WHERE e[1] = 'w' AND e[2] <> ''),
c AS (SELECT in_field, term, count(*) AS occurrences, count(DISTINCT rec) AS records FROM t GROUP BY ALL),
n AS (SELECT 'lemma' AS in_field, count(DISTINCT sent_id) AS n FROM parsed_tokens UNION ALL SELECT 'elements', count(*) FROM lexicon_rows),
m AS (SELECT in_field, term, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records * 20 > n THEN 'common' END AS mark FROM c JOIN n USING (in_field))
"""
P6_TERMS_SQL = _TERMS + "SELECT * FROM m"
P6_SQL = _TERMS + "SELECT in_field, term, mark FROM m WHERE mark IS NOT NULL"
