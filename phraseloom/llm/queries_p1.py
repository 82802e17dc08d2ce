"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.llm import representative as R
from phraseloom.plans.lineage import cut_lineage
from phraseloom.sources.tables import table

FIELDS = {"definition": "string", "categories": "array<string>", "tags": "array<string>"}
GROUP = ["headword", "pos"]


def grouped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon rows with their headword key and the trust of their origin; fields are reduced before anything is joined."""
    words = table(spark, sf_dir, "wiki_dump").select("entry_id", R.headword_key(F.col("word")).alias("headword")).where("headword is not null")
    trust = table(spark, sf_dir, "origin_trust").groupBy("origin").agg(F.max("trust").alias("trust"))
    rows = table(spark, sf_dir, "lexicon_rows").where("entry_id is not null and pos is not null")
    narrow = R.reduced(rows.select("rec_id", "entry_id", "pos", "origin", "updated_at", *FIELDS), FIELDS)
    return narrow.join(trust, "origin", "left").drop("origin").join(words, "entry_id").drop("entry_id")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut_lineage(grouped_rows(spark, sf_dir))  # narrow; votes and group sizes read it
    best = R.winners(rows, GROUP, "rec_id", FIELDS, "trust", "updated_at")
    groups = rows.groupBy(*GROUP).agg(F.min("rec_id").alias("first_rec_id"), F.count("*").alias("n")).where("n >= 2")
    return best.join(groups, GROUP).select("first_rec_id", "in_field", F.col("best_id").alias("best_rec_id"))


def p1_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One entry per headword and part of speech, groups of one row included."""
    best = R.winners(grouped_rows(spark, sf_dir), GROUP, "rec_id", FIELDS, "trust", "updated_at")
    whole = R.survivors(table(spark, sf_dir, "lexicon_rows"), best, GROUP, "rec_id", FIELDS)
    return whole.withColumns({"categories": F.array_join("categories", "|"), "tags": F.array_join("tags", "|")})


_VALUES = r"""
WITH g AS (
  SELECT lower(trim(regexp_replace(replace(w.word, '’', ''''), '\s+', ' ', 'g'))) AS headword, l.*
  FROM lexicon_rows l JOIN wiki_dump w USING (entry_id) WHERE l.pos IS NOT NULL AND w.word IS NOT NULL),
n AS (SELECT headword, pos, min(rec_id) AS first_rec_id FROM g GROUP BY ALL HAVING count(*) >= 2),
v AS (
  SELECT headword, pos, rec_id, updated_at, 'definition' AS in_field FROM g
    WHERE definition IS NOT NULL AND lower(trim(definition)) NOT IN ('', '-', '—', '?', 'n/a', 'tbd')
  UNION ALL SELECT headword, pos, rec_id, updated_at, 'categories' FROM g WHERE len(list_filter(categories, lambda x: trim(x) <> '')) > 0
  UNION ALL SELECT headword, pos, rec_id, updated_at, 'tags' FROM g WHERE len(list_filter(tags, lambda x: trim(x) <> '')) > 0),
b AS (SELECT headword, pos, in_field, arg_max(rec_id, coalesce(epoch_us(updated_at), -1)) AS best_rec_id FROM v GROUP BY ALL)
"""
P1_SQL = _VALUES + "SELECT first_rec_id, in_field, best_rec_id FROM b JOIN n USING (headword, pos)"
_FIELD = "max({1}) FILTER (WHERE in_field = '{0}') AS {0}, max(best_rec_id) FILTER (WHERE in_field = '{0}') AS {0}_from"
P1_ENTRIES_SQL = (
    _VALUES
    + "SELECT b.headword, b.pos, "
    + ", ".join(_FIELD.format(f, f"l.{f}" if kind == "string" else f"array_to_string(l.{f}, '|')") for f, kind in FIELDS.items())
    + " FROM b JOIN lexicon_rows l ON l.rec_id = b.best_rec_id GROUP BY b.headword, b.pos"
)
