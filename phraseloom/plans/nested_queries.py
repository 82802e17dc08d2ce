"""Queries of problem 5: nested records as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.operators import nested
from phraseloom.plans.lineage import scratch_path
from phraseloom.sources.tables import table

#: The arrays of both kinds of records and their tables.
WIKI_TAGS = {"categories": "category", "senses": "sense", "senses.categories": "sense_category", "senses.tags": "sense_tag", "senses.glosses": "gloss"}
RESULT_TAGS = {"tokens": "token", "mwes": "mwe", "mwes.categories": "mwe_category", "mwes.token_ids": "mwe_token", "mwes.words": "mwe_word"}


def _wiki(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every table of the dump's entries, with its payload."""
    return nested.emit_tagged(table(spark, sf_dir, "wiki_dump"), "entry_id", WIKI_TAGS, root_tag="entry")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of every table of the parsed sentences; a result delivered twice counts once."""
    once = nested.distinct_records(table(spark, sf_dir, "sentence_results"), "sent_id", ["tokens", "mwes"])
    return nested.emit_tagged(once, "sent_id", RESULT_TAGS, root_tag="result")


def flat_tables(spark: SparkSession, sf_dir: str) -> str:
    """Folder of all flat tables of both kinds of records: a single pass over each, written partitioned by tag."""
    path = scratch_path(spark)
    nested.write_tables(_wiki(spark, sf_dir), path)
    nested.write_tables(_results(spark, sf_dir), path, mode="append")
    return path


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of five of the tables, read from the written ones."""
    rows = spark.read.parquet(flat_tables(spark, sf_dir)).where(F.col("tag").isin("sense", "gloss", "token", "mwe", "mwe_token"))
    place = lambda i: F.coalesce(F.get("positions", i), F.lit(-1))
    return rows.select(F.col("tag").cast("string").alias("child"), "root_id", place(0).alias("pos_1"), place(1).alias("pos_2"))


def _named(tagged: DataFrame, tag: str, schema: str, **names: str) -> DataFrame:
    places = sum(old.startswith("pos_") for old in names)
    return nested.as_table(tagged, tag, schema, places).withColumnsRenamed(names)


def p5_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records' own table: what an entry holds besides its arrays."""
    return _named(_wiki(spark, sf_dir), "entry", "word string, pos string, lang_code string", root_id="entry_id")


def p5_glosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The glosses' table with its payload."""
    return _named(_wiki(spark, sf_dir), "gloss", "value string", root_id="entry_id", pos_1="sense_pos", pos_2="gloss_pos", v_value="gloss")


def p5_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the senses' categories."""
    return _named(_wiki(spark, sf_dir), "sense_category", "value string", root_id="entry_id", pos_1="sense_pos", pos_2="category_pos", v_value="category")


def p5_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the senses' tags."""
    return _named(_wiki(spark, sf_dir), "sense_tag", "value string", root_id="entry_id", pos_1="sense_pos", pos_2="tag_pos", v_value="tag")


def p5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens' table with its payload."""
    schema = "id int, word string, lemma string, head int, rel string, upos string, feats string"
    return _named(_results(spark, sf_dir), "token", schema, root_id="sent_id", pos_1="token_pos")


def p5_mwes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matches' table with its payload."""
    schema = "id bigint, pos string, phrase string, definition string, has_slot boolean, surface string, discontinuous boolean"
    return _named(_results(spark, sf_dir), "mwe", schema, root_id="sent_id", pos_1="mwe_pos")


def p5_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of the matches' words."""
    return _named(_results(spark, sf_dir), "mwe_word", "value string", root_id="sent_id", pos_1="mwe_pos", pos_2="word_pos", v_value="word")


QUERIES = {f.__name__: f for f in (p5_found, p5_entries, p5_glosses, p5_categories, p5_tags, p5_tokens, p5_mwes, p5_words)}

_RESULTS = "(SELECT DISTINCT sent_id, tokens, mwes FROM sentence_results)"
_SENSES = "(SELECT entry_id, generate_subscripts(senses, 1) - 1 AS p, unnest(senses) AS s FROM wiki_dump)"
_of_senses = lambda field: f"(SELECT entry_id, p, generate_subscripts(s.{field}, 1) - 1 AS q, unnest(s.{field}) AS g FROM {_SENSES} WHERE s IS NOT NULL)"
_GLOSSES = _of_senses("glosses")
_TOKENS = f"(SELECT sent_id, generate_subscripts(tokens, 1) - 1 AS p, unnest(tokens) AS t FROM {_RESULTS})"
_MWES = f"(SELECT sent_id, generate_subscripts(mwes, 1) - 1 AS p, unnest(mwes) AS m FROM {_RESULTS})"
_of_mwes = lambda field: f"(SELECT sent_id, p, generate_subscripts(m.{field}, 1) - 1 AS q, unnest(m.{field}) AS t FROM {_MWES} WHERE m IS NOT NULL)"
_MWE_TOKENS = _of_mwes("token_ids")

SQL = {
    "p5_found": f"""
SELECT 'sense' AS child, entry_id AS root_id, p::int AS pos_1, -1 AS pos_2 FROM {_SENSES} WHERE s IS NOT NULL
UNION ALL SELECT 'gloss', entry_id, p::int, q::int FROM {_GLOSSES} WHERE g IS NOT NULL
UNION ALL SELECT 'token', sent_id, p::int, -1 FROM {_TOKENS} WHERE t IS NOT NULL
UNION ALL SELECT 'mwe', sent_id, p::int, -1 FROM {_MWES} WHERE m IS NOT NULL
UNION ALL SELECT 'mwe_token', sent_id, p::int, q::int FROM {_MWE_TOKENS} WHERE t IS NOT NULL
""",
    "p5_entries": "SELECT entry_id, word AS v_word, pos AS v_pos, lang_code AS v_lang_code FROM wiki_dump",
    "p5_glosses": f"SELECT entry_id, p::int AS sense_pos, q::int AS gloss_pos, g AS gloss FROM {_GLOSSES} WHERE g IS NOT NULL",
    "p5_categories": f"SELECT entry_id, p::int AS sense_pos, q::int AS category_pos, g AS category FROM {_of_senses('categories')} WHERE g IS NOT NULL",
    "p5_tags": f"SELECT entry_id, p::int AS sense_pos, q::int AS tag_pos, g AS tag FROM {_of_senses('tags')} WHERE g IS NOT NULL",
    "p5_tokens": f"""
SELECT sent_id, p::int AS token_pos, t.id AS v_id, t.word AS v_word, t.lemma AS v_lemma, t.head AS v_head, t.rel AS v_rel, t.upos AS v_upos, t.feats AS v_feats
FROM {_TOKENS} WHERE t IS NOT NULL""",
    "p5_mwes": f"""
SELECT sent_id, p::int AS mwe_pos, m.id AS v_id, m.pos AS v_pos, m.phrase AS v_phrase, m.definition AS v_definition, m.has_slot AS v_has_slot,
  m.surface AS v_surface, m.discontinuous AS v_discontinuous FROM {_MWES} WHERE m IS NOT NULL""",
    "p5_words": f"SELECT sent_id, p::int AS mwe_pos, q::int AS word_pos, t AS word FROM {_of_mwes('words')} WHERE t IS NOT NULL",
}
