"""Queries that go through files: lexicon, corrections and vocabularies are written, then read as a user's files are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.operators import lexicon, reclassify
from phraseloom.plans import sqltext as S
from phraseloom.plans.lineage import scratch_path
from phraseloom.sources import jsonl, vocab
from phraseloom.sources.tables import table

#: A lexicon by hand; ids above 3,000,000,000 are kept for such entries.
BY_HAND = (
    (3000000101, "hold the line", ("idiom",), "verb", "To wait on the telephone.", ("informal",), (("w", "hold"), ("w", "the"), ("w", "line"))),
    (3000000102, "by and large", ("fixed_collocation", "idiom"), "adv", None, (), (("w", "by"), ("w", "and"), ("w", "large"))),
    (3000000103, "take someone aside", ("phrasal_verb",), "verb", "To talk to in private.", (), (("w", "take"), ("slot",), ("w", "aside"))),
)
_COLUMNS = ("id", "phrase", "categories", "pos", "definition", "tags", "elements")


def lexicon_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a main lexicon file and of one by hand, both written and loaded again; a third, which is not there, is left out."""
    main, custom = scratch_path(spark), scratch_path(spark)
    jsonl.write_lexicon(table(spark, sf_dir, "core_lexicon"), main)
    jsonl.write_lexicon(spark.createDataFrame([tuple(map(_list, row)) for row in BY_HAND], jsonl.LEXICON_SCHEMA), custom)
    loaded = lexicon.load(spark, main, custom)
    alone = lexicon.load(spark, main, scratch_path(spark)).agg(F.count("*").alias("n"), F.max("entry_idx").alias("last")).first()
    flat = F.array_join(F.transform("elements", lambda e: F.array_join(e, ":")), " ")
    rows = loaded.select("id", "phrase", F.array_join("categories", "|").alias("categories"), "pos", "definition", F.array_join("tags", "|").alias("tags"), flat.alias("elements"))
    return rows.withColumns({"n_main": F.lit(alone.n), "last_idx": F.lit(alone.last)})


def _list(value):
    return [_list(v) for v in value] if isinstance(value, tuple) else value


def correction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections appended in two runs, read from their folder, laid over the idioms they are for."""
    path = scratch_path(spark)
    idioms = reclassify.idioms(table(spark, sf_dir, "lexicon_rows")).where("id is not null")
    firsts = idioms.groupBy("id").agg(F.min_by("categories", "rec_id").alias("categories"))
    for rest in (0, 1):  # each run has half of the ids
        part = firsts.where(F.col("id") % 2 == rest)
        jsonl.append_corrections(part.select("id", reclassify.rewrite(F.col("categories"), F.lit("fixed_collocation")).alias("categories")), path)
    fixes = jsonl.parse_corrections(jsonl.read_lines(spark, [path]), ["file_ord", "line_no"])
    return lexicon.apply_corrections(idioms.select("rec_id", "id", "categories"), fixes).select("rec_id", "id", F.array_join("categories", "|").alias("categories"))


def vocab_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label vocabularies written as one JSON file: relations and tags of the parsed tokens by rank, and their FEATS categories."""
    path = scratch_path(spark)
    tokens = table(spark, sf_dir, "parsed_tokens")
    names = lambda c: F.array_sort(F.collect_set(c))
    by_rank = lambda names: F.map_from_entries(F.transform(names, lambda x, i: F.struct(x, i)))
    sets = tokens.agg(F.lit(1).alias("one"), names("rel").alias("r"), names("upos").alias("u"))
    pairs = tokens.where("feats is not null and feats <> '_'").select(F.explode(F.split("feats", "[|]")).alias("p"))
    values = pairs.groupBy(F.substring_index("p", "=", 1).alias("c")).agg(names(F.substring_index("p", "=", -1)).alias("v"))
    values = values.agg(F.lit(1).alias("one"), F.map_from_entries(F.collect_list(F.struct("c", by_rank(F.concat(F.array(F.lit("_")), "v"))))).alias("feats_vocab"))
    whole = sets.join(values, "one").select(by_rank("r").alias("rel_vocab"), by_rank("u").alias("pos_vocab"), "feats_vocab")
    whole.coalesce(1).write.json(path)  # one row
    found = vocab.read(spark, path)
    rows = [("rel", "", i, x) for i, x in enumerate(found.rels)] + [("upos", "", i, x) for i, x in enumerate(found.upos)]
    rows += [("feats", c, i, x) for c, vs in found.feats for i, x in enumerate(vs)]
    return spark.createDataFrame(rows, "vocab string, category string, place int, label string")


QUERIES = {f.__name__: f for f in (lexicon_files, correction_files, vocab_file)}

_HAND = ", ".join(f"({i}, {S.q(p)}, {S.q('|'.join(c))}, {S.q(pos)}, {S.q(d) if d else 'NULL'}, {S.q('|'.join(t))}, {S.q(' '.join(':'.join(e) for e in es))})" for i, p, c, pos, d, t, es in BY_HAND)
_RANKED = "(row_number() OVER (PARTITION BY category ORDER BY v))::int"
SQL = {
    "lexicon_files": f"""WITH c AS (SELECT * FROM core_lexicon WHERE len(list_filter(elements, lambda e: e[1] = 'w')) >= 2)
SELECT *, (SELECT count(*) FROM c) AS n_main, (SELECT count(*) - 1 FROM c) AS last_idx FROM (
SELECT id, phrase, coalesce(array_to_string(categories, '|'), '') AS categories, pos, definition, coalesce(array_to_string(tags, '|'), '') AS tags, {S.flat('elements')} AS elements FROM c
UNION ALL SELECT * FROM (VALUES {_HAND}))""",
    "correction_files": """WITH i AS (SELECT * FROM lexicon_rows WHERE list_contains(categories, 'idiom') AND id IS NOT NULL),
f AS (SELECT id, list_transform(arg_min(categories, rec_id), lambda c: CASE WHEN c = 'idiom' THEN 'fixed_collocation' ELSE c END) AS r FROM i GROUP BY id)
SELECT rec_id, i.id, array_to_string(list_filter(r, lambda c, k: list_position(r, c) = k), '|') AS categories FROM i JOIN f ON i.id = f.id""",
    "vocab_file": f"""WITH p AS (SELECT DISTINCT split_part(p, '=', 1) AS category, split_part(p, '=', -1) AS v FROM (SELECT unnest(string_split(feats, '|')) AS p FROM parsed_tokens WHERE feats IS NOT NULL AND feats <> '_'))
SELECT 'rel' AS vocab, '' AS category, (row_number() OVER (ORDER BY rel) - 1)::int AS place, rel AS label FROM (SELECT DISTINCT rel FROM parsed_tokens WHERE rel IS NOT NULL)
UNION ALL SELECT 'upos', '', (row_number() OVER (ORDER BY upos) - 1)::int, upos FROM (SELECT DISTINCT upos FROM parsed_tokens WHERE upos IS NOT NULL)
UNION ALL SELECT 'feats', category, {_RANKED}, v FROM p UNION ALL SELECT DISTINCT 'feats', category, 0, '_' FROM p""",
}
