"""Queries over the lexicon: sources, builder, corrections, reclassification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.functions import pattern
from phraseloom.operators import builder, lexicon, reclassify
from phraseloom.plans import sqltext as S
from phraseloom.sources import jsonl
from phraseloom.sources.tables import table

#: The builder's targets for the categories that the test tables hold.
CONFIG = builder.BuilderConfig(
    target_categories={
        "English figures of speech": "idiom",
        "English sayings": "proverb",
        "English verbs": "phrasal_verb",
        "English terms with": "fixed_collocation",
    },
    lang_code="en",
    pos_filter={"fixed_collocation": ("verb", "phrase", "adv", "prep_phrase"), "phrasal_verb": ("verb",)},
    phrase_blocklist=(*builder.DEFAULT_CONFIG.phrase_blocklist, "call past", "win the sail"),
)


def _joined(column: str):
    return F.array_join(column, "|")


def _flat(df: DataFrame) -> DataFrame:
    elements = F.array_join(F.transform("elements", lambda e: F.array_join(e, ":")), " ")
    return df.withColumns({"categories": _joined("categories"), "tags": _joined("tags"), "elements": elements})


def _dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "wiki_dump").select("entry_id", "word", "pos", "lang_code", "categories", "senses")


def _core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "core_lexicon")


def _custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries entered by hand: the second file of a load."""
    rows = table(spark, sf_dir, "lexicon_rows").where("entry_id is null")
    return rows.select("id", "phrase", "categories", "pos", "definition", "tags", "elements", "rec_id")


def _all_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = _core(spark, sf_dir).withColumn("rec_id", F.lit(0).cast("bigint"))
    return lexicon.with_entry_index(lexicon.union_in_order([core, _custom(spark, sf_dir)]), ["file_ord", "rec_id", "id"]).drop("rec_id", "file_ord")


def lexicon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good lexicon entries among raw lines."""
    rows = jsonl.parse_lexicon(table(spark, sf_dir, "raw_lines").select("line_no", F.col("raw_text").alias("line")))
    return _flat(rows).select("line_no", "id", "phrase", "categories", "pos", "definition", "tags", "elements")


def wiki_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Good dump entries among raw lines, with what they hold."""
    rows = jsonl.parse_wiki(table(spark, sf_dir, "raw_lines").select("line_no", F.col("raw_text").alias("line")))
    count = lambda name: F.coalesce(F.aggregate("senses", F.lit(0), lambda a, s: a + F.coalesce(F.size(s[name]), F.lit(0))), F.lit(0))
    return rows.where("word is not null").select("line_no", "word", "pos", "lang_code", _joined("categories").alias("categories"), F.size("senses").alias("n_senses"), count("glosses").alias("n_glosses"))


def lexicon_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(_all_entries(spark, sf_dir)).select("entry_idx", "id", "phrase", "categories", "elements")


def first_lemma_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexicon.first_lemma_index(_all_entries(spark, sf_dir))
    return found.select("first_lemma", "block", F.size("entries").alias("n"), F.array_join(F.transform("entries", lambda x: x.cast("string")), ",").alias("entries"))


def corrections_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon rows, with the categories of the last correction of their id (the rows of the editors serve as corrections)."""
    rows = table(spark, sf_dir, "lexicon_rows")
    fixes = rows.where("origin = 'editors' and categories is not null").groupBy("id").agg(F.max_by("categories", "rec_id").alias("categories"))
    fixed = lexicon.apply_corrections(rows.select("rec_id", "id", "phrase", "categories"), fixes)
    return fixed.withColumn("categories", _joined("categories"))


def correction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections read from JSON lines (any line with an id and categories), last one per id."""
    lines = table(spark, sf_dir, "raw_lines").select("line_no", F.col("raw_text").alias("line"))
    return jsonl.parse_corrections(lines, ["line_no"]).withColumn("categories", _joined("categories"))


def builder_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builder.in_language(_dump(spark, sf_dir), CONFIG).select("entry_id", "word")


def builder_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = builder.with_types(_dump(spark, sf_dir), CONFIG)
    return rows.select("entry_id", _joined("types").alias("types"), "first_gloss", _joined("sense_tags").alias("sense_tags"))


def builder_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = builder.build(_dump(spark, sf_dir), CONFIG, ["entry_id"])
    return _flat(built).select("entry_id", "phrase", "categories", "pos", "definition", "tags", "elements")


def builder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builder.build_stats(_dump(spark, sf_dir), CONFIG, ["entry_id"])


def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phraseloom.functions.hashing import phrase_id

    words = table(spark, sf_dir, "wiki_dump").select("word").where("word is not null").distinct()
    return words.select("word", phrase_id("word").alias("id"))


def idiom_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reclassify.idioms(table(spark, sf_dir, "lexicon_rows")).select("rec_id", "phrase")


def _open_idioms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lexicon_rows")
    done = rows.where("origin = 'editors'").select("id")
    return reclassify.unprocessed(reclassify.idioms(rows), done)


def anti_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idioms whose id no row of the editors has."""
    return _open_idioms(spark, sf_dir).select("rec_id", "id")


def llm_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reclassify.batches(_open_idioms(spark, sf_dir).select("rec_id", "id"), ["rec_id"]).select("rec_id", "batch", "batch_pos")


def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and text of the prompt lines of each batch."""
    rows = reclassify.batches(_open_idioms(spark, sf_dir).select("rec_id", "id", "phrase", "definition"), ["rec_id"])
    lines = reclassify.prompts(rows, "{count}\n{lines}")
    return lines.select("batch", "prompt")


def _labels(rows: DataFrame) -> DataFrame:
    """Stand-in labels with their places: by the id's remainder, some missing, some repeated with another kind, some of ids of no entry."""
    kinds = F.when(F.col("id") % 4 == 0, F.array(F.lit("idiom"), F.lit("fixed"))).when(F.col("id") % 4 == 1, F.array(F.lit("fixed"), F.lit("idiom"))).when(F.col("id") % 4 == 2, F.array(F.lit("other")))
    ids = rows.select("id").distinct()
    known = ids.select("id", F.posexplode(kinds).alias("place", "kind"))
    return known.unionByName(ids.select((-F.col("id")).alias("id"), F.lit(0).alias("place"), F.lit("fixed").alias("kind")))


def category_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Idioms with the categories that the last label of their id gives."""
    rows = reclassify.idioms(table(spark, sf_dir, "lexicon_rows"))
    out = reclassify.relabel(rows, _labels(rows), "place")
    return out.groupBy("id", _joined("categories").alias("categories"), "reclassified").agg(F.count("*").alias("n"))


def _answers(batched: DataFrame) -> DataFrame:
    """(batch, answer): stand-in answers, each with all labels of its batch twice, the second time by the id's remainder,
    then a label of every entry of the next batch, which counts only for an entry that has the same id here."""
    label = lambda x, kind: F.concat(F.lit('{"id":'), x["id"], F.lit(',"kind":"'), kind, F.lit('"}'))
    first = F.transform("_l", lambda x: label(x, F.lit("fixed")))
    second = F.transform("_l", lambda x: label(x, F.when(x["id"] % 4 == 0, "fixed").otherwise("idiom")))
    ids = batched.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("batch_pos", "id"))).alias("_l"))
    following = ids.select((F.col("batch") - 1).alias("batch"), F.transform("_l", lambda x: label(x, F.lit("fixed"))).alias("_foreign"))
    both = ids.join(following, "batch", "left")
    inner = F.concat(F.lit('{"results":['), F.array_join(F.concat(first, second, F.coalesce("_foreign", F.array().cast("array<string>"))), ","), F.lit("]}"))
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(inner.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    return both.select("batch", answer.alias("answer"))


def reclassified_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open idioms relabelled from the answers to their batches."""
    rows = reclassify.batches(_open_idioms(spark, sf_dir).select("rec_id", "id", "categories"), ["rec_id"])
    out = reclassify.relabel(rows, reclassify.labels_in(_answers(rows)), "place")
    return out.groupBy("id", _joined("categories").alias("categories"), "reclassified").agg(F.count("*").alias("n"))


def reclassify_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: entries processed, entries reclassified, batches."""
    rows = _open_idioms(spark, sf_dir)
    out = reclassify.relabel(rows, _labels(rows), "place")
    return out.agg(
        F.count("*").alias("processed"), F.count_if("reclassified").alias("reclassified"), F.ceil(F.count("*") / reclassify.C.BATCH_SIZE).alias("batches")
    )


def json_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels found in answers that wrap JSON in JSON."""
    rows = table(spark, sf_dir, "core_lexicon").select("id")
    inner = F.concat(F.lit('{"results":[{"id":'), F.col("id"), F.lit(',"kind":"'), F.when(F.col("id") % 2 == 0, "fixed").otherwise("idiom"), F.lit('"}]}'))
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(inner.alias("text"))).alias("parts")).alias("content"))).alias("candidates")))
    label = F.get(reclassify.labels_of(answer), 0)
    return rows.select("id", label["id"].alias("label_id"), label["kind"].alias("kind"))


QUERIES = {
    f.__name__: f
    for f in (
        lexicon_lines, wiki_lines, lexicon_load, first_lemma_index, corrections_overlay, correction_lines, builder_filters, builder_categories, builder_lexicon,
        builder_stats, hash_ids, idiom_selection, anti_cache, llm_batches, prompt_lines, category_rewrite, reclassified_batches, reclassify_stats, json_pointer,
    )
}



def _j(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN len({c}) = 0 THEN '' ELSE array_to_string({c}, '|') END"


_FIXED = "len(list_filter(elements, lambda e: e[1] = 'w'))"
_ENTRIES = f"""(SELECT row_number() OVER (ORDER BY file_ord, rec_id, id) - 1 AS entry_idx, * FROM (
SELECT 0 AS file_ord, 0 AS rec_id, id, phrase, categories, pos, definition, tags, elements FROM core_lexicon UNION ALL
SELECT 1, rec_id, id, phrase, categories, pos, definition, tags, elements FROM lexicon_rows WHERE entry_id IS NULL) WHERE {_FIXED} >= 2)"""

_GOOD_STRINGS = "CASE json_type(j, '$.{0}') WHEN 'ARRAY' THEN len(list_filter(json_extract(j, '$.{0}[*]'), lambda m: json_type(m) IS DISTINCT FROM 'VARCHAR')) = 0 ELSE json_type(j, '$.{0}') IS NULL{1} END"
_TEXT = "coalesce(json_type(j, '$.{0}') IN ('VARCHAR', 'NULL'), true)"
_LINES = "(SELECT line_no, raw_text::json AS j FROM raw_lines WHERE json_valid(raw_text))"
_ID_OK = "json_type(j, '$.id') IN ('UBIGINT', 'BIGINT') AND (j->>'$.id')::decimal(30,0) BETWEEN 0 AND 4294967295"
_MEMBERS = "(j->>'$.{}[*]')"

_LEXICON_LINES = f"""
SELECT line_no, (j->>'$.id')::bigint AS id, j->>'$.phrase' AS phrase, coalesce(array_to_string({_MEMBERS.format('categories')}, '|'), '') AS categories,
  j->>'$.pos' AS pos, j->>'$.definition' AS definition, coalesce(array_to_string({_MEMBERS.format('tags')}, '|'), '') AS tags,
  array_to_string(list_transform(json_extract(j, '$.elements[*]'), lambda e: array_to_string(e->>'$[*]', ':')), ' ') AS elements
FROM {_LINES} WHERE json_type(j) = 'OBJECT' AND {_ID_OK} AND json_type(j, '$.phrase') = 'VARCHAR' AND json_type(j, '$.elements') = 'ARRAY'
  AND {_GOOD_STRINGS.format('categories', '')} AND {_GOOD_STRINGS.format('tags', '')} AND {_TEXT.format('pos')} AND {_TEXT.format('definition')}
  AND len(list_filter(json_extract(j, '$.elements[*]'), lambda e: coalesce(e->>'$[0]' NOT IN ('w', 'slot', 'slot:pron', 'slot:noun'), true))) = 0
"""
_WIKI_LINES = f"""
SELECT line_no, j->>'$.word' AS word, j->>'$.pos' AS pos, j->>'$.lang_code' AS lang_code,
  CASE WHEN json_type(j, '$.categories') = 'ARRAY' THEN coalesce(array_to_string({_MEMBERS.format('categories')}, '|'), '') END AS categories,
  CASE WHEN json_type(j, '$.senses') = 'ARRAY' THEN json_array_length(j, '$.senses')::int END AS n_senses,
  coalesce(len(j->>'$.senses[*].glosses[*]'), 0)::int AS n_glosses
FROM {_LINES} WHERE json_type(j) = 'OBJECT' AND json_type(j, '$.word') = 'VARCHAR' AND {_TEXT.format('pos')} AND {_TEXT.format('lang_code')}
  AND {_GOOD_STRINGS.format('categories', " OR json_type(j, '$.categories') = 'NULL'")}
"""

_TARGETS = list(CONFIG.target_categories.items())
_TYPES = lambda c: "list_filter([" + ", ".join(f"CASE WHEN {c} = {S.q(t)} OR starts_with({c}, {S.q(t + ' ')}) THEN {S.q(k)} END" for t, k in _TARGETS) + "], lambda k: k IS NOT NULL)"
_HITS = f"list_filter(coalesce(senses, []), lambda s: len(list_filter(coalesce(s.categories, []), lambda c: coalesce(len({_TYPES('c')}) > 0, false))) > 0)"
_KEEP = "(t NOT IN {} OR {})".format(S.qs(CONFIG.pos_filter), " OR ".join(f"(t = {S.q(k)} AND coalesce(pos, '') IN {S.qs(v)})" for k, v in CONFIG.pos_filter.items()))
_ALL_TYPES = f"list_concat(flatten(list_transform(coalesce(categories, []), lambda c: {_TYPES('c')})), flatten(list_transform(hits, lambda s: flatten(list_transform(s.categories, lambda c: {_TYPES('c')})))))"
_TYPED = f"""(SELECT entry_id, word, pos, lang_code, list_filter(list_sort(list_distinct({_ALL_TYPES})), lambda t: {_KEEP}) AS types,
  flatten(list_transform(hits, lambda s: coalesce(s.glosses, [])))[1] AS first_gloss,
  list_sort(list_distinct(flatten(list_transform(hits, lambda s: coalesce(s.tags, []))))) AS sense_tags
  FROM (SELECT *, {_HITS} AS hits FROM wiki_dump))"""
_LANG = f"lang_code = 'en' AND word IS NOT NULL AND len(list_filter(regexp_split_to_array(word, {S.q(f'[{S.C.BLANK}]+')}), lambda w: w <> '')) >= 2"
_FIRSTS = f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY word ORDER BY entry_id) AS rn FROM {_TYPED}
  WHERE {_LANG} AND len(types) > 0 AND word NOT IN {S.qs(CONFIG.phrase_blocklist)}) WHERE rn = 1)"""
_SHAPED = f"(SELECT *, {S.elements('word')} AS elements FROM {_FIRSTS})"
_LONG = f"({_FIXED} >= 2 AND len(list_filter(elements, lambda e: e[1] = 'w' AND lower(e[2]) NOT IN {S.qs(S.C.CLOSED_CLASS)})) > 0)"
_OPEN = "(SELECT * FROM lexicon_rows WHERE list_contains(categories, 'idiom') AND id NOT IN (SELECT id FROM lexicon_rows WHERE origin = 'editors'))"
_BATCHED = f"(SELECT *, (n // 50)::bigint AS batch, (n % 50 + 1)::int AS batch_pos FROM (SELECT *, row_number() OVER (ORDER BY rec_id) - 1 AS n FROM {_OPEN}))"
_REWRITTEN = "list_transform(categories, lambda c: CASE WHEN c = 'idiom' AND id % 4 = 0 THEN 'fixed_collocation' ELSE c END)"
SQL = {
    "lexicon_lines": _LEXICON_LINES,
    "wiki_lines": _WIKI_LINES,
    "lexicon_load": f"SELECT entry_idx, id, phrase, {_j('categories')} AS categories, {S.flat('elements')} AS elements FROM {_ENTRIES}",
    "first_lemma_index": f"""SELECT first_lemma, entry_idx // 65536 AS block, count(*)::int AS n, string_agg(entry_idx::varchar, ',' ORDER BY entry_idx) AS entries
FROM (SELECT entry_idx, list_filter(elements, lambda e: e[1] = 'w')[1][2] AS first_lemma FROM {_ENTRIES}) GROUP BY first_lemma, block""",
    "corrections_overlay": f"""WITH f AS (SELECT id, arg_max(categories, rec_id) AS fixed FROM lexicon_rows WHERE origin = 'editors' AND categories IS NOT NULL GROUP BY id)
SELECT rec_id, id, phrase, {_j('c')} AS categories FROM (SELECT rec_id, l.id, phrase, CASE WHEN f.id IS NULL THEN categories ELSE fixed END AS c FROM lexicon_rows l LEFT JOIN f ON l.id = f.id)""",
    "correction_lines": f"""SELECT (j->>'$.id')::bigint AS id, coalesce(array_to_string(arg_max({_MEMBERS.format('categories')}, line_no), '|'), '') AS categories
FROM {_LINES} WHERE json_type(j) = 'OBJECT' AND {_ID_OK} AND json_type(j, '$.categories') = 'ARRAY' AND {_GOOD_STRINGS.format('categories', '')} GROUP BY 1""",
    "builder_filters": f"SELECT entry_id, word FROM wiki_dump WHERE {_LANG}",
    "builder_categories": f"SELECT entry_id, coalesce(array_to_string(types, '|'), '') AS types, first_gloss, coalesce(array_to_string(sense_tags, '|'), '') AS sense_tags FROM {_TYPED}",
    "builder_lexicon": f"""SELECT entry_id, word AS phrase, array_to_string(types, '|') AS categories, pos, first_gloss AS definition,
coalesce(array_to_string(sense_tags, '|'), '') AS tags, {S.flat('elements')} AS elements FROM {_SHAPED} WHERE {_LONG}""",
    "builder_stats": f"""SELECT (SELECT count(*) FROM wiki_dump) AS scanned, count(*) FILTER (WHERE {_LONG}) AS written, count(*) FILTER (WHERE NOT {_LONG}) AS skipped_too_short FROM {_SHAPED}""",
    "hash_ids": S.siphash13_low32("(SELECT DISTINCT word FROM wiki_dump WHERE word IS NOT NULL)"),
    "idiom_selection": "SELECT rec_id, phrase FROM lexicon_rows WHERE list_contains(categories, 'idiom')",
    "anti_cache": f"SELECT rec_id, id FROM {_OPEN}",
    "llm_batches": f"SELECT rec_id, batch, batch_pos FROM {_BATCHED}",
    "prompt_lines": f"""SELECT batch, count(*) || chr(10) || string_agg(batch_pos || '. id=' || id || ': "' || phrase || '" — ' || coalesce(definition, ''), chr(10) ORDER BY batch_pos) AS prompt
FROM {_BATCHED} GROUP BY batch""",
    "category_rewrite": f"""SELECT id, array_to_string(list_filter(r, lambda c, i: list_position(r, c) = i), '|') AS categories, id % 4 = 0 AS reclassified, count(*) AS n
FROM (SELECT id, {_REWRITTEN} AS r FROM lexicon_rows WHERE list_contains(categories, 'idiom')) GROUP BY ALL""",
    "reclassified_batches": f"""WITH b AS {_BATCHED}, l AS (SELECT *, id % 4 = 0 OR EXISTS (SELECT 1 FROM b n WHERE n.batch = b.batch + 1 AND n.id = b.id) AS reclassified FROM b)
SELECT id, array_to_string(list_filter(r, lambda c, i: list_position(r, c) = i), '|') AS categories, reclassified, count(*) AS n
FROM (SELECT id, reclassified, list_transform(categories, lambda c: CASE WHEN c = 'idiom' AND reclassified THEN 'fixed_collocation' ELSE c END) AS r FROM l) GROUP BY ALL""",
    "reclassify_stats": f"SELECT count(*) AS processed, count(*) FILTER (WHERE id % 4 = 0) AS reclassified, ceil(count(*) / 50)::bigint AS batches FROM {_OPEN}",
    "json_pointer": "SELECT id, id AS label_id, CASE WHEN id % 2 = 0 THEN 'fixed' ELSE 'idiom' END AS kind FROM core_lexicon",
}
