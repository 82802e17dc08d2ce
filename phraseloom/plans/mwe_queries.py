"""Queries that find multi-word expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.functions import feats, pattern, text
from phraseloom.operators import lexicon, mwe
from phraseloom.plans import sqltext as S
from phraseloom.sources.tables import table

C = S.C


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.with_entry_index(table(spark, sf_dir, "core_lexicon"), ["id"])


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mwe.sentences_of(table(spark, sf_dir, "parsed_tokens"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mwe.candidates(mwe.prepared(_sentences(spark, sf_dir)).drop("tokens"), mwe.planned(_entries(spark, sf_dir)))


def _ids(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a sentence and an entry whose first lemma is in it and whose other lemmas' stems are."""
    return _pairs(spark, sf_dir).select("sent_id", "entry_idx")


def _paths(pairs: DataFrame) -> DataFrame:
    """Candidates that match, with their path, computed once."""
    return pairs.select("*", text.once_if(pattern.match(F.col("_toks"), F.col("_plan")), lambda p: p.isNotNull()).alias("_path"))


def match_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of every match, before the gate and before overlaps are resolved."""
    return _paths(_pairs(spark, sf_dir)).select("sent_id", "entry_idx", _ids("_path").alias("path"))


def arc_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of phrasal verbs and whether they pass the gate."""
    pairs = _paths(_pairs(spark, sf_dir).where("_phrasal"))
    gate = pattern.phrasal_arc_ok(F.col("_path"), F.col("_heads"), F.col("_rels"), F.col("_upos"))
    return pairs.select("sent_id", "entry_idx", gate.alias("passes"))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"categories": F.array_join("categories", "|"), "token_ids": _ids("token_ids"), "words": F.array_join("words", " ")})


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gated match in the shape of the results."""
    return _shown(mwe.as_matches(mwe.matched(_pairs(spark, sf_dir)))).select("sent_id", "entry_idx", "surface", "discontinuous", "has_slot", "token_ids", "words")


def detect_mwes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions found in all parsed sentences."""
    found = mwe.detect(_sentences(spark, sf_dir), _entries(spark, sf_dir))
    return _shown(found).select("sent_id", "id", "pos", "phrase", "definition", "categories", "has_slot", "token_ids", "words", "surface", "discontinuous")


def detect_large_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expressions found in all parsed sentences, joined as with a lexicon that is too large to broadcast."""
    found = mwe.detect(_sentences(spark, sf_dir), _entries(spark, sf_dir), most_bytes=0)
    return _shown(found).select("sent_id", "id", "phrase", "token_ids", "surface")


def overlap_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered matches that no overlapping one beats; ties go to the smaller id."""
    rows = table(spark, sf_dir, "mwe_matches").where("token_ids is not null and size(token_ids) > 0 and id is not null")
    narrow = rows.select("sent_id", F.col("id").alias("entry_idx"), "token_ids").distinct()
    return mwe.resolve_overlaps(narrow).select("sent_id", F.col("entry_idx").alias("id"), _ids("token_ids").alias("token_ids"))


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and expressions of each sentence."""
    rows = mwe.results(_sentences(spark, sf_dir), _entries(spark, sf_dir))
    return rows.select("sent_id", F.size("tokens").alias("words"), F.size("mwes").alias("mwes"))


def tag_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each morphological value occurs with each tag."""
    pairs = F.split("feats", "[|]")
    rows = table(spark, sf_dir, "parsed_tokens").where("feats is not null and feats <> '_'").select("upos", F.explode(pairs).alias("p"))
    return rows.groupBy("upos", F.substring_index("p", "=", 1).alias("category"), F.substring_index("p", "=", -1).alias("value")).agg(F.count("*").alias("n"))


def feats_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens by what is wrong with their FEATS, if anything."""
    rows = table(spark, sf_dir, "parsed_tokens").select(feats.problem(F.col("feats")).alias("problem"), "upos")
    return rows.groupBy("problem", "upos").agg(F.count("*").alias("n"))


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivered results as JSON lines, nulls written."""
    rows = table(spark, sf_dir, "sentence_results").select("sent_id", "tokens", "mwes").dropDuplicates(["sent_id"])
    return rows.select("sent_id", F.to_json(F.struct("tokens", "mwes"), {"ignoreNullFields": "false"}).alias("result"))


QUERIES = {
    f.__name__: f
    for f in (candidates, match_entries, arc_gate, surfaces, detect_mwes, detect_large_lexicon, overlap_resolution, sentence_stats, tag_profile, feats_problems, result_lines)
}

_CELLS = "id, coalesce(word, '') AS word, coalesce(lemma, '') AS lemma, coalesce(head, 0) AS head, coalesce(rel, '') AS rel, coalesce(upos, '') AS upos, coalesce(feats, '') AS feats"
_IRR = f"""
w AS (SELECT word, v, {S.lemma('word', 'v')} AS l FROM (SELECT DISTINCT coalesce(word, '') AS word, coalesce(upos, '') = 'VERB' AS v FROM parsed_tokens)),
t AS (SELECT sent_id, row_number() OVER (PARTITION BY sent_id ORDER BY id, d.word, lemma, head, rel, upos, feats) - 1 AS p, d.word, head, rel, upos, w.l
  FROM (SELECT DISTINCT sent_id, {_CELLS} FROM parsed_tokens WHERE id IS NOT NULL) d JOIN w ON d.word = w.word AND w.v = (d.upos = 'VERB')),
s AS (SELECT sent_id, list(word ORDER BY p) AS words, list(upos ORDER BY p) AS upos, list(head ORDER BY p) AS heads, list(rel ORDER BY p) AS rels FROM t GROUP BY sent_id),
e AS (SELECT row_number() OVER (ORDER BY id) - 1 AS entry_idx, *, {S.plan('elements')} AS plan FROM core_lexicon WHERE len(list_filter(elements, lambda x: x[1] = 'w')) >= 2),
k AS (SELECT entry_idx, len(plan) AS n_fixed, i - 1 AS k, plan[i].w AS w, plan[i].gap AS gap, plan[i].slot AS slot FROM (SELECT entry_idx, plan, unnest(range(1, len(plan) + 1)) AS i FROM e)),
c AS (SELECT DISTINCT t.sent_id, k.entry_idx FROM t JOIN k ON k.k = 0 AND t.l = k.w),
st AS (SELECT DISTINCT sent_id, substring(l, 1, 4) AS x FROM t),
cc AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.entry_idx = c.entry_idx AND (c.sent_id, substring(k.w, 1, 4)) NOT IN (SELECT sent_id, x FROM st)))
"""
_SEG = lambda a: f"s.{a}[r.p + 2 : t.p]"  # noqa: E731  tokens between positions r.p and t.p (0-based), 1-based slice
_TAGGED = "list_zip(" + _SEG("words") + ", " + _SEG("upos") + ")"
_VETO = f"""
  len(list_filter({_TAGGED}, lambda z: z[2] = 'PUNCT' AND (z[1] IN {S.qs(C.HARD_BOUNDARIES)} OR regexp_full_match(z[1], '\\.{{2,}}')))) = 0
  AND NOT (k.gap <= 1 AND len(list_filter({_SEG('upos')}, lambda u: u IN {S.qs(C.CONTENT_UPOS)})) > 0)
  AND NOT (k.gap <= 1 AND k.n_fixed < 3 AND len(list_filter({_TAGGED}, lambda z: z[2] = 'PUNCT' AND z[1] = ',')) > 0)
  AND (k.gap <= 1 OR k.slot = 'slot' OR (k.slot = 'slot:pron' AND t.p > r.p + 1 AND {_SEG('upos')}[1] = 'PRON')
    OR (k.slot = 'slot:noun' AND t.p > r.p + 1 AND {_SEG('upos')}[1] IN {S.qs(C.NOMINAL_UPOS)}))
"""
_WITH = f"""
WITH RECURSIVE {_IRR},
r AS (
  SELECT cc.sent_id, cc.entry_idx, 0 AS k, t.p, t.p AS start, [t.p] AS path FROM cc JOIN k ON k.entry_idx = cc.entry_idx AND k.k = 0 JOIN t ON t.sent_id = cc.sent_id AND {S.lemma_eq('t.l', 'k.w')}
  UNION ALL
  SELECT r.sent_id, r.entry_idx, k.k, t.p, r.start, list_append(r.path, t.p) FROM r JOIN k ON k.entry_idx = r.entry_idx AND k.k = r.k + 1
    JOIN t ON t.sent_id = r.sent_id AND t.p > r.p AND t.p <= r.p + 1 + k.gap AND {S.lemma_eq('t.l', 'k.w')} JOIN s ON s.sent_id = r.sent_id WHERE {_VETO}),
m AS (SELECT r.sent_id, r.entry_idx, arg_min(path, {{'span': p - start, 'start': start, 'back': list_reverse(path)}}) AS path
  FROM r JOIN (SELECT DISTINCT entry_idx, n_fixed FROM k) n ON n.entry_idx = r.entry_idx AND r.k = n.n_fixed - 1 GROUP BY r.sent_id, r.entry_idx),
g AS (SELECT m.*, e.id, e.pos, e.phrase, e.definition, e.categories, e.elements, s.words, coalesce(list_contains(e.categories, 'phrasal_verb'), false) AS phrasal,
  s.upos[path[1] + 1] = 'VERB' AND (path[2] IS NULL OR s.heads[path[2] + 1] = path[1] + 1
    OR (s.heads[path[2] + 1] > 0 AND coalesce(s.heads[s.heads[path[2] + 1]] = path[1] + 1, false) AND s.rels[path[2] + 1] <> 'mark')) AS passes
  FROM m JOIN e ON e.entry_idx = m.entry_idx JOIN s ON s.sent_id = m.sent_id)
"""
_SURFACE = "array_to_string(words[path[1] + 1 : path[-1] + 1], ' ')"
for _mark in ("'s", "n't", ",", ".", "!", "?"):
    _SURFACE = f"replace({_SURFACE}, {S.q(' ' + _mark)}, {S.q(_mark)})"
_NUMBERS = lambda x: f"array_to_string({x}, ',')"
_ROW = f"""{_SURFACE} AS surface, path[-1] - path[1] + 1 <> len(path) AS discontinuous, len(list_filter(elements, lambda x: x[1] <> 'w')) > 0 AS has_slot,
{_NUMBERS('list_transform(path, lambda x: x + 1)')} AS token_ids, array_to_string(list_transform(path, lambda x: words[x + 1]), ' ') AS words"""
_BEATS = """o.sent_id = g.sent_id AND list_has_any(o.path, g.path) AND (len(o.path) > len(g.path) OR (len(o.path) = len(g.path) AND (o.path[-1] - o.path[1] < g.path[-1] - g.path[1]
  OR (o.path[-1] - o.path[1] = g.path[-1] - g.path[1] AND o.entry_idx < g.entry_idx))))"""
_KEPT = f"gg AS (SELECT * FROM g WHERE NOT phrasal OR passes), kept AS (SELECT * FROM gg g WHERE NOT EXISTS (SELECT 1 FROM gg o WHERE {_BEATS}))"
SQL = {
    "candidates": f"WITH {_IRR} SELECT sent_id, entry_idx FROM cc",
    "match_entries": f"{_WITH} SELECT sent_id, entry_idx, {_NUMBERS('path')} AS path FROM m",
    "arc_gate": f"{_WITH} SELECT sent_id, entry_idx, passes FROM g WHERE phrasal",
    "surfaces": f"{_WITH} SELECT sent_id, entry_idx, {_ROW} FROM g WHERE NOT phrasal OR passes",
    "detect_mwes": f"{_WITH}, {_KEPT} SELECT sent_id, id, pos, phrase, definition, CASE WHEN len(categories) = 0 THEN '' ELSE array_to_string(categories, '|') END AS categories, {_ROW} FROM kept",
    "detect_large_lexicon": f"{_WITH}, {_KEPT} SELECT sent_id, id, phrase, {_NUMBERS('list_transform(path, lambda x: x + 1)')} AS token_ids, {_SURFACE} AS surface FROM kept",
    "sentence_stats": f"{_WITH}, {_KEPT} SELECT sent_id, len(s.words)::int AS words, count(kept.id)::int AS mwes FROM s LEFT JOIN kept USING (sent_id) GROUP BY sent_id, s.words",
    "overlap_resolution": f"""WITH g AS (SELECT DISTINCT sent_id, id AS entry_idx, token_ids AS path FROM mwe_matches WHERE len(token_ids) > 0 AND id IS NOT NULL)
SELECT sent_id, entry_idx AS id, {_NUMBERS('path')} AS token_ids FROM g WHERE NOT EXISTS (SELECT 1 FROM g o WHERE {_BEATS})""",
    "feats_problems": f"""SELECT problem, upos, count(*) AS n FROM (SELECT upos, CASE WHEN feats IS NULL THEN 'missing'
  WHEN NOT regexp_full_match(feats, '_|[A-Za-z]+=[^|=]+([|][A-Za-z]+=[^|=]+)*') THEN 'grammar'
  WHEN p <> list_sort(list_distinct(p)) THEN 'order' WHEN feats <> '_' AND len(list_filter(string_split(feats, '|'), lambda x: x NOT IN {S.qs(f'{c}={v}' for c, vs in C.FEATS.items() for v in vs.split())})) > 0 THEN 'unknown' END AS problem
  FROM (SELECT upos, feats, list_transform(list_filter(string_split(feats, '|'), lambda x: x <> '_'), lambda x: split_part(x, '=', 1)) AS p FROM parsed_tokens)) GROUP BY ALL""",
    "result_lines": "SELECT sent_id, to_json({'tokens': tokens, 'mwes': mwes})::varchar AS result FROM (SELECT DISTINCT sent_id, tokens, mwes FROM sentence_results)",
    "tag_profile": """SELECT upos, split_part(p, '=', 1) AS category, split_part(p, '=', -1) AS value, count(*) AS n
FROM (SELECT upos, unnest(string_split(feats, '|')) AS p FROM parsed_tokens WHERE feats IS NOT NULL AND feats <> '_') GROUP BY ALL""",
}
