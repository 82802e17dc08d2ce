"""Queries that decode scores, and events of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.functions import decode, text
from phraseloom.operators import annotate
from phraseloom.plans import sqltext as S
from phraseloom.plans.lineage import scratch_path
from phraseloom.sources.tables import table
from phraseloom.streaming import events, ordered

RELS = ("root", "nsubj", "obj", "det", "amod", "advmod", "punct", "case")
UPOS = ("NOUN", "VERB", "ADJ", "ADV", "PRON", "DET", "ADP", "PUNCT")
FEATS = (("Case", ("_", "Nom", "Acc")), ("Mood", ("_", "Ind", "Imp", "Sub")), ("NumForm", ("_", "Digit")), ("Number", ("_", "Sing", "Plur")))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("float")).alias("e"))


def argmax_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of the largest value of all, and of coarse values with many ties."""
    coarse = F.transform("e", lambda x: F.floor(x * 2).cast("int"))
    return _scores(spark, sf_dir).select("vec_id", decode.argmax(F.col("e")).alias("best"), decode.argmax(coarse).alias("last_tied"))


def upos_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag for each of eight rows of eight scores; one label is left out, so the fallback shows."""
    labels = F.array(*[F.lit(u) for u in UPOS[:7]])
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: decode.label(labels, decode.argmax(F.slice("e", r * 8 + 1, 8)), "X"))
    return _scores(spark, sf_dir).select("vec_id", F.array_join(rows, " ").alias("tags"))


def rel_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation at the chosen head: the best of eight scores of the row that the first eight scores choose."""
    head = decode.argmax(F.slice("e", 1, 8))
    labels = F.array(*[F.lit(r) for r in RELS])
    return _scores(spark, sf_dir).select("vec_id", head.alias("head"), decode.label(labels, decode.argmax(F.slice("e", head * 8 + 1, 8)), "dep").alias("rel"))


def feats_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FEATS of four categories scored by the first sixteen values, four each."""
    facts = F.array(*[F.struct(F.lit(c).alias("category"), F.array(*[F.lit(v) for v in vs]).alias("values")) for c, vs in FEATS])
    scores = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: F.slice("e", c * 4 + 1, 4))
    return _scores(spark, sf_dir).select("vec_id", decode.feats_string(facts, scores).alias("feats"))


def mst_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads of three words by the first sixteen values as a 4 x 4 matrix of dependent and head."""
    matrix = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.slice("e", r * 4 + 1, 4))
    heads = _scores(spark, sf_dir).select("vec_id", decode.heads_of(matrix).alias("h"))
    return heads.select("vec_id", *[F.get("h", i).alias(f"head_{i}") for i in (1, 2, 3)])


def vocab_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by place of a vocabulary with gaps, and of nested ones in byte order."""
    rows = spark.createDataFrame(
        [(1, {"a": 0, "c": 3, "b": 1}, {"Number": {"_": 0, "Sing": 2}, "NumForm": {"_": 0}}), (2, {}, {}), (3, {"x": 2}, {"B": {"v": 1}, "A": {}})],
        "id int, vocab map<string,int>, feats map<string,map<string,int>>",
    )
    flat = F.transform(decode.invert_feats(F.col("feats")), lambda f: F.concat(f["category"], F.lit("="), F.array_join(f["values"], ",")))
    return rows.select("id", F.array_join(decode.invert_vocab(F.col("vocab")), ",").alias("labels"), F.array_join(flat, ";").alias("feats"))


def subword_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword grids of the first words of expressions; the ids are the words' code points."""
    words = table(spark, sf_dir, "mwe_matches").where("words is not null").select("sent_id", "mwe_no", "matched_at", "words")
    ids = F.transform("words", lambda w: F.transform(F.filter(F.split(w, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint")))
    grid = annotate.subword_rows(ids)
    shown = F.array_join(F.transform(grid, lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), ",")), ";")
    return words.select("sent_id", "mwe_no", shown.alias("grid")).distinct()


def score_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tokens of three invented words from score arrays."""
    e = lambda a, n: F.slice("e", a + 1, n)
    block = lambda a, n, size: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda r: F.slice("e", a + r * size + 1, size))
    rows = _scores(spark, sf_dir).select(
        "vec_id",
        F.array(F.lit("Dogs"), F.lit("barked"), F.lit(".")).alias("words"),
        block(0, 4, 4).alias("s_arc"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda r: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda h: F.slice("e", (r * 4 + h) * 2 + 17, 2))).alias("s_rel"),
        block(48, 4, 4).alias("s_pos"),
    )
    tokens = annotate.decode_scores(rows, ["dep", "root"], list(UPOS[:4]))
    return tokens.select("vec_id", F.array_join(F.transform("tokens", lambda t: F.concat_ws("/", t["id"].cast("string"), t["word"], t["lemma"], t["head"].cast("string"), t["rel"], t["upos"], t["feats"])), " ").alias("tokens"))


def _requests(spark: SparkSession, sf_dir: str, broken: bool) -> DataFrame:
    """Each request once, its sentences tokenized; with ``broken`` some sentences fail."""
    rows = table(spark, sf_dir, "parse_requests").groupBy("req_no").agg(F.min_by(F.struct("request_id", F.coalesce("sentences", F.array().cast("array<string>")).alias("s")), "loaded_at").alias("r"))
    answer = lambda s: F.concat(F.lit('{"words":'), F.size(text.tokenize(text.unicode_trim(F.coalesce(s, F.lit(""))))), F.lit("}"))
    fails = lambda s: F.when(F.lit(broken) & (F.length(s) % 11 == 0), F.lit("too odd"))
    items = F.transform("r.s", lambda s: F.struct(answer(s).alias("result"), fails(s).alias("error")))
    return rows.select("req_no", items.alias("results"))


def progress_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.request_events(_requests(spark, sf_dir, False), "req_no").where("event = 'progress'")


def result_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.request_events(_requests(spark, sf_dir, False), "req_no").where("event in ('result', 'done')")


def error_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of requests of which some end with an error."""
    return events.request_events(_requests(spark, sf_dir, True), "req_no")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same events from a stream of answered sentences: requests are read file by file, states put their sentences in order."""
    place = f"{sf_dir}/parse_requests.parque[t]"  # the stream's reader takes a pattern or a folder
    requests = spark.readStream.schema(table(spark, sf_dir, "parse_requests").schema).option("maxFilesPerTrigger", 4).parquet(place)
    sentences = F.coalesce("sentences", F.array().cast("array<string>"))
    rows = requests.select("req_no", F.size(sentences).alias("total"), F.posexplode_outer(sentences).alias("sent_index", "s"))
    words = F.size(text.tokenize(text.unicode_trim(F.coalesce("s", F.lit("")))))
    answered = rows.select("req_no", "sent_index", "total", F.concat(F.lit('{"words":'), words, F.lit("}")).alias("result"), F.when(F.length("s") % 11 == 0, F.lit("too odd")).alias("error"))
    out, progress = scratch_path(spark), scratch_path(spark)
    stream = ordered.ordered_events(answered, "req_no", keep_seconds=None).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress)
    stream.trigger(availableNow=True).start().awaitTermination()  # it ends with its input, however large; a failure is raised
    return spark.read.schema("req_no bigint, seq int, event string, data string").parquet(out)


def request_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parse_requests").select("req_no", "sentences").distinct()
    return events.request_sentences(rows, "req_no")


QUERIES = {
    f.__name__: f
    for f in (
        argmax_decode, upos_decode, rel_decode, feats_string, mst_decode, vocab_invert, subword_grid, score_decode, progress_events, result_events, error_events,
        stream_events, request_sentences,
    )
}

_E = "(SELECT vec_id, list_transform(embedding, lambda x: x::float) AS e FROM embeddings)"
_ARG = lambda l: f"(len({l}) - list_position(list_reverse({l}), list_max({l})))::int"  # noqa: E731,E741
_LIST = lambda xs: "[" + ", ".join(S.q(x) for x in xs) + "]"
_ROWS8 = "list_transform(range(8), lambda r: {})"
_FEAT = ", ".join(f"CASE WHEN a[{i + 1}] > 0 THEN {S.q(c + '=')} || {_LIST(vs)}[a[{i + 1}] + 1] END" for i, (c, vs) in enumerate(FEATS))
_BEST = ", ".join(_ARG(f"e[{i * 4 + 1}:{i * 4 + len(vs)}]") for i, (_, vs) in enumerate(FEATS))
_ACYCLIC = "(p1 = 0 OR [p1, p2, p3][p1] = 0 OR [p1, p2, p3][[p1, p2, p3][p1]] = 0) AND (p2 = 0 OR [p1, p2, p3][p2] = 0 OR [p1, p2, p3][[p1, p2, p3][p2]] = 0) AND (p3 = 0 OR [p1, p2, p3][p3] = 0 OR [p1, p2, p3][[p1, p2, p3][p3]] = 0)"
_TREES = f"""(SELECT vec_id, e, arg_max([p1, p2, p3], e[5 + p1] + e[9 + p2] + e[13 + p3]) AS h FROM {_E},
  (SELECT unnest([0, 2, 3]) AS p1) a, (SELECT unnest([0, 1, 3]) AS p2) b, (SELECT unnest([0, 1, 2]) AS p3) c WHERE {_ACYCLIC} GROUP BY vec_id, e)"""
_TOKENS = ", ' ', ".join(
    f"'{i}/{w}/{lem}/' || h[{i}] || '/' || CASE WHEN e[17 + ({i} * 4 + h[{i}]) * 2] > e[18 + ({i} * 4 + h[{i}]) * 2] THEN 'dep' ELSE 'root' END || '/' || {_LIST(UPOS[:4])}[{_ARG(f'e[{49 + i * 4}:{52 + i * 4}]')} + 1] || '/_'"
    for i, (w, lem) in enumerate((("Dogs", "dog"), ("barked", "bark"), (".", "")), 1)
)
_REQ = "(SELECT req_no, arg_min(coalesce(sentences, []), loaded_at) AS s FROM parse_requests GROUP BY req_no)"
_ITEMS = f"(SELECT req_no, len(s) AS total, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS x FROM {_REQ})"
_N = f"len({S.tokenize(S.trim('''coalesce(x, '')'''))})".replace("'''", "'")
_ANSWERED = f"(SELECT req_no, total, i, '{{\"words\":' || {_N} || '}}' AS result, coalesce(length(x) % 11 = 0, false) AS bad FROM {_ITEMS})"
_RESULT = """'{"index":' || i || ',"result":' || result || '}'"""
_PROGRESS = """'{"done":' || (i + 1) || ',"total":' || total || ',"percent":' || ((i + 1) * 100 // total) || '}'"""
_DONE = f"""SELECT r.req_no, (2 * len(r.s))::int AS seq, 'done' AS event, '{{"results":[' || coalesce(j.j, '') || ']}}' AS data
FROM {_REQ} r LEFT JOIN (SELECT req_no, string_agg(result, ',' ORDER BY i) AS j, bool_or(bad) AS bad FROM {_ANSWERED} GROUP BY req_no) j ON r.req_no = j.req_no"""
SQL = {
    "argmax_decode": f"SELECT vec_id, {_ARG('e')} AS best, {_ARG('f')} AS last_tied FROM (SELECT vec_id, e, list_transform(e, lambda x: floor(x * 2)::int) AS f FROM {_E})",
    "upos_decode": f"SELECT vec_id, array_to_string({_ROWS8.format('coalesce(' + _LIST(UPOS[:7]) + '[' + _ARG('e[r * 8 + 1:r * 8 + 8]') + ' + 1], ' + S.q('X') + ')')}, ' ') AS tags FROM {_E}",
    "rel_decode": f"SELECT vec_id, head, {_LIST(RELS)}[{_ARG('e[head * 8 + 1:head * 8 + 8]')} + 1] AS rel FROM (SELECT vec_id, e, {_ARG('e[1:8]')} AS head FROM {_E})",
    "feats_string": f"SELECT vec_id, CASE WHEN len(f) = 0 THEN '_' ELSE array_to_string(f, '|') END AS feats FROM (SELECT vec_id, list_filter([{_FEAT}], lambda x: x IS NOT NULL) AS f FROM (SELECT vec_id, [{_BEST}] AS a FROM {_E}))",
    "mst_decode": f"SELECT vec_id, h[1]::int AS head_1, h[2]::int AS head_2, h[3]::int AS head_3 FROM {_TREES}",
    "vocab_invert": "SELECT * FROM (VALUES (1, 'a,b,,c', 'NumForm=_;Number=_,,Sing'), (2, '', ''), (3, ',,x', 'A=;B=,v')) v(id, labels, feats)",
    "subword_grid": """SELECT DISTINCT sent_id, mwe_no, array_to_string(list_transform(g, lambda r: array_to_string(list_transform(range(1, w + 1), lambda c: coalesce(r[c], 0)), ',')), ';') AS grid
FROM (SELECT sent_id, mwe_no, g, least(20, list_max(list_transform(g, lambda r: len(r)))) AS w
FROM (SELECT sent_id, mwe_no, list_concat([[1]], list_transform(words, lambda x: CASE WHEN length(x) = 0 THEN [3] ELSE list_transform(range(1, length(x) + 1), lambda c: unicode(x[c])) END)) AS g
FROM mwe_matches WHERE words IS NOT NULL))""",
    "score_decode": f"SELECT vec_id, concat({_TOKENS}) AS tokens FROM {_TREES}",
    "progress_events": f"SELECT req_no, (2 * i + 1)::int AS seq, 'progress' AS event, {_PROGRESS} AS data FROM {_ANSWERED}",
    "result_events": f"SELECT req_no, (2 * i)::int AS seq, 'result' AS event, {_RESULT} AS data FROM {_ANSWERED} UNION ALL {_DONE}",
    "error_events": f"""WITH a AS {_ANSWERED}, b AS (SELECT req_no, min(i) FILTER (WHERE bad) AS first_bad FROM a GROUP BY req_no), x AS (SELECT a.*, first_bad FROM a JOIN b USING (req_no) WHERE first_bad IS NULL OR i <= first_bad)
SELECT req_no, (2 * i)::int AS seq, 'result' AS event, {_RESULT} AS data FROM x WHERE i IS DISTINCT FROM first_bad
UNION ALL SELECT req_no, (2 * i + 1)::int, 'progress', {_PROGRESS} FROM x WHERE i IS DISTINCT FROM first_bad
UNION ALL SELECT req_no, (2 * i)::int, 'error', 'sentence ' || i || ': too odd' FROM x WHERE i = first_bad
UNION ALL {_DONE} WHERE j.bad IS DISTINCT FROM true""",
    "request_sentences": "SELECT req_no, (generate_subscripts(sentences, 1) - 1)::int AS sent_index, unnest(sentences) AS sentence FROM (SELECT DISTINCT req_no, sentences FROM parse_requests)",
}
SQL["stream_events"] = SQL["error_events"]
