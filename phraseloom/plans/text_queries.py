"""Queries over tokens, lemmas and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.functions import pattern, register, text
from phraseloom.plans import sqltext as S
from phraseloom.sources.tables import table

#: Sentences with every kind of contraction, abbreviation and number.
SAMPLES = (
    "He didn't like life?", "twenty-one cats.", "co-workers e-mail.", "at 10 p.m. local", "U.S. policy", "I cannot won't can't",
    "Bush's I'm they're we've you'll I'd", "its dont", "end -- mid ... ***", "256,000 and 14:57 and 303-832-8160",
    "CANNOT've he'd've y’all’ll n't 's", "see https://a.example/it's www.b.example x@y.example", "naïve café, “quoted”… Dr. No. '90s", "", "   ",
)
SLOTS = ("[pron]", "(somebody)", "one's", "apple", " Someone ", "⟨x⟩", "sth", "sw", "yourself", "X", "so", "", "[", "<a>")
PAIRS = (
    ("moon", "moons"), ("alway", "always"), ("go", "gone"), ("the", "then"), ("but", "butter"), ("thin", "thing"), ("wall", "wallaby"), ("", ""), ("", "a"),
    ("carr", "carries"), ("broke", "broken"), ("walked", "walk"), ("a", "a"),
)


def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def tokenize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.array_join(text.tokenize(F.col("line")), "␟").alias("tokens"))


def token_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's tokens as a JSON array."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.to_json(text.tokenize(F.col("line"))).alias("tokens"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(text.tokenize(F.col("text"))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n"))


def sql_tokenize_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line's tokens by the registered table function."""
    register.register(spark)
    lines = "SELECT doc_id, t.line_no, array_join(t.tokens, '␟') AS tokens FROM {docs}, LATERAL ml_tokenize_lines(text) t"
    return spark.sql(lines, docs=table(spark, sf_dir, "documents"))


def sql_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lemmas of all words by the registered function."""
    register.register(spark)
    return spark.sql("SELECT DISTINCT word, ml_lemma(word) AS lemma FROM {tokens}", tokens=table(spark, sf_dir, "parsed_tokens"))


def contractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every sentence of the requests, and of samples of each kind."""
    samples = spark.createDataFrame([(s,) for s in SAMPLES], "sentence string")
    rows = table(spark, sf_dir, "parse_requests").select(F.explode("sentences").alias("sentence")).where("sentence is not null").unionByName(samples).distinct()
    return rows.select("sentence", F.array_join(text.tokenize(F.col("sentence")), "␟").alias("tokens"))


def lemma_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "parsed_tokens").select("word").distinct()
    return words.select("word", text.lemma(F.col("word")).alias("lemma"))


def lemma_verb_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "parsed_tokens").select("word", F.coalesce(F.col("upos") == "VERB", F.lit(False)).alias("is_verb")).distinct()
    return words.select("word", "is_verb", text.lemma(F.col("word"), F.col("is_verb")).alias("lemma"))


def lemma_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the lemma rules give the lemma the tokens carry, by tag."""
    rows = table(spark, sf_dir, "parsed_tokens").where("word is not null and lemma is not null")
    return rows.groupBy("upos").agg(F.count("*").alias("n"), F.count_if(text.lemma(F.col("word")) == F.col("lemma")).alias("same"))


def slot_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([(s,) for s in SLOTS], "token string")
    words = table(spark, sf_dir, "wiki_dump").select(F.explode(F.split("word", " ")).alias("token")).unionByName(given).distinct()
    return words.select("token", text.is_slot_token(F.col("token")).alias("is_slot"), text.slot_type(F.col("token")).alias("slot_type"))


def phrase_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = spark.createDataFrame([("spill the beans",), ("lose one's mind",), ("give someone or something away",), ("x y of sth and sb's",), ("so far, so good",)], "phrase string")
    phrases = table(spark, sf_dir, "wiki_dump").select(F.col("word").alias("phrase")).where("phrase is not null").unionByName(given).distinct()
    flat = F.array_join(F.transform(pattern.phrase_elements(F.col("phrase")), lambda e: F.array_join(e, ":")), " ")
    return phrases.select("phrase", flat.alias("elements"))


def element_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lexicon_rows").select("rec_id", "elements")
    e = F.col("elements")
    steps = F.transform(pattern.plan(e), lambda s: F.concat_ws(":", s["w"], s["gap"].cast("string"), s["slot"]))
    return rows.select(
        "rec_id",
        F.array_join(steps, " ").alias("steps"),
        pattern.fixed_count(e).alias("n_fixed"),
        pattern.first_fixed(e).alias("first_lemma"),
        pattern.has_slot(e).alias("has_slot"),
        pattern.has_content_word(e).alias("has_content"),
    )


def lemma_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a word in lower case and its lemma, and pairs of each kind."""
    given = spark.createDataFrame(PAIRS, "a string, b string")
    words = table(spark, sf_dir, "parsed_tokens").where("word is not null and lemma is not null").select(F.lower("word").alias("a"), F.col("lemma").alias("b"))
    rows = words.unionByName(given).distinct()
    return rows.select("a", "b", pattern.lemma_eq(F.col("a"), F.col("b")).alias("equal"))


def sentence_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "parse_requests").select("req_no", F.unix_micros("loaded_at").alias("loaded_us"), F.posexplode("sentences").alias("sent_index", "sentence"))
    return rows.select("req_no", "loaded_us", "sent_index", text.unicode_trim(F.col("sentence")).alias("sentence"), F.size(text.unicode_words(F.col("sentence"))).alias("n_words"))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_docs, tokenize_lines, token_json, token_counts, sql_tokenize_lines, sql_lemmas, contractions, lemma_vocab, lemma_verb_gate, lemma_agreement, slot_tokens, phrase_elements, element_plan,
        lemma_equality, sentence_trim,
    )
}


def _values(rows, columns: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(S.q(x) for x in ((r,) if isinstance(r, str) else r)) + ")" for r in rows) + f") v({columns})"


_US = "chr(9247)"
_HEADWORDS = (
    "(SELECT word AS phrase FROM wiki_dump WHERE word IS NOT NULL UNION SELECT phrase FROM (VALUES ('spill the beans'), ('lose one''s mind'), "
    "('give someone or something away'), ('x y of sth and sb''s'), ('so far, so good')) v(phrase))"
)
_WORDS = "list_filter(elements, lambda e: e[1] = 'w')"
SQL = {
    "tokenize_docs": f"SELECT doc_id, CASE WHEN t IS NULL THEN NULL ELSE len(t)::int END AS n_tokens, CASE WHEN len(t) = 0 THEN md5('') ELSE md5(array_to_string(t, ' ')) END AS tokens_md5 FROM (SELECT doc_id, {S.tokenize('text')} AS t FROM documents)",
    "tokenize_lines": f"""SELECT doc_id, line_no, CASE WHEN len(t) = 0 THEN '' ELSE array_to_string(t, {_US}) END AS tokens
FROM (SELECT doc_id, line_no, {S.tokenize('line')} AS t FROM (SELECT doc_id, (generate_subscripts(l, 1) - 1)::int AS line_no, unnest(l) AS line
FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents WHERE text IS NOT NULL)))""",
    "token_json": f"""SELECT doc_id, line_no, to_json({S.tokenize('line')})::varchar AS tokens FROM (SELECT doc_id, (generate_subscripts(l, 1) - 1)::int AS line_no, unnest(l) AS line
FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS l FROM documents WHERE text IS NOT NULL))""",
    "token_counts": f"SELECT token, count(*) AS n FROM (SELECT unnest({S.tokenize('text')}) AS token FROM documents) GROUP BY token",
    "contractions": f"SELECT sentence, CASE WHEN len(t) = 0 THEN '' ELSE array_to_string(t, {_US}) END AS tokens FROM (SELECT sentence, {S.tokenize('sentence')} AS t FROM (SELECT unnest(sentences) AS sentence FROM parse_requests UNION SELECT sentence FROM {_values(SAMPLES, 'sentence')}) WHERE sentence IS NOT NULL)",
    "lemma_vocab": f"SELECT word, CASE WHEN word IS NOT NULL THEN {S.lemma('word')} END AS lemma FROM (SELECT DISTINCT word FROM parsed_tokens)",
    "lemma_verb_gate": f"SELECT word, is_verb, CASE WHEN word IS NOT NULL THEN {S.lemma('word', 'is_verb')} END AS lemma FROM (SELECT DISTINCT word, coalesce(upos = 'VERB', false) AS is_verb FROM parsed_tokens)",
    "lemma_agreement": f"""WITH l AS (SELECT word, {S.lemma('word')} AS rule FROM (SELECT DISTINCT word FROM parsed_tokens WHERE word IS NOT NULL))
SELECT upos, count(*) AS n, count(*) FILTER (WHERE rule = lemma) AS same FROM parsed_tokens JOIN l USING (word) WHERE lemma IS NOT NULL GROUP BY upos""",
    "slot_tokens": f"SELECT token, {S.is_slot('token')} AS is_slot, {S.slot_type('token')} AS slot_type FROM (SELECT unnest(string_split(word, ' ')) AS token FROM wiki_dump UNION SELECT token FROM {_values(SLOTS, 'token')})",
    "phrase_elements": f"SELECT phrase, coalesce({S.flat(S.elements('phrase'))}, '') AS elements FROM {_HEADWORDS}",
    "element_plan": f"""SELECT rec_id, coalesce(array_to_string(list_transform({S.plan('elements')}, lambda s: s.w || ':' || s.gap || ':' || s.slot), ' '), '') AS steps,
len({_WORDS})::int AS n_fixed, {_WORDS}[1][2] AS first_lemma, len({_WORDS}) < len(elements) AS has_slot,
len(list_filter({_WORDS}, lambda e: lower(e[2]) NOT IN {S.qs(S.C.CLOSED_CLASS)})) > 0 AS has_content FROM lexicon_rows""",
    "lemma_equality": f"SELECT a, b, {S.lemma_eq('a', 'b')} AS equal FROM (SELECT lower(word) AS a, lemma AS b FROM parsed_tokens WHERE word IS NOT NULL AND lemma IS NOT NULL UNION SELECT a, b FROM {_values(PAIRS, 'a, b')})",
    "sentence_trim": f"""SELECT req_no, loaded_us, i::int AS sent_index, {S.trim('s')} AS sentence,
CASE WHEN s IS NULL THEN NULL ELSE len(list_filter(regexp_split_to_array(s, {S.q(f'[{S.C.BLANK}]+')}), lambda w: w <> ''))::int END AS n_words
FROM (SELECT req_no, epoch_us(loaded_at) AS loaded_us, generate_subscripts(sentences, 1) - 1 AS i, unnest(sentences) AS s FROM parse_requests)""",
}
SQL |= {"sql_tokenize_lines": SQL["tokenize_lines"], "sql_lemmas": SQL["lemma_vocab"]}
