"""Queries over the whole chain from sentences to results, with scores that a rule gives in place of a model."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.operators import lexicon
from phraseloom.plans import mwe_queries, pipeline
from phraseloom.plans import sqltext as S
from phraseloom.plans.decode_queries import RELS, UPOS
from phraseloom.sources.tables import table
from phraseloom.sources.vocab import Vocab

NUMBER = ("_", "Sing", "Plur")
VOCAB = Vocab(list(RELS), list(UPOS), [("Number", list(NUMBER))])


def chain_scores(words: list[str]) -> dict[str, np.ndarray]:
    """Scores by which each word hangs on the one before it; relation, tag and number follow from its length."""
    n = len(words) + 1
    at, size = np.arange(1, n), np.array([len(w) for w in words])
    arc, rel, pos, feats = np.zeros((1, n, n)), np.zeros((1, n, n, len(RELS))), np.zeros((1, n, len(UPOS))), np.zeros((1, n, 1, len(NUMBER)))
    arc[0, at, at - 1] = 1.0
    rel[0, at, at - 1, size % len(RELS)] = 1.0
    pos[0, at, size * 3 % len(UPOS)] = 1.0
    feats[0, at, 0, size % len(NUMBER)] = 1.0
    return {"s_arc": arc, "s_rel": rel, "s_pos": pos, "s_feats": feats}


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sent_id, sentence) of all requests, each once."""
    requests = table(spark, sf_dir, "parse_requests").groupBy("req_no").agg(F.min_by("sentences", "loaded_at").alias("sentences"))
    rows = requests.select("req_no", F.posexplode("sentences").alias("i", "sentence"))
    return rows.select((F.col("req_no") * 1000 + F.col("i")).alias("sent_id"), "sentence")


def annotate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and expressions of every sentence: tokenized, scored, decoded, matched, overlaps resolved."""
    entries = lexicon.with_entry_index(table(spark, sf_dir, "core_lexicon"), ["id"])
    found = pipeline.parse(sentences(spark, sf_dir), chain_scores, VOCAB, entries)
    of = lambda name: F.array_join(F.transform("tokens", lambda t: t[name].cast("string")), " ").alias(name)
    mwes = F.array_join(F.transform("mwes", lambda m: F.concat_ws(":", m["id"].cast("string"), F.array_join(F.transform(m["token_ids"], lambda x: x.cast("string")), ","))), " ")
    return found.select("sent_id", F.size("tokens").alias("n_tokens"), *[of(n) for n in ("word", "lemma", "head", "rel", "upos", "feats")], mwes.alias("mwes"), "error")


QUERIES = {"annotate_results": annotate_results}

_list = lambda names, at: f"[{', '.join(S.q(x) for x in names)}][({at}) % {len(names)} + 1]"
_TOKENS = f"""sents AS (SELECT req_no * 1000 + i AS sent_id, {S.tokenize(S.trim("coalesce(s, '')"))} AS ws
  FROM (SELECT req_no, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS s FROM (SELECT req_no, arg_min(sentences, loaded_at) AS a FROM parse_requests GROUP BY req_no))),
parsed_tokens AS (SELECT sent_id, i AS id, word, '' AS lemma, i - 1 AS head, {_list(RELS, 'length(word)')} AS rel, {_list(UPOS, 'length(word) * 3')} AS upos,
  CASE length(word) % 3 WHEN 0 THEN '_' WHEN 1 THEN 'Number=Sing' ELSE 'Number=Plur' END AS feats
  FROM (SELECT sent_id, generate_subscripts(ws, 1)::int AS i, unnest(ws) AS word FROM sents)),
shown AS (SELECT sent_id, count(*)::int AS n_tokens, string_agg(word, ' ' ORDER BY id) AS word, string_agg(l, ' ' ORDER BY id) AS lemma, string_agg(head::varchar, ' ' ORDER BY id) AS head,
  string_agg(rel, ' ' ORDER BY id) AS rel, string_agg(upos, ' ' ORDER BY id) AS upos, string_agg(feats, ' ' ORDER BY id) AS feats
  FROM parsed_tokens JOIN (SELECT word, {S.lemma('word')} AS l FROM (SELECT DISTINCT word FROM parsed_tokens)) USING (word) GROUP BY sent_id),"""
SQL = {
    "annotate_results": f"""WITH RECURSIVE {_TOKENS} {mwe_queries._WITH.strip().removeprefix('WITH RECURSIVE')}, {mwe_queries._KEPT},
found AS (SELECT sent_id, string_agg(id || ':' || array_to_string(list_transform(path, lambda x: x + 1), ','), ' ' ORDER BY entry_idx) AS mwes FROM kept GROUP BY sent_id)
SELECT sent_id, coalesce(n_tokens, 0) AS n_tokens, """
    + ", ".join(f"coalesce({c}, '') AS {c}" for c in ("word", "lemma", "head", "rel", "upos", "feats", "mwes"))
    + ", NULL::varchar AS error FROM sents LEFT JOIN shown USING (sent_id) LEFT JOIN found USING (sent_id)"
}
