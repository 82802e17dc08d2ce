"""The whole chain from sentences to results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from phraseloom.operators import annotate, mwe
from phraseloom.plans.lineage import scratch_path
from phraseloom.sources.vocab import Vocab


def parse(sentences: DataFrame, scorer, vocab: Vocab, entries: DataFrame, key: str = "sent_id") -> DataFrame:
    """(key, tokens, mwes, error) of (key, sentence): tokenize, score, decode, detect.

    Blank sentences have empty results.  A sentence whose scoring fails has
    empty results and the error's message.  What is read off the scores is
    written to the shared folder, so the model sees each sentence once; the
    scores themselves never leave the worker.
    """
    words = annotate.words_of(sentences.select(key, "sentence")).select(key, "words")
    scored = annotate.annotated(words, scorer, f"{key} {words.schema[key].dataType.simpleString()}", vocab.rels, vocab.upos, vocab.feats)
    path = scratch_path(sentences.sparkSession)
    scored.write.option("compression", "zstd").parquet(path)
    tokens = annotate.tokens_of(sentences.sparkSession.read.schema(scored.schema).parquet(path))
    return mwe.results(tokens, entries, key).select(key, "tokens", "mwes", "error")


def as_answers(results: DataFrame, key: str, index: str) -> DataFrame:
    """(key, results) of each request, in the shape that ``streaming.events.request_events`` reads.

    Results are JSON of tokens and mwes with nulls written.
    """
    body = F.to_json(F.struct("tokens", "mwes"), {"ignoreNullFields": "false"})
    cells = F.struct(F.col(index).alias("i"), F.struct(body.alias("result"), F.col("error").alias("error")).alias("r"))
    return results.groupBy(key).agg(F.array_sort(F.collect_list(cells)).alias("_l")).select(key, F.transform("_l", lambda x: x["r"]).alias("results"))


def observed(results: DataFrame, observation: Observation) -> DataFrame:
    """``results`` of ``parse`` that count themselves as they are written: sentences, words, mwes and errors, read from ``observation.get``."""
    error = F.count_if(F.col("error").isNotNull()) if "error" in results.columns else F.lit(0)
    return results.observe(
        observation,
        F.count("*").alias("sentences"),
        F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("words"),
        F.coalesce(F.sum(F.size("mwes")), F.lit(0)).alias("mwes"),
        error.alias("errors"),
    )
