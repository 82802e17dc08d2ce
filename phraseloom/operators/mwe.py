"""Finding multi-word expressions in annotated sentences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phraseloom.functions import pattern, text
from phraseloom.operators.sizes import fits_broadcast
from phraseloom.plans.lineage import cut_lineage

TOKEN = "struct<id:int,word:string,lemma:string,head:int,rel:string,upos:string,feats:string>"


def sentences_of(tokens: DataFrame, key: str = "sent_id") -> DataFrame:
    """(key, tokens) from one row per token; tokens delivered twice count once, nulls of text fields are empty.

    One shuffle by sentence; a sentence is as large as its text, so no group is unbounded.
    """
    cells = [F.col("id")] + [F.coalesce(c, F.lit("")).alias(c) for c in ("word", "lemma")] + [F.coalesce("head", F.lit(0)).alias("head")]
    cells += [F.coalesce(c, F.lit("")).alias(c) for c in ("rel", "upos", "feats")]
    return tokens.where(F.col("id").isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(F.struct(*cells))).alias("tokens"))


def prepared(sentences: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Add the parallel arrays that detection reads: words, upos, rels, heads, lemmas (verb-gated), stems."""
    of = lambda name: F.transform(tokens, lambda t: t[name])
    rows = sentences.withColumns({"_words": of("word"), "_upos": of("upos"), "_rels": of("rel"), "_heads": of("head")})
    rows = rows.withColumn("_lemmas", F.zip_with("_words", "_upos", lambda w, u: text.lemma(w, u == "VERB")))
    return rows.withColumns({"_toks": pattern.tokens(F.col("_lemmas"), F.col("_upos"), F.col("_words")), "_stems": F.array_distinct(F.transform("_lemmas", pattern.stem_key))})


def planned(entries: DataFrame) -> DataFrame:
    """Add to lexicon entries what matching needs: key, plan, stems, and facts of the entry."""
    e = F.col("elements")
    return entries.withColumns(
        {
            "_first": pattern.first_fixed(e),
            "_plan": pattern.plan(e),
            "_entry_stems": F.array_distinct(F.transform(pattern.fixed_lemmas(e), pattern.stem_key)),
            "_has_slot": pattern.has_slot(e),
            "_phrasal": F.coalesce(F.array_contains("categories", "phrasal_verb"), F.lit(False)),
        }
    )


#: Parts into which the sentences of one lemma are spread where the lexicon is too large to broadcast.
SALTS = 32


def candidates(sentences: DataFrame, entries: DataFrame, key: str = "sent_id", most_bytes: int | None = None) -> DataFrame:
    """Prepared sentences joined to the planned entries whose first lemma occurs in them, exactly.

    Equal lemmas share their first characters, so pairs where a stem of the
    entry is missing from the sentence are dropped by a set difference before
    any matching.

    A lexicon of at most ``most_bytes`` (measured) is broadcast: one hash join
    in the task that reads the sentences, nothing is shuffled.  A larger one is
    joined in two steps: sentence keys, lemmas and stems meet first lemmas and
    stems, without the sentences themselves; lemmas as frequent as "be" are
    spread over ``SALTS`` parts, for which the narrow side of the lexicon is
    repeated.  The few pairs that are left fetch their entry and their
    sentence, whose keys are unique.
    """
    stems_there = F.size(F.array_except("_entry_stems", "_stems")) == 0
    lemmas = F.explode(F.array_distinct("_lemmas")).alias("_lemma")
    if fits_broadcast(entries, most_bytes):
        joined = sentences.select("*", lemmas).join(F.broadcast(entries), F.col("_lemma") == F.col("_first")).drop("_lemma")
        return joined.where(stems_there)
    salt = F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")
    narrow = sentences.select(key, "_stems", lemmas).withColumn("_salt", salt)
    firsts = entries.select("_first", "_entry_stems", "entry_idx", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    hits = narrow.join(firsts, (F.col("_lemma") == F.col("_first")) & (narrow["_salt"] == firsts["_salt"])).where(stems_there).select(key, "entry_idx")
    return hits.join(entries, "entry_idx").join(sentences, key)


def matched(pairs: DataFrame) -> DataFrame:
    """Candidates with the positions of their match, ``_path``; the others drop.  Phrasal verbs pass their gate."""
    path = pattern.match(F.col("_toks"), F.col("_plan"))
    found = pairs.select("*", text.once_if(path, lambda p: p.isNotNull()).alias("_path"))
    gate = pattern.phrasal_arc_ok(F.col("_path"), F.col("_heads"), F.col("_rels"), F.col("_upos"))
    return found.where(~F.col("_phrasal") | gate)


def match_cells() -> list[Column]:
    """Cells of a match in the shape of the results, after the number of its entry."""
    path, words = F.col("_path"), F.col("_words")
    lo, hi = F.get(path, 0), F.element_at(path, -1)
    return [
        F.col("entry_idx"),
        F.col("id"),
        F.col("pos"),
        F.col("phrase"),
        F.col("definition"),
        F.col("categories"),
        F.col("_has_slot").alias("has_slot"),
        F.transform(path, lambda p: p + 1).alias("token_ids"),
        F.transform(path, lambda p: F.get(words, p)).alias("words"),
        pattern.surface(words, lo, hi).alias("surface"),
        (hi - lo + 1 != F.size(path)).alias("discontinuous"),
    ]


def as_matches(found: DataFrame, key: str = "sent_id") -> DataFrame:
    """One row per match in the shape of the results."""
    return found.select(key, *match_cells())


def _rank(m: Column) -> Column:
    """Orders matches from strongest: more words, less gap, earlier entry."""
    ids = m["token_ids"]
    return F.struct((-F.size(ids)).alias("n"), (F.element_at(ids, -1) - F.get(ids, 0)).alias("span"), m["entry_idx"].alias("entry_idx"))


def keep_strongest(matches: Column) -> Column:
    """Matches of one sentence that no overlapping stronger match beats; a beaten match still beats others."""
    beaten = lambda m: F.exists(matches, lambda o: F.arrays_overlap(o["token_ids"], m["token_ids"]) & (_rank(o) < _rank(m)))
    return F.filter(matches, lambda m: ~beaten(m))


def resolve_overlaps(matches: DataFrame, key: str = "sent_id") -> DataFrame:
    """Rows of ``as_matches`` without those beaten by an overlapping stronger one.

    The matches of a sentence are gathered (a few per sentence) and compared
    in place, so overlap is no self-join.
    """
    cells = [c for c in matches.columns if c not in (key, "entry_idx")]
    grouped = matches.groupBy(key).agg(F.collect_list(F.struct("entry_idx", *cells)).alias("_m"))
    return grouped.select(key, F.explode(keep_strongest(F.col("_m"))).alias("_k")).select(key, "_k.*")


def detect(sentences: DataFrame, entries: DataFrame, key: str = "sent_id", most_bytes: int | None = None) -> DataFrame:
    """One row per expression found: the whole chain over (key, tokens) and (entry_idx, id, phrase, ..., elements).

    The lexicon join needs no shuffle while the lexicon can be broadcast (see
    ``candidates``); overlaps are resolved after one shuffle of the few matches.
    """
    narrow = prepared(sentences.select(key, "tokens")).drop("tokens")
    found = matched(candidates(narrow, planned(entries), key, most_bytes))
    return resolve_overlaps(as_matches(found, key), key)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row without ``_match`` with the list of the matches that follow it; batches may fall anywhere between."""
    held = None
    for batch in batches:
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()
        if not rows:
            continue
        heads = np.flatnonzero(rows[0].column("_match").is_null().to_numpy(zero_copy_only=False))
        held = rows[0].slice(heads[-1])  # its matches may go on
        if heads[-1]:
            yield _lists(rows[0].slice(0, heads[-1]), heads)
    if held is not None:
        yield _lists(held, np.array([0, len(held)]))


def _lists(rows: pa.RecordBatch, heads: np.ndarray) -> pa.RecordBatch:
    """Sentences at the places ``heads`` but the last, which is the number of rows, with their matches."""
    at = pa.array(heads[:-1])
    matches = rows.column("_match").drop_null()
    lists = pa.ListArray.from_arrays(pa.array(heads - np.arange(len(heads)), pa.int32()), matches)
    names = [n for n in rows.schema.names if n != "_match"]
    return pa.RecordBatch.from_arrays([*[rows.column(n).take(at) for n in names], lists], [*names, "_matches"])


def _results_in_place(sentences: DataFrame, entries: DataFrame, key: str) -> DataFrame:
    """``results`` with a broadcast lexicon and no shuffle.

    A sentence becomes one row that carries it and, right behind it, one for
    each lemma, of which the matches are left.  Nothing between moves rows, so
    the matches that follow a sentence are its own.
    """
    own = sentences.columns
    lemmas = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("_lemmas"))).alias("_lemma")
    carries = F.col("_lemma").isNull()
    rows = prepared(sentences).select("*", lemmas).join(F.broadcast(entries), F.col("_lemma") == F.col("_first"), "left")
    pairs = rows.where(carries | (F.size(F.array_except("_entry_stems", "_stems")) == 0))
    found = pairs.select("*", text.once_if(F.when(~carries, pattern.match(F.col("_toks"), F.col("_plan"))), lambda p: p.isNotNull() | carries).alias("_path"))
    gate = pattern.phrasal_arc_ok(F.col("_path"), F.col("_heads"), F.col("_rels"), F.col("_upos"))
    kept = found.where(carries | ~F.col("_phrasal") | gate)
    cell = F.struct(*match_cells())
    parts = kept.select(*[F.when(carries, F.col(c)).alias(c) for c in own], F.when(~carries, cell).alias("_match"))
    kind = T.StructType([parts.schema[c] for c in own]).add("_matches", T.ArrayType(parts.schema["_match"].dataType))
    lists = parts.mapInArrow(_gathered, kind)
    names = [n for n in parts.schema["_match"].dataType.names if n != "entry_idx"]
    mwes = F.transform(F.array_sort(keep_strongest(F.col("_matches"))), lambda m: F.struct(*[m[n].alias(n) for n in names]))
    return lists.select(*own, mwes.alias("mwes"))


def results(sentences: DataFrame, entries: DataFrame, key: str = "sent_id", most_bytes: int | None = None) -> DataFrame:
    """(key, tokens, ..., mwes): every sentence with its matches in entry order, empty where there are none.

    Sentences are read once where the lexicon can be broadcast, and checkpointed where it is too large.
    """
    if fits_broadcast(planned(entries), most_bytes):
        return _results_in_place(sentences, planned(entries), key)
    sentences = cut_lineage(sentences)
    found = detect(sentences, entries, key, most_bytes)
    cells = [c for c in found.columns if c not in (key, "entry_idx")]
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("entry_idx", F.struct(*cells).alias("m")))).alias("_l"))
    joined = sentences.join(lists.select(key, F.transform("_l", lambda x: x["m"]).alias("mwes")), key, "left")
    empty = F.array().cast(joined.schema["mwes"].dataType)
    return joined.withColumn("mwes", F.coalesce("mwes", empty))
