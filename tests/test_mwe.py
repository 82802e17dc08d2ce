"""Detection end to end: gate, surface, overlaps, results."""

from __future__ import annotations

from pyspark.sql import functions as F

from phraseloom.functions import pattern
from phraseloom.operators import lexicon, mwe

LEXICON = [
    (1, "break a leg", ["idiom"]), (2, "spill the beans", ["idiom"]), (3, "kick the bucket", ["idiom"]), (4, "over the moon", ["idiom"]),
    (5, "hold with", ["phrasal_verb"]), (6, "spy on", ["phrasal_verb"]), (7, "the moon", ["fixed_collocation"]), (8, "alone", ["idiom"]), (9, "look for", ["phrasal_verb"]),
]


def _lexicon(spark):
    rows = spark.createDataFrame(LEXICON, "id bigint, phrase string, categories array<string>")
    entries = rows.withColumns({"pos": F.lit(None).cast("string"), "definition": F.lit(None).cast("string"), "tags": F.array().cast("array<string>"), "elements": pattern.phrase_elements(F.col("phrase"))})
    return lexicon.with_entry_index(entries, ["id"])


def _sentence(key, spec):
    """word/UPOS/head/rel ..."""
    out = []
    for i, part in enumerate(spec.split(), 1):
        word, upos, head, rel = part.rsplit("/", 3)
        out.append((key, i, word, "", int(head), rel, upos, "_"))
    return out


SENTENCES = [
    "Break/VERB/0/root a/DET/3/det leg/NOUN/1/obj !/PUNCT/1/punct",
    "He/PRON/2/nsubj spilled/VERB/0/root the/DET/4/det beans/NOUN/2/obj ./PUNCT/2/punct",
    "she/PRON/2/nsubj kicked/VERB/0/root the/DET/4/det bucket/NOUN/2/obj",
    "She/PRON/4/nsubj was/AUX/4/cop over/ADP/4/case the/DET/5/det moon/NOUN/0/root",
    "did/AUX/3/aux not/PART/3/advmod hold/VERB/0/root with/ADP/6/case such/ADJ/6/amod nonsense/NOUN/3/obl",
    "time/NOUN/0/root spying/VERB/1/acl on/ADP/5/case the/DET/5/det neighbours/NOUN/2/obl",
    "look/VERB/0/root for/ADP/3/mark find/VERB/1/advcl",
    "look/NOUN/0/root for/ADP/1/case",
]


def test_detect(spark):
    tokens = [t for k, s in enumerate(SENTENCES) for t in _sentence(k, s)]
    rows = spark.createDataFrame(tokens, "sent_id bigint, id int, word string, lemma string, head int, rel string, upos string, feats string")
    sentences = mwe.sentences_of(rows.unionByName(rows))  # delivered twice
    assert sentences.select(F.sum(F.size("tokens"))).first()[0] == len(tokens)
    found = {r.sent_id: r for r in mwe.detect(sentences, _lexicon(spark)).collect()}
    assert {k: r.phrase for k, r in found.items()} == {0: "break a leg", 1: "spill the beans", 2: "kick the bucket", 3: "over the moon", 4: "hold with", 5: "spy on"}
    assert found[1].token_ids == [2, 3, 4] and found[1].surface == "spilled the beans" and not found[1].discontinuous and found[1].entry_idx == 1
    results = {r.sent_id: len(r.mwes) for r in mwe.results(sentences, _lexicon(spark)).collect()}
    assert results == {0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 0, 7: 0}


def test_entries_of_one_word_are_not_indexed(spark):
    assert [r.phrase for r in _lexicon(spark).orderBy("entry_idx").collect()] == [p for _, p, _ in LEXICON if p != "alone"]


def test_overlap_chain(spark):
    """A loses to B and B to C: both go, although B is gone itself."""
    rows = [(1, 0, [1, 2]), (1, 1, [2, 3, 4]), (1, 2, [4, 5, 6, 7]), (1, 3, [9, 10]), (1, 4, [9, 10]), (1, 5, [12, 14]), (1, 6, [12, 13]), (2, 7, [1, 2])]
    df = spark.createDataFrame(rows, "sent_id bigint, entry_idx bigint, token_ids array<int>")
    assert sorted(r.entry_idx for r in mwe.resolve_overlaps(df).collect()) == [2, 3, 6, 7]


def test_surface(spark):
    df = spark.createDataFrame([(["do", "n't", "you", "'s", ",", "go", "!", "?", "."],)], "w array<string>")
    assert df.select(pattern.surface(F.col("w"), F.lit(0), F.lit(8)).alias("s")).first().s == "don't you's, go!?."


def test_empty_tables(spark):
    tokens = spark.createDataFrame([], "sent_id bigint, id int, word string, lemma string, head int, rel string, upos string, feats string")
    assert mwe.detect(mwe.sentences_of(tokens), _lexicon(spark)).count() == 0
