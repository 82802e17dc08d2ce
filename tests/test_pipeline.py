"""From sentences and scores to results and events."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Observation
from pyspark.sql import functions as F
from test_mwe import SENTENCES, _lexicon, _sentence

from phraseloom.functions import feats
from phraseloom.operators import annotate, mwe
from phraseloom.plans import pipeline
from phraseloom.sources import vocab
from phraseloom.streaming import events


def _make_scorer():
    """A scorer that is sent to the workers by value."""

    def scorer(words):
        """Every word hangs on the first, which is a verb; the others are nouns with a number."""
        if "boom" in words:
            raise RuntimeError("too loud")
        n = len(words) + 1
        arc = np.full((1, n, n), -9.0)
        arc[0, 1, 0] = 9.0
        arc[0, 2:, 1] = 9.0
        rel = np.zeros((1, n, n, 2))
        rel[0, 1, 0, 1] = rel[0, 2:, 1, 0] = 1.0
        pos = np.zeros((1, n, 3))
        pos[0, 1, 1] = pos[0, 2:, 0] = 1.0
        morph = np.zeros((1, n, 1, 3))
        morph[0, :, 0, 0] = 0.5
        morph[0, 2:, 0, 2] = 1.0
        return {"s_arc": arc, "s_rel": rel, "s_pos": pos, "s_feats": morph}

    return scorer


def test_parse_and_events(spark, tmp_path):
    path = tmp_path / "vocabs.json"
    path.write_text(json.dumps({"rel_vocab": {"dep": 0, "root": 1}, "pos_vocab": {"NOUN": 0, "VERB": 1, "PUNCT": 2}, "feats_vocab": {"Number": {"_": 0, "Sing": 1, "Plur": 2}}, "x": 1}, indent=1))
    labels = vocab.read(spark, str(path))
    assert labels == vocab.Vocab(["dep", "root"], ["NOUN", "VERB", "PUNCT"], [("Number", ["_", "Sing", "Plur"])])
    sentences = spark.createDataFrame([("r", 0, 10, "Spill the beans"), ("r", 1, 11, ""), ("q", 0, 12, "boom"), ("q", 1, 13, "Break a leg"), ("n", 0, 14, None)], "req string, i int, sent_id bigint, sentence string")
    results = pipeline.parse(sentences, _make_scorer(), labels, _lexicon(spark))
    rows = {r.sent_id: r for r in results.collect()}
    assert [t.rel for t in rows[10].tokens] == ["root", "dep", "dep"] and [t.head for t in rows[10].tokens] == [0, 1, 1]
    assert [t.feats for t in rows[10].tokens] == ["_", "Number=Plur", "Number=Plur"] and [m.phrase for m in rows[10].mwes] == ["spill the beans"]
    assert rows[11].tokens == rows[14].tokens == rows[12].tokens == [] and rows[12].error == "too loud"
    seen = Observation()
    pipeline.observed(results, seen).write.format("noop").mode("overwrite").save()
    assert seen.get == {"sentences": 5, "words": 6, "mwes": 2, "errors": 1}
    answers = pipeline.as_answers(results.join(sentences.select("sent_id", "req", "i"), "sent_id"), "req", "i")
    by: dict = {}
    for r in events.request_events(answers, "req").orderBy("req", "seq").collect():
        by.setdefault(r.req, []).append((r.event, r.data))
    assert [e for e, _ in by["r"]] == ["result", "progress", "result", "progress", "done"]
    first = json.loads(by["r"][0][1])
    assert first["index"] == 0 and first["result"]["mwes"][0]["definition"] is None and first["result"]["tokens"][0]["word"] == "Spill"
    assert by["q"] == [("error", "sentence 0: too loud")]


#: sentence, annotation (word/UPOS/head/rel) and the expression that must be found
GOLDEN = [
    ("You have an audition today? Break a leg!", "You/PRON/2/dep have/VERB/0/root an/DET/4/dep audition/NOUN/2/dep today/NOUN/2/dep ?/PUNCT/2/dep Break/VERB/2/dep a/DET/9/dep leg/NOUN/7/dep !/PUNCT/7/dep", "break a leg"),
    ("He spilled the beans about the surprise party.", "He/PRON/2/dep spilled/VERB/0/root the/DET/4/dep beans/NOUN/2/dep about/ADP/8/dep the/DET/8/dep surprise/NOUN/8/dep party/NOUN/2/dep ./PUNCT/2/dep", "spill the beans"),
    ("After years of hard work, she finally kicked the bucket.", "After/ADP/2/dep years/NOUN/9/dep of/ADP/5/dep hard/ADJ/5/dep work/NOUN/2/dep ,/PUNCT/9/dep she/PRON/9/dep finally/ADV/9/dep kicked/VERB/0/root the/DET/11/dep bucket/NOUN/9/dep ./PUNCT/9/dep", "kick the bucket"),
    ("She was over the moon when she heard the news.", "She/PRON/5/dep was/AUX/5/dep over/ADP/5/dep the/DET/5/dep moon/NOUN/0/root when/ADV/8/dep she/PRON/8/dep heard/VERB/5/dep the/DET/10/dep news/NOUN/8/dep ./PUNCT/5/dep", "over the moon"),
    ("they just did not hold with such nonsense.", "they/PRON/5/dep just/ADV/5/dep did/AUX/5/dep not/PART/5/dep hold/VERB/0/root with/ADP/8/dep such/ADJ/8/dep nonsense/NOUN/5/dep ./PUNCT/5/dep", "hold with"),
    ("she spent her time spying on the neighbours.", "she/PRON/2/dep spent/VERB/0/root her/PRON/4/dep time/NOUN/2/dep spying/VERB/2/dep on/ADP/8/dep the/DET/8/dep neighbours/NOUN/5/dep ./PUNCT/2/dep", "spy on"),
]
TAGS = ["NOUN", "VERB", "ADJ", "ADV", "PRON", "DET", "ADP", "PUNCT", "AUX", "PART"]


def _lookup_scorer(known, tags):
    """A scorer that knows the annotation of some sentences, by their words."""
    import numpy as np

    def scorer(words):
        parts = [x.rsplit("/", 3) for x in known[" ".join(words)].split()]
        n = len(parts) + 1
        arc, rel, pos = np.zeros((1, n, n)), np.zeros((1, n, n, 2)), np.zeros((1, n, len(tags)))
        for i, (_, tag, head, r) in enumerate(parts, 1):
            arc[0, i, int(head)] = pos[0, i, tags.index(tag)] = 5.0
            rel[0, i, int(head), int(r == "root")] = 1.0
        return {"s_arc": arc, "s_rel": rel, "s_pos": pos}

    return scorer


def test_golden_sentences(spark):
    known = {" ".join(x.rsplit("/", 3)[0] for x in annotation.split()): annotation for _, annotation, _ in GOLDEN}
    df = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(GOLDEN)], "sent_id bigint, sentence string")
    rows = {r.sent_id: r for r in pipeline.parse(df, _lookup_scorer(known, TAGS), vocab.Vocab(["dep", "root"], TAGS), _lexicon(spark)).collect()}
    for i, (_, annotation, phrase) in enumerate(GOLDEN):
        assert rows[i].error is None and ["/".join((t.word, t.upos, str(t.head), t.rel)) for t in rows[i].tokens] == annotation.split()
        assert phrase in [m.phrase for m in rows[i].mwes] and all(len(m.token_ids) >= 2 for m in rows[i].mwes)
        assert all(t.feats == "_" for t in rows[i].tokens)


def test_feats(spark):
    cases = {"_": None, "Mood=Ind|Number=Plur": None, "Gender=Fem,Masc": None, "Number=Plur|Mood=Ind": "order", "Mood=Odd": "unknown", "Mood": "grammar", "": "grammar", None: "missing", "NumType=Card|Number=Sing": None}
    df = spark.createDataFrame([(k,) for k in cases], "f string")
    assert {r.f: r.p for r in df.select("f", feats.problem(F.col("f")).alias("p")).collect()} == cases
    assert df.where("f like 'Mood=Ind%'").select(feats.as_map(F.col("f")).alias("m")).first().m == {"Mood": "Ind", "Number": "Plur"}


def _sparing_scorer():
    """A scorer of many sentences that takes no more of them than fit the bound on cells."""

    class Sparing:
        def many(self, sentences):
            if sum((len(words) + 1) ** 2 for words in sentences) > 1 << 17:
                raise MemoryError("too many scores at once")
            return [{"s_pos": np.ones((1, len(words) + 1, 1))} for words in sentences]

        def __call__(self, words):
            raise MemoryError("one by one")

    return Sparing()


def test_scores_of_few_sentences_are_held_at_once(spark):
    sentences = spark.range(3000).select(F.col("id").alias("sent_id"), F.lit("one two three four five six seven eight").alias("sentence")).coalesce(1)
    rows = pipeline.parse(sentences, _sparing_scorer(), vocab.Vocab(["dep"], ["NOUN"]), _lexicon(spark))
    assert rows.agg(F.count("*"), F.count("error"), F.sum(F.size("tokens"))).first() == (3000, 0, 24000)
    words = sentences.select("sent_id", F.split("sentence", " ").alias("words"))
    assert annotate.score(words, _sparing_scorer(), "sent_id bigint").agg(F.count("*"), F.count("error")).first() == (3000, 0)


def _random_scorer():
    """Scores drawn by the words, with ties, cycles and no numbers; some sentences lack tensors or rows of them."""

    def scorer(words):
        n, rng = len(words) + 1, np.random.default_rng(len("".join(words)) * 97 + len(words))
        if words[0] == "boom":
            raise RuntimeError("too loud")
        found = {"s_arc": rng.integers(0, 4, (1, n, n)), "s_rel": rng.integers(0, 3, (1, n, n, 3)) / 2, "s_pos": rng.integers(0, 2, (1, n, 4)) / 3, "s_feats": rng.integers(0, 3, (1, n, 2, 3)) / 4}
        found["s_pos"][0, -1, 0] = np.nan
        if words[0] == "less":
            found = {"s_arc": found["s_arc"], "s_pos": found["s_pos"][:, :-1]}
        return found

    return scorer


def test_annotated_is_score_and_decode(spark):
    rng = np.random.default_rng(5)
    texts = [[("boom", "less", "a", "bb", "ccc")[k] for k in rng.integers(0, 5, n)] for n in rng.integers(0, 9, 300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(300, None)], "k int, words array<string>")
    labels = (["dep", "root"], ["A", "B", "C"], [("Case", ["_", "Nom"]), ("Number", ["_", "Sing", "Plur"]), ("Mood", ["_", "Ind"])])
    one = annotate.tokens_of(annotate.annotated(df, _random_scorer(), "k int", *labels))
    scored = annotate.score(df, _random_scorer(), "k int")
    empty = F.array().cast("array<string>")
    two = annotate.decode_scores(scored.withColumn("words", F.when(scored["error"].isNull(), scored["words"]).otherwise(empty)), *labels).select("k", "error", F.coalesce("tokens", F.array().cast(one.schema["tokens"].dataType)).alias("tokens"))
    assert sorted(one.select("k", "error", "tokens").collect()) == sorted(two.collect(), key=lambda r: r.k)


def test_results_in_place(spark):
    """Matches stay with their sentence wherever batches fall, and are those of the joins."""
    tokens = [t for k in range(4) for j, s in enumerate(SENTENCES) for t in _sentence(10 * k + j, s)]
    rows = mwe.sentences_of(spark.createDataFrame(tokens, "sent_id bigint, id int, word string, lemma string, head int, rel string, upos string, feats string"))
    entries = _lexicon(spark)
    twin = entries.withColumns({"entry_idx": F.col("entry_idx") + 100, "id": F.col("id") + 100})
    both = entries.unionByName(twin).unionByName(entries.where("id = 7").withColumn("entry_idx", F.lit(300).cast("bigint")))
    joined = sorted(mwe.results(rows, both, most_bytes=0).collect())
    assert sum(len(r.mwes) for r in joined) > 20
    for size in ("1", "2", "3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert sorted(mwe.results(rows, both).collect()) == joined
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
