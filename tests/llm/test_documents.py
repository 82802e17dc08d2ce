from __future__ import annotations

import os
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from phraseloom.llm import packing, tokenizers, truncation
from phraseloom.llm.queries_docs import FILES, p8_assign, vocabulary_path

TEXTS = [
    None, "", " ", "\n", "a", "  two  blanks ", "tabs\t\tand\r\nreturns;\r\n\r\nend", "He's   here — isn't he? ", "日本語のテキスト。次の文", "x" * 9000, ("word, " * 3000) + "end.",
    "zero​width 　 wide", "🙂🙂 emoji️", "<|endoftext|> stays text", "12,345.67 and 1e9", "á" * 5000 + "." + "б" * 5000, "\x1c\x85odd\x0bbreaks",
]


@pytest.fixture(scope="module")
def paths(spark):
    try:
        found = {n: vocabulary_path(spark, n) for n in FILES}
    except Exception:
        found = {}
    if not found or not all(os.path.exists(p) for p in found.values()):
        pytest.skip("tokenizer files are not here")
    return found


def test_encoding_equals_the_library_and_decodes(spark, paths):
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)], "doc_id bigint, text string, ids array<int>").repartition(3)
    encoded = tokenizers.encode(df, "doc_id", "text", paths["byte_bpe_50k"])
    got = {r.doc_id: r.ids for r in encoded.collect()}
    whole = tokenizers.load_tiktoken(tokenizers.read_vocabulary(paths["byte_bpe_50k"]))
    assert got == {i: whole.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    back = {r.doc_id: r.bytes for r in tokenizers.decode(encoded, "doc_id", "ids", paths["byte_bpe_50k"]).collect()}
    assert {i: bytes(b) for i, b in back.items()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert tokenizers.encode(df.where("false"), "doc_id", "text", paths["byte_bpe_50k"]).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.bytes for r in tokenizers.decode(nulls, "doc_id", "ids", paths["byte_bpe_50k"]).collect()} == {1: None, 2: bytearray()}


@pytest.mark.parametrize("name", ["byte_bpe_50k", "piece_bpe_32k"])
def test_counts_equal_whole_encodings(paths, name):
    counter = tokenizers.load_counter(paths[name], tokenizers.read_vocabulary(paths[name]))
    whole = counter.encoding.encode_ordinary if name == "byte_bpe_50k" else counter.model.encode
    for t in TEXTS:
        assert tokenizers.count_tokens(counter, t) == (len(whole(t)) if t else 0), t
    rng = random.Random(1)
    pool = [" ", "  ", "a", "The", ".", "\n", "\r", "\t", ";", "　", "é", "字", "'s", "}", "1"]
    for _ in range(1500):
        t = "".join(rng.choice(pool) for _ in range(rng.randint(1, 14)))
        assert tokenizers.count_tokens(counter, t) == len(whole(t)), ascii(t)


def test_pack_shard_properties():
    rng = np.random.default_rng(3)
    for capacity in (64, 100, 512):
        sizes = rng.integers(0, 300, 400)
        docs = [rng.integers(0, 500, n) for n in rng.integers(0, 40, 400)]
        doc, part, first, n, box = packing.pack_shard(sizes, capacity, packing.Index(docs, packing.Bm25()))
        assert (np.bincount(doc, weights=n, minlength=400) == sizes).all()
        assert np.bincount(box, weights=n).max() <= capacity and len(np.unique(box)) == box.max() + 1
        for d in np.unique(doc):
            own = np.sort(first[doc == d])
            assert (len(own) == 1) == (sizes[d] <= capacity) and own.tolist() == [i * capacity for i in range(len(own))]
        assert sizes.sum() / ((box.max() + 1) * capacity) > 0.93


def test_neighbours_share_containers():
    """Documents about one thing end up together."""
    rng = np.random.default_rng(1)
    topic = rng.permutation(np.repeat(np.arange(20), 10))
    docs = [np.concatenate((t * 50 + rng.integers(0, 50, 60), 5000 + rng.integers(0, 200, 20))) for t in topic]
    doc, _, _, _, box = packing.pack_shard(np.full(200, 10), 100, packing.Index(docs, packing.Bm25()))
    by_box = defaultdict(list)
    for d, b in zip(doc, box):
        by_box[b].append(topic[d])
    assert np.mean([len(set(v)) == 1 for v in by_box.values()]) > 0.9


def test_bm25_scores_equal_the_formula():
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 30, n) for n in rng.integers(1, 25, 40)]
    bm = packing.Bm25(query_terms=100)
    index = packing.Index(docs, bm)
    n, avg = len(docs), np.mean([len(d) for d in docs])
    for seed in (0, 7, 39):
        want = np.zeros(n)
        for term in set(docs[seed].tolist()):
            df = sum(term in d for d in docs)
            if df < 2:
                continue
            idf = np.log1p((n - df + 0.5) / (df + 0.5))
            for i, d in enumerate(docs):
                tf = int((d == term).sum())
                want[i] += idf * tf * (bm.k1 + 1) / (tf + bm.k1 * (1 - bm.b + bm.b * len(d) / avg))
        assert np.allclose(index.scores(seed), want)


def test_a_query_is_the_whole_seed():
    """Every shared term of a long seed counts, so a document that shares only common ones is found too."""
    rng = np.random.default_rng(5)
    docs = [np.concatenate((np.arange(40), 1000 + np.arange(200))), np.arange(40)]  # the seed and what shares its 40 rare terms
    docs += [1000 + rng.choice(200, 30, replace=False) for _ in range(60)]  # share only its common terms
    index = packing.Index(docs, packing.Bm25())
    assert len(index.query_terms[index.query_start[0] : index.query_start[1]]) == 240
    assert (index.scores(0) > 0).all()
    assert np.allclose(index.scores(0), packing.Index(docs, packing.Bm25(query_terms=10_000)).scores(0))
    _, _, _, _, box = packing.pack_shard(np.array([50, 10] + [5] * 60), 65, index)
    assert (np.bincount(box, weights=np.array([50, 10] + [5] * 60)) <= 65).all()


class _Ones:
    """A counter by which each piece is one token."""

    def middle(self, piece):
        return 1

    first = middle


def test_texts_without_blanks_share_terms():
    """Japanese and Thai texts are retrieved by what they say; full-width marks are no part of a term."""
    texts = ["新しい料理の本を読みました。", "料理の本はとても面白い！", "電車で東京駅へ行く", "昨日、東京駅の電車が遅れた", "ไปโรงเรียน", "โรงเรียนของฉัน", "the word（word） here", "Word！"]
    vocabulary = packing.Vocabulary([_Ones()])
    terms = [vocabulary.measure(t)[0] for t in texts]
    index = packing.Index(terms, packing.Bm25())
    near = []
    for seed in range(6):
        score = index.scores(seed)
        score[seed] = 0
        assert score.max() > 0
        near.append(int(score.argmax()))
    assert near == [1, 0, 3, 2, 5, 4]
    assert vocabulary.terms["word"] in terms[7] and vocabulary.measure("東")[0].tolist() == [vocabulary.terms["東"]]
    assert all(vocabulary.measure(t)[0].tolist() == own.tolist() and (own >= 0).all() for t, own in zip(texts, terms))
    vocabulary.terms.update((str(i), i) for i in range(vocabulary._FULL + 1))
    vocabulary.trim()
    assert not vocabulary and not vocabulary.terms


def test_pack(spark, paths):
    rows = [(i, t, 0) for i, t in enumerate(TEXTS)] + [(100 + i, "some words of text number %d." % (i % 7), 0) for i in range(60)] + [(100, "some words of text number 0.", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, part int").repartition(3)
    kinds = [packing.Container("s", paths["byte_bpe_50k"], 64), packing.Container("l", paths["piece_bpe_32k"], 4096)]
    out = packing.pack(df, "doc_id", "text", kinds, shard_docs=16).collect()
    for kind in kinds:
        counter = tokenizers.load_counter(kind.vocabulary_path, tokenizers.read_vocabulary(kind.vocabulary_path))
        own = [r for r in out if r.pack_kind == kind.kind]
        total, boxes = defaultdict(int), defaultdict(int)
        for r in own:
            total[r.doc_id] += r.n_tokens
            if r.container is None:
                assert r.n_tokens == 0
            else:
                boxes[r.shard, r.container] += r.n_tokens
        want = defaultdict(int)
        for i, t, _ in rows:
            want[i] += tokenizers.count_tokens(counter, t)
        assert total == want and max(boxes.values()) <= kind.capacity
        assert sum(r.container is None for r in own) == 2
        assert sum(r.doc_id == 100 for r in own) == 2  # a repeated row is an item of its own
    assert packing.pack(df.where("false"), "doc_id", "text", kinds).count() == 0


def _sources():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 9)))

    def prose(n):
        out = ""
        while len(out) < n:
            out += (" " if out else "") + " ".join(word() for _ in range(rng.randint(3, 9))).capitalize() + "."
        return out

    rows, truth = [], set()

    def add(text, source, is_cut):
        if is_cut:
            truth.add(len(rows))
        rows.append((len(rows), text, source))

    for i in range(150):
        full = prose(rng.randint(50, 900))
        hard = len(full) > 400
        cut = full[:400]
        add(cut if hard else full, "hard", hard and not cut.rstrip().endswith("."))
        add((full[:393].rstrip() + " [etc]") if hard else full, "marked", hard)
        at = full[:400].rfind(" ")
        add(full[:at] if hard else full, "words", hard and not full[:at].endswith("."))
        add(full, None, False)
        raw = (full.replace("a", "é")).encode()[:300].decode(errors="ignore")
        long = len(full.replace("a", "é").encode()) > 300
        add(raw if long else full.replace("a", "é"), "bytes", long and not raw.rstrip().endswith("."))
        broken = full[: len(full) // 2].rstrip(" .") + " th"
        add(broken if i % 10 == 0 else full, "transfer", i % 10 == 0)
    for t in ("A Title For Each Day", "Words here. 🙂", "Said it.\n\n— Ann Lee", "Text.\n#one #two", "Text.\nSource: http://a.example/x/12", "<p>In a tag.</p>", "- a (b) [c]\n- d (e)", "But then…", "“Quoted.”", "はい。"):
        add(t, "kinds", False)
    for t in (None, "", "  \n"):
        add(t, "kinds", False)
    for t in ("<p>Open tag.", "A list:\n1. One.\n2.", "See http://host.", "It ended in the mid"):
        add(t, "kinds", True)
    return rows, truth


def test_truncation(spark):
    rows, truth = _sources()
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string, _chars string")
    found = truncation.truncated(df, "doc_id", "text", "source")
    got = {r.doc_id: (r.cut, r.filled, r.source) for r in found.collect()}
    flagged = {i for i, v in got.items() if v[0]}
    assert len(got) == len(rows) and flagged == truth, [(rows[i][2], (rows[i][1] or "")[-30:]) for i in list(flagged ^ truth)[:9]]
    assert {v[0] for i, v in got.items() if v[2] in ("hard", "marked", "words", "bytes")} == {"limit", None}
    shares = {r.source: r for r in truncation.by_source(found, "source").collect()}
    assert shares["transfer"].transfer_cuts == 15 and shares["transfer"].share == pytest.approx(0.1) and shares[None].share == 0
    assert truncation.truncated(df.where("false"), "doc_id", "text", "source").count() == 0


def test_no_spike_without_a_limit(spark):
    rows = [(i, "Ab cd ef." * (i + 1), "s") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert truncation.limits(truncation.measured(df, "doc_id", "text", "source")).count() == 0
    assert truncation.truncated(df, "doc_id", "text", "source").where("cut is not null").count() == 0


def test_truncation_with_longer_texts_and_two_limits(spark):
    """Longer texts hide no limit; a source may have two; marks of omission and their numbers need not be known."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeiou") for _ in range(rng.randint(2, 9)))
    rows, truth = [], set()

    def add(text, source, is_cut):
        if is_cut:
            truth.add(len(rows))
        rows.append((len(rows), text, source))

    for i in range(400):
        full = ""
        while len(full) < rng.randint(40, 1500):
            full += (" " if full else "") + " ".join(word() for _ in range(rng.randint(4, 9))).capitalize() + rng.choice([".", ".", ".", ".", "!", "?", ".", ".", "..."])
        late = i % 25 == 0  # loaded before or after the limit held
        for source, limit, mark in (("more", 300, lambda: " (more)"), ("count", 420, lambda: f" [+{rng.randint(5, 999)}]"), ("dots", 350, lambda: "..."), ("sign", 500, lambda: " »"), ("stop", 350, lambda: " Read on.")):
            m = mark()
            cut = len(full) > limit and not late
            add(full[: limit - len(m)].rstrip() + m if cut else full, source, cut)
        limit = 250 if i % 2 else 700
        cut = len(full) > limit and not late
        add(full[:limit] if cut else full, "two", cut and full[:limit].rstrip()[-1] not in ".!?")
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id: r.cut for r in truncation.truncated(df, "doc_id", "text", "source").where("cut is not null").collect()}
    assert truth <= set(found), [rows[i][1:] for i in list(truth - set(found))[:5]]
    assert len(set(found) - truth) <= 0.01 * len(truth)
    assert sum(found[i] == "limit" for i in truth) >= 0.97 * len(truth)


def test_small_sources_and_odd_columns(spark):
    rows = [(i, None, None, 0, "a") for i in range(3)] + [(10 + i, "Done.", "a", 1, "b") for i in range(20)] + [(40, "x" * 100_000 + ".", "a", 1, "c"), (40, "x" * 100_000 + ".", "a", 1, "c")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n int, _limits string")
    got = truncation.truncated(df, "doc_id", "text", "source")
    assert got.count() == len(rows) and got.where("cut is not null").count() == 0


def test_titles_cut_at_a_limit(spark):
    """A title or a text without letter case that ends at its source's limit is cut; short complete titles are not."""
    rng = random.Random(4)
    words = lambda most=16: " ".join(rng.choice(["Green", "House", "Of", "Winter", "Lakes", "In", "Morning"]) for _ in range(rng.randint(2, most)))
    rows, truth = [], set()
    for _ in range(90):
        for text, source, limit in ((words(), "titles", 60), ("日本の古い町を歩く旅" * rng.randint(1, 9), "ja", 45)):
            if len(text) > limit:
                truth.add(len(rows))
            rows.append((len(rows), text[:limit].rstrip(), source))
    for _ in range(90):
        text = words(30)
        at = text[:61].rfind(" ") if len(text) > 60 else len(text)
        if len(text) > 60:
            truth.add(len(rows))
        rows.append((len(rows), text[:at], "whole words"))
    rows += [(1000 + i, words(8), "complete") for i in range(75)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id for r in truncation.truncated(df, "doc_id", "text", "source").where("cut is not null").collect()}
    assert truth <= found
    sources = {i: (s, len(t)) for i, t, s in rows}
    assert all(sources[i][0] != "complete" for i in found), [sources[i] for i in found - truth][:9]


def test_every_kind_of_container_is_packed(spark, paths, tmp_path):
    spark.createDataFrame([(1, "some words")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    kinds = [(f"k{i:03}", "byte_bpe_50k", 64) for i in range(103)]
    spark.createDataFrame(kinds, "pack_kind string, tokenizer string, capacity int").write.parquet(f"{tmp_path}/pack_sizes.parquet")
    assert sorted(r.pack_kind for r in p8_assign(spark, str(tmp_path)).collect()) == [k[0] for k in kinds]


def test_neighbours_are_those_of_brute_force():
    """The index ranks a shard's documents exactly as BM25 computed document by document."""
    rng = np.random.default_rng(8)
    docs = [rng.zipf(1.3, rng.integers(1, 120)) % 400 for _ in range(300)]
    bm = packing.Bm25()
    index = packing.Index(docs, bm)
    mean, n = np.mean([len(d) for d in docs]), len(docs)
    df = defaultdict(int)
    for d in docs:
        for t in set(d.tolist()):
            df[t] += 1
    hits = 0
    for seed in range(0, n, 10):
        terms = {t for t in docs[seed].tolist() if df[t] > 1}
        want = np.zeros(n)
        for i, d in enumerate(docs):
            own = d.tolist()
            for t in terms & set(own):
                tf = own.count(t)
                idf = np.log1p((n - df[t] + 0.5) / (df[t] + 0.5))
                want[i] += idf * tf * (bm.k1 + 1) / (tf + bm.k1 * (1 - bm.b + bm.b * len(own) / mean))
        assert np.allclose(index.scores(seed), want)
        hits += len(set(np.argsort(-want, kind="stable")[:10]) & set(np.argsort(-index.scores(seed), kind="stable")[:10]))
    assert hits >= 0.99 * 10 * len(range(0, n, 10))  # recall of the ten nearest


def test_how_texts_are_placed():
    docs = [np.array([1, 2, 3]), np.array([1, 2, 3]), np.array([9, 8]), np.zeros(0, np.int64)]
    doc, _, _, n, _, how = packing.placed_shard(np.array([130, 30, 20, 0]), 100, packing.Index(docs, packing.Bm25()))
    assert {(int(d), int(k), packing.PLACED[h]) for d, k, h in zip(doc, n, how)} == {(0, 100, "cut"), (0, 30, "seed"), (1, 30, "neighbour"), (2, 20, "size")}
