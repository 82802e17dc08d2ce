"""From sentences to annotated tokens, with a model behind an interface.

No model files are part of this project.  ``decode_scores`` turns the score
tensors of any parser into tokens, ``annotated`` does so inside the workers,
which then return no scores; ``OnnxScorer`` runs a parser there.
"""

from __future__ import annotations

import os
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom import constants as C
from phraseloom.functions import decode, text


@dataclass(frozen=True)
class SessionOptions:
    """How a worker runs the model: as environment variables PARSER_* or by hand.  Idle models are dropped after ``idle_unload_seconds``."""

    intra_threads: int = 1
    cpu_arena: bool = True
    mem_pattern: bool = True
    idle_unload_seconds: float = 300.0

    @classmethod
    def from_env(cls, env=os.environ) -> SessionOptions:
        on = lambda name: env.get(name, "1").strip().lower() not in ("0", "false", "off")
        idle = float(env.get("PARSER_IDLE_UNLOAD_SECS", "300"))
        return cls(max(1, int(env.get("PARSER_INTRA_THREADS", "1"))), on("PARSER_CPU_ARENA"), on("PARSER_MEM_PATTERN"), idle if idle > 0 else 300.0)


def subword_grid(words: list[list[int]]) -> np.ndarray:
    """(1, words + 1, width) of subword ids: a row for the root, one per word, cut at the limit, padded with 0."""
    rows = [[C.ROOT_SUBWORD], *[w if len(w) else [C.UNKNOWN_SUBWORD] for w in words]]
    width = min(C.MAX_SUBWORDS, max(map(len, rows)))
    grid = np.zeros((1, len(rows), width), np.int64)
    for r, row in enumerate(rows):
        grid[0, r, : min(width, len(row))] = row[:width]
    return grid


def subword_rows(ids: Column) -> Column:
    """The same grid as a column: array<array<bigint>> from the subword ids of each word."""
    one = lambda x: F.array(F.lit(x).cast("bigint"))
    words = F.transform(ids, lambda w: F.when(F.size(w) > 0, w).otherwise(one(C.UNKNOWN_SUBWORD)))
    rows = F.concat(F.array(one(C.ROOT_SUBWORD)), words)
    width = F.least(F.array_max(F.transform(rows, F.size)), F.lit(C.MAX_SUBWORDS))
    return F.transform(rows, lambda r: F.concat(F.slice(r, 1, width), F.array_repeat(F.lit(0).cast("bigint"), F.greatest(width - F.size(r), F.lit(0)))))


def decode_scores(scored: DataFrame, rels: list[str], upos: list[str], feats: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """Add ``tokens`` to rows with ``words`` and score arrays over the grid (row 0 is the root).

    ``s_arc[dependent][head]``, ``s_rel[dependent][head][relation]``,
    ``s_pos[row][tag]`` and, with feature names, ``s_feats[row][category][value]``.
    """
    label = lambda names, at, other: decode.label(F.array(*[F.lit(n) for n in names]), at, other)
    rows = scored.withColumn("_heads", decode.heads_of("s_arc"))
    facts = F.array(*[F.struct(F.lit(c).alias("category"), F.array(*[F.lit(v) for v in vs]).alias("values")) for c, vs in feats]) if feats else None

    def token(w: Column, i: Column) -> Column:
        at = i + 1
        head = F.get("_heads", at)
        rel = label(rels, decode.argmax(F.get(F.get("s_rel", at), head)), "dep")
        tag = label(upos, decode.argmax(F.get("s_pos", at)), "X")
        morph = decode.feats_string(facts, F.get("s_feats", at)) if feats else F.lit("_")
        return F.struct(
            at.cast("int").alias("id"), w.alias("word"), text.lemma(w).alias("lemma"), head.alias("head"), rel.alias("rel"), tag.alias("upos"), morph.alias("feats")
        )

    return rows.withColumn("tokens", F.transform("words", token)).drop("_heads")


class _Models:
    """What a worker process has loaded, by key: shared by all of its tasks, dropped after idle seconds by a timer."""

    def __init__(self):
        self.lock = threading.Lock()
        self.loaded: dict = {}
        self.timers: dict = {}

    def get(self, key, load: Callable[[], object], idle_seconds: float):
        """The model under ``key``, loaded if it is not there; its timer begins anew."""
        with self.lock:
            if key not in self.loaded:
                self.loaded[key] = load()
            timer = self.timers.pop(key, None)
            if timer is not None:
                timer.cancel()
            timer = threading.Timer(idle_seconds, self._drop, (key,))
            timer.daemon = True
            self.timers[key] = timer
            timer.start()
            return self.loaded[key]

    def _drop(self, key) -> None:
        with self.lock:
            if self.timers.get(key) is threading.current_thread():  # else it was used meanwhile
                self.loaded.pop(key, None)
                self.timers.pop(key, None)


_MODELS = _Models()


def load_onnx(model_path: str, tokenizer_path: str, options: SessionOptions):
    """An inference session and its tokenizer."""
    import onnxruntime as ort
    from tokenizers import Tokenizer

    o = ort.SessionOptions()
    o.graph_optimization_level = ort.GraphOptimizationLevel.ORT_ENABLE_ALL
    o.enable_cpu_mem_arena = options.cpu_arena
    o.enable_mem_pattern = options.mem_pattern
    o.intra_op_num_threads = options.intra_threads
    return ort.InferenceSession(model_path, o, providers=["CPUExecutionProvider"]), Tokenizer.from_file(tokenizer_path)


@dataclass(frozen=True)
class OnnxScorer:
    """Scores of a parser model.

    The scorer is sent to the workers as its two paths and options; the model
    itself is loaded once per worker process, when first needed, shared by all
    tasks that the process runs, and freed after ``idle_unload_seconds``
    without use.  Sentences whose grids have one shape are run together, at
    most ``batch_size`` at a time, if the model takes more than one.
    """

    model_path: str
    tokenizer_path: str
    options: SessionOptions = field(default_factory=SessionOptions)
    batch_size: int = 64
    load: Callable = load_onnx

    def _model(self):
        key = (self.model_path, self.tokenizer_path, self.options)
        return _MODELS.get(key, lambda: self.load(self.model_path, self.tokenizer_path, self.options), self.options.idle_unload_seconds)

    def __call__(self, words: list[str]) -> dict[str, np.ndarray]:
        return self.many([words])[0]

    def many(self, sentences: list[list[str]]) -> list[dict[str, np.ndarray]]:
        """One result for each sentence, in order."""
        session, tokenizer = self._model()
        grids = [subword_grid([tokenizer.encode(w, add_special_tokens=False).ids for w in words]) for words in sentences]
        names = [o.name for o in session.get_outputs()]
        fixed = session.get_inputs()[0].shape[0] == 1
        shapes: dict = {}
        for i, grid in enumerate(grids):
            shapes.setdefault(grid.shape, []).append(i)
        found: list = [None] * len(sentences)
        for same in shapes.values():
            step = 1 if fixed else self.batch_size
            for at in range(0, len(same), step):
                part = same[at : at + step]
                tensors = session.run(names, {"subwords": np.concatenate([grids[i] for i in part])})
                for k, i in enumerate(part):
                    found[i] = {n: t[k : k + 1] for n, t in zip(names, tensors)}
        return found


#: Cells of arc scores that a worker holds at once.
CELLS = 1 << 17

SCORES = "s_arc array<array<float>>, s_rel array<array<array<float>>>, s_pos array<array<float>>, s_feats array<array<array<float>>>"


def _parts(sentences: list[list[str]]) -> Iterator[slice]:
    """The sentences in parts whose arc scores have at most ``CELLS`` cells together; a longer sentence is a part of its own."""
    lo = cells = 0
    for i, words in enumerate(sentences):
        size = (len(words) + 1) ** 2
        if i > lo and cells + size > CELLS:
            yield slice(lo, i)
            lo, cells = i, 0
        cells += size
    if lo < len(sentences):
        yield slice(lo, len(sentences))


def _scored(scorer, sentences: list[list[str]]) -> list[tuple[dict, str | None]]:
    """(tensors, error) of each sentence; a sentence without words is not scored, and one that fails fails alone."""

    def alone(words):
        try:
            return (scorer(words) if words else {}), None
        except Exception as e:
            return {}, str(e)

    some = [i for i, words in enumerate(sentences) if words]
    if hasattr(scorer, "many") and some:
        try:
            results = dict(zip(some, scorer.many([sentences[i] for i in some])))
            return [(results.get(i, {}), None) for i in range(len(sentences))]
        except Exception:  # one of them: find out which
            pass
    return [alone(words) for words in sentences]


def score(sentences: DataFrame, scorer, key_schema: str) -> DataFrame:
    """Run ``scorer(words) -> {name: tensor}`` over rows with ``words``; a sentence without words has empty scores.

    A scorer with a method ``many`` gets the sentences of a batch at once.  A
    failing sentence does not fail its task: ``error`` holds the message.
    """
    keys = [c for c in sentences.columns if c != "words"]
    names = ("s_arc", "s_rel", "s_pos", "s_feats")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sentences = [list(words) if words is not None else [] for words in frame["words"]]
            for part in _parts(sentences):
                results = _scored(scorer, sentences[part])
                out = {n: [np.asarray(tensors[n][0], np.float32).tolist() if n in tensors else [] for tensors, _ in results] for n in names}
                rows = frame.iloc[part]
                yield pd.concat([rows, pd.DataFrame(out | {"error": [error for _, error in results]}, index=rows.index)], axis=1)

    return sentences.select(*keys, "words").mapInPandas(run, f"{key_schema}, words array<string>, {SCORES}, error string")


def _last_best(scores: np.ndarray) -> np.ndarray:
    """``decode.argmax`` along the last axis; what is no number, which ``score`` returns as null, is below every number."""
    n = scores.shape[-1]
    return n - 1 - np.where(np.isnan(scores), -np.inf, scores)[..., ::-1].argmax(axis=-1) if n else np.zeros(scores.shape[:-1], np.int64)


def _choices(tensors: list[dict], n: int, feats: list[tuple[str, list[str]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Head, place of relation and of tag, and places of features of the ``n`` words of sentences whose tensors have one shape; -1 without a score."""
    many = len(tensors)
    of = lambda name: np.concatenate([np.asarray(t[name])[:1] for t in tensors]).astype(np.float32) if name in tensors[0] else None
    heads, rels, tags = (np.full((many, n), -1) for _ in range(3))
    morph = np.full((many, n, len(feats)), -1)
    arc, rel, pos, feat = of("s_arc"), of("s_rel"), of("s_pos"), of("s_feats")
    if arc is not None and arc.size:
        there = min(n, arc.shape[1] - 1)
        heads[:, :there] = decode.arborescences(arc.transpose(0, 2, 1))[:, 1 : there + 1]
    if rel is not None and rel.size:
        i, at = np.nonzero((heads >= 0) & (heads < rel.shape[2]) & (np.arange(1, n + 1) < rel.shape[1]))
        rels[i, at] = _last_best(rel[i, at + 1, heads[i, at]])
    if pos is not None and pos.size:
        there = min(n, pos.shape[1] - 1)
        tags[:, :there] = _last_best(pos[:, 1 : there + 1])
    if feat is not None:
        there = min(n, feat.shape[1] - 1)
        morph[:, :there] = 0
        for c, (_, values) in enumerate(feats[: feat.shape[2]]):
            morph[:, :there, c] = _last_best(feat[:, 1 : there + 1, c, : len(values)])
    return heads, rels, tags, morph


def _annotations(scorer, sentences: list[list[str]], rels: list[str], upos: list[str], feats: list[tuple[str, list[str]]]) -> list[pa.Array]:
    """Columns ``ANNOTATED`` of some sentences."""
    results = _scored(scorer, sentences)
    words = [w if error is None else [] for w, (_, error) in zip(sentences, results)]
    offsets = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    heads, rel, tag = (np.full(offsets[-1], -1) for _ in range(3))
    morph = np.full((offsets[-1], len(feats)), -1)
    shapes: dict = {}
    for i, (w, (tensors, _)) in enumerate(zip(words, results)):
        if w:
            shapes.setdefault((len(w), *[(name, np.shape(x)) for name, x in tensors.items()]), []).append(i)
    for (n, *_), same in shapes.items():
        at = offsets[same][:, None] + np.arange(n)
        heads[at], rel[at], tag[at], morph[at] = _choices([results[i][0] for i in same], n, feats)

    def labels(names: list[str], places: np.ndarray, other: str) -> pa.Array:
        return pa.array([*names, other], pa.string()).take(pa.array(np.where((places >= 0) & (places < len(names)), places, len(names))))

    if feats:
        kinds, kind = np.unique(morph, axis=0, return_inverse=True)
        shown = ["|".join(f"{c}={values[p]}" for (c, values), p in zip(feats, places) if p > 0) or "_" if places[0] >= 0 else None for places in kinds]
        morphs = pa.array(shown, pa.string()).take(pa.array(kind.reshape(-1)))
    else:
        morphs = labels([], heads, "_")
    lists = [pa.array([w for ws in words for w in ws], pa.string()), pa.array(heads, pa.int32(), mask=heads < 0), labels(rels, rel, "dep"), labels(upos, tag, "X"), morphs]
    return [*[pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x) for x in lists], pa.array([error for _, error in results], pa.string())]


ANNOTATED = "words array<string>, heads array<int>, rels array<string>, upos array<string>, feats array<string>, error string"


def annotated(sentences: DataFrame, scorer, key_schema: str, rels: list[str], upos: list[str], feats: list[tuple[str, list[str]]] = ()) -> DataFrame:
    """``score`` and ``decode_scores`` in one pass over rows with ``words``: the keys and, in parallel arrays, ``ANNOTATED``.

    Scores grow with the square of a sentence, so they stay in the worker,
    ``CELLS`` at a time.  A sentence that fails has no words, and its message
    in ``error``.
    """
    keys = [c for c in sentences.columns if c != "words"]
    names = [x.split()[0] for x in ANNOTATED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [words or [] for words in batch.column("words").to_pylist()]
            for part in _parts(rows):
                own = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*[own.column(k) for k in keys], *_annotations(scorer, rows[part], rels, upos, list(feats))], [*keys, *names])

    return sentences.select(*keys, "words").mapInArrow(run, f"{key_schema}, {ANNOTATED}")


def tokens_of(rows: DataFrame) -> DataFrame:
    """Rows of ``annotated`` with ``tokens`` in place of the parallel arrays."""

    def token(w: Column, i: Column) -> Column:
        of = lambda name: F.get(name, i)
        return F.struct((i + 1).cast("int").alias("id"), w.alias("word"), text.lemma(w).alias("lemma"), of("heads").alias("head"), of("rels").alias("rel"), of("upos").alias("upos"), of("feats").alias("feats"))

    return rows.withColumn("tokens", F.transform("words", token)).drop("words", "heads", "rels", "upos", "feats")


def words_of(sentences: DataFrame, sentence: str = "sentence") -> DataFrame:
    """Add ``words``: the trimmed sentence's tokens; null has none."""
    words = text.tokenize(text.unicode_trim(F.coalesce(sentence, F.lit(""))))
    return sentences.withColumn("words", words)
