"""Filling fixed-capacity containers with whole texts, by lexical retrieval.

A shard is a run of documents that one task reads.  It gets an inverted index
with BM25 weights; for each container size, the largest unused document seeds
a container, the index returns its unused neighbours by score, and they fill
the window greedily.  What room is then left takes the largest unused
documents that fit, neighbours or not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from phraseloom.llm.tokenizers import PIECES, _once, load_counter, read_vocabulary


@dataclass(frozen=True)
class Container:
    """A kind of container: its name, the vocabulary file that sizes texts, and its capacity in tokens."""

    kind: str
    vocabulary_path: str
    capacity: int


@dataclass(frozen=True)
class Bm25:
    """Parameters of the ranking; a query is every term of the seed that occurs elsewhere, or its ``query_terms`` rarest if given."""

    k1: float = 1.2
    b: float = 0.75
    query_terms: int | None = None


#: Letters of scripts written without blanks: Thai, Lao, Myanmar, Khmer, Tai, kana and Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u1950-\u19df\u1a20-\u1aaf\u3005-\u3007\u3040-\u309f\u30a1-\u30fa\u30fc-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uaa60-\uaa7f\uf900-\ufaff\uff66-\uff9f\U0001b000-\U0001b16f\U00020000-\U0003ffff"
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]")
_RUNS = re.compile(f"([{_UNSPACED}]+)|[^\\W{_UNSPACED}]+")

#: Marks that are no part of a term at its ends.
_MARKS = ".,;:!?\"'()[]{}“”‘’«»…—-" + "。、．，：；！？（）［］｛｝「」『』【】〈〉《》・｡､｢｣〜～"


class Vocabulary(dict):
    """Per worker: piece -> row of a table with its term number and its tokens under each vocabulary.

    A piece with letters of a script without blanks is many terms; it has the
    number -1, and they are made anew each time, as such pieces seldom repeat.
    """

    _FULL = 1 << 19

    def __init__(self, counters: Sequence):
        super().__init__()
        self.counters = list(counters)
        self.terms: dict[str, int] = {}
        self.width = len(self.counters) + 1
        self.table = np.zeros((1 << 12, self.width), np.int64)

    def __missing__(self, piece: str) -> int:
        many = not piece.isascii() and _HAS_UNSPACED.search(piece)
        word = piece.strip().strip(_MARKS).lower()
        at = len(self)
        if at == len(self.table):
            self.table = np.concatenate((self.table, np.zeros_like(self.table)))
        self.table[at] = (-1 if many else self.terms.setdefault(word, len(self.terms)), *[c.middle(piece) for c in self.counters])
        self[piece] = at
        return at

    def trim(self) -> None:
        """Between shards: forget everything once there is too much (term numbers matter within a shard only)."""
        if max(len(self), len(self.terms)) > self._FULL:
            self.terms.clear()
            self.clear()

    def grams(self, piece: str) -> list[int]:
        """Terms of a piece with letters of a script without blanks: their pairs of neighbours, and other words whole."""
        found = []
        for run in _RUNS.finditer(piece.lower()):
            word = run.group()
            words = (word[i : i + 2] for i in range(len(word) - 1)) if run.group(1) and len(word) > 1 else (word,)
            found.extend(self.terms.setdefault(w, len(self.terms)) for w in words)
        return found

    def measure(self, text: str) -> tuple[np.ndarray, list[int]]:
        """Term numbers of a text, and its size under each vocabulary."""
        pieces = PIECES.findall(text)
        at = np.fromiter(map(self.__getitem__, pieces), np.int64, len(pieces))
        rows = self.table[at]
        sizes = rows[:, 1:].sum(axis=0).tolist()
        for k, c in enumerate(self.counters):
            sizes[k] += c.first(pieces[0]) - int(rows[0, k + 1])
        terms = rows[:, 0]
        if terms.min() < 0:
            terms = np.array(list(chain.from_iterable(self.grams(p) if t < 0 else (t,) for p, t in zip(pieces, terms.tolist()))), np.int64)
        return terms, sizes


class Index:
    """Inverted index of one shard."""

    def __init__(self, docs: list[np.ndarray], bm25: Bm25):
        n = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        owner = np.repeat(np.arange(n), lengths)
        terms = np.concatenate(docs) if n else np.zeros(0, np.int64)
        pair, times = np.unique(terms * n + owner, return_counts=True)
        term, doc = pair // max(n, 1), pair % max(n, 1)
        self.names, local = np.unique(term, return_inverse=True)
        df = np.bincount(local, minlength=len(self.names))
        idf = np.log1p((n - df + 0.5) / (df + 0.5))
        norm = bm25.k1 * (1 - bm25.b + bm25.b * lengths / max(lengths.mean(), 1.0)) if n else np.zeros(0)
        self.weight = idf[local] * times * (bm25.k1 + 1) / (times + norm[doc])
        self.doc = doc
        self.start = np.concatenate(([0], np.cumsum(df)))
        self.n = n
        # each document's terms that others hold too, rarest first
        shared = df[local] > 1
        by_doc = np.lexsort((-idf[local][shared], doc[shared]))
        self.query_terms = local[shared][by_doc]
        self.query_start = np.concatenate(([0], np.cumsum(np.bincount(doc[shared], minlength=n))))
        self.limit = bm25.query_terms
        # the lists of terms that an eighth of the documents hold are kept as whole columns: adding those is faster than counting by document
        common = np.flatnonzero(df * 8 > n)
        self.column = np.full(len(df), -1)
        self.column[common] = np.arange(len(common))
        self.columns = np.zeros((len(common), n))
        held = self.column[local] >= 0
        self.columns[self.column[local[held]], doc[held]] = self.weight[held]

    def scores(self, seed: int) -> np.ndarray:
        terms = self.query_terms[self.query_start[seed] : self.query_start[seed + 1]][: self.limit]
        columns = self.column[terms]
        found = np.zeros(self.n)
        for c in columns[columns >= 0].tolist():
            found += self.columns[c]
        terms = terms[columns < 0]
        if len(terms):
            lo, hi = self.start[terms], self.start[terms + 1]
            sizes = hi - lo
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1]) + np.repeat(lo - (ends - sizes), sizes)
            found += np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)
        return found


def _best_first(near: np.ndarray, score: np.ndarray, few: int = 64) -> Iterator[np.ndarray]:
    """``near`` by falling score, ties in order: the best few, which mostly fill a container, then the rest."""
    own = score[near]
    if len(near) > 4 * few:
        best = own >= np.partition(own, len(own) - few)[len(own) - few]
        yield near[best][np.argsort(-own[best], kind="stable")]
        near, own = near[~best], own[~best]
    yield near[np.argsort(-own, kind="stable")]


#: How a part came into its container: cut from a text above the capacity, as its seed, as a neighbour of the seed, or by its size.
PLACED = ("cut", "seed", "neighbour", "size")


def pack_shard(sizes: np.ndarray, capacity: int, index: Index | None) -> tuple[np.ndarray, ...]:
    """(document, part, first token, tokens, container) of every part of one shard's documents (see ``placed_shard``)."""
    return placed_shard(sizes, capacity, index)[:5]


def placed_shard(sizes: np.ndarray, capacity: int, index: Index | None) -> tuple[np.ndarray, ...]:
    """(document, part, first token, tokens, container, place in ``PLACED``) of every part of one shard's documents.

    A document above the capacity is cut into parts of the capacity, each in a
    container of its own, and a rest that is packed like a whole document.
    """
    n = len(sizes)
    whole = sizes // capacity
    rest = sizes - whole * capacity
    cut = np.where(sizes > capacity, whole, 0)
    item = np.where(sizes > capacity, rest, sizes)  # what is packed; 0 where nothing is left
    doc = np.repeat(np.arange(n), cut)
    part = np.concatenate([np.arange(c) for c in cut]) if cut.any() else np.zeros(0, np.int64)
    first = part * capacity
    out = [(doc, part, first, np.full(len(doc), capacity), np.arange(len(doc)), np.zeros(len(doc), np.int64))]
    container = len(doc)

    order = np.argsort(-item, kind="stable")  # ties: the order in which documents came
    order = order[item[order] > 0]
    ranked = -item[order]  # ascending, for searching
    position = np.empty(n, np.int64)
    position[order] = np.arange(len(order))
    free = item > 0
    after = list(range(len(order) + 1))  # position -> the next unused one, with path halving

    def unused(p: int) -> int:
        while after[p] != p:
            after[p] = after[after[p]]
            p = after[p]
        return p

    docs_out: list[int] = []
    containers_out: list[int] = []
    how_out: list[int] = []

    def take(d: int, how: int) -> int:
        free[d] = False
        p = int(position[d])
        after[p] = p + 1
        docs_out.append(d)
        containers_out.append(container)
        how_out.append(how)
        return int(item[d])

    seed_at = unused(0)
    while seed_at < len(order):
        seed = int(order[seed_at])
        room = capacity - take(seed, 1)
        smallest = int(item[order[-1]])
        if index is not None and room >= smallest:
            score = index.scores(seed)
            near = np.flatnonzero((score > 0) & free & (item <= room))
            for near in _best_first(near, score):
                near = near[item[near] <= room]
                while len(near):
                    d = int(near[0])
                    room -= take(d, 2)
                    near = near[1:]
                    near = near[item[near] <= room]
                if room < smallest:
                    break
        while room >= smallest:
            p = unused(int(np.searchsorted(ranked, -room)))
            if p >= len(order):
                break
            room -= take(int(order[p]), 3)
        container += 1
        seed_at = unused(seed_at)
    d = np.array(docs_out, np.int64)
    out.append((d, cut[d], cut[d] * capacity, item[d], np.array(containers_out, np.int64), np.array(how_out, np.int64)))
    return tuple(np.concatenate(column) for column in zip(*out))


def pack(docs: DataFrame, id_col: str, text_col: str, containers: Sequence[Container], shard_docs: int = 4096, bm25: Bm25 = Bm25()) -> DataFrame:
    """(pack_kind, id, part, first_token, n_tokens, shard, container, placed): where each text goes, for each kind, and how (see ``PLACED``).

    A container is told apart by (pack_kind, shard, container).  Each text is
    whole in one container unless it alone exceeds the capacity; then it is cut
    every ``capacity`` tokens.  Every row is assigned once per kind; null and
    empty texts have no tokens: they come out with ``n_tokens`` 0 and a null
    container.  Repeated rows are items of their own.

    A task packs the rows it reads in shards of up to ``shard_docs`` documents,
    so there is no shuffle, a task holds one shard at a time whatever the skew,
    and shards can be lost and made again.  Only the last container of each
    size in a shard may be far from full.
    """
    paths = sorted({c.vocabulary_path for c in containers})
    files = docs.sparkSession.sparkContext.broadcast([read_vocabulary(p) for p in paths])
    id_type = docs.schema[id_col].dataType.simpleString()
    at = [paths.index(c.vocabulary_path) for c in containers]
    names = ["pack_kind", id_col, "part", "first_token", "n_tokens", "shard", "container", "placed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _once(f"pack {paths}", lambda: Vocabulary([load_counter(p, b) for p, b in zip(paths, files.value)]))
        base = TaskContext.get().partitionId() << 32

        def emit(ids: pa.Array, texts: list[str | None], number: int) -> Iterator[pa.RecordBatch]:
            vocabulary.trim()
            terms, sizes = [], []
            for text in texts:
                if text:
                    t, s = vocabulary.measure(text)
                    terms.append(t)
                    sizes.append(s)
                else:
                    terms.append(np.zeros(0, np.int64))
                    sizes.append([0] * len(paths))
            measured = np.array(sizes, np.int64).reshape(-1, len(paths))
            index = Index(terms, bm25)
            for kind, column in zip(containers, at):
                own = measured[:, column]
                doc, part, first, n, container, how = placed_shard(own, kind.capacity, index)
                nothing = np.flatnonzero(own == 0)
                zeros = np.zeros(len(nothing), np.int64)
                place = pa.concat_arrays([pa.array(container, pa.int64()), pa.nulls(len(nothing), pa.int64())])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([kind.kind] * (len(doc) + len(nothing)), pa.string()),
                        ids.take(pa.array(np.append(doc, nothing))),
                        *[pa.array(np.append(column, zeros).astype(np.int32)) for column in (part, first, n)],
                        pa.array(np.full(len(doc) + len(nothing), base + number)),
                        place,
                        pa.array([PLACED[h] for h in how.tolist()] + [None] * len(nothing), pa.string()),
                    ],
                    names,
                )

        ids, texts, number = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, shard_docs):
                rows = batch.slice(lo, shard_docs)
                while rows.num_rows:
                    take = min(rows.num_rows, shard_docs - len(texts))
                    ids.append(rows.column(0).slice(0, take))
                    texts.extend(rows.column(1).slice(0, take).to_pylist())
                    rows = rows.slice(take)
                    if len(texts) == shard_docs:
                        yield from emit(pa.concat_arrays(ids), texts, number)
                        ids, texts, number = [], [], number + 1
        if texts:
            yield from emit(pa.concat_arrays(ids), texts, number)

    schema = f"pack_kind string, {id_col} {id_type}, part int, first_token int, n_tokens int, shard bigint, container bigint, placed string"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
