"""Model scores to labels and trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def argmax(scores: Column) -> Column:
    """Place of the largest score, the last one on ties; 0 for an empty array, null for null."""
    best = F.array_max(F.transform(scores, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    return F.when(scores.isNotNull(), F.coalesce(best["i"], F.lit(0)))


def label(labels: Column, place: Column, fallback: str) -> Column:
    """Label at a place, or the fallback outside the list."""
    return F.coalesce(F.get(labels, place), F.lit(fallback))


def invert_vocab(vocab: Column) -> Column:
    """map<label, place> -> labels by place; places without a label hold the empty string."""
    by_place = F.map_from_entries(F.transform(F.map_entries(vocab), lambda e: F.struct(e["value"], e["key"])))
    last = F.array_max(F.map_values(vocab))
    return F.when(F.size(vocab) == 0, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.coalesce(last, F.lit(0))), lambda i: F.coalesce(F.try_element_at(by_place, i), F.lit("")))
    )


def invert_feats(vocab: Column) -> Column:
    """map<category, map<value, place>> -> array of (category, values by place), categories in byte order."""
    return F.array_sort(F.transform(F.map_entries(vocab), lambda e: F.struct(e["key"].alias("category"), invert_vocab(e["value"]).alias("values"))))


def feats_string(feats: Column, scores: Column) -> Column:
    """``Cat=Val|...`` of each category's best value; place 0 means absent; ``_`` if none is present."""
    one = best_feat
    present = F.filter(F.zip_with(feats, scores, one), lambda p: p.isNotNull())
    return F.when(F.size(present) == 0, "_").otherwise(F.array_join(present, "|"))


def best_feat(feat: Column, scores: Column) -> Column:
    """``Cat=Val`` for one category, null if its best value is absent or unknown."""
    best = argmax(F.slice(scores, 1, F.greatest(F.size(feat["values"]), F.lit(0))))
    value = F.get(feat["values"], best)
    return F.when((best != 0) & value.isNotNull(), F.concat(feat["category"], F.lit("="), value))


def arborescence(score: np.ndarray, root: int = 0) -> np.ndarray:
    """Parents of the maximum spanning arborescence; ``score[u, v]`` is the weight of u being v's head.

    Works on one matrix in place of a recursion: while the greedy choice of
    heads has cycles, each cycle becomes one node whose incoming weights are
    lowered by what leaving the cycle's own arc costs; then the choices are
    undone level by level.  All sums are in float32; the lowest head wins ties.
    Raises ValueError if a node cannot be reached at all.
    """
    levels = []
    weight = np.array(score, np.float32)
    np.fill_diagonal(weight, -np.inf)
    while True:
        n = len(weight)
        weight[:, root] = -np.inf
        head = weight.argmax(axis=0)
        best = weight[head, np.arange(n)]
        head[~np.isfinite(best)] = root
        head[root] = root
        cycle = _cycles(head, root)
        count = cycle.max() + 1
        if count == 0:
            break
        free = np.flatnonzero(cycle < 0)
        group = cycle.copy()
        group[free] = count + np.arange(len(free))
        m = count + len(free)
        gain = weight - np.where(cycle >= 0, best, np.float32(0))[None, :]
        joined, arcs = _best_between(gain, group, m, root)
        levels.append((head, arcs, group[root]))
        weight, root = joined, group[root]
    for inner, arcs, top in reversed(levels):
        outer = inner.copy()
        for b, a in enumerate(head):
            if b != top:
                u, v = arcs[a, b]
                if u < 0:
                    raise ValueError("a node has no incoming arc")
                outer[v] = u
        head = outer
    return head


def arborescences(scores: np.ndarray, root: int = 0) -> np.ndarray:
    """``arborescence`` of each of many matrices of one size; only those whose greedy heads have cycles are taken one by one."""
    weight = np.array(scores, np.float32)
    n = weight.shape[1]
    weight[:, np.arange(n), np.arange(n)] = -np.inf
    weight[:, :, root] = -np.inf
    heads = weight.argmax(axis=1)
    heads[~np.isfinite(np.take_along_axis(weight, heads[:, None, :], 1)[:, 0])] = root
    heads[:, root] = root
    above = heads
    for _ in range(n.bit_length()):
        above = np.take_along_axis(above, above, 1)
    for i in np.flatnonzero((above != root).any(axis=1)):
        heads[i] = arborescence(scores[i], root)
    return heads


def _best_between(gain: np.ndarray, group: np.ndarray, m: int, root: int) -> tuple[np.ndarray, np.ndarray]:
    """The best arc between any two of ``m`` groups of nodes, and its ends; the lowest head, then dependent, wins ties."""
    usable = (group[:, None] != group[None, :]) & np.isfinite(gain)
    usable[:, root] = False
    u, v = np.nonzero(usable)
    pair, value = group[u] * m + group[v], gain[u, v]
    order = np.lexsort((v, u, -value, pair))
    first = order[np.flatnonzero(np.append(True, np.diff(pair[order]) > 0))] if len(order) else order
    joined, arcs = np.full((m, m), -np.inf, np.float32), np.full((m, m, 2), -1)
    a, b = np.divmod(pair[first], m)
    joined[a, b] = value[first]
    arcs[a, b, 0], arcs[a, b, 1] = u[first], v[first]
    return joined, arcs


def _cycles(head: np.ndarray, root: int) -> np.ndarray:
    """Number of the cycle each node is on, in the order they are met; -1 for none."""
    n = len(head)
    number = np.full(n, -1)
    met = np.full(n, -1)  # the walk that first met a node
    found = 0
    for s in range(n):
        v = s
        while v != root and met[v] < 0:
            met[v] = s
            v = head[v]
        if v != root and met[v] == s and number[v] < 0:
            while number[v] < 0:
                number[v] = found
                v = head[v]
            found += 1
    return number


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def heads_of(arc_scores: pd.Series) -> pd.Series:
    """Heads by place from ``arc[dependent][head]`` (place 0 is the root, its head 0); null for null."""

    def one(rows):
        if rows is None:
            return None
        matrix = np.array([np.asarray(r, np.float32) for r in rows], np.float32).T
        return arborescence(matrix).tolist() if len(matrix) else []

    return arc_scores.map(one)
