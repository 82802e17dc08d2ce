"""Trees, labels, hashes."""

from __future__ import annotations

import itertools
import os
import subprocess
import sys
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from phraseloom.functions import decode, hashing
from phraseloom.operators import annotate


def _matrix(n, edges):
    m = np.full((n, n), -np.inf, np.float32)
    for (u, v), w in edges.items():
        m[u, v] = w
    return m


def test_greedy_tree_and_cycle():
    assert decode.arborescence(_matrix(3, {(0, 1): 5, (1, 2): 4, (0, 2): 1})).tolist() == [0, 0, 1]
    assert decode.arborescence(_matrix(3, {(0, 1): 1, (2, 1): 3, (1, 2): 3, (0, 2): 0.5})).tolist() == [0, 0, 1]
    assert decode.arborescence(_matrix(1, {})).tolist() == [0]


@pytest.mark.parametrize("n", [2, 3, 4, 5])
def test_against_brute_force(n):
    rng = np.random.default_rng(n)
    for _ in range(60):
        m = rng.integers(-20, 20, (n, n)).astype(np.float32) + rng.random((n, n)).astype(np.float32) / 8
        best = -np.inf
        for heads in itertools.product(range(n), repeat=n - 1):
            par = [0, *heads]
            if any(par[v] == v for v in range(1, n)):
                continue
            v_ok = True
            for v in range(1, n):
                x, seen = v, 0
                while x and seen <= n:
                    x, seen = par[x], seen + 1
                v_ok &= x == 0
            if v_ok:
                best = max(best, sum(m[par[v], v] for v in range(1, n)))
        got = decode.arborescence(m)
        assert sum(m[got[v], v] for v in range(1, n)) == pytest.approx(best, rel=1e-5)


def test_nested_cycles_are_trees():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n = 24
        heads = decode.arborescence(rng.normal(size=(n, n)))
        for v in range(n):
            for _ in range(n):
                v = heads[v]
            assert v == 0


def _plain_tree(score):
    """Heads by the textbook recursion over dictionaries: another way to the same tree."""

    def solve(nodes, root, arcs):
        best = {v: max((w, -u, u) for (u, x), w in arcs.items() if x == v) for v in nodes if v != root}
        head = {v: b[2] for v, b in best.items()}
        for s in nodes:
            path, v = [], s
            while v != root and v not in path:
                path.append(v)
                v = head[v]
            if v != root:
                cycle = set(path[path.index(v) :])
                new = max(nodes) + 1
                inner, joined = {}, {}
                for (u, x), w in sorted(arcs.items()):
                    a, b = (new if u in cycle else u), (new if x in cycle else x)
                    value = w - best[x][0] if x in cycle else w
                    if a != b and ((a, b) not in joined or value > joined[a, b]):
                        joined[a, b], inner[a, b] = value, (u, x)
                tree = solve([n for n in nodes if n not in cycle] + [new], root, joined)
                out = {k: v for k, v in head.items() if k in cycle}
                for b, a in tree.items():
                    u, x = inner[a, b]
                    out[x] = u
                return out
        return head

    n = len(score)
    return solve(list(range(n)), 0, {(u, v): float(score[u, v]) for u in range(n) for v in range(1, n) if u != v})


@pytest.mark.parametrize("n", [6, 12, 25, 40])
def test_against_another_algorithm(n):
    rng = np.random.default_rng(n)
    for _ in range(10):
        score = rng.integers(0, 4096, (n, n)).astype(np.float32)  # exact in either precision
        head = decode.arborescence(score)
        other = _plain_tree(score)
        assert sum(score[head[v], v] for v in range(1, n)) == sum(score[other[v], v] for v in range(1, n))
        assert all(_reaches_root(head, v) for v in range(n))


def _reaches_root(head, v):
    for _ in range(len(head)):
        v = head[v]
    return v == 0


def test_argmax_and_labels(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([],), (None,)], "x array<double>")
    assert [r[0] for r in df.select(decode.argmax(F.col("x"))).collect()] == [2, 0, None]


def test_heads_of_nulls(spark):
    df = spark.createDataFrame([(None,), ([],), ([[0.0]],)], "x array<array<float>>")
    assert [r[0] for r in df.select(decode.heads_of("x")).collect()] == [None, [], [0]]


def test_siphash():
    """Python hashes bytes with the same function, and with zero keys if its seed is 0."""
    if sys.hash_info.algorithm != "siphash13" or sys.hash_info.cutoff:
        pytest.skip("this Python hashes differently")
    texts = [b"a", b"abcdefg", b"abcdefgh", b"abcdefghi", b"x" * 300, "spill the béans".encode() + b"\xff"]
    code = f"print(*[hash(t) % 2**64 for t in {texts!r}])"
    out = subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONHASHSEED": "0"}, capture_output=True, text=True, check=True).stdout
    assert hashing.siphash13(texts).tolist() == [int(x) for x in out.split()]
    assert [int(hashing.siphash13([t])[0]) for t in texts] == hashing.siphash13(texts).tolist()


def test_phrase_ids(spark):
    df = spark.createDataFrame([("spill the beans",), (None,), ("",)], "w string").select("w", hashing.phrase_id("w").alias("id"))
    rows = {r.w: r.id for r in df.collect()}
    assert rows[None] is None and all(0 <= rows[w] < 2**32 for w in ("spill the beans", ""))


def test_subword_grid():
    grid = annotate.subword_grid([[5, 6, 7], [], list(range(30))])
    assert grid.shape == (1, 4, 20) and grid[0, 0].tolist() == [1] + [0] * 19 and grid[0, 2, 0] == 3 and grid[0, 1, :4].tolist() == [5, 6, 7, 0]


def test_scorer_errors_do_not_fail_the_task(spark):
    def scorer(words):
        if "bad" in words:
            raise ValueError("no")
        n = len(words) + 1
        return {"s_arc": np.zeros((1, n, n)), "s_rel": np.zeros((1, n, n, 2)), "s_pos": np.zeros((1, n, 3))}

    df = annotate.words_of(spark.createDataFrame([(1, "Dogs bark."), (2, "bad"), (3, " "), (4, None)], "k int, sentence string")).select("k", "words")
    rows = {r.k: r for r in annotate.decode_scores(annotate.score(df, scorer, "k int"), ["dep", "root"], ["A", "B", "C"]).collect()}
    assert [t.upos for t in rows[1].tokens] == ["C", "C", "C"] and rows[2].error == "no" and rows[3].tokens == [] and rows[4].tokens == []


def _loader(log):
    """What loads a stand-in for a model: the score of an arc is the first subword of the dependent plus the place of the head."""

    class Session:
        def get_outputs(self):
            return [SimpleNamespace(name="s_arc"), SimpleNamespace(name="s_pos")]

        def get_inputs(self):
            return [SimpleNamespace(shape=["batch", "words", "subwords"])]

        def run(self, names, feeds):
            grid = feeds["subwords"]
            if (grid == 666).any():
                raise ValueError("bad subword")
            return [grid[:, :, :1] + np.arange(grid.shape[1])[None, None, :], grid[:, :, :1] * 1.0]

    def load(model_path, tokenizer_path, options):
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")
        return Session(), SimpleNamespace(encode=lambda w, add_special_tokens: SimpleNamespace(ids=[int(w)]))

    return load


def test_models_are_loaded_once_a_worker(spark, tmp_path):
    log = str(tmp_path / "loads")
    scorer = annotate.OnnxScorer("m", log, load=_loader(log))
    rows = [(i, [str(i + k) for k in range(i % 5)]) for i in range(200)] + [(999, ["666"])]
    df = spark.createDataFrame(rows, "k int, words array<string>").repartition(32)
    got = {r.k: r for r in annotate.score(df, scorer, "k int").collect()}
    loads = open(log).read().split()
    assert len(loads) == len(set(loads)) <= 8  # processes, not tasks
    assert got[999].error == "bad subword" and got[0].s_arc == [] and sum(r.error is not None for r in got.values()) == 1
    for k, words in rows[:-1]:
        if words:
            assert [r[0] for r in got[k].s_arc] == [1.0] + [float(w) for w in words] and got[k].s_arc[1][1] == float(words[0]) + 1


def test_idle_models_are_freed(tmp_path):
    models, loads = annotate._Models(), []
    get = lambda: models.get("m", lambda: loads.append(1) or "model", 0.3)
    for _ in range(4):
        assert get() == "model"
        time.sleep(0.1)
    assert len(loads) == 1 and models.loaded
    time.sleep(0.6)
    assert not models.loaded and get() == "model" and len(loads) == 2


def test_session_options():
    o = annotate.SessionOptions.from_env({"PARSER_CPU_ARENA": "0", "PARSER_IDLE_UNLOAD_SECS": "-1", "PARSER_INTRA_THREADS": "3"})
    assert (o.cpu_arena, o.idle_unload_seconds, o.intra_threads, o.mem_pattern) == (False, 300.0, 3, True)
