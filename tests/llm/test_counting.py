from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from phraseloom.llm.heavy_hitters import SketchShape, _add, descend, frequent
from phraseloom.llm.term_counts import LastSeen, marked, term_counts


def test_frequent_values(spark):
    rng = random.Random(2)
    values = ["the"] * 3000 + ["edge"] * 100 + ["below"] * 99 + [""] * 500 + [f"w{rng.randint(0, 4000)}" for _ in range(10000 - 3699)] + [None] * 700
    rng.shuffle(values)
    df = spark.createDataFrame([(v, 1, 2) for v in values], "word string, h int, cell int").repartition(5)
    exact = Counter(v for v in values if v is not None)
    expected = {v: n for v, n in exact.items() if n * 100 >= sum(exact.values())}
    assert expected["edge"] == 100 and "below" not in expected
    got = frequent(df, "word", 100).collect()
    assert {r.item: r.n for r in got} == expected
    assert all(abs(r.estimate - r.n) <= 60 for r in got)
    narrow = frequent(df, "word", 100, shape=SketchShape(width=256))  # a poor sketch costs candidates, not results
    assert {r.item: r.n for r in narrow.collect()} == expected
    assert {r.item for r in frequent(df, "word", 100, least_rows=101).collect()} == set(expected) - {"edge"}


def test_frequent_edges(spark):
    schema = "word string"
    assert frequent(spark.createDataFrame([], schema), "word", 200).collect() == []
    assert frequent(spark.createDataFrame([(None,)], schema), "word", 200).collect() == []
    few = spark.createDataFrame([("a",), ("b",), ("x" * 100000,)], schema)
    assert {r.item[:1] for r in frequent(few, "word", 200).collect()} == {"a", "b", "x"}
    assert frequent(few, "word", 200, least_rows=10).collect() == []


def _expected(rows):
    n, recs = Counter(), defaultdict(set)
    for t, r in rows:
        if t:
            n[t] += 1
            recs[t] |= {r} - {None}
    return {t: (n[t], len(recs[t])) for t in n}


def test_term_counts(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["the"] * 6 + ["a", "b", "c", None, "", "A"]), rng.choice([None, *range(60)])) for _ in range(5000)]
    rows += [(f"t{i}", i) for i in range(3000)] + [("z" * 50000, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(t, r, "x") for t, r in rows], "lemma string, sent_id bigint, term string").repartition(6)
    got = {r.term: (r.occurrences, r.records) for r in term_counts(df, "lemma", "sent_id").collect()}
    assert got == _expected(rows)
    assert term_counts(df.where("false"), "lemma", "sent_id").count() == 0


def test_marks(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 5), ("e", 6)], "term string, records bigint")
    assert {r.term: r.mark for r in marked(df, 100).collect()} == {"a": "rare", "b": "rare", "c": None, "d": None, "e": "common"}
    assert {r.term: r.mark for r in marked(df, 20).collect()} == {"a": "rare", "b": "rare", "c": "common", "d": "common", "e": "common"}


def test_many_heavy_values_survive_the_descent():
    """150 values of 1 in 180 rows each; with five rows of counters these seeds lost one."""
    shape = SketchShape()
    for seed in (22, 64, 78, 79):
        values = np.random.default_rng(seed).integers(0, 2**64, 150, dtype=np.uint64)
        counts = np.zeros((len(shape.bits), shape.depth, shape.width), np.int64)
        _add(counts, np.repeat(values, 100), shape)
        assert set((values >> np.uint64(64 - shape.bits[-1])).tolist()) <= set(descend(counts, 90.0, shape))


def test_many_heavy_values(spark, monkeypatch):
    """Shapes widen with the number of values that can be heavy; many prefixes are joined, with the same result."""
    import phraseloom.llm.heavy_hitters as module

    assert SketchShape.fit(200).width == 4096 and SketchShape.fit(5000).width == 65536
    with pytest.raises(ValueError, match="counters"):
        SketchShape.fit(10**6)
    df = spark.range(6000).selectExpr("concat('w', id % 1500) as word", "'x' as item")
    plain = {tuple(r) for r in frequent(df, "word", 2000).collect()}
    assert len(plain) == 1500 and {r[2] for r in plain} == {4}
    monkeypatch.setattr(module, "MOST_LITERALS", 10**6)
    assert {(i, n) for i, _, n in (tuple(r) for r in frequent(df, "word", 2000).collect())} == {(i, n) for i, _, n in plain}


def test_counters_come_in_slices():
    counters = LastSeen()
    counters.add(pa.array([f"t{i}" for i in range(2500)]), np.zeros(2500, np.int64))
    parts = list(counters.batches(1000))
    assert [p.num_rows for p in parts] == [1000, 1000, 500] and parts[2].column(0)[499].as_py() == "t2499" and not list(LastSeen().batches())
