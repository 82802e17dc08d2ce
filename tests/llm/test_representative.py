from __future__ import annotations

import datetime as dt
import random

from phraseloom.llm import representative as R

FIELDS = {"definition": "string", "tags": "array<string>"}
SCHEMA = "id bigint, g string, definition string, tags array<string>, trust int, at timestamp, size int, norm string"


def _day(n):
    return None if n is None else dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(days=n)


def _run(spark, rows, **kw):
    df = spark.createDataFrame([(*r[:5], _day(r[5]), 1, "x") for r in rows], SCHEMA)
    found = R.winners(df, ["g"], "id", FIELDS, "trust", "at", **kw)
    return df, found, {(r.g, r.in_field): r.best_id for r in found.collect()}


def test_recent_value_wins_and_fillers_do_not_vote(spark):
    rows = [
        (1, "a", "old but trusted", ["x"], 5, 1), (2, "a", "new", None, 1, 30), (3, "a", " TBD ", [""], 5, 60), (4, "a", None, [], None, None), (5, "a", "", ["-"], 2, 70),
        (6, "b", None, None, 1, 1), (7, "b", "?", [None], 1, 2),
        (8, "c", "only", ["t"], None, None),
    ]
    df, found, best = _run(spark, rows)
    assert best == {("a", "definition"): 2, ("a", "tags"): 1, ("c", "definition"): 8, ("c", "tags"): 8}
    merged = {r.g: (r.definition, r.tags, r.definition_from) for r in R.survivors(df, found, ["g"], "id", FIELDS).collect()}
    assert merged == {"a": ("new", ["x"], 2), "c": ("only", ["t"], 8)}


def test_ties(spark):
    """Same time: trust, then the longer text, then the smaller id."""
    rows = [(1, "a", "one", ["x"], 2, 5), (2, "a", "two", ["y"], 3, 5), (3, "b", "same value", ["x"], 2, 5), (4, "b", "Same  value.", ["X"], 2, 5), (6, "c", "v", ["q"], 1, None), (5, "c", "v", ["q"], 1, None)]
    assert _run(spark, rows)[2] == {("a", "definition"): 2, ("a", "tags"): 2, ("b", "definition"): 4, ("b", "tags"): 3, ("c", "definition"): 5, ("c", "tags"): 5}


def test_votes_add_up_over_bands(spark):
    """With a long half-life three agreeing rows outvote a newer one; far older rows still count without underflow."""
    rows = [(1, "a", "common", None, 3, 10), (2, "a", "COMMON", None, 3, 11), (3, "a", "common.", None, 3, 12), (4, "a", "rare", None, 3, 13)]
    assert _run(spark, rows, half_life_hours=24 * 365.0)[2] == {("a", "definition"): 3}
    assert _run(spark, rows, half_life_hours=1.0)[2] == {("a", "definition"): 4}
    old = [(1, "a", "x", None, 1, -100000), (2, "a", "y", None, 5, -100001), (3, "a", "z", None, 5, None)]
    assert _run(spark, old)[2] == {("a", "definition"): 1}


def test_newest_value_wins_in_dense_groups(spark):
    """However close and many older rows are, the most recent usable row's value survives; votes decide at its very time."""
    half_hour = 1 / 48
    rows = [(1, "a", "new", ["n"], 5, 10), (2, "a", "old", ["o"], 5, 10 - half_hour), (3, "a", "old", ["o"], 5, 10 - half_hour), (4, "a", "tbd", [], 5, 11)]
    rows += [(10 + i, "b", f"v{i % 3}", [f"t{i % 2}"], 5, i / 1440) for i in range(300)] + [(400, "b", "last", ["l"], 1, 300 / 1440)]
    rows += [(501, "c", "one", None, 2, 5), (502, "c", "two", None, 2, 5), (503, "c", "one", None, 2, 4.99)]
    expected = {("a", "definition"): 1, ("a", "tags"): 1, ("b", "definition"): 400, ("b", "tags"): 400, ("c", "definition"): 501}
    assert _run(spark, rows)[2] == expected


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice("pqrs"), rng.choice(["aa", "Bb.", "bb", "n/a", None, "cc"]), rng.choice([None, [], ["t"], ["u", "t"]]), rng.choice([None, 1, 5]), rng.choice([None, *range(9)])) for i in range(300)]
    half = 36.0
    expected = {}
    for g in "pqrs":
        for f, (col, norm) in {"definition": (2, lambda v: None if v is None or v == "n/a" else v.lower().rstrip(".")), "tags": (3, lambda v: "|".join(sorted(v)) if v else None)}.items():
            votes, rows_of = {}, {}
            for r in rows:
                v = norm(r[col])
                if r[1] == g and v is not None:
                    age = (r[5] if r[5] is not None else -10_000_000) * 24 / half
                    votes[v] = votes.get(v, 0) + (1 + (r[4] or 0)) * 2.0 ** max(age, -1000)
                    size = len(" ".join(r[col]) if f == "tags" else r[col])
                    rows_of.setdefault(v, []).append((r[5] if r[5] is not None else -1, r[4] or 0, size, -r[0]))
            w = max(votes, key=lambda v: (votes[v], max(rows_of[v])))
            expected[g, f] = -max(rows_of[w])[3]
    assert _run(spark, rows, half_life_hours=half)[2] == expected


def test_empty(spark):
    assert _run(spark, [])[2] == {}


def test_headword_key(spark):
    df = spark.createDataFrame([(" Pay\tsomeone’S  way ",), ("pay someone's way",), (None,), ("",)], "w string")
    assert [r[0] for r in df.select(R.headword_key(df.w)).collect()] == ["pay someone's way", "pay someone's way", None, ""]
