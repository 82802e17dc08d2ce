from __future__ import annotations

import json
import random
import string
import unicodedata

import pytest

from phraseloom.llm import formatting as M


def _canon(v, key=None):
    squeeze = lambda s: "".join(c for c in s.lower() if not c.isspace() and c not in string.punctuation and unicodedata.category(c)[0] != "P")
    if isinstance(v, str):
        return "s" + squeeze(v)
    if isinstance(v, dict):
        return "d" + repr(sorted((squeeze(k), _canon(x, k)) for k, x in v.items() if x is not None))
    if isinstance(v, list):
        members = [_canon(x) for x in v]
        return "l" + repr(sorted(members) if key in ("categories", "tags") else members)
    return repr(v if isinstance(v, bool) or v is None else float(v))


EQUAL = [
    '{"phrase": "a b", "tags": ["x", "y"], "n": 1}',
    '{"n":1,"tags":["Y","x."],"phrase":"A  B!"}',
    '{"phrase": "a\\tb\\u0021", "tags": ["y", "x"], "n": 1.0, "pos": null}',
    ' {"Phrase" : "\\"a b\\"", "tags" : ["x" , "y"] , "n" : 1 }\n',
]
OTHER = [
    '{"phrase": "a b", "tags": ["x", "y"], "n": 2}',
    '{"phrase": "a b", "tags": ["x", "y"], "n": "1"}',
    '{"phrase": "a b", "tags": ["x"], "n": 1}',
    '{"phrase": "a b", "tags": ["x", "x"], "n": 1}',
    '{"phrase": "a b", "tags": ["x", "y", null], "n": 1}',
    '{"phrase": "ab c", "tags": ["x", "y"], "n": 1}',
    '{"phrase": "a b", "tags": [["x", "y"]], "n": 1}',
    '{"phrase": "a b", "tags": {"x": "y"}, "n": 1}',
    '{"phrase": "a b", "elements": [["x"], ["y"]], "n": 1}',
    '{"phrase": "a b", "elements": [["y"], ["x"]], "n": 1}',
    '{"phrase": "a b", "elements": [["y", "x"], []], "n": 1}',
    '{"phrase": "a b", "tags": ["x", "y"], "n": -1}',
    '{"phrase": "a b", "tags": ["x", "y"], "n": true}',
    "{}",
]
BAD = [None, "", "  ", "[1]", '"x"', "{", '{"a": 1', '{"a": NaN}', "null", '{"a": 01}', '{"a": "x}']


def test_fingerprints():
    marks = M.fingerprints(EQUAL + OTHER + BAD)
    assert len(set(marks[: len(EQUAL)])) == 1 and marks[0] is not None
    assert len(set(marks[len(EQUAL) : len(EQUAL) + len(OTHER)]) | {marks[0]}) == len(OTHER) + 1
    assert marks[len(EQUAL) + len(OTHER) :] == [None] * len(BAD)
    assert M.fingerprints([]) == []
    assert M.fingerprints(OTHER + EQUAL)[-1] == marks[0]  # whatever else is in the batch


def test_random_records_agree_with_canonical_strings():
    rng = random.Random(1)

    def value(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.5:
            return rng.choice(["a", "A.", "b c", "bC", "", "é", "É", 1, 2, 1.5, None, True])
        if kind < 0.75:
            return [value(depth - 1) for _ in range(rng.randint(0, 3))]
        return {rng.choice(["tags", "k", "K", "l"]): value(depth - 1) for _ in range(rng.randint(0, 3))}

    texts = [json.dumps({rng.choice(["tags", "categories", "x", "y"]): value(2) for _ in range(2)}, ensure_ascii=rng.random() < 0.5) for _ in range(1500)]
    marks = M.fingerprints(texts)
    by_canon: dict = {}
    for t, m in zip(texts, marks):
        if len({k.lower() for k in json.loads(t)}) == len(json.loads(t)):
            by_canon.setdefault(_canon(json.loads(t)), set()).add(m)
    assert all(len(s) == 1 for s in by_canon.values())
    assert len({next(iter(s)) for s in by_canon.values()}) == len(by_canon)
    for a, b in rng.sample(list(zip(texts, texts[1:])), 300):
        assert M.same_value(json.loads(a), json.loads(b), ("categories", "tags")) == (_canon(json.loads(a)) == _canon(json.loads(b)))


def test_two_pointers():
    assert M.same_text("A b-c", " a.B\tC ") and not M.same_text("ab", "abc") and M.same_text("", " .") and not M.same_text("a", "")


def test_copies(spark):
    long = json.dumps({"phrase": "word " * 20000})
    texts = [*OTHER, EQUAL[0], *BAD, EQUAL[1], EQUAL[2], EQUAL[0], long, long.replace("word", "WORD,"), EQUAL[3]]
    rows = [(100 + i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "line_no bigint, raw_text string, _mark string")
    groups: dict = {}
    for i, t, _ in rows:
        v = M.parse_object(t)
        if v is not None:
            groups.setdefault(_canon({k.lower(): x for k, x in v.items()}), []).append(i)
    expected = {(g[0], i) for g in groups.values() if len(g) > 1 for i in g}
    assert {(r.first_id, r.id) for r in M.copies(df, "line_no", "raw_text").collect()} == expected and len(expected) == 7
    assert M.copies(df.where("false"), "line_no", "raw_text").count() == 0


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    """With all fingerprints equal the comparison alone must keep the groups apart."""
    import phraseloom.llm.formatting as module

    df = spark.createDataFrame([(i, t) for i, t in enumerate([OTHER[0], EQUAL[0], OTHER[0], EQUAL[1], EQUAL[2], OTHER[2]])], "i bigint, t string")
    monkeypatch.setattr(module, "fingerprint_rows", lambda rows, a, b, u: rows.selectExpr(f"{a} as _id", f"{b} as _text", "cast('x' as binary) as _mark"))
    got = {(r.first_id, r.id) for r in module.copies(df, "i", "t").collect()}
    assert got == {(0, 0), (0, 2), (1, 1), (1, 3), (1, 4), (5, 5)}


def test_deep_nesting(spark):
    """How deep a record is nested is no bound, neither for fingerprints nor for comparison."""
    deep = lambda n, x="[": '{"a": ' + x * n + "]" * n + "}"
    texts = [deep(800), deep(800, "[ "), deep(801), deep(60_000), deep(60_000, " ["), deep(60_000)[:-2]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i bigint, t string")
    assert {(r.first_id, r.id) for r in M.copies(df, "i", "t").collect()} == {(0, 0), (0, 1), (3, 3), (3, 4)}


def test_parsing_with_an_own_stack():
    good = ['{"a": [1, {"b": null}, [], {}], "c": "x\\"y"}', "[]", " 1.5 ", '"s"', '{"a": {"a": [[2]]}}']
    bad = ["", "{", "[1,]", '{"a":}', '{"a" 1}', "[1 2]", "}", "[}", '{"a":1,}', "[NaN]", "1 2", "{1: 2}", '["a" : 1]', "[01]", "\u00a0[]"]
    assert [M._parse_deep(t) for t in good] == [json.loads(t) for t in good]
    for t in bad:
        with pytest.raises(ValueError):
            M._parse_deep(t)


def test_repeated_keys_escapes_and_lone_surrogates():
    same = lambda a, b: M.fingerprints([a])[0] == M.fingerprints([b])[0] is not None
    assert same('{"a": [1, 2], "a": "x"}', '{"a": "X"}') and not same('{"a": 1, "A": 2}', '{"a": 2}')
    assert same('{"a": 1, "a": null}', "{}") and same('{"o": {"b": 1, "b": {"c": 2}}}', '{"o": {"b": {"c": 2}}}')
    assert same('{"a": "q\\\\ \\" \\n [1, {"}', '{"a": "q1"}') and same('{"a": "\\u00c9"}', '{"a": "é"}')
    assert M.fingerprints(['{"a": "\\ud83d"}'])[0] is not None
    assert same('{"a": -1.50, "b": 1e3}', '{"b": 1000, "a": -1.5}') and not same('{"a": -1}', '{"a": 1}')


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(M, "BATCH_CHARS", 10)
    assert list(M._slices(["x" * 6, "x" * 4, "x" * 1, "x" * 30, "x"])) == [(0, 2), (2, 3), (3, 4), (4, 5)] and list(M._slices([])) == []
