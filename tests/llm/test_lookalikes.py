from __future__ import annotations

import random
import unicodedata
from collections import defaultdict

from phraseloom.llm import lookalikes as L

SAME = ["señor go", "señor go", "ѕеñor gо", "ｓｅｎ̃or go", "señor go", "se​ñor　go", "﻿señor go­"]
DIFFERENT = ["senor go", "Señor go", "señor go²", "señor go2", "señor, go", "señor’s go", "señor's go", "señor  go", "señor–go", "señor-go"]


def test_canonical():
    assert {L.canonical(s) for s in SAME} == {"señor go"}
    assert len({L.canonical(s) for s in DIFFERENT}) == len(DIFFERENT) and L.canonical("") == ""
    assert L.canonical("ａ‐ｂ ＇ｃ！ x‑y") == "a-b 'c! x-y" and L.canonical("x² … Dr.") == "x² … Dr."
    assert L.canonical("́a") == "́a" and L.canonical("각") == "각"


def test_splicing_equals_the_whole(spark):
    rng = random.Random(5)
    pool = [*"abe ,.é²…", "ñ", "̃", "́", "̧", "ｅ", "‍", " ", "е", "ο", "ё", "и", "̆", "ガ", "ｶ", "ﾞ", "가", "ᆨ", "ᅡ", "ᄀ", "Å", "ǆ", "ﬁ", "🙂", "️", "丽"]
    for _ in range(4000):
        s = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        assert L.canonical(s) == L.whole_form(s), ascii(s)
        assert L.canonical(L.canonical(s)) == L.whole_form(L.canonical(s))


def test_stable_characters_are_stable():
    """Every character outside the class keeps its form, alone and next to others."""
    ranges = L.unstable_ranges()
    inside = lambda cp: any(a <= cp <= b for a, b in ranges)
    for cp in range(0x20, 0x3000):
        if not inside(cp):
            assert L.whole_form("a" + chr(cp) + "b") == "a" + chr(cp) + "b" and unicodedata.combining(chr(cp)) == 0


def test_pairs(spark):
    texts = [*SAME, *DIFFERENT, *DIFFERENT[:3], SAME[0], SAME[2], None, "", " ", "​", " ", "word " * 5000, "wоrd " + "word " * 4999]
    rows = [(10 + i, t, "f") for i, t in enumerate(texts)]
    groups = defaultdict(list)
    for k, t, _ in rows:
        if t is not None and L.whole_form(t).strip():
            groups[L.whole_form(t)].append((k, t))
    expected = {(a[0], b[0]) for g in groups.values() for a in g for b in g if a[0] < b[0] and a[1] != b[1]}
    df = spark.createDataFrame(rows, "id bigint, text string, form string")
    got = L.look_alike_pairs(df, "id", "text").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected) > 20
    forms = {r.id: r.form for r in L.with_form(df, "text").collect()}
    assert forms == {k: t if t is None else L.whole_form(t) for k, t, _ in rows}
    assert L.look_alike_pairs(df.where("false"), "id", "text").count() == 0


def test_scripts():
    """Texts in one script stay; a letter of another script takes that of its word, or of the text."""
    for text in ("стол и окно", "Ёжик, а не я", "νόμος και τάξη", "оса", "Երեւան", "На Windows и со мной", "Привет, world"):
        assert L.canonical(text) == text or text == "оса"
    assert L.canonical("cтoл") == "стол" and L.canonical("hоuѕe") == "house" and L.canonical("а house") == "a house"
    assert L.canonical("стол c окнoм") == "стол с окном" and L.canonical("оса") == "oca" and L.canonical("ﬁne 𝐛𝑜x") == "fine box"
    assert L.canonical("νόμoς") == "νόμος" and L.canonical("Ёlan") == "Ëlan"


def test_equal_skeletons_have_equal_forms():
    """Exactly the texts that differ by shapes that scripts share have one form."""
    rng = random.Random(3)
    twins = [p.split(":") for p in L.LOOK_ALIKES.split()]
    skeleton = lambda s: unicodedata.normalize("NFC", unicodedata.normalize("NFD", s).translate(L.to_script()["latin"]))
    pool = [*"aeopcyx rtb", *"тлибж", *"λθσ", *"ё й"]
    by_skeleton = defaultdict(set)
    for _ in range(3000):
        base = "".join(rng.choice(pool) for _ in range(rng.randint(1, 9)))
        for _ in range(3):
            other = "".join(rng.choice([c, *(a for a, b in twins if b == skeleton(c))]) for c in base)
            by_skeleton[skeleton(other)].add(L.canonical(other))
            assert L.canonical(L.canonical(other)) == L.canonical(other)
    assert all(len(forms) == 1 for forms in by_skeleton.values())
    assert len({next(iter(f)) for f in by_skeleton.values()}) == len(by_skeleton)


def test_classes(spark):
    texts = [*SAME, *SAME[:2], *DIFFERENT, None, "", "стол", "cтол", "стол"]
    df = spark.createDataFrame([(i, t, i % 2, "x") for i, t in enumerate(texts)], "id bigint, text string, side int, class_id string")
    pairs = L.look_alike_pairs(df, "id", "text", by=["side"]).collect()
    links = defaultdict(int)
    for p in pairs:
        links[p.key_a] += 1
        links[p.key_b] += 1
    got = {r.key: r for r in L.look_alike_classes(df, "id", "text", by=["side"]).collect()}
    assert {k: r.links for k, r in got.items()} == dict(links) and links
    assert all(got[p.key_a].class_id == got[p.key_b].class_id <= p.key_a and (p.key_a - p.key_b) % 2 == 0 for p in pairs)
