"""Golden cases of tokens, lemmas, patterns and matching."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from phraseloom import constants as C
from phraseloom.functions import pattern, text

TOKENS = [
    ("He didn't like life?", "He|did|n't|like|life|?"),
    ("twenty-one cats.", "twenty|-|one|cats|."),
    ("co-workers e-mail.", "co-workers|e-mail|."),
    ("at 10 p.m. local", "at|10|p.m.|local"),
    ("U.S. policy", "U.S.|policy"),
    ("I cannot won't can't", "I|can|not|wo|n't|ca|n't"),
    ("Bush's I'm they're we've you'll I'd", "Bush|'s|I|'m|they|'re|we|'ve|you|'ll|I|'d"),
    ("its dont", "its|dont"),
    ("end -- mid ... ***", "end|--|mid|...|***"),
    ("256,000 and 14:57 and 303-832-8160", "256,000|and|14:57|and|303-832-8160"),
    ("cannot've he'd've", "can|not|'ve|he|'d|'ve"),
    ("y’all’ll", "y’all|’ll"),
    ("see https://a.example/it's", "see|https://a.example/it|'s"),
    ("naïve", "na|ï|ve"),
    ("a b　c", "a|b|c"),
    ("", ""),
    ("  ", ""),
]


def test_tokenize(spark):
    rows = spark.createDataFrame(TOKENS, "t string, e string").select("t", "e", F.array_join(text.tokenize(F.col("t")), "|").alias("g")).collect()
    assert [(r.t, r.g) for r in rows] == [(r.t, r.e) for r in rows]
    assert spark.sql("select cast(null as string) t").select(text.tokenize(F.col("t")).alias("g")).first().g is None


LEMMAS = (
    "spilled:spill beans:bean brought:bring knees:knee beaten:beaten boy's:boy studies:study the:the ?: is:be was:be were:be been:be being:be told:tell "
    "became:become woke:wake saw:saw lay:lay shot:shot abode:abode houses:hous making:mak running:runn n't:n't 's:s 'll:ll --:-- classes:class boss:boss bus:bus tied:tied"
)
VERB_LEMMAS = "saw:see Saw:see shot:shoot smelt:smell spelt:spell spat:spit abode:abide lay:lay born:born walked:walk brought:bring"


def test_lemma(spark):
    cases = [(*p.rsplit(":", 1), False) for p in LEMMAS.split()] + [(*p.split(":"), True) for p in VERB_LEMMAS.split()]
    rows = spark.createDataFrame(cases, "w string, e string, v boolean").select("w", "v", "e", text.lemma(F.col("w"), F.col("v")).alias("g")).collect()
    assert [(r.w, r.v, r.g) for r in rows] == [(r.w, r.v, r.e) for r in rows]


def test_constants():
    assert (len(C.ABBREVIATIONS), len(C.PREFIXES), len(C.SLOT_WORDS), len(C.IRREGULAR), len(C.CLOSED_CLASS)) == (154, 29, 22, 199, 38)


@pytest.mark.parametrize(
    "a,b,equal",
    [("moon", "moons", True), ("alway", "always", True), ("go", "gone", False), ("the", "then", False), ("but", "butter", False), ("thin", "thing", False), ("wall", "wallaby", False), ("", "", True), ("", "a", False)],
)
def test_lemma_eq(spark, a, b, equal):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(pattern.lemma_eq(F.col("a"), F.col("b")).alias("x"), pattern.lemma_eq(F.col("b"), F.col("a")).alias("y")).first() == (equal, equal)


ELEMENTS = [
    ("spill the beans", "w:spill w:the w:bean"),
    ("lose one's mind", "w:lose slot:pron w:mind"),
    ("give someone or something away", "w:give slot w:away"),
    ("someone someone goes", "slot w:goe"),
    ("take x and go", "w:take slot w:and w:go"),
    ("", ""),
]


def test_phrase_elements(spark):
    flat = F.array_join(F.transform(pattern.phrase_elements(F.col("p")), lambda e: F.array_join(e, ":")), " ")
    rows = spark.createDataFrame(ELEMENTS, "p string, e string").select("p", "e", flat.alias("g")).collect()
    assert [(r.p, r.g) for r in rows] == [(r.p, r.e) for r in rows]


def _elements(s: str) -> list[list[str]]:
    kinds = {"_": ["slot"], "_p": ["slot:pron"], "_n": ["slot:noun"]}
    return [kinds.get(x, ["w", x]) for x in s.split()]


MATCHES = [
    ("spill the bean", "he spill the bean today", "X X X X X", [1, 2, 3]),
    ("make _ up mind", "they make her up mind now", "X VERB PRON X NOUN X", [1, 3, 4]),
    ("kick bucket", "kick a big old bucket", "X X X X X", None),
    ("kick _ bucket", "kick a big old bucket", "VERB DET ADJ ADJ NOUN", [0, 4]),
    ("over moon", "over moons", "X X", [0, 1]),
    ("fair play", "fair . play", "ADJ PUNCT VERB", None),
    ("so far so good", "so far , so good", "ADV ADV PUNCT ADV ADJ", [0, 1, 3, 4]),
    ("fair play", "fair , play", "ADJ PUNCT VERB", None),
    ("over board", "over - board", "ADP PUNCT NOUN", [0, 2]),
    ("_ far _ good", "so far , so good", "ADV ADV PUNCT ADV ADJ", [1, 4]),
    ("_ far _ good", "so far . so good", "ADV ADV PUNCT ADV ADJ", None),
    ("about time", "about four time", "ADP NUM NOUN", None),
    ("wake up", "wake you up", "VERB PRON ADP", [0, 2]),
    ("look around", "look quickly around", "VERB ADV ADV", [0, 2]),
    ("pull _p together", "pull herself together", "VERB PRON ADV", [0, 2]),
    ("pull _p together", "pull a team together", "VERB DET NOUN ADV", None),
    ("pull _p together", "pull young volunteer together", "VERB ADJ NOUN ADV", None),
    ("pull _p together", "pull together", "VERB ADV", None),
    ("pull _n together", "pull a team together", "VERB DET NOUN ADV", [0, 3]),
    ("pull _n together", "pull quickly together", "VERB ADV ADV", None),
    ("up up", "up up up", "X X X", [0, 1]),
    ("kick it", "", "", None),
]


def _match(spark, cases):
    rows = [(i, _elements(e), s.split(), u.split()) for i, (e, s, u) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, e array<array<string>>, w array<string>, u array<string>")
    path = pattern.match(pattern.tokens(F.col("w"), F.col("u"), F.col("w")), pattern.plan(F.col("e")))
    return [r.path for r in df.select("i", path.alias("path")).orderBy("i").collect()]


def test_match_cases(spark):
    assert _match(spark, [m[:3] for m in MATCHES]) == [m[3] for m in MATCHES]


def _brute(elements, words, upos):
    """Least (span, start, reversed path) over all paths of positions."""
    eq = lambda a, b: a == b or any(len(x) >= 4 and y.startswith(x) and y[len(x) :] in C.INFLECTIONS for x, y in ((a, b), (b, a)))
    steps, pending = [], None
    for e in elements:
        if e[0] != "w":
            pending = e[0]
        else:
            steps.append((e[1], 4 if pending and steps else 1, pending if steps and pending else "slot"))
            pending = None
    best = None
    for path in itertools.combinations(range(len(words)), len(steps)):
        if not all(eq(words[p], s[0]) for p, s in zip(path, steps)):
            continue
        ok = True
        for (p, q), (_, gap, slot) in zip(zip(path, path[1:]), steps[1:]):
            mid = range(p + 1, q)
            punct = [t for t in mid if upos[t] == "PUNCT"]
            ok &= q <= p + 1 + gap and not any(words[t] in C.HARD_BOUNDARIES for t in punct)
            if gap == 1:
                ok &= not any(upos[t] in C.CONTENT_UPOS for t in mid) and not (len(steps) < 3 and any(words[t] == "," for t in punct))
            elif slot == "slot:pron":
                ok &= q > p + 1 and upos[p + 1] == "PRON"
            elif slot == "slot:noun":
                ok &= q > p + 1 and upos[p + 1] in C.NOMINAL_UPOS
        rank = (path[-1] - path[0], path[0], path[::-1])
        if ok and (best is None or rank < best):
            best = rank
    return list(best[2][::-1]) if best else None


def test_match_random(spark):
    rng = random.Random(7)
    words, tags = ["kick", "kicks", "up", "the", "bucket", "buckets", ",", ".", "it"], ["NOUN", "VERB", "PRON", "DET", "ADP", "PUNCT", "X"]
    cases = []
    for _ in range(400):
        n = rng.randint(1, 9)
        shape = [rng.choice(["kick", "up", "the", "bucket", "_", "_p", "_n"]) for _ in range(rng.randint(1, 4))]
        if not any(not s.startswith("_") for s in shape):
            shape.append("up")
        cases.append((" ".join(shape), " ".join(rng.choice(words) for _ in range(n)), " ".join(rng.choice(tags) for _ in range(n))))
    expected = [_brute(_elements(e), s.split(), u.split()) for e, s, u in cases]
    assert sum(x is not None for x in expected) > 40
    assert _match(spark, cases) == expected
