"""Slot and gap patterns: deriving, planning and matching them over arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from phraseloom import constants as C
from phraseloom.functions import text as X


def phrase_elements(phrase: Column) -> Column:
    """Pattern of a headword: array of ["w", lemma], ["slot"], ["slot:pron"] or ["slot:noun"].

    Clitics are dropped, a connector between two slots is dropped, and adjacent
    slots become one unconstrained slot.
    """
    words = F.filter(X.tokenize(phrase), lambda t: ~t.isin(*C.CLITICS))
    raw = F.transform(words, lambda t: F.when(X.is_slot_token(t), F.array(X.slot_type(t))).otherwise(F.array(F.lit("w"), X.lemma(t))))

    def linked(raw: Column) -> Column:
        slot_at = lambda i: F.coalesce(F.get(F.get(raw, i), 0) != "w", F.lit(False))
        kept = F.filter(raw, lambda e, i: ~(F.get(e, 1).isin(*C.CONNECTORS) & slot_at(i - 1) & slot_at(i + 1)) | (F.get(e, 0) != "w"))
        return X.let(kept, collapsed)

    def collapsed(kept: Column) -> Column:
        is_slot = lambda i: F.coalesce(F.get(F.get(kept, i), 0) != "w", F.lit(False))
        # a slot after a slot goes; the first of such a run loses its constraint
        heads = F.transform(kept, lambda e, i: F.when(is_slot(i) & is_slot(i - 1), F.lit(None)).when(is_slot(i) & is_slot(i + 1), F.array(F.lit("slot"))).otherwise(e))
        return F.filter(heads, lambda e: e.isNotNull())

    return X.let(raw, linked)


def fixed_lemmas(elements: Column) -> Column:
    """Lemmas of the fixed words, in order; a fixed word without a lemma has the empty one."""
    return F.transform(F.filter(elements, lambda e: F.get(e, 0) == "w"), lambda e: F.coalesce(F.get(e, 1), F.lit("")))


def fixed_count(elements: Column) -> Column:
    return F.size(F.filter(elements, lambda e: F.get(e, 0) == "w"))


def first_fixed(elements: Column) -> Column:
    """First fixed lemma, the key of the lexicon's index; null if there is none."""
    return F.get(fixed_lemmas(elements), 0)


def has_slot(elements: Column) -> Column:
    return F.exists(elements, lambda e: F.get(e, 0) != "w")


def has_content_word(elements: Column) -> Column:
    """Whether a fixed lemma is no closed-class word."""
    return F.exists(fixed_lemmas(elements), lambda w: ~F.lower(w).isin(*C.CLOSED_CLASS))


def valid_elements(elements: Column) -> Column:
    """Whether every element is of a known kind."""
    return F.coalesce(F.forall(elements, lambda e: F.coalesce(F.get(e, 0).isin("w", "slot", "slot:pron", "slot:noun"), F.lit(False))), F.lit(False))


def plan(elements: Column) -> Column:
    """array<struct<w, gap, slot>> of the fixed words: lemma, tokens allowed before it, constraint on them.

    The slot of a word is the element right before it; slots before the first
    word and after the last one are ignored.
    """

    def steps(elements: Column) -> Column:
        kinds = F.transform(elements, lambda e: F.get(e, 0))

        def step(e: Column, i: Column) -> Column:
            before = F.get(F.get(elements, i - 1), 0)
            slotted = F.coalesce(before != "w", F.lit(False)) & (i > first)
            gap = F.when(i == first, 0).when(slotted, C.SLOT_MAX).otherwise(C.GAP_MAX)
            word = F.struct(F.coalesce(F.get(e, 1), F.lit("")).alias("w"), gap.alias("gap"), F.when(slotted, before).otherwise("slot").alias("slot"))
            return F.when(F.get(e, 0) == "w", word)

        first = (F.array_position(kinds, "w") - 1).cast("int")
        return F.filter(F.transform(elements, step), lambda s: s.isNotNull())

    return X.let(elements, steps)


def lemma_eq(a: Column, b: Column) -> Column:
    """Equal, or one is the other (of four characters at least) and an inflectional ending."""
    ending = lambda short, long: (F.length(short) >= C.SHORTEST_STEM) & F.startswith(long, short) & F.substr(long, F.length(short) + 1).isin(*C.INFLECTIONS)
    return (a == b) | ending(a, b) | ending(b, a)


def stem_key(lemma: Column) -> Column:
    """First characters, which equal lemmas share: a key for joins before ``lemma_eq``."""
    return F.left(lemma, F.lit(C.SHORTEST_STEM))


def tokens(lemmas: Column, upos: Column, surface: Column) -> Column:
    """array<struct<lemma, upos, surface>> that ``match`` reads."""
    return F.arrays_zip(lemmas.alias("lemma"), upos.alias("upos"), surface.alias("surface"))


def _hard_boundary(surface: Column) -> Column:
    return surface.isin(*C.HARD_BOUNDARIES) | surface.rlike(r"^\.{2,}$")


def crossing_ok(between: Column, step: Column, n_fixed: Column) -> Column:
    """Whether a match may step over the tokens ``between`` two of its words."""
    punct = lambda t: t["upos"] == "PUNCT"
    hard = F.exists(between, lambda t: punct(t) & _hard_boundary(t["surface"]))
    content = F.exists(between, lambda t: t["upos"].isin(*C.CONTENT_UPOS))
    comma = F.exists(between, lambda t: punct(t) & (t["surface"] == ","))
    first = F.get(between, 0)["upos"]
    fill = (
        F.when(step["slot"] == "slot:pron", F.coalesce(first == "PRON", F.lit(False)))
        .when(step["slot"] == "slot:noun", F.coalesce(first.isin(*C.NOMINAL_UPOS), F.lit(False)))
        .otherwise(True)
    )
    implicit = step["gap"] <= C.GAP_MAX
    rules = [~hard, ~(implicit & content), ~(implicit & (n_fixed < 3) & comma), implicit | fill]
    return reduce(lambda x, y: x & y, rules)


def match(toks: Column, steps: Column) -> Column:
    """0-based positions of the fixed words in the match of least span, the leftmost of those; null without a match.

    ``toks`` is as from ``tokens``, ``steps`` as from ``plan``.  One state per
    position where the words so far can end: the latest start that leads there
    and its path, the earliest predecessor on ties.
    """
    state = "array<struct<start:int,path:array<int>>>"
    places = F.sequence(F.lit(0), F.size(toks) - 1)
    n_fixed = F.size(steps)
    first = F.get(steps, 0)["w"]
    starts = F.transform(
        F.filter(places, lambda p: lemma_eq(F.get(toks, p)["lemma"], first)), lambda p: F.struct(p.alias("start"), F.array(p).alias("path"))
    ).cast(state)

    def advance(states: Column, step: Column) -> Column:
        def reach(q: Column) -> Column:
            def usable(s: Column) -> Column:
                p = F.element_at(s["path"], -1)
                near = (p < q) & (q <= p + 1 + step["gap"])
                return near & crossing_ok(F.slice(toks, p + 2, F.when(near, q - p - 1).otherwise(0)), step, n_fixed)

            best = F.array_max(F.transform(F.filter(states, usable), lambda s: F.struct(s["start"].alias("start"), (-F.element_at(s["path"], -1)).alias("p"), s["path"].alias("path"))))
            return X.let(best, lambda b: F.when(b.isNotNull(), F.struct(b["start"].alias("start"), F.concat(b["path"], F.array(q)).alias("path"))))

        targets = F.filter(places, lambda q: lemma_eq(F.get(toks, q)["lemma"], step["w"]))
        after = F.filter(F.transform(targets, reach), lambda s: s.isNotNull())
        return F.when(F.size(states) == 0, states).otherwise(after.cast(state))

    ends = F.aggregate(F.slice(steps, 2, F.greatest(n_fixed - 1, F.lit(0))), starts, advance)
    ranked = F.transform(ends, lambda s: F.struct((F.element_at(s["path"], -1) - s["start"]).alias("span"), s["start"].alias("start"), s["path"].alias("path")))
    return F.when((F.size(toks) > 0) & (n_fixed > 0), F.array_min(ranked)["path"])


def surface(words: Column, lo: Column, hi: Column) -> Column:
    """Words lo..hi (0-based) joined as text."""
    joined = F.array_join(F.slice(words, lo + 1, hi - lo + 1), " ")
    for mark in ("'s", "n't", ",", ".", "!", "?"):
        joined = F.replace(joined, F.lit(" " + mark), F.lit(mark))
    return joined


def phrasal_arc_ok(path: Column, heads: Column, rels: Column, upos: Column) -> Column:
    """Gate of phrasal verbs: a verb whose particle hangs on it, or on a word that does and is no mark of a clause.

    ``heads`` are 1-based with 0 for the root, parallel to the words.
    """
    verb, particle = F.get(path, 0), F.get(path, 1)
    head = F.coalesce(F.get(heads, particle), F.lit(0))
    direct = head == verb + 1
    hop = (head > 0) & F.coalesce(F.get(heads, head - 1) == verb + 1, F.lit(False)) & (F.coalesce(F.get(rels, particle), F.lit("")) != "mark")
    return F.coalesce(F.get(upos, verb) == "VERB", F.lit(False)) & (particle.isNull() | direct | hop)
