"""Tokens and lemmas as native columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from phraseloom import constants as C


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def once(value: Column) -> Column:
    """A generator of exactly ``value``, for ``select``.

    The optimizer copies a column into every filter above it; it does not
    copy a generator, so a costly value is computed once per row.
    """
    return F.explode(F.array(value))


def once_if(value: Column, test: Callable[[Column], Column]) -> Column:
    """A generator of ``value`` where it passes ``test``, and of no row where it does not; both see it computed once."""
    return F.explode(F.filter(F.array(value), lambda v: F.coalesce(test(v), F.lit(False))))


_LONGEST = max(map(len, C.ABBREVIATIONS))


def _faster(form: str) -> str:
    """The same form for Java's matcher: no way back into a long name before @, a look ahead before the list of abbreviations."""
    if "@" in form:
        return form.replace("]+@", "]++@")
    return rf"(?=\p{{L}}{{2,{_LONGEST}}}\.)" + form if form.endswith(")\\.") and "(?iu:" in form else form


#: One alternative per kind of token; the first that matches at a place wins.
#: The first four are shortcuts for plain words and marks: what they take, the
#: last two would, as no other alternative can begin there.
TOKEN_PATTERN = "|".join(
    (
        r"[A-Za-z0-9]++(?=[ \t\n\r;!?\"()\[\]{}<>]|\z)",
        r"[A-Za-z]++(?=,)",
        rf"[A-Za-z]{{{_LONGEST + 1},}}+(?=\.[ \n])",
        r"[,;:!?\"()\[\]{}<>]",
        *map(_faster, C.token_forms("?iu")),
    )
)

_TAIL = C.CLITIC_TAIL


def _apostrophe(t: Column) -> Column:
    return F.contains(t, F.lit("'")) | F.contains(t, F.lit("’"))


def split_contraction(token: Column) -> Column:
    """A token without and with its clitics (``didn't`` -> did, n't; ``cannot`` -> can, not); case is kept."""

    def words(stem: Column) -> Column:
        cannot = (F.length(stem) == 6) & (F.lower(stem) == "cannot")
        return F.when(cannot, F.array(F.substring(stem, 1, 3), F.substring(stem, 4, 3))).otherwise(F.array(stem))

    stem = F.regexp_extract(token, rf"(?ius)^(.+?)({_TAIL}*)$", 1)
    with_tail = let(stem, lambda s: F.concat(words(s), F.regexp_extract_all(F.substr(token, F.length(s) + 1), F.lit(f"(?iu){_TAIL}"), 0)))
    return F.when(_apostrophe(token), with_tail).otherwise(words(token))


def tokenize(text: Column) -> Column:
    """Word list of a text; null stays null, a blank text has no words.  Letters outside ASCII are words of their own."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), 0)
    # a text without apostrophe and without "cannot" has nothing to split
    nothing = ~_apostrophe(text) & ~F.contains(F.lower(text), F.lit("cannot"))
    return F.when(nothing, tokens).otherwise(F.flatten(F.transform(tokens, split_contraction)))


def _in(word: Column, table: dict[str, str]) -> Column:
    """Whether ``word`` is a key; a hashed test, so words outside the table cost one probe."""
    return word.isin(*table)


def _value(word: Column, table: dict[str, str]) -> Column:
    """The value of a key."""
    entries = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in table.items())), F.lit(","), F.lit(":"))  # folded to a constant
    return F.element_at(entries, word)


def lemma(word: Column, is_verb: Column | bool = False) -> Column:
    """Match key of one word: lower case, no outer punctuation, irregular forms mapped, regular endings cut.

    ``is_verb`` opens the forms that are irregular for verbs only.  Null stays
    null; a word of punctuation has the empty string.
    """
    ends = lambda t, *ss: reduce(lambda a, b: a | b, [F.endswith(t, F.lit(s)) for s in ss])
    verb = F.lit(is_verb) if isinstance(is_verb, bool) else is_verb

    def without_possessive(t: Column) -> Column:  # outer apostrophes are gone already
        return F.when(ends(t, "'s", "’s"), F.left(t, F.length(t) - 2)).otherwise(t)

    def rules(t: Column) -> Column:
        n = F.length(t)
        cut = lambda k: F.left(t, n - k)
        return (
            F.when(verb & _in(t, C.IRREGULAR_VERBS), _value(t, C.IRREGULAR_VERBS))
            .when(_in(t, C.IRREGULAR), _value(t, C.IRREGULAR))
            .when((n <= 3) | ~ends(t, "s", "ing", "ed") | ~t.rlike(r"^\p{IsAlphabetic}+$"), t)
            .when(ends(t, "ies") & (n > 4), F.concat(cut(3), F.lit("y")))
            .when(ends(t, "ses", "shes", "ches", "xes", "zes"), cut(2))
            .when(ends(t, "ing") & (n > 5), cut(3))
            .when(ends(t, "ied") & (n > 4), F.concat(cut(3), F.lit("y")))
            .when(ends(t, "ed") & (n > 4), cut(2))
            .when(ends(t, "s") & ~ends(t, "ss"), cut(1))
            .otherwise(t)
        )

    return let(F.btrim(F.lower(word), F.lit(C.STRIP_CHARS)), lambda t: let(without_possessive(t), rules))


def lemmatize(words: Column, is_verb: Column | None = None) -> Column:
    """Lemmas of a word list, with parallel verb flags where given."""
    return F.transform(words, lemma) if is_verb is None else F.zip_with(words, is_verb, lemma)


def unicode_trim(text: Column) -> Column:
    """Without white space (of any kind) at both ends."""
    return F.regexp_replace(text, f"^[{C.BLANK}]+|[{C.BLANK}]+$", "")


def unicode_words(text: Column) -> Column:
    """Parts between white space of any kind."""
    return F.filter(F.split(text, f"[{C.BLANK}]+"), lambda w: w != "")


def is_slot_token(token: Column) -> Column:
    """Whether a headword's token stands for a free slot."""
    t = unicode_trim(token)
    return t.rlike(r"^[\[(<⟨].*[\])>⟩]$") | F.lower(t).isin(*C.SLOT_WORDS)


def slot_type(token: Column) -> Column:
    """``slot:pron``, ``slot:noun`` or ``slot`` for a slot token."""
    t = F.lower(unicode_trim(token))
    return F.when(t.isin(*C.PRONOUN_SLOTS), "slot:pron").when(t.isin(*C.NOUN_SLOTS), "slot:noun").otherwise("slot")
