"""Text that looks the same but differs in its characters, brought to one form.

Full-width and half-width forms, letters in another type face, ligatures and
blanks of any width become the ordinary ones, characters of no width are
dropped, hyphens that look like the ordinary hyphen become it, and accents are
composed.  Letters that look the same in Latin, Cyrillic, Greek and Armenian
are written in the script of their word: that of most of its letters that only
one script has, or where it has none, the text's if that has all its shapes.  So a Russian or Greek
text stays as it is, a Latin letter within one becomes Cyrillic or Greek, and
the other way round.  Letter case, accents, raised digits and other
punctuation stay.

Most text is already in that form.  A character that may change, or that may
combine with the one before it, is unstable (Unicode's quick-check property,
widened by the folds above); runs of unstable characters are isolated with one
character of context, only they are normalised, and the results are spliced
into the unchanged text.  Words are looked at only in texts that mix scripts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom.plans.lineage import cut_lineage

#: Ranges of characters without width.
NO_WIDTH = ((0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF))

#: Letter:look-alike in Latin, after Unicode's confusables; a line each of Cyrillic small, Cyrillic
#: capital, Greek and Armenian letters, and Latin ones of other shape.
LOOK_ALIKES = (
    "а:a е:e һ:h і:i ј:j ӏ:l о:o р:p ԛ:q ѕ:s с:c у:y х:x ԁ:d ԝ:w ѵ:v "
    "А:A В:B Е:E Н:H І:I Ј:J К:K М:M О:O Р:P Ԛ:Q Ѕ:S Т:T С:C Ү:Y Х:X Ԝ:W Ѵ:V Ӏ:l "
    "ο:o ϲ:c ϳ:j ν:v Α:A Β:B Ε:E Ζ:Z Η:H Ι:I Κ:K Μ:M Ν:N Ο:O Ρ:P Τ:T Υ:Y Χ:X Ϲ:C Ϳ:J "
    "օ:o ս:u հ:h ո:n ց:g զ:q Օ:O Ս:U "
    "ɡ:g ɑ:a"
)

#: Marks that look like the ordinary hyphen.
HYPHENS = "‐‑"

#: Code points of the scripts that share shapes with Latin.
SCRIPTS = {"cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0xA640, 0xA69F)), "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)), "armenian": ((0x531, 0x58F),)}


#: Latin letters whose shape is an everyday letter of the other scripts.
EVERYDAY = {"cyrillic": "aceiopxyABCEHIKMOPTX", "greek": "ovABEZHIKMNOPTYX", "armenian": "ouhngqOU"}


def _script(c: str) -> str:
    return next((name for name, ranges in SCRIPTS.items() if any(a <= ord(c) <= b for a, b in ranges)), "latin")


@lru_cache(maxsize=1)
def to_script() -> dict[str, dict[int, str]]:
    """Script -> how each shared shape is written in it; a shape that it lacks becomes the Latin letter."""
    twins = [pair.split(":") for pair in LOOK_ALIKES.split()]
    latin = {ord(a): b for a, b in twins}
    tables = {"latin": latin}
    for script in SCRIPTS:
        own = {b: a for a, b in twins if _script(a) == script}
        tables[script] = {**{cp: own.get(b, b) for cp, b in latin.items()}, **{ord(b): a for b, a in own.items()}}
    return tables


def _class_of(ranges) -> str:
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(maxsize=1)
def _patterns() -> dict[str, regex.Pattern]:
    """Words, letters of the other scripts, and of each script the letters that only it has."""
    shared = "".join(chr(cp) for cp in to_script()["latin"]) + "".join(sorted(set(to_script()["latin"].values())))
    found = {name: regex.compile(f"(?V1)[[{_class_of(ranges)}]&&\\p{{L}}--[{shared}]]") for name, ranges in SCRIPTS.items()}
    found["latin"] = regex.compile(f"(?V1)[\\p{{Latin}}--[{shared}]]")
    found["word"] = regex.compile(r"[\p{L}\p{M}]+")
    found["foreign"] = regex.compile("[" + "".join(map(_class_of, SCRIPTS.values())) + "]")
    return found


def _target(text: str) -> str | None:
    """The script of most letters that only one script has, Latin on ties; None if there are none.  ``text`` is decomposed."""
    counts = {name: len(_patterns()[name].findall(text)) for name in ("latin", *SCRIPTS)}
    best = max(counts.values())
    return next(name for name, n in counts.items() if n == best) if best else None


def by_script(text: str) -> str:
    """``text`` (composed) with the shapes that scripts share written in the script of their word."""
    if not _patterns()["foreign"].search(text) and not any(c in text for c in "ɡɑ"):
        return text
    whole = _target(unicodedata.normalize("NFD", text)) or "latin"

    def word(match: regex.Match) -> str:
        own = match.group()
        if own.isascii() and whole == "latin":
            return own
        parts = unicodedata.normalize("NFD", own)
        script = _target(parts)
        if script is None:  # the text's, if that writes all these shapes
            shapes = (c for c in parts.translate(to_script()["latin"]) if c.isalpha())
            script = whole if whole != "latin" and all(c in EVERYDAY[whole] for c in shapes) else "latin"
        return unicodedata.normalize("NFC", parts.translate(to_script()[script]))

    return _patterns()["word"].sub(word, text)


def _assigned() -> Iterator[int]:
    """Code points that may have a form of their own, ascending: no surrogates, private use or empty planes."""
    return chain(range(0xD800), range(0xF900, 0x30000), range(0xE0000, 0xE0200))


@lru_cache(maxsize=1)
def folds() -> dict[int, str]:
    """Code point (of a decomposed text) -> what it looks like in any text; the empty string drops it."""
    table: dict[int, str] = {}
    for cp in _assigned():
        c = chr(cp)
        if unicodedata.category(c) == "Zs" and c != " ":
            table[cp] = " "
            continue
        how = unicodedata.decomposition(c)
        if how.startswith(("<wide>", "<narrow>")) or (how.startswith("<font>") and cp >= 0x1D400) or 0xFB00 <= cp <= 0xFB06:
            table[cp] = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", c))
    for first, last in NO_WIDTH:
        table.update({cp: "" for cp in range(first, last + 1)})
    table.update({ord(h): "-" for h in HYPHENS})
    return table


def _local_form(text: str) -> str:
    """The form but for letters that scripts share; what changes depends on neighbours only."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(folds()))


def whole_form(text: str) -> str:
    """The form computed over the whole text at once (the definition that the splicing must equal)."""
    return by_script(_local_form(text))


def _ranges(form) -> tuple[tuple[int, int], ...]:
    """Ranges of code points that ``form`` changes or that may combine with the one before."""
    maybe = set(range(0x1161, 0x1176)) | set(range(0x11A8, 0x11C3))  # vowels and finals of Hangul
    for cp in _assigned():
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            maybe.add(int(parts[1], 16))
    found: list[list[int]] = []
    for cp in _assigned():
        if cp < 0x80:
            continue
        c = chr(cp)
        if cp in maybe or unicodedata.combining(c) or form(c) != c:
            if found and found[-1][1] == cp - 1:
                found[-1][1] = cp
            else:
                found.append([cp, cp])
    return tuple((a, b) for a, b in found)


@lru_cache(maxsize=1)
def unstable_ranges() -> tuple[tuple[int, int], ...]:
    """Ranges of code points that may change, alone, or combine with the one before."""
    return _ranges(whole_form)


@lru_cache(maxsize=1)
def _local_ranges() -> tuple[tuple[int, int], ...]:
    return _ranges(_local_form)


def _java_class(ranges) -> str:
    """Ranges as a character class for the JVM's regular expressions."""
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges) + "]"


def java_class() -> str:
    """The characters that are unstable in any text as a character class for the JVM's regular expressions."""
    return _java_class(_local_ranges())


@lru_cache(maxsize=1)
def _segments() -> regex.Pattern:
    # the character before a run is its context: a mark may combine with it
    inside = _class_of(_local_ranges())
    return regex.compile(f"[^{inside}]?[{inside}]+", regex.S)


def canonical(text: str) -> str:
    """The form of ``text``, normalising unstable segments only, then the words of a text that mixes scripts."""
    return by_script(_segments().sub(lambda m: _local_form(m.group()), text))


@lru_cache(maxsize=1)
def _own_letters() -> tuple[tuple[int, int], ...]:
    """Letters of the other scripts that, with or without accents, no other script has."""
    kept = lambda c: c.isalpha() and any(_patterns()[s].match(unicodedata.normalize("NFD", c)[0]) for s in SCRIPTS)
    return tuple((cp, cp) for ranges in SCRIPTS.values() for a, b in ranges for cp in range(a, b + 1) if kept(chr(cp)))


def unstable(text: Column) -> Column:
    """Whether a text may have another form.

    ASCII text, told by its length in bytes, is never searched.  A text wholly
    in one of the other scripts, with a letter of its own, is stable.
    """
    scripts = [text.rlike(_java_class(ranges)) for ranges in SCRIPTS.values()]
    several = (scripts[0] & scripts[1]) | (scripts[0] & scripts[2]) | (scripts[1] & scripts[2])
    foreign = scripts[0] | scripts[1] | scripts[2]
    mixed = foreign & (text.rlike("\\p{IsLatin}") | several | ~text.rlike(_java_class(_own_letters())))
    return (F.octet_length(text) > F.length(text)) & (text.rlike(java_class()) | mixed | text.rlike("[ɡɑ]"))


def with_form(rows: DataFrame, text_col: str, form_col: str = "form") -> DataFrame:
    """Add the consistent form of ``text_col``; null stays null, the empty string stays empty.

    Rows without any unstable character are told apart inside the JVM and
    never reach Python: their form is the text itself.
    """
    rows = rows.drop(form_col)
    odd = unstable(F.col(text_col))
    stable = rows.where(F.coalesce(~odd, F.lit(True))).withColumn(form_col, F.col(text_col))
    return stable.unionByName(unstable_rows(rows, text_col, form_col))


def unstable_rows(rows: DataFrame, text_col: str, form_col: str = "form") -> DataFrame:
    """Only the rows with an unstable character, with their form."""
    rows = rows.drop(form_col)
    at = rows.columns.index(text_col)
    schema = rows.select("*", F.col(text_col).alias(form_col)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = pa.array([canonical(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, forms], names=[*batch.schema.names, form_col])

    return rows.where(unstable(F.col(text_col))).mapInArrow(run, schema)


_TEXT, _FORM = ["_t1", "_t2"], ["_f1", "_f2"]


def _hashes(text: Column, names: Sequence[str]) -> list[Column]:
    """128 bits that stand for a text, so that texts themselves are not shuffled."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(1), text).alias(names[1])]


def _together(rows: DataFrame, key: str, text_col: str, by: Sequence[str]) -> DataFrame:
    """(by, key, hashes of text and form) of the texts that can look like another: the unstable ones and the stable ones of their forms.

    One pass over the texts tells which are unstable and keeps only those; a
    stable text is its own form, so its hashes are all that is needed of it.
    """
    text = F.col(text_col)
    marked = rows.where(text.isNotNull()).select(*by, F.col(key).alias("key"), *_hashes(text, _TEXT), F.when(unstable(text), text).alias("text"))
    marked = cut_lineage(marked)
    odd = unstable_rows(marked.where("text is not null"), "text").where(~F.col("form").rlike("^\\s*$"))
    odd = cut_lineage(odd.select(*by, "key", *_TEXT, *_hashes(F.col("form"), _FORM)))
    forms = odd.select(*by, *[F.col(f).alias(t) for f, t in zip(_FORM, _TEXT)]).distinct()
    plain = marked.where("text is null").drop("text").join(forms, [*by, *_TEXT], "left_semi")
    return odd.unionByName(plain.select(*by, "key", *_TEXT, *[F.col(t).alias(f) for f, t in zip(_FORM, _TEXT)]))


def _shared(together: DataFrame, by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows, and the distinct texts whose form another text has as well, with their numbers of rows."""
    kept = cut_lineage(together)
    texts = kept.groupBy(*by, *_FORM, *_TEXT).agg(F.count("*").alias("_n"))
    several = texts.groupBy(*by, *_FORM).agg(F.count("*").alias("_texts"), F.sum("_n").alias("_all")).where("_texts > 1")
    return kept, texts.join(several, [*by, *_FORM])


def look_alike_classes(rows: DataFrame, key: str, text_col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, key, class_id, links): each row that looks like a row of other characters, its class and how many such rows there are.

    A class is all rows of one form, of which there are two texts at least;
    ``class_id`` is its smallest key.  Linear in the rows: no pair is made.
    """
    kept, texts = _shared(_together(rows, key, text_col, by), by)
    facts = cut_lineage(texts.select(*by, *_FORM, *_TEXT, (F.col("_all") - F.col("_n")).alias("links")))
    members = kept.join(facts, [*by, *_FORM, *_TEXT])
    first = members.groupBy(*by, *_FORM).agg(F.min("key").alias("class_id"))
    return members.join(first, [*by, *_FORM]).select(*by, "key", "class_id", "links")


def look_alike_pairs(rows: DataFrame, key: str, text_col: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, key_a, key_b) with key_a < key_b: texts that look the same and are not the same characters.

    ``rows`` must hold each key once (per value of the columns ``by``, within
    which texts are compared).  Null and blank texts are no case; equal texts
    are no pair.  Two stable texts of one form are equal, so every pair has an
    unstable member: only forms of unstable texts are searched among the
    stable ones.  Forms are compared as distinct texts first, and the keys are
    joined to the pairs of differing texts at the end, so a group of equal
    texts, however large, is never paired with itself.  Texts and forms are
    told apart by 128 bits of them.  The pairs of two texts are the product of
    their keys; ``look_alike_classes`` has the same links without it.
    """
    kept, texts = _shared(_together(rows, key, text_col, by), by)
    texts = cut_lineage(texts.select(*by, *_FORM, *_TEXT))  # the few texts that are in a pair
    side = lambda df, name, more=(): df.select(*by, *more, *[F.col(t).alias(t + name) for t in _TEXT])
    less = F.struct("_t1a", "_t2a") < F.struct("_t1b", "_t2b")
    pairs = side(texts, "a", _FORM).join(side(texts, "b", _FORM), [*by, *_FORM]).where(less).drop(*_FORM)
    keys = kept.join(texts, [*by, *_FORM, *_TEXT], "left_semi")
    joined = pairs.join(side(keys, "a", [F.col("key").alias("a")]), [*by, "_t1a", "_t2a"]).join(side(keys, "b", [F.col("key").alias("b")]), [*by, "_t1b", "_t2b"])
    return joined.select(*by, F.least("a", "b").alias("key_a"), F.greatest("a", "b").alias("key_b"))
