"""Building the lexicon from dictionary dumps."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from phraseloom.functions import hashing, pattern, text


@dataclass(frozen=True)
class BuilderConfig:
    """What the builder keeps.  ``lang_code`` None switches the language filter off; the empty string does not."""

    target_categories: Mapping[str, str]
    lang_code: str | None = None
    pos_filter: Mapping[str, Sequence[str]] = field(default_factory=dict)
    phrase_blocklist: Sequence[str] = ()
    input_file: str = ""

    @classmethod
    def from_toml(cls, path: str) -> BuilderConfig:
        with open(path, "rb") as f:
            raw = tomllib.load(f)
        return cls(raw["target_categories"], raw.get("lang_code"), raw.get("pos_filter", {}), raw.get("phrase_blocklist", ()), raw["input_file"])


#: The default categories, part-of-speech filter and blocked phrases.
DEFAULT_CONFIG = BuilderConfig(
    target_categories={"English idioms": "idiom", "English phrasal verbs": "phrasal_verb", "English proverbs": "proverb", "English multiword terms": "fixed_collocation"},
    lang_code="en",
    pos_filter={"fixed_collocation": ("verb", "phrase", "adv", "prep_phrase")},
    phrase_blocklist=(
        "on the wallaby", "that is", "is that so", "be one thing", "so to say", "as one man", "in one voice", "the house", "have it", "do it", "make it",
        "I do", "I know", "is all", "and that", "of his", "had best", "make something of oneself", "make something of", "this is someone", "be on nights",
        "going to", "want to", "ought to", "have got", "liked to", "there be",
    ),
)


def category_types(category: Column, config: BuilderConfig) -> Column:
    """Types whose target is the category or its first words."""
    hits = [F.when((category == t) | F.startswith(category, F.lit(t + " ")), F.lit(kind)) for t, kind in sorted(config.target_categories.items())]
    return F.filter(F.array(*hits), lambda k: k.isNotNull())


def _types_of(categories: Column, config: BuilderConfig) -> Column:
    none = F.array().cast("array<string>")
    return F.coalesce(F.flatten(F.transform(F.filter(categories, lambda c: c.isNotNull()), lambda c: category_types(c, config))), none)


def in_language(entries: DataFrame, config: BuilderConfig) -> DataFrame:
    """Entries of the wanted language with a headword of two words at least."""
    kept = entries if config.lang_code is None else entries.where(F.col("lang_code").eqNullSafe(F.lit(config.lang_code)))
    return kept.where(F.col("word").isNotNull() & (F.size(text.unicode_words(F.col("word"))) >= 2))


def with_types(entries: DataFrame, config: BuilderConfig) -> DataFrame:
    """Add ``types``, ``first_gloss`` and ``sense_tags``.

    Types come from the categories of entry and senses; gloss and tags only
    from senses with a matching category, before types are dropped whose
    part-of-speech filter lacks the entry's.  Sorted, without repetition.
    """
    none = F.array().cast("array<string>")
    senses = F.filter(F.coalesce("senses", F.array().cast(entries.schema["senses"].dataType)), lambda s: F.size(_types_of(s["categories"], config)) > 0)
    entries = entries.withColumn("_hits", senses)
    from_senses = F.flatten(F.transform("_hits", lambda s: _types_of(s["categories"], config)))
    types = F.array_sort(F.array_distinct(F.concat(_types_of(F.col("categories"), config), from_senses)))
    pos = F.coalesce("pos", F.lit(""))
    allowed = lambda t: ~F.array_contains(F.array(*[F.lit(k) for k in config.pos_filter]), t) if config.pos_filter else F.lit(True)

    def keep(t: Column) -> Column:
        ok = allowed(t)
        for kind, tags in config.pos_filter.items():
            ok = ok | ((t == kind) & pos.isin(*tags))
        return ok

    glosses = F.flatten(F.transform("_hits", lambda s: F.coalesce(s["glosses"], none)))
    tags = F.flatten(F.transform("_hits", lambda s: F.coalesce(s["tags"], none)))
    return (
        entries.select("*", text.once(F.filter(types, keep)).alias("types"))
        .withColumn("first_gloss", F.get(glosses, 0))
        .withColumn("sense_tags", F.array_sort(F.array_distinct(F.filter(tags, lambda t: t.isNotNull()))))
        .drop("_hits")
    )


def first_per_word(entries: DataFrame, config: BuilderConfig, order: list[str]) -> DataFrame:
    """The first entry of each exact headword among those that have a type and are not blocked.

    A hash aggregation with partial results: a headword that a third of the
    rows share is reduced to one row per task before the shuffle, which moves
    only what the lexicon keeps, not the senses and categories of the dump.
    """
    good = entries.where((F.size("types") > 0) & ~F.col("word").isin(*config.phrase_blocklist))
    rest = list(dict.fromkeys(c for c in ("pos", "types", "first_gloss", "sense_tags", *order) if c in entries.columns))
    return good.groupBy("word").agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_e")).select("word", "_e.*")


def long_enough(elements: Column) -> Column:
    """Two fixed words at least, one of them a content word."""
    return (pattern.fixed_count(elements) >= 2) & pattern.has_content_word(elements)


def build(entries: DataFrame, config: BuilderConfig, order: list[str]) -> DataFrame:
    """Lexicon entries of a dump: id, phrase, categories, pos, definition, tags, elements, and the columns of ``order``.

    Entries with fewer than two fixed words or without a content word drop
    after the first of each headword was chosen.
    """
    firsts = first_per_word(with_types(in_language(entries, config), config), config, order)
    kept = firsts.select("*", text.once_if(pattern.phrase_elements(F.col("word")), long_enough).alias("elements"))
    return kept.select(
        hashing.phrase_id("word").alias("id"),
        F.col("word").alias("phrase"),
        F.col("types").alias("categories"),
        "pos",
        F.col("first_gloss").alias("definition"),
        F.col("sense_tags").alias("tags"),
        "elements",
        *order,
    )


def observed(entries: DataFrame, observation: Observation) -> DataFrame:
    """Dump entries that count themselves as they are scanned: a running job reports them, and ``observation.get`` at its end."""
    return entries.observe(observation, F.count("*").alias("scanned"), F.count("word").alias("with_word"))


def build_stats(entries: DataFrame, config: BuilderConfig, order: list[str]) -> DataFrame:
    """One row: lines scanned, entries written, headwords skipped as too short."""
    firsts = first_per_word(with_types(in_language(entries, config), config), config, order)
    good = firsts.select(text.once(text.let(pattern.phrase_elements(F.col("word")), long_enough)).alias("good"))
    counts = good.agg(F.count_if("good").alias("written"), F.count_if(~F.col("good")).alias("skipped_too_short"), F.lit(0).cast("bigint").alias("scanned"))
    scanned = entries.agg(F.lit(0).cast("bigint").alias("written"), F.lit(0).cast("bigint").alias("skipped_too_short"), F.count("*").alias("scanned"))
    return counts.unionByName(scanned).agg(*[F.sum(c).alias(c) for c in ("scanned", "written", "skipped_too_short")])
