"""JSON-lines sources and sinks.

A line is taken or dropped as a whole: malformed JSON, a missing or null
required field or a value of a wrong type drops it; unknown fields are
ignored.  Types are checked on the raw JSON, as a lenient parser would turn a
number into a string or null a single field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.functions import pattern, text

LEXICON_SCHEMA = (
    "id bigint, phrase string, categories array<string>, pos string, definition string, tags array<string>, elements array<array<string>>"
)
WIKI_SCHEMA = (
    "word string, pos string, lang_code string, categories array<string>, "
    "senses array<struct<categories:array<string>,tags:array<string>,glosses:array<string>>>"
)
CORRECTION_SCHEMA = "id bigint, categories array<string>"


def read_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file_ord, line_no, line) of text files, in file and line order.

    Lines are numbered within their file by the place the reader found them:
    (block start, order within the split), which does not depend on how splits
    are scheduled.  A missing file is an error.
    """
    parts = [
        spark.read.text(p).select(
            F.lit(i).alias("file_ord"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("at")).alias("line_no"), F.col("value").alias("line")
        )
        for i, p in enumerate(paths)
    ]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found


def _kind(variant: Column, path: str) -> Column:
    """Type name of a field: null if it is missing, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(variant, path, "variant"))


def _text_or_nothing(variant: Column, path: str) -> Column:
    kind = _kind(variant, path)
    return kind.isNull() | kind.isin("STRING", "VOID")


def _strings(variant: Column, path: str, required: bool = False, nullable: bool = False) -> Column:
    """Whether a field is an array of strings (or missing, unless required; or null, if nullable)."""
    kind = _kind(variant, path)
    good = kind.isin("ARRAY<STRING>", "ARRAY<VOID>")
    # an array with a null member has the same type as one without
    members = F.try_variant_get(variant, path, "array<string>")
    good = good & (F.coalesce(F.forall(members, lambda m: m.isNotNull()), F.lit(False)))
    allowed = [good]
    if not required:
        allowed.append(kind.isNull())
    if nullable:
        allowed.append(kind == "VOID")
    out = allowed[0]
    for a in allowed[1:]:
        out = out | a
    return F.coalesce(out, F.lit(False))


def _u32(variant: Column, path: str) -> Column:
    value = F.try_variant_get(variant, path, "bigint")
    return F.coalesce(_kind(variant, path).isin("BIGINT", "LONG") & value.between(0, 4294967295), F.lit(False))


def _parsed(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """Add ``_p``: the line as a variant (v) and by the schema (e), parsed once for all checks."""
    both = F.struct(F.try_parse_json(line).alias("v"), F.from_json(line, schema).alias("e"))
    return lines.select("*", text.once(both).alias("_p")).select(*lines.columns, F.col("_p.v").alias("_v"), F.col("_p.e").alias("_e"))


def parse_lexicon(lines: DataFrame, line: str = "line") -> DataFrame:
    """Entries of a lexicon file; other columns are kept.

    Required: id (32 bits, unsigned), phrase, elements with known kinds.
    Missing categories and tags are empty lists; blank and bad lines drop.
    """
    v = F.col("_v")
    parsed = (
        _parsed(lines.where(text.unicode_trim(F.col(line)) != ""), line, LEXICON_SCHEMA)
        .where(
            _u32(v, "$.id")
            & F.coalesce(_kind(v, "$.phrase") == "STRING", F.lit(False))
            & _strings(v, "$.categories")
            & _strings(v, "$.tags")
            & _text_or_nothing(v, "$.pos")
            & _text_or_nothing(v, "$.definition")
            & pattern.valid_elements(F.try_variant_get(v, "$.elements", "array<array<string>>"))
        )
    )
    rest = [c for c in lines.columns if c != line]
    empty = F.array().cast("array<string>")
    return parsed.select(
        *rest,
        "_e.id",
        "_e.phrase",
        F.coalesce("_e.categories", empty).alias("categories"),
        "_e.pos",
        "_e.definition",
        F.coalesce("_e.tags", empty).alias("tags"),
        "_e.elements",
    )


def parse_wiki(lines: DataFrame, line: str = "line") -> DataFrame:
    """Entries of a dictionary dump; every field may be missing or null."""
    v = F.col("_v")
    sense_ok = lambda s: F.coalesce(
        F.schema_of_variant(s).startswith("OBJECT")
        & _strings(s, "$.categories", nullable=True)
        & _strings(s, "$.tags", nullable=True)
        & _strings(s, "$.glosses", nullable=True),
        F.lit(False),
    )
    senses = F.try_variant_get(v, "$.senses", "array<variant>")
    kind = _kind(v, "$.senses")
    senses_ok = kind.isNull() | (kind == "VOID") | F.coalesce(F.forall(senses, sense_ok), F.lit(False))
    parsed = (
        _parsed(lines, line, WIKI_SCHEMA)
        .where(
            F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
            & _text_or_nothing(v, "$.word")
            & _text_or_nothing(v, "$.pos")
            & _text_or_nothing(v, "$.lang_code")
            & _strings(v, "$.categories", nullable=True)
            & senses_ok
        )
    )
    rest = [c for c in lines.columns if c != line]
    return parsed.select(*rest, "_e.*")


def parse_corrections(lines: DataFrame, order: list[str], line: str = "line") -> DataFrame:
    """(id, categories): the last good line of each id, by the columns of ``order``."""
    v = F.col("_v")
    good = (
        _parsed(lines.where(text.unicode_trim(F.col(line)) != ""), line, CORRECTION_SCHEMA)
        .where(_u32(v, "$.id") & _strings(v, "$.categories", required=True))
    )
    return good.groupBy(F.col("_e.id").alias("id")).agg(F.max_by("_e.categories", F.struct(*order)).alias("categories"))


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON object per row in column order, nulls written."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_lexicon(entries: DataFrame, path: str) -> None:
    """Overwrite a folder of lexicon lines."""
    columns = ["id", "phrase", "categories", "pos", "definition", "tags", "elements"]
    to_json_lines(entries.select(*columns)).write.mode("overwrite").text(path)


def append_corrections(rows: DataFrame, path: str) -> None:
    """Append (id, categories) lines; a row is written even where nothing changed, which marks it as done."""
    to_json_lines(rows.select("id", "categories")).write.mode("append").text(path)
