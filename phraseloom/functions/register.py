"""The functions under names of their own in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from phraseloom import constants as C
from phraseloom.functions import decode, hashing, text


def _q(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _words(words) -> str:
    return ", ".join(_q(w) for w in words)


def _map(table: dict[str, str]) -> str:
    return f"str_to_map({_q(','.join(f'{k}:{v}' for k, v in table.items()))}, ',', ':')"


def _definitions() -> dict[str, str]:
    """Name and signature -> body, each usable by those after it.  All are SQL functions: the optimizer sees through them."""
    tail = text._TAIL
    letters = "rlike(t, '^\\\\p{IsAlphabetic}+$')"
    bare = f"btrim(lower(word), {_q(C.STRIP_CHARS)})"
    cut = lambda k: f"left(t, length(t) - {k})"
    stem = f"IF(contains(token, '\\'') OR contains(token, '’'), regexp_extract(token, {_q(f'(?ius)^(.+?)({tail}*)$')}, 1), token)"
    clitics = f"regexp_extract_all(substring(token, length(s) + 1), {_q(f'(?iu){tail}')}, 0)"
    split = f"flatten(transform(array({stem}), s -> concat(IF(lower(s) = 'cannot', array(substring(s, 1, 3), substring(s, 4, 3)), array(s)), {clitics})))"
    return {
        "ml_split_contraction(token STRING) RETURNS ARRAY<STRING>": split,
        "ml_tokenize(txt STRING) RETURNS ARRAY<STRING>": f"flatten(transform(regexp_extract_all(txt, {_q(text.TOKEN_PATTERN)}, 0), token -> {split}))",
        "ml_lemma(word STRING, is_verb BOOLEAN DEFAULT false) RETURNS STRING": f"""
            get(transform(transform(array({bare}), t -> IF(endswith(t, "'s") OR endswith(t, '’s'), {cut(2)}, t)), t -> CASE
              WHEN is_verb AND t IN ({_words(C.IRREGULAR_VERBS)}) THEN element_at({_map(C.IRREGULAR_VERBS)}, t)
              WHEN t IN ({_words(C.IRREGULAR)}) THEN element_at({_map(C.IRREGULAR)}, t)
              WHEN length(t) <= 3 OR NOT {letters} THEN t
              WHEN endswith(t, 'ies') AND length(t) > 4 THEN concat({cut(3)}, 'y')
              WHEN rlike(t, '(s|sh|ch|x|z)es$') THEN {cut(2)}
              WHEN endswith(t, 'ing') AND length(t) > 5 THEN {cut(3)}
              WHEN endswith(t, 'ied') AND length(t) > 4 THEN concat({cut(3)}, 'y')
              WHEN endswith(t, 'ed') AND length(t) > 4 THEN {cut(2)}
              WHEN endswith(t, 's') AND NOT endswith(t, 'ss') THEN {cut(1)} ELSE t END), 0)""",
        "ml_tokenize_lines(txt STRING) RETURNS TABLE (line_no INT, tokens ARRAY<STRING>)": "SELECT pos, ml_tokenize(line) FROM (SELECT posexplode(split(txt, '\\r?\\n')) AS (pos, line))",
    }


def register(spark: SparkSession) -> list[str]:
    """Register everything for SQL in this session; the names.

    ``ml_tokenize``, ``ml_split_contraction`` and ``ml_lemma`` are SQL
    functions, ``ml_tokenize_lines`` is a table function over the lines of a
    text; ``ml_arborescence`` and ``ml_phrase_id`` are Arrow UDFs.
    """
    names = []
    for signature, body in _definitions().items():
        names.append(signature.split("(")[0])
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    spark.udf.register("ml_arborescence", decode.heads_of)
    spark.udf.register("ml_phrase_id", hashing.phrase_id)
    return [*names, "ml_arborescence", "ml_phrase_id"]
