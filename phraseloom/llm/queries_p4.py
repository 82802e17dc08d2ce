"""Queries of problem 4."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.llm import lookalikes
from phraseloom.sources.tables import table


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, text) of every sentence; a request delivered twice counts once."""
    requests = table(spark, sf_dir, "parse_requests").groupBy("req_no").agg(F.min_by("sentences", "loaded_at").alias("sentences"))
    rows = requests.select("req_no", F.posexplode("sentences").alias("pos", "text"))
    return rows.select((F.col("req_no") * 1000 + F.col("pos")).alias("key"), "text").where("text is not null")


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lexicon_rows").select(F.col("rec_id").alias("key"), F.col("phrase").alias("text")).where("text is not null")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(in_field, key, text) of both fields."""
    both = [("phrase", phrases(spark, sf_dir)), ("sentences", sentences(spark, sf_dir))]
    named = [rows.select(F.lit(name).alias("in_field"), "key", "text") for name, rows in both]
    return named[0].unionByName(named[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalikes.look_alike_pairs(texts(spark, sf_dir), "key", "text", by=["in_field"])


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that looks like another, its class and its number of links."""
    return lookalikes.look_alike_classes(texts(spark, sf_dir), "key", "text", by=["in_field"])


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its consistent form."""
    return lookalikes.with_form(texts(spark, sf_dir), "text")


_q = lambda x: x.replace("'", "''")


def _translate(pairs: list[tuple[str, str]], dropped: str = "") -> str:
    """Two strings of equal places for SQL's translate; characters without width stand at the end of the first."""
    return f"'{_q(''.join(a for a, _ in pairs) + dropped)}', '{_q(''.join(b for _, b in pairs))}'"


def _wide() -> str:
    pairs = [(chr(0xFF00 + c - 0x20), chr(c)) for c in range(0x21, 0x7F)] + [(h, "-") for h in lookalikes.HYPHENS]
    pairs += [(chr(c), " ") for c in (0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)]
    return _translate(pairs, "".join(chr(c) for a, b in lookalikes.NO_WIDTH for c in range(a, b + 1)))


_composed = lambda c: unicodedata.normalize("NFC", c)
_parts = lambda c: unicodedata.normalize("NFD", c)


def _letters(script: str) -> list[str]:
    """Letters of a script, composed ones included, that no other script has."""
    ranges = lookalikes.SCRIPTS.get(script, ((0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF)))
    return [chr(c) for a, b in ranges for c in range(a, b + 1) if chr(c).isalpha() and lookalikes._patterns()[script].match(_parts(chr(c))[0])]


def _into(script: str) -> str:
    """Arguments of translate that write shared shapes, also under an accent, in one script."""
    table = lookalikes.to_script()[script]
    pairs = []
    for c in map(chr, range(0x41, 0x1FFF)):
        to = _composed(_parts(c).translate(table))
        if to != c and len(to) == 1 and c.isalpha():
            pairs.append((c, to))
    return _translate(pairs)


def _target(x: str) -> str:
    """SQL of the script of most letters of its own in ``x``, null if there are none."""
    counts = {s: f"length(regexp_replace({x}, '[^{''.join(_letters(s))}]', '', 'g'))" for s in ("latin", *lookalikes.SCRIPTS)}
    most = f"greatest({', '.join(counts.values())})"
    return f"CASE WHEN {most} = 0 THEN NULL " + " ".join(f"WHEN {n} = {most} THEN '{s}'" for s, n in counts.items()) + " END"


def _by_script() -> str:
    """SQL of ``text`` (words and what is between them in ``parts``, the whole text's script in ``whole``)."""
    into = {s: _into(s) for s in ("latin", *lookalikes.SCRIPTS)}
    everyday = " ".join(f"WHEN '{s}' THEN regexp_full_match(regexp_replace(translate(w, {into['latin']}), '\\P{{L}}', '', 'g'), '[{letters}]*')" for s, letters in lookalikes.EVERYDAY.items())
    script = f"coalesce({_target('w')}, CASE WHEN CASE whole {everyday} ELSE false END THEN whole ELSE 'latin' END)"
    done = " ".join(f"WHEN '{s}' THEN translate(w, {args})" for s, args in into.items())
    return f"CASE WHEN foreign_letters THEN nfc_normalize(array_to_string(list_transform(parts, lambda w: CASE {script} {done} END), '')) ELSE plain END"


_SKELETON = _translate([tuple(pair.split(":")) for pair in lookalikes.LOOK_ALIKES.split()])
_TEXTS = f"""
WITH t AS (
  SELECT 'phrase' AS in_field, rec_id AS key, phrase AS text FROM lexicon_rows WHERE phrase IS NOT NULL
  UNION ALL SELECT 'sentences', req_no * 1000 + i, s FROM (SELECT req_no, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS s
    FROM (SELECT req_no, arg_min(sentences, loaded_at) AS a FROM parse_requests GROUP BY req_no)) WHERE s IS NOT NULL),
p AS (SELECT *, nfc_normalize(translate(text, {_wide()})) AS plain FROM t),
f AS (SELECT *, nfc_normalize(translate(plain, {_SKELETON})) AS skeleton FROM p)
"""
P4_SQL = _TEXTS + """SELECT a.in_field, a.key AS key_a, b.key AS key_b FROM f a JOIN f b ON a.in_field = b.in_field AND a.skeleton = b.skeleton AND a.key < b.key AND a.text <> b.text
WHERE trim(a.skeleton) <> ''"""
P4_CLASSES_SQL = _TEXTS + """, n AS (SELECT *, count(*) OVER s AS everyone, count(*) OVER (PARTITION BY in_field, skeleton, text) AS own, min(key) OVER s AS class_id FROM f WHERE trim(skeleton) <> ''
  WINDOW s AS (PARTITION BY in_field, skeleton))
SELECT in_field, key, class_id, everyone - own AS links FROM n WHERE everyone > own"""
_FOREIGN = "".join(f"{chr(a)}-{chr(b)}" for r in lookalikes.SCRIPTS.values() for a, b in r)
P4_CANONICAL_SQL = (
    _TEXTS
    + f""", w AS (SELECT *, regexp_matches(plain, '[{_FOREIGN}ɡɑ]') AS foreign_letters,
  regexp_extract_all(plain, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+') AS parts, coalesce({_target('plain')}, 'latin') AS whole FROM f)
SELECT in_field, key, text, {_by_script()} AS form FROM w"""
)
