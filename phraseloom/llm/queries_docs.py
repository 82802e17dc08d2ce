"""Queries of problems 7, 8 and 9."""

from __future__ import annotations

import importlib.util
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phraseloom.llm import packing, tokenizers, truncation
from phraseloom.plans.lineage import cut_lineage
from phraseloom.sources.tables import table

#: File of each tokenizer that the tables name.
FILES = {"byte_bpe_50k": "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k": "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k": "piece_bpe_32k.model"}


def vocabulary_path(spark: SparkSession, name: str) -> str:
    """Path of a public tokenizer's file; the folder is spark.phraseloom.tokenizers, else where the files are installed."""
    folder = spark.conf.get("spark.phraseloom.tokenizers", None)
    if folder is None:
        spec = importlib.util.find_spec("public_tokenizers")
        folder = os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"
    return os.path.join(folder, FILES[name])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizers.encode(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary_path(spark, "byte_bpe_50k"))


def p7_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the raw bytes of each text's ids are the text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    path = vocabulary_path(spark, "byte_bpe_50k")
    back = tokenizers.decode(tokenizers.encode(docs, "doc_id", "text", path), "doc_id", "ids", path)
    return back.join(docs, "doc_id").select("doc_id", (F.col("bytes") == F.encode("text", "UTF-8")).alias("same"))


def p8_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pack_sizes does not grow: a row per kind of container
    kinds = table(spark, sf_dir, "pack_sizes").orderBy("pack_kind").collect()
    containers = [packing.Container(k["pack_kind"], vocabulary_path(spark, k["tokenizer"]), k["capacity"]) for k in kinds]
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", containers)


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each kind are, and what share of the texts' tokens came by retrieval or by size alone."""
    parts = p8_assign(spark, sf_dir).where("container is not null")
    tokens = lambda how: F.sum(F.when(F.col("placed") == how, F.col("n_tokens")).otherwise(0))
    each = parts.groupBy("pack_kind", "shard", "container").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("items"), tokens("neighbour").alias("near"), tokens("size").alias("sized"))
    sizes = table(spark, sf_dir, "pack_sizes").select("pack_kind", "capacity")
    return (
        each.groupBy("pack_kind")
        .agg(F.count("*").alias("containers"), *[F.sum(c).alias(c) for c in ("tokens", "items", "near", "sized")], F.max("tokens").alias("fullest"))
        .join(sizes, "pack_kind")
        .withColumns({"filled": F.col("tokens") / (F.col("containers") * F.col("capacity")), "by_retrieval": F.col("near") / F.col("tokens"), "by_size": F.col("sized") / F.col("tokens")})
        .drop("near", "sized")
    )


def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind's documents, those whose tokens are not all assigned once and in order, and containers above the capacity: the last two are 0."""
    kinds = table(spark, sf_dir, "pack_sizes").select("pack_kind", "tokenizer", "capacity")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = None
    for name in sorted(r.tokenizer for r in kinds.select("tokenizer").distinct().collect()):  # a few names
        one = tokenizers.token_sizes(docs, "doc_id", "text", vocabulary_path(spark, name)).withColumn("tokenizer", F.lit(name))
        sized = one if sized is None else sized.unionByName(one)
    assigned = cut_lineage(p8_assign(spark, sf_dir))
    by_doc = assigned.groupBy("pack_kind", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("end"), F.count("*").alias("parts"), F.max("part").alias("last"))
    checked = sized.join(F.broadcast(kinds), "tokenizer").join(by_doc, ["pack_kind", "doc_id"], "left")  # a row for each kind
    right = F.coalesce((F.col("n") == F.col("size")) & (F.col("end") == F.col("size")) & (F.col("parts") == F.col("last") + 1), F.lit(False))
    boxes = assigned.where("container is not null").groupBy("pack_kind", "shard", "container").agg(F.sum("n_tokens").alias("n")).join(F.broadcast(kinds), "pack_kind")
    over = boxes.groupBy("pack_kind").agg(F.count_if(F.col("n") > F.col("capacity")).alias("overfull"))
    return checked.groupBy("pack_kind").agg(F.count("*").alias("documents"), F.count_if(~right).alias("wrong")).join(over, "pack_kind")


def p9_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with whether and how its text was cut."""
    return truncation.truncated(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_cuts(spark, sf_dir).where("cut is not null").select("doc_id")


def p9_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of each source's texts was cut."""
    return truncation.by_source(p9_cuts(spark, sf_dir), "source")


_B = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}\x{1C}-\x{1F}]"
_CLOSE = "[\"''”’»«)\\]}*_]*"
_ENDED = f"""regexp_matches(last, '[.!?。！？؟।]{_CLOSE}$') AND NOT regexp_matches(last, '(^|\\s)\\d+\\.$') AND NOT regexp_matches(last, 'https?://[^/\\s]*\\.$')
  OR regexp_matches(last, '[)\\]}}>”»]$') AND NOT marker OR regexp_matches(last, '([\\p{{So}}\\p{{Sk}}\\x{{FE0F}}\\x{{200D}}]|\\s([:;=][''-]?[()DPpO3]|<3|\\^_?\\^))$')
  OR regexp_matches(last, '^[—–-]{{1,2}} ?\\p{{Lu}}[\\p{{L}}''’.-]*( \\p{{Lu}}[\\p{{L}}''’.-]*)+$') OR regexp_matches(last, '^(#[\\p{{L}}\\p{{N}}_]+\\s*)+$')
  OR regexp_matches(last, '^\\s*([*#~=_–—-]\\s*){{3,}}$') OR regexp_matches(last, 'https?://\\S+/\\d+$') OR e = ''"""
_TITLED = """regexp_matches(e, '^[^\\n.!?。！？…:\\[\\]、]+$') AND regexp_matches(e, '^[\\p{Lu}\\p{Lo}\\p{N}"''“‘«]') AND NOT regexp_matches(e, '(^|\\s)\\p{Ll}[\\p{L}''’-]{4,}')"""


def _around(lo: str, hi: str) -> str:
    return f"coalesce(sum(n) OVER (PARTITION BY source, measure ORDER BY length RANGE BETWEEN {lo} AND {hi}), 0)"


def _hits() -> str:
    """The three kinds of zones as rows, each length of a histogram tested against its neighbourhood."""
    test, found = truncation.Spike(), []
    for z in truncation.ZONES:
        words = z.name == "words"
        own, width, least = (_around(f"{z.under} PRECEDING", "CURRENT ROW"), z.under + 1, 0.5) if words else ("n", 1, 0.5 / z.below)
        start = z.under + z.gap
        under = f"{_around(f'{start + z.below} PRECEDING', f'{start + 1} PRECEDING')} / greatest(least(length - {start}, {z.below}), 1)"
        over = f"{_around(f'{z.over + z.gap + 1} FOLLOWING', f'{z.over + z.gap + z.above} FOLLOWING')} / {z.above}"
        rest = f"sum(n) OVER (PARTITION BY source, measure) - {_around('UNBOUNDED PRECEDING', f'{z.over} FOLLOWING')}"
        edge = f"AND edge >= {test.edge} * own AND past <= {test.past} * edge" if words else ""
        found.append(f"""SELECT source, measure, '{z.name}' AS name, length - {z.under} AS lo, length + {z.over} AS hi, top FROM (
  SELECT *, beyond <= {test.beyond} * total AS top FROM (SELECT source, measure, length, {own} AS own, greatest({under}, {over}) * {width} + {least} AS ex, {rest} AS beyond,
    sum(n) OVER (PARTITION BY source, measure) AS total, {_around('3 PRECEDING', 'CURRENT ROW')} AS edge, {_around('1 FOLLOWING', '4 FOLLOWING')} AS past FROM hist WHERE measure = '{z.measure}'))
  WHERE own >= {test.least} AND own >= {test.times} * ex AND own * ln(own / ex) - (own - ex) >= CASE WHEN top THEN {test.top_deviance} ELSE {test.deviance} END {edge}""")
    return "\nUNION ALL ".join(found)


_SAME = "IS NOT DISTINCT FROM"
_CUTS = f"""
WITH a AS (SELECT doc_id, source, text, coalesce(NOT regexp_full_match(text, '{_B}*'), false) AS filled, length(text) AS chars, strlen(text) AS bytes, regexp_replace(text, '{_B}+$', '') AS e FROM documents),
b AS (SELECT *, regexp_extract(e, '[^\n]*$') AS last, regexp_extract(text, '^\\s*<([A-Za-z][A-Za-z0-9]*)[^<>]*>', 1) AS tag, right(regexp_replace(right(e, {3 * truncation.TAIL}), '\\p{{Nd}}+', '0', 'g'), {truncation.TAIL}) AS tail FROM a),
c AS (SELECT *, regexp_matches(last, '(\\[\\s*(\\.\\.\\.|…)\\s*\\]|\\x{{FFFD}})$') AS marker, regexp_matches(last, '…{_CLOSE}$') AS dots, coalesce(tag <> '' AND NOT ends_with(e, '</' || tag || '>'), false) AS open FROM b),
d AS (SELECT *, ({_ENDED}) AND NOT open AS ended, {_TITLED} AND NOT open AS titled FROM c),
hist AS (SELECT source, measure, length, count(*) AS n
  FROM (SELECT source, 'chars' AS measure, chars AS length FROM d WHERE filled UNION ALL SELECT source, 'bytes', bytes FROM d WHERE filled) GROUP BY ALL),
zones AS ({_hits()}),
f AS (SELECT d.*, EXISTS (SELECT 1 FROM zones z WHERE z.source {_SAME} d.source AND CASE z.measure WHEN 'chars' THEN chars ELSE bytes END BETWEEN lo AND hi) AS zoned,
  EXISTS (SELECT 1 FROM zones z WHERE z.source {_SAME} d.source AND CASE z.measure WHEN 'chars' THEN chars ELSE bytes END BETWEEN lo AND hi AND top) AS topmost,
  EXISTS (SELECT 1 FROM zones z WHERE z.source {_SAME} d.source AND CASE z.measure WHEN 'chars' THEN chars ELSE bytes END BETWEEN lo AND hi AND top AND name <> 'words') AS there FROM d),
sizes AS (SELECT source, count(DISTINCT text) FILTER (WHERE zoned) AS inside, count(*) FILTER (WHERE NOT zoned) AS outside FROM f WHERE filled GROUP BY source),
m AS (SELECT source, ending, count(DISTINCT text) FILTER (WHERE zoned) AS n, count(*) FILTER (WHERE NOT zoned) AS others
  FROM (SELECT source, text, zoned, unnest(list_distinct(list_transform(range(1, 9), lambda k: right(tail, k)))) AS ending FROM f WHERE filled) WHERE ending <> '' GROUP BY ALL),
g AS (SELECT m.* FROM m JOIN sizes s ON m.source {_SAME} s.source WHERE n >= 4 AND n >= 0.3 * inside AND n / inside >= 4 * (others + 1) / (outside + 2)),
marks AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.source {_SAME} g.source AND length(h.ending) > length(g.ending) AND ends_with(h.ending, g.ending) AND h.n >= 0.9 * g.n)),
h AS (SELECT f.*, EXISTS (SELECT 1 FROM marks WHERE marks.source {_SAME} f.source AND ends_with(tail, ending)) AS learned, NOT (ended OR dots) AND (topmost OR NOT titled) AS unended FROM f),
cuts AS (SELECT doc_id, source, filled, CASE WHEN NOT filled THEN NULL WHEN zoned AND (learned OR marker OR unended OR (there AND dots)) THEN 'limit' WHEN marker OR unended THEN 'transfer' END AS cut FROM h)
"""
P9_CUTS_SQL = _CUTS + "SELECT * FROM cuts"
P9_SQL = _CUTS + "SELECT doc_id FROM cuts WHERE cut IS NOT NULL"
P9_SOURCES_SQL = _CUTS + """SELECT source, count(*) AS texts, count(*) FILTER (WHERE cut = 'limit') AS limit_cuts, count(*) FILTER (WHERE cut = 'transfer') AS transfer_cuts,
  count(cut) / count(*) AS share FROM cuts WHERE filled GROUP BY source"""
