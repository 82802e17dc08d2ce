"""Texts cut off by field limits or mid-transfer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phraseloom.plans.lineage import cut_lineage

#: White space of any kind and what has no width: no text ends in it.
_BLANK = "".join(map(chr, (*range(0x9, 0xE), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(_BLANK))

#: Characters of a text's end that are kept to learn marks of omission from.
TAIL = 12


@dataclass(frozen=True)
class Zone:
    """One kind of limit: texts at a limit ``L`` have lengths from ``L - under`` to ``L + over`` in ``measure``.

    How many texts to expect at ``L`` is told by the ``below`` lengths under
    and the ``above`` lengths over the zone, beyond ``gap`` more on either side.
    """

    name: str
    measure: str
    under: int
    over: int
    gap: int
    below: int
    above: int


#: A limit in characters cuts there, or one short where a blank was trimmed;
#: one in bytes cuts at the end of a character, or leaves a mark for a broken
#: one; one that keeps words whole cuts at the end of the last that fits.
ZONES = (
    Zone("exact", "chars", 1, 0, 0, 12, 12),
    Zone("bytes", "bytes", 3, 2, 3, 12, 12),
    Zone("words", "chars", 15, 0, 0, 48, 16),
)


@dataclass(frozen=True)
class Spike:
    """When a length counts as a limit: at least ``least`` texts, ``times`` as many as its neighbourhood
    leads to expect, and so much more that Poisson's law gives it less than exp(-``deviance``), or exp(-``top_deviance``)
    at the top, where no more than the share ``beyond`` of the source's texts is longer: elsewhere many more lengths are
    tested.  Where words are kept whole the share ``edge`` of them lies within four lengths of the limit, as few words
    are longer, and at most the share ``past`` of that number within the next four."""

    least: int = 3
    times: float = 3.0
    deviance: float = 20.0
    top_deviance: float = 6.0
    beyond: float = 0.02
    edge: float = 0.4
    past: float = 0.25


def ending_columns(text: Column) -> dict[str, Column]:
    """What the end of a text says, on its last line without trailing blanks."""
    end = _trimmed(text)
    last = F.substring_index(end, "\n", -1)
    closers = "[\"'”’»«)\\]}*_]*"
    marker = last.rlike("(\\[\\s*(\\.\\.\\.|…)\\s*\\]|\\x{FFFD})$")
    dots = last.rlike("…" + closers + "$")
    sentence = last.rlike("[.!?。！？؟।]" + closers + "$") & ~last.rlike("(^|\\s)\\d+\\.$") & ~last.rlike("https?://[^/\\s]*\\.$")
    bracket = last.rlike("[)\\]}>”»]$")
    picture = last.rlike("([\\p{So}\\p{Sk}\\x{FE0F}\\x{200D}]|\\s([:;=]['-]?[()DPpO3]|<3|\\^_?\\^))$")
    signed = last.rlike("^[—–-]{1,2} ?\\p{Lu}[\\p{L}'’.-]*( \\p{Lu}[\\p{L}'’.-]*)+$")
    tags = last.rlike("^(#[\\p{L}\\p{N}_]+\\s*)+$")
    rule = last.rlike("^\\s*([*#~=_–—-]\\s*){3,}$")
    source = last.rlike("https?://\\S+/\\d+$")
    # a heading: one line without sentence marks that begins with a capital (where there are capitals), as all its longer words do
    title = end.rlike("^[^\\n.!?。！？…:\\[\\]、]+$") & end.rlike("^[\\p{Lu}\\p{Lo}\\p{N}\"'“‘«]") & ~end.rlike("(?U)(^|\\s)\\p{Ll}[\\p{L}'’-]{4,}")
    nothing = end == ""
    tag = F.regexp_extract(text, "^\\s*<([A-Za-z][A-Za-z0-9]*)[^<>]*>", 1)
    open_tag = (tag != "") & ~F.endswith(end, F.concat(F.lit("</"), tag, F.lit(">")))
    ended = sentence | (bracket & ~marker) | picture | signed | tags | rule | source | nothing
    return {"marker": marker, "dots": dots, "ended": ended & ~open_tag, "titled": title & ~open_tag}


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, chars, bytes, hash, tail, and what the end says) for every row; narrow, so texts are not shuffled."""
    text = F.col(text_col)
    end = F.right(_trimmed(text), F.lit(3 * TAIL))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        F.coalesce(_trimmed(text) != "", F.lit(False)).alias("_filled"),
        F.length(text).alias("_chars"),
        F.octet_length(text).alias("_bytes"),
        F.xxhash64(text).alias("_hash"),
        F.right(F.regexp_replace(end, "\\p{Nd}+", "0"), F.lit(TAIL)).alias("_tail"),  # numbers in a mark of omission differ
        *[m.alias("_" + name) for name, m in ending_columns(text).items()],
    )


def histogram(rows: DataFrame) -> DataFrame:
    """(_source, measure, length, n): one aggregation with partial sums for all sources and both measures."""
    lengths = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_{m}").alias("length")) for m in ("chars", "bytes")])
    return rows.where("_filled").select("_source", F.explode(lengths).alias("_l")).groupBy("_source", "_l.measure", "_l.length").agg(F.count("*").alias("n"))


def _deviance(n: Column, expected: Column) -> Column:
    """Minus the exponent of a bound on the chance that a count of mean ``expected`` reaches ``n``."""
    return n * F.log(n / expected) - (n - expected)


def limits(rows: DataFrame, test: Spike = Spike()) -> DataFrame:
    """(_source, _limits): the zones of lengths at which a source's texts were cut, array<struct<name, lo, hi, top>>.

    Every length of a source is tested against its own neighbourhood, on both
    sides, by a count test, so a source may have several limits, and longer
    texts (late, unlimited or wrongly sourced ones) hide none.  A limit that
    keeps words whole has no single length: there the lengths of one word are
    counted together, and must break off at the limit.
    """
    at = Window.partitionBy("_source", "measure").orderBy("length")
    around = lambda lo, hi: F.coalesce(F.sum("n").over(at.rangeBetween(lo, hi)), F.lit(0))
    all_of = F.sum("n").over(Window.partitionBy("_source", "measure"))
    counted = histogram(rows).withColumns({"_all": all_of, "_edge": around(-3, 0), "_past": around(1, 4)})
    hits = []
    for z in ZONES:
        own, width, least = (around(-z.under, 0), z.under + 1, 0.5) if z.name == "words" else (F.col("n"), 1, 0.5 / z.below)
        start = z.under + z.gap
        there = F.greatest(F.least(F.col("length") - start, F.lit(z.below)), F.lit(1))  # no text is shorter than 0
        under = around(-start - z.below, -start - 1) / there
        over = around(z.over + z.gap + 1, z.over + z.gap + z.above) / z.above
        upto = around(Window.unboundedPreceding, z.over)
        counted = counted.withColumns({f"_own_{z.name}": own, f"_expected_{z.name}": F.greatest(under, over) * width + least, f"_upto_{z.name}": upto})
        n, expected = F.col(f"_own_{z.name}"), F.col(f"_expected_{z.name}")
        top = F.col("_all") - F.col(f"_upto_{z.name}") <= F.lit(test.beyond) * F.col("_all")
        hit = (F.col("measure") == z.measure) & (n >= test.least) & (n >= test.times * expected)
        hit = hit & (_deviance(n, expected) >= F.when(top, test.top_deviance).otherwise(test.deviance))
        if z.name == "words":
            hit = hit & (F.col("_edge") >= F.lit(test.edge) * n) & (F.col("_past") <= F.lit(test.past) * F.col("_edge"))
        hits.append(F.when(hit, F.struct(F.lit(z.name).alias("name"), (F.col("length") - z.under).alias("lo"), (F.col("length") + z.over).alias("hi"), top.alias("top"))))
    found = counted.select("_source", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())).alias("_h"))
    return found.groupBy("_source").agg(F.collect_list("_h").alias("_limits"))


def _inside(top: bool, *names: str) -> Column:
    """Whether a row's length lies in a zone of these kinds, at the top of its source only if so asked."""
    within = lambda z: F.when(z["name"] == "bytes", F.col("_bytes")).otherwise(F.col("_chars")).between(z["lo"], z["hi"])
    return F.coalesce(F.exists("_limits", lambda z: z["name"].isin(*names) & within(z) & (z["top"] | F.lit(not top))), F.lit(False))


def _with_source(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Join facts of sources (one row each); a null source is a source."""
    return rows.join(facts.withColumnRenamed("_source", "_fact_source"), F.col("_source").eqNullSafe(F.col("_fact_source")), "left").drop("_fact_source")


def marks(rows: DataFrame, least: int = 4, share: float = 0.3, times: float = 4.0, longest: int = 8) -> DataFrame:
    """(_source, _marks): endings that stand for what was cut, learned from rows with ``_zoned``.

    An ending of up to ``longest`` characters is a mark if at least ``least``
    texts and the given share of a source's texts at its limits have it, and
    that share is ``times`` as large as among the source's other texts.  Copies
    of one text at a limit count once.  Of endings that the same texts have
    only the longest counts.  Candidates are
    counted among the texts at limits only, so at most ``longest / share`` of
    them per source are then looked for among the rest.
    """
    filled = rows.where("_filled")
    zoned, rest = filled.where("_zoned").select("_source", "_hash", "_tail").distinct(), filled.where("not _zoned")
    # the ending of no characters is every text's, so its count is the number of texts
    endings = zoned.select("_source", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(longest)), lambda k: F.right("_tail", k)))).alias("ending"))
    counts = endings.groupBy("_source", "ending").agg(F.count("*").alias("n")).withColumn("_in", F.max("n").over(Window.partitionBy("_source")))
    often = counts.where((F.col("ending") != "") & (F.col("n") >= least) & (F.col("n") >= F.lit(share) * F.col("_in")))
    candidates = often.groupBy("_source", "_in").agg(F.collect_list(F.struct("ending", "n")).alias("_c"))
    found = F.transform(F.filter("_c", lambda c: F.endswith("_tail", c["ending"])), lambda c: c["ending"])
    elsewhere = (
        rest.select("_source", "_tail")
        .join(candidates.select(F.col("_source").alias("_fact_source"), "_c"), F.col("_source").eqNullSafe(F.col("_fact_source")))
        .select("_source", F.explode(F.concat(F.array(F.lit("")), found)).alias("ending"))
        .groupBy("_source", "ending")
        .agg(F.count("*").alias("n"))
        .groupBy("_source")
        .agg(F.map_from_entries(F.collect_list(F.struct("ending", "n"))).alias("_elsewhere"))
    )
    both = _with_source(candidates, elsewhere)
    others = lambda ending: F.coalesce(F.try_element_at("_elsewhere", ending), F.lit(0))
    stands_out = lambda c: c["n"] / F.col("_in") >= F.lit(times) * (others(c["ending"]) + 1) / (others(F.lit("")) + 2)
    good = F.filter("_c", stands_out)
    longer = lambda c: F.exists(good, lambda d: (F.length(d["ending"]) > F.length(c["ending"])) & F.endswith(d["ending"], c["ending"]) & (d["n"] >= F.lit(0.9) * c["n"]))
    return both.select("_source", F.transform(F.filter(good, lambda c: ~longer(c)), lambda c: c["ending"]).alias("_marks"))


def truncated(docs: DataFrame, id_col: str, text_col: str, source_col: str, test: Spike = Spike()) -> DataFrame:
    """(id, source, filled, cut): every row with whether its text was cut, and how.

    ``cut`` is ``limit`` for a text whose length (in characters or bytes) lies
    in a spike of its source's length histogram (see ``limits``) and that ends
    in no terminal punctuation or closing of its kind, or in a mark of
    omission; that it looks like a title does not count where the spike is the
    source's topmost.  ``transfer`` is for any other text that ends within a
    word, a sentence or an open tag; else null.  Marks of omission are the usual ones anywhere and, at its
    limits, those learned for each source (see ``marks``).  Null, empty and
    blank texts are never cut (``filled`` is false).  A null source is a
    source of its own; one or two texts are no spike.

    Texts are reduced to lengths and marks in the one scan, whose narrow rows
    are checkpointed; what is shuffled then is the histogram, where a source
    with a third of all rows is summed up in each task first.  Its spikes, one
    row per source, join back with a broadcast or, where there are too many
    sources, a sort-merge join that adaptive execution splits.
    """
    rows = cut_lineage(measured(docs, id_col, text_col, source_col))
    rows = _with_source(rows, cut_lineage(limits(rows, test)))
    every = [z.name for z in ZONES]
    rows = rows.withColumns({"_zoned": _inside(False, *every), "_topmost": _inside(True, *every), "_cut_there": _inside(True, "exact", "bytes")}).drop("_limits")
    rows = _with_source(rows, marks(rows))
    learned = F.coalesce(F.exists("_marks", lambda m: F.endswith("_tail", m)), F.lit(False))
    open_end = ~(F.col("_ended") | F.col("_dots")) & (F.col("_topmost") | ~F.col("_titled"))
    cut = (
        F.when(~F.col("_filled"), F.lit(None))
        .when(F.col("_zoned") & (learned | F.col("_marker") | open_end | (F.col("_cut_there") & F.col("_dots"))), "limit")
        .when(F.col("_marker") | open_end, "transfer")
    )
    return rows.select(F.col("_id").alias(id_col), F.col("_source").alias(source_col), F.col("_filled").alias("filled"), cut.alias("cut"))


def by_source(found: DataFrame, source_col: str) -> DataFrame:
    """(source, texts, limit_cuts, transfer_cuts, share) for each source with a text."""
    return (
        found.where("filled")
        .groupBy(source_col)
        .agg(
            F.count("*").alias("texts"),
            F.count_if(F.col("cut") == "limit").alias("limit_cuts"),
            F.count_if(F.col("cut") == "transfer").alias("transfer_cuts"),
        )
        .withColumn("share", (F.col("limit_cuts") + F.col("transfer_cuts")) / F.col("texts"))
    )
