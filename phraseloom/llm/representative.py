"""Best representative of each duplicate group, chosen field by field."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for "nothing", after trimming and lower case.
FILLERS = ("-", "--", "–", "—", "?", "??", ".", "...", "…", "n/a", "na", "n.a.", "none", "null", "nil", "tbd", "tba", "todo", "unknown", "undefined", "xxx")

#: Half-lives summed before the sum is put on a logarithmic scale.
_BAND = 64.0

#: Half-life of votes where none is given.
_HALF_LIFE_HOURS = 1.0


def headword_key(word: Column) -> Column:
    """Letter case, blanks and the shape of the apostrophe set aside."""
    same = F.regexp_replace(word, "[\\u2018\\u2019\\u02BC\\u201B\\uFF07\\u0060\\u00B4]", "'")
    return F.lower(F.trim(F.regexp_replace(same, "(?U)[\\s\\u00A0]+", " ")))


def _text_of(value: Column, is_array: bool) -> Column:
    """One string per value with what does not matter set aside; null where nothing is left."""
    clean = lambda c: F.lower(F.trim(F.regexp_replace(c, "(?U)[\\s\\u00A0]+", " ")))
    real = lambda c: c.isNotNull() & (c != "") & ~c.isin(*FILLERS)
    if is_array:
        members = F.array_sort(F.array_distinct(F.filter(F.transform(value, clean), real)))
        return F.when(F.size(members) > 0, F.array_join(members, "\u0001"))
    text = F.regexp_replace(clean(value), "[.;,\\s]+$", "")
    return F.when(real(clean(value)) & (text != ""), text)


def reduced(rows: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """``rows`` with 128 bits of each field's normalised value and its size, ``_v_<field>``, in place of the field.

    Null where the value is no value.  Votes need no more than whether two
    values are the same, so texts and lists are not shuffled.
    """

    def short(name: str, kind: str) -> Column:
        is_array = kind.startswith("array")
        norm = _text_of(F.col(name), is_array)
        size = F.length(F.array_join(F.col(name), " ") if is_array else F.col(name))
        cells = F.transform(F.filter(F.array(norm), lambda n: n.isNotNull()), lambda n: F.struct(F.xxhash64(n).alias("a"), F.xxhash64(F.lit(1), n).alias("b"), size.alias("size")))
        return F.get(cells, 0)

    return rows.withColumns({f"_v_{name}": short(name, kind) for name, kind in fields.items()}).drop(*fields)


def vote_long(rows: DataFrame, group: Sequence[str], row_id: str, fields: Mapping[str, str], trust: str, time: str, half_life_hours: float) -> DataFrame:
    """Unpivot ``reduced`` rows: (group, row_id, in_field, _a, _b, _size, _trust, _seconds, _lives) for each usable value."""
    parts = F.array(*[F.struct(F.lit(name).alias("in_field"), F.col(f"_v_{name}").alias("v")) for name in fields])
    # A null time is older than every other: 400 years before the epoch.
    seconds = F.coalesce(F.unix_micros(F.col(time)) / F.lit(1e6), F.lit(-1.26e10))
    long = rows.select(
        *group, row_id, F.coalesce(F.col(trust), F.lit(0)).cast("double").alias("_trust"), seconds.alias("_seconds"), F.explode(F.filter(parts, lambda p: p["v"].isNotNull())).alias("_f")
    )
    values = {"_a": "_f.v.a", "_b": "_f.v.b", "_size": "_f.v.size"}
    return long.select(
        *group, row_id, "_trust", "_seconds", "_f.in_field", *[F.col(v).alias(k) for k, v in values.items()], (F.col("_seconds") / F.lit(3600.0 * half_life_hours)).alias("_lives")
    )


def winners(
    rows: DataFrame,
    group: Sequence[str],
    row_id: str,
    fields: Mapping[str, str],
    trust: str,
    time: str,
    half_life_hours: float | None = None,
) -> DataFrame:
    """The winning value of each group and field: (group, in_field, best_id).  ``rows`` may be ``reduced`` already.

    A value's votes are the sum over its rows of (1 + trust) * 2 ** (-age /
    half-life).  The sums are kept as logarithms: rows are added up within
    bands of 64 half-lives, then the bands of a value are joined by
    log-sum-exp, so an age of any number of half-lives counts and nothing
    underflows.  Without a half-life the value of the most recent row wins,
    however many votes others have, and votes (with a half-life of an hour)
    decide only between values whose most recent rows have the same time; with
    one, votes decide alone.  The row that stands for a value is its most
    recent; ties go to more trust, more text, the smaller id (a number).

    Every step is a hash aggregation with partial sums, so a group that holds
    a third of all rows is combined before it is shuffled; nothing is
    collected but the band sums of one value, at most one for each 64
    half-lives between its first and last row.

    Nulls: a null, empty, blank or filler value has no vote; null trust counts
    0, a null time is the oldest; a group or field without any value is not in
    the result.  Repeated rows only add votes.
    """
    if any(f"_v_{name}" not in rows.columns for name in fields):
        rows = reduced(rows, fields)
    keys = [*group, "in_field", "_a", "_b"]
    long = vote_long(rows, group, row_id, fields, trust, time, _HALF_LIFE_HOURS if half_life_hours is None else half_life_hours)
    rank = F.struct("_seconds", "_trust", "_size", (-F.col(row_id)).alias("_id"))
    by_band = (
        long.withColumn("_band", F.floor(F.col("_lives") / F.lit(_BAND)))
        .groupBy(*keys, "_band")
        .agg(F.sum((1 + F.col("_trust")) * F.pow(F.lit(2.0), F.col("_lives") - F.col("_band") * _BAND)).alias("_sum"), F.max(rank).alias("_rank"))
    )
    by_value = by_band.groupBy(*keys).agg(F.collect_list(F.col("_band") * _BAND + F.log2("_sum")).alias("_logs"), F.max("_rank").alias("_rank"))
    top = F.array_max("_logs")
    votes = top + F.log2(F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.pow(F.lit(2.0), x - top)))
    # no sum of votes is sure to stay below those of the newest row, so its time is compared first
    order = [F.col("_votes"), F.col("_rank")] if half_life_hours is not None else [F.col("_rank._seconds").alias("_newest"), F.col("_votes"), F.col("_rank")]
    best = by_value.withColumn("_votes", votes).groupBy(*group, "in_field").agg(F.max_by("_rank", F.struct(*order)).alias("_best"))
    return best.select(*group, "in_field", (-F.col("_best._id")).alias("best_id"))


def survivors(rows: DataFrame, best: DataFrame, group: Sequence[str], row_id: str, fields: Mapping[str, str]) -> DataFrame:
    """Pivot back: one record per group with the winning value of each field, null where no row has one.

    ``rows`` must hold each ``row_id`` once; their groups are not read.  The
    join is on unique ids, so no key is hot; the pivot aggregates at most one
    row per field.
    """
    values = rows.select(F.col(row_id).alias("best_id"), *[F.col(n).alias(f"_v_{n}") for n in fields])
    joined = best.join(values, "best_id")
    return joined.groupBy(*group).agg(
        *[F.max_by(F.when(F.col("in_field") == n, F.col(f"_v_{n}")), F.when(F.col("in_field") == n, F.lit(1))).alias(n) for n in fields],
        *[F.max(F.when(F.col("in_field") == n, F.col("best_id"))).alias(f"{n}_from") for n in fields],
    )
