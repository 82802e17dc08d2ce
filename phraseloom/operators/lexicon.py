"""The lexicon: loading order, index, corrections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phraseloom.functions import pattern
from phraseloom.plans.lineage import cut_lineage
from phraseloom.sources import jsonl


def with_entry_index(entries: DataFrame, order: list[str]) -> DataFrame:
    """Entries with two fixed words at least, numbered from 0 in ``order``: ``entry_idx``.

    The numbers break ties between matches, so they follow the loading order.
    """
    kept = entries.where(pattern.fixed_count(F.col("elements")) >= 2)
    return numbered(kept, order, "entry_idx")


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Row numbers from 0 in the given order (unique keys), without a single-task window.

    Rows are range-partitioned and sorted; a row's number is its place in its
    partition plus the sizes of the partitions before, one small row each.  The
    sorted rows are checkpointed, as both steps must see the same partitions.
    """
    at = F.monotonically_increasing_id()
    ranged = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.shiftright(at, 33), "_at": at.bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(offsets), "_part").select(*df.columns, (F.col("_before") + F.col("_at")).alias(name))


def load(spark: SparkSession, main: str, custom: str | None = None) -> DataFrame:
    """Main lexicon file, then the custom one if it exists; a missing main file is an error."""
    paths = [main]
    if custom is not None and exists(spark, custom):
        paths.append(custom)
    return with_entry_index(jsonl.parse_lexicon(jsonl.read_lines(spark, paths)), ["file_ord", "line_no"]).drop("file_ord", "line_no")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def union_in_order(parts: list[DataFrame]) -> DataFrame:
    """All entries with the number of their part, ``file_ord``."""
    return reduce(DataFrame.unionByName, [p.withColumn("file_ord", F.lit(i)) for i, p in enumerate(parts)])


def first_lemma_index(entries: DataFrame, block: int = 1 << 16) -> DataFrame:
    """(first_lemma, block, entries): the numbers of the entries that begin with a lemma, ascending.

    A row holds those of one block of ``block`` numbers, so the list of a lemma
    with which any share of the lexicon begins is bounded; blocks follow each
    other.
    """
    keyed = entries.select(pattern.first_fixed(F.col("elements")).alias("first_lemma"), F.floor(F.col("entry_idx") / block).alias("block"), "entry_idx")
    return keyed.groupBy("first_lemma", "block").agg(F.array_sort(F.collect_list("entry_idx")).alias("entries"))


def apply_corrections(entries: DataFrame, corrections: DataFrame) -> DataFrame:
    """Entries with the categories of ``corrections`` (unique ids) where their id is there; other ids are ignored."""
    fixes = corrections.select("id", F.col("categories").alias("_fixed"), F.lit(True).alias("_has"))
    joined = entries.join(fixes, "id", "left")
    return joined.withColumn("categories", F.when(F.col("_has"), F.col("_fixed")).otherwise(F.col("categories"))).select(*entries.columns)
