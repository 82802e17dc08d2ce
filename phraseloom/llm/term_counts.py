"""How often every term occurs and in how many records, by last-seen counters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Least number of parts into which the records of one term are spread.
SALTS = 32


class LastSeen:
    """Per term: occurrences, records, and the last record it was seen in.

    Fed with terms ordered by record, so a term is in a new record exactly
    when the record differs from the last one it was seen in; no set of
    records is kept.
    """

    def __init__(self):
        self.code: dict[str, int] = {}
        self.occurrences = np.zeros(1024, np.int64)
        self.records = np.zeros(1024, np.int64)
        self.last = np.zeros(1024, np.int64)
        self.seen = np.zeros(1024, bool)

    def add(self, terms: pa.Array, records: np.ndarray) -> None:
        packed = pc.dictionary_encode(terms)
        codes = self.code
        ids = np.array([codes.setdefault(t, len(codes)) for t in packed.dictionary.to_pylist()], np.int64)
        while len(codes) > len(self.seen):
            for name in ("occurrences", "records", "last", "seen"):
                old = getattr(self, name)
                setattr(self, name, np.concatenate((old, np.zeros_like(old))))
        term = ids[packed.indices.to_numpy()]
        order = np.argsort(term, kind="stable")  # stable: records stay ordered within a term
        term, record = term[order], records[order]
        first = np.append(True, term[1:] != term[:-1])
        changed = np.append(True, record[1:] != record[:-1]) & ~first
        heads = np.flatnonzero(first)
        known = term[heads]
        fresh = ~self.seen[known] | (self.last[known] != record[heads])
        tails = np.append(heads[1:], len(term)) - 1
        self.occurrences[known] += np.diff(np.append(heads, len(term)))
        self.records[known] += np.add.reduceat(changed.astype(np.int64), heads) + fresh
        self.last[known] = record[tails]
        self.seen[known] = True

    def batches(self, size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
        """All terms and their counters, in slices."""
        terms = iter(self.code)
        for at in range(0, len(self.code), size):
            names = list(islice(terms, size))
            end = at + len(names)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(self.occurrences[at:end]), pa.array(self.records[at:end])], ["term", "occurrences", "records"])


def term_counts(tokens: DataFrame, term: str, record: str) -> DataFrame:
    """(term, occurrences, records) for every distinct term.

    Tokens are hash-partitioned by term and a salt of their record, and sorted
    by record within each partition; a record has one salt, so the counts of a
    term's parts add up exactly while a term that a third of the tokens hold is
    spread over as many tasks as the shuffle has.  A partition keeps three numbers per distinct term.

    Null and empty terms are left out; a null record is no record (its tokens
    still occur); terms are compared exactly; an empty table gives no row.
    ``record`` must be an integer column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, loose = LastSeen(), LastSeen()
        for batch in batches:
            if not batch.num_rows:
                continue
            records = batch.column(1)
            if records.null_count:
                missing = batch.filter(records.is_null())
                loose.add(missing.column(0), np.zeros(missing.num_rows, np.int64))
                batch = batch.filter(records.is_valid())
                if not batch.num_rows:
                    continue
            counters.add(batch.column(0), batch.column(1).to_numpy())
        yield from counters.batches()
        for rest in loose.batches():
            yield rest.set_column(2, "records", pa.array(np.zeros(rest.num_rows, np.int64)))

    parts_of_a_term = max(SALTS, int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salt = F.pmod(F.xxhash64(F.lit(7), "_record"), F.lit(parts_of_a_term))
    spread = (
        tokens.select(F.col(term).alias("_term"), F.col(record).cast("bigint").alias("_record"))
        .where("_term is not null and _term <> ''")
        .repartition(F.col("_term"), salt)
        .sortWithinPartitions("_record")
    )
    parts = spread.mapInArrow(run, "term string, occurrences bigint, records bigint")
    return parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(counts: DataFrame, n_records: int, rare_records: int = 2, common_one_in: int = 20) -> DataFrame:
    """Add ``mark``: rare if at most ``rare_records`` records hold the term, else common if more than one in
    ``common_one_in`` of all records do, else null."""
    return counts.withColumn(
        "mark", F.when(F.col("records") <= rare_records, "rare").when(F.col("records") * common_one_in > F.lit(n_records), "common")
    )
