"""Events of a parsing request: result and progress per sentence, then done, or an error that ends it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _event(seq: Column, event: str, data: Column) -> Column:
    return F.struct(seq.cast("int").alias("seq"), F.lit(event).alias("event"), data.alias("data"))


def request_events(requests: DataFrame, key: str = "request_id", results: str = "results") -> DataFrame:
    """(key, seq, event, data) of each request.

    ``results`` is array<struct<result:string, error:string>> in sentence
    order, ``result`` being JSON.  Up to the first error there is a ``result``
    and a ``progress`` event for each sentence; the error is one event
    ``sentence i: message`` and the last.  Without an error ``done`` holds all
    results.  A null or empty request has only ``done`` with an empty list.
    Events are made within the request's row; nothing is shuffled.
    """
    items = F.coalesce(F.col(results), F.array().cast(requests.schema[results].dataType))
    rows = requests.select(key, items.alias("_items"))
    total = F.size("_items")
    failed = F.array_position(F.transform("_items", lambda x: x["error"].isNotNull()), True).cast("int")
    rows = rows.withColumn("_ok", F.when(failed > 0, failed - 1).otherwise(total))

    def pair(x: Column, i: Column) -> Column:
        done = i + 1
        result = F.concat(F.lit('{"index":'), i, F.lit(',"result":'), x["result"], F.lit("}"))
        percent = F.floor(done * 100 / F.size("_items"))
        progress = F.concat(F.lit('{"done":'), done, F.lit(',"total":'), F.size("_items"), F.lit(',"percent":'), percent, F.lit("}"))
        return F.array(_event(i * 2, "result", result), _event(i * 2 + 1, "progress", progress))

    steps = F.flatten(F.transform(F.slice("_items", 1, F.col("_ok")), pair))
    every = F.concat(F.lit('{"results":['), F.array_join(F.transform("_items", lambda x: x["result"]), ","), F.lit("]}"))
    error = F.concat(F.lit("sentence "), F.col("_ok"), F.lit(": "), F.get("_items", F.col("_ok"))["error"])
    last = F.when(F.col("_ok") == total, _event(total * 2, "done", every)).otherwise(_event(F.col("_ok") * 2, "error", error))
    return rows.select(key, F.explode(F.concat(steps, F.array(last))).alias("_e")).select(key, "_e.*")


def request_sentences(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, sent_index, sentence): the sentences of each request, 0-based; empty requests have none."""
    return requests.select(key, F.posexplode("sentences").alias("sent_index", "sentence"))


def gather(sentences: DataFrame, key: str, index: str, result: str, error: str) -> DataFrame:
    """Results of each request in sentence order, as ``request_events`` reads them."""
    cells = F.struct(index, F.struct(F.col(result).alias("result"), F.col(error).alias("error")).alias("r"))
    return sentences.groupBy(key).agg(F.array_sort(F.collect_list(cells)).alias("_l")).select(key, F.transform("_l", lambda x: x["r"]).alias("results"))


def start(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Stream of requests to a folder of events.

    ``answer`` maps a batch of requests to rows with ``request_id`` and
    ``results``.  Each micro-batch writes a folder of its own, named by its
    number, so a batch that is tried again after a failure overwrites its own
    events and none is written twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        request_events(answer(batch)).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
