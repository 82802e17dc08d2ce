"""Reclassifying idioms: batches, prompts, labels, rewritten categories."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phraseloom import constants as C
from phraseloom.operators.lexicon import exists, numbered
from phraseloom.plans.lineage import cut_lineage
from phraseloom.sources import jsonl


def idioms(entries: DataFrame) -> DataFrame:
    return entries.where(F.array_contains("categories", "idiom"))


def unprocessed(entries: DataFrame, done: DataFrame) -> DataFrame:
    """Entries whose id is not in ``done`` yet."""
    return entries.join(done.select("id").distinct(), "id", "left_anti")


def batches(entries: DataFrame, order: list[str], size: int = C.BATCH_SIZE) -> DataFrame:
    """Add ``batch`` (from 0) and ``batch_pos`` (from 1) in the given order."""
    rows = numbered(entries, order, "_n")
    return rows.withColumns({"batch": F.floor(F.col("_n") / size), "batch_pos": (F.col("_n") % size + 1).cast("int")}).drop("_n")


def prompt_line() -> Column:
    """``i. id=...: "phrase" — definition``; a missing definition is empty."""
    return F.concat(F.col("batch_pos"), F.lit(". id="), F.col("id"), F.lit(': "'), F.col("phrase"), F.lit('" — '), F.coalesce("definition", F.lit("")))


#: What the classifier is asked; {count} and {lines} are filled in per batch.
INSTRUCTION = (
    "Sort English multi-word expressions into two kinds.\n"
    '"idiom": figurative, while its literal reading could also stand in a real sentence.\n'
    '"fixed": a formula or discourse marker that is only ever used as one unit.\n'
    'Answer with JSON only: {"results": [{"id": 1, "kind": "idiom"}, {"id": 2, "kind": "fixed"}]}\n'
    "with exactly {count} results, one for each phrase, by its id.\n\nPhrases:\n{lines}\n"
)


def prompts(batched: DataFrame, instruction: str = INSTRUCTION) -> DataFrame:
    """(batch, prompt): one text per batch of at most ``BATCH_SIZE`` entries."""
    lines = batched.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("batch_pos", prompt_line().alias("line")))).alias("_l"))
    body = F.replace(F.lit(instruction), F.lit("{count}"), F.size("_l").cast("string"))
    return lines.select("batch", F.replace(body, F.lit("{lines}"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).alias("prompt"))


def labels_of(answers: Column) -> Column:
    """array<struct<id, kind>> in a model's answer: the JSON text at candidates[0].content.parts[0].text."""
    body = F.get_json_object(answers, "$.candidates[0].content.parts[0].text")
    return F.from_json(body, "results array<struct<id:bigint,kind:string>>")["results"]


def classify(prompted: DataFrame, ask: Callable[[str], str], per_minute: int = 0, retry_seconds=C.RETRY_SECONDS, keep_errors: bool = False) -> DataFrame:
    """(batch, answer): ``ask`` called once per prompt, with retries and a rate limit.

    Errors whose message holds 429, 503 or 500 are retried after each delay;
    others are raised, or with ``keep_errors`` end up in a column ``error``, so
    that other answers are not lost.  With a limit all calls go through one
    task, as the limit is for all of them.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gap = 60.0 / per_minute if per_minute > 0 else 0.0
        last = None
        for frame in frames:
            answers: list[str | None] = []
            errors: list[str | None] = []
            for prompt in frame["prompt"]:
                if gap and last is not None:
                    time.sleep(max(0.0, last + gap - time.monotonic()))
                last = time.monotonic()
                try:
                    answers.append(with_retries(ask, prompt, retry_seconds))
                    errors.append(None)
                except Exception as e:
                    if not keep_errors:
                        raise
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            out = {"batch": frame["batch"], "answer": answers}
            yield pd.DataFrame(out | {"error": errors} if keep_errors else out)

    rows = prompted.select("batch", "prompt")
    return (rows.repartition(1) if per_minute > 0 else rows).mapInPandas(run, "batch bigint, answer string" + (", error string" if keep_errors else ""))


def with_retries(ask: Callable[[str], str], prompt: str, delays, sleep: Callable[[float], None] = time.sleep) -> str:
    """One answer; transient errors are tried again after each of ``delays``."""
    waits = iter(delays)
    while True:
        try:
            return ask(prompt)
        except Exception as e:
            wait = next(waits, None)
            if wait is None or not any(code in str(e) for code in C.RETRYABLE):
                raise
            sleep(wait)


def rewrite(categories: Column, target: Column) -> Column:
    """Every ``idiom`` becomes ``target``; order is kept, repetitions go."""
    return F.array_distinct(F.transform(categories, lambda c: F.when(c == "idiom", target).otherwise(c)))


def labels_in(answers: DataFrame) -> DataFrame:
    """(batch, id, kind, place): the labels of each answer with their places in it; an answer that cannot be read has none."""
    return answers.select("batch", F.posexplode(labels_of(F.col("answer"))).alias("place", "_l")).select("batch", "place", "_l.*")


def relabel(entries: DataFrame, labels: DataFrame, order: str | None = None) -> DataFrame:
    """(id, categories, reclassified) of entries by (id, kind) labels.

    ``fixed`` gives fixed_collocation; any other kind, or none, stays idiom.
    Of several labels of one id the last by ``order`` holds (without an order
    it must have one).  Labels of ids that are no entry's are ignored; where
    both sides have a ``batch``, a label counts in its own batch only.
    """
    keys = ["batch", "id"] if "batch" in labels.columns and "batch" in entries.columns else ["id"]
    kind = F.max_by("kind", order) if order else F.max("kind")
    joined = entries.join(labels.groupBy(*keys).agg(kind.alias("_kind")), keys, "left")
    fixed = F.coalesce(F.col("_kind") == "fixed", F.lit(False))
    target = F.when(fixed, "fixed_collocation").otherwise("idiom")
    return joined.select("id", rewrite(F.col("categories"), target).alias("categories"), fixed.alias("reclassified"))


def run(entries: DataFrame, corrections_path: str, ask: Callable[[str], str], order: list[str], per_minute: int = 0, flush_batches: int | None = None) -> DataFrame:
    """Reclassify the idioms that ``corrections_path`` has no line for yet, append their lines, return counters.

    Batches are asked in waves of ``flush_batches`` (one at a time under a rate
    limit, else as many as the cluster runs tasks), and the lines of a wave are
    appended before the next begins.  If a call fails for good, or its answer
    holds no labels, the other answers of
    its wave are appended all the same, then the error is raised: no answered
    batch is ever asked again, as a second run begins with what the folder
    lacks.  The driver keeps three sums; waves are as few as calls allow.
    """
    spark = entries.sparkSession
    todo = idioms(entries)
    if exists(spark, corrections_path):
        lines = spark.read.text(corrections_path).withColumnRenamed("value", "line")
        todo = unprocessed(todo, lines.select(F.get_json_object("line", "$.id").cast("bigint").alias("id")).where("id is not null"))
    batched = cut_lineage(batches(todo, order))
    count = (batched.agg(F.max("batch")).first()[0] + 1) if not batched.isEmpty() else 0
    wave = flush_batches or (1 if per_minute > 0 else max(1, spark.sparkContext.defaultParallelism))
    done = {"processed": 0, "reclassified": 0, "batches": 0}
    waited = 0.0  # a wave is a task of its own, so the gap to the call before is kept here
    for start in range(0, count, wave):
        part = batched.where(F.col("batch").between(start, start + wave - 1))
        if per_minute > 0 and waited:
            time.sleep(max(0.0, waited + 60.0 / per_minute - time.monotonic()))
        answers = classify(prompts(part), ask, per_minute, keep_errors=True)
        unreadable = F.when(labels_of(F.col("answer")).isNull(), F.concat(F.lit("no labels in the answer: "), F.left("answer", F.lit(300))))
        answers = cut_lineage(answers.withColumn("error", F.coalesce("error", unreadable)))
        waited = time.monotonic()
        answered = part.join(answers.where("error is null").select("batch"), "batch", "left_semi")
        lines = cut_lineage(relabel(answered, labels_in(answers.where("error is null")), "place"))
        jsonl.append_corrections(lines, corrections_path)
        sums = lines.agg(F.count("*"), F.count_if("reclassified")).first()
        done["processed"] += sums[0]
        done["reclassified"] += sums[1]
        failed = answers.where("error is not null").orderBy("batch").first()
        done["batches"] += min(wave, count - start)
        if failed is not None:
            raise RuntimeError(f"batch {failed.batch}: {failed.error}; what was answered is in {corrections_path}")
    return spark.createDataFrame([tuple(done.values())], "processed bigint, reclassified bigint, batches bigint")
