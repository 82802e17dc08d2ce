"""Events of requests as their sentences are answered one by one, in any order and over any number of micro-batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Groups into which requests fall by hash: a call of Python and a state is for a group, as one for each request costs more than its events.
GROUPS = 256
STATE = "requests string"


def _take(mine: list, index: float | None, total: int, result: str | None, error: str | None) -> Iterator[tuple[int, str, str]]:
    """(seq, event, data) that one more answer allows; ``mine`` is [next index, waiting answers, results], None and empty once ended."""
    at, held, answers = mine
    if index is not None and index >= at:
        held.setdefault(str(int(index)), [result, error])
    while str(at) in held:
        result, error = held.pop(str(at))
        if error is not None:
            yield at * 2, "error", f"sentence {at}: {error}"
            mine[:] = None, {}, []
            return
        answers.append(result)
        yield at * 2, "result", f'{{"index":{at},"result":{result}}}'
        at += 1
        yield at * 2 - 1, "progress", f'{{"done":{at},"total":{total},"percent":{at * 100 // total}}}'
    mine[0] = at
    if at >= total:
        yield at * 2, "done", '{"results":[' + ",".join(answers) + "]}"
        mine[:] = None, {}, []  # an ended request stays known for a while, so what is delivered twice is told once


def _events(frames: Iterator[pd.DataFrame], state: GroupState, keep_ms: int | None) -> Iterator[pd.DataFrame]:
    """Events that the answers so far allow: of each request in sentence order, none twice."""
    requests = json.loads(state.get[0]) if state.exists else {}
    now = 0 if keep_ms is None else state.getCurrentProcessingTimeMs()
    if not state.hasTimedOut:
        for frame in frames:
            out = []
            for name, index, total, result, error in zip(*[frame[c].tolist() for c in ("_name", "sent_index", "total", "result", "error")]):
                mine = requests.setdefault(name, [0, {}, [], now])
                mine[3] = now
                if mine[0] is None:
                    continue
                three = mine[:3]
                known = index if index is not None and index == index else None
                out += [(name, *e) for e in _take(three, known, int(total), *[x if isinstance(x, str) else None for x in (result, error)])]
                mine[:3] = three
            yield pd.DataFrame(out, columns=["request", "seq", "event", "data"])
    if keep_ms is not None:
        requests = {name: mine for name, mine in requests.items() if mine[3] + keep_ms > now}
    if not requests:
        if state.exists:
            state.remove()
        return
    state.update((json.dumps(requests),))
    if keep_ms is not None:
        state.setTimeoutDuration(min(mine[3] for mine in requests.values()) + keep_ms - now)


def ordered_events(answers: DataFrame, key: str, keep_seconds: int | None = 3600) -> DataFrame:
    """(key, seq, event, data) of a stream of (key, sent_index, total, result, error), one row for each answered sentence.

    A request's ``result`` and ``progress`` events come as soon as the
    sentences before them are answered, however micro-batches fall; ``done``
    follows the last, an error ends the request.  A request without sentences
    is one row with a null ``sent_index`` and a ``total`` of 0: only ``done``.
    Sentences answered twice count once.  The state of a request is what waits
    for earlier sentences and the results that ``done`` repeats; it goes
    ``keep_seconds`` after its last answer.  Requests are grouped by hash, and
    a group keeps the states of its requests together.  Timers keep a query
    going, so one that is to end with its input (``availableNow``) takes None:
    states stay.  Appends only, so any sink takes it.
    """
    kind = answers.schema[key].dataType.simpleString()
    name = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("_name")
    rows = answers.select(F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int").alias("_group"), name, "sent_index", "total", "result", "error")
    keep_ms = None if keep_seconds is None else keep_seconds * 1000
    timeout = GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    stated = rows.groupBy("_group").applyInPandasWithState(lambda k, frames, state: _events(frames, state, keep_ms), "request string, seq int, event string, data string", STATE, "append", timeout)
    return stated.select(F.when(F.col("request") != "", F.substring("request", 2, (1 << 31) - 1)).cast(kind).alias(key), "seq", "event", "data")
