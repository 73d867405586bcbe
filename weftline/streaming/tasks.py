"""Task queues, stage state, resume, token streams as Structured Streaming.

Each function works on a streaming frame or, where the result does not depend on arrival, on a batch frame alike. State is
bounded by watermarks; exactly-once output is that of the checkpoint folder that the caller names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.operators.windows import folded


def read(spark: SparkSession, folder: str, schema: T.StructType, format: str = "parquet", files_a_batch: int | None = None) -> DataFrame:
    """A folder as a stream. STM-08: ``files_a_batch`` bounds what one micro-batch takes."""
    reader = spark.readStream.schema(schema).format(format)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).load(folder)


def deduplicated(tasks: DataFrame, key: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """STM-03: one row a task id. In a stream, repeats are known for the length of the delay and state stays bounded."""
    if tasks.isStreaming:
        return tasks.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])
    return tasks.dropDuplicates([key])


def stage_state(events: DataFrame, key: str, ts: str, stage: str, tiebreak: str) -> DataFrame:
    """STM-04, Q-24: current stage, last success and number of events of each task: an aggregate, so that partial states merge."""
    at = F.struct(ts, tiebreak)
    return events.groupBy(key).agg(F.max_by(stage, at).alias("current_stage"), F.max(ts).alias("updated_at"), F.count("*").alias("n_events"))


def zombie_sessions(events: DataFrame, key: str, ts: str, minutes: int = 5) -> DataFrame:
    """STM-06: spans without a gap of ``minutes``; the task counts as dead at the end of each."""
    return events.groupBy(key, F.session_window(ts, f"{minutes} minutes").alias("s")).agg(F.count("*").alias("n_events")).select(key, F.col("s.start").alias("started"), F.col("s.end").alias("dead_at"), "n_events")


def resumable(tasks: DataFrame, status: str, stage: str, fails: str, most: int = 3) -> DataFrame:
    """STM-05: running tasks go back to pending from their last successful stage; after too many resumes they have failed."""
    running = F.col(status) == "running"
    again = F.col(fails) < most
    return tasks.withColumns({status: F.when(running & again, "pending").when(running, "failed").otherwise(F.col(status)), "resume_from": F.when(running & again, F.coalesce(F.col(stage), F.lit("start")))})


def progress(events: DataFrame, key: str, ts: str, delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """STM-02: events of each task and minute; late ones count up to the delay."""
    return events.withWatermark(ts, delay).groupBy(key, F.window(ts, window).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("minute"), "n")


def attempts(events: DataFrame, key: str, ok: Column, most: int = 3) -> DataFrame:
    """STM-04 with failures in a row: (key, failures, gave_up) each time that a task has news. For streams: state is one number a task."""
    rows = events.select(F.col(key).cast("string").alias("key"), ok.alias("ok"))

    def run(k: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        for b in batches:
            for good in b["ok"]:
                n = 0 if good else n + 1
        state.update((n,))
        yield pd.DataFrame({"key": [k[0]], "failures": [n], "gave_up": [n >= most]})

    return rows.groupBy("key").applyInPandasWithState(run, "key string, failures long, gave_up boolean", "failures long", "update", GroupStateTimeout.NoTimeout)


def token_text(tokens: DataFrame, key: str, order: str, delta: str, finish: str) -> DataFrame:
    """STM-01: the text of each answer up to the first finish mark, tokens in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, delta, finish)))
    first = F.array_position(F.transform(rows, lambda r: r[finish].isNotNull()), True)
    kept = F.when(first > 0, F.slice(rows, 1, first.cast("int"))).otherwise(rows)
    return tokens.groupBy(key).agg(F.array_join(F.transform(kept, lambda r: F.coalesce(r[delta], F.lit(""))), "").alias("text"))


def run_once(df: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append", seconds: int | None = None) -> StreamingQuery:
    """SNK-10, STM-05, STM-07, STM-08: everything that is there, through ``each(batch, batch_id)``, then ends. A batch's failure is raised.

    With ``seconds``, a run that takes longer is stopped and a TimeoutError raised: it is no result. A batch that was not
    committed comes again with its id when the checkpoint is taken up, so that ``each`` may write by id and be repeated.
    """
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    if seconds is None:
        q.awaitTermination()
    elif not q.awaitTermination(seconds):
        q.stop()
        raise TimeoutError(f"stopped after {seconds} seconds, before everything was read")
    return q


def write_by_batch(path: str, key: str, content: str) -> Callable[[DataFrame, int], None]:
    """STM-07: rows with their content's digest, in a folder for each batch: a repeated batch overwrites its own."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("content_hash", F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return each


def fan_out(*subscribers: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """SNK-10: each batch to every subscriber; one that fails is dropped and the others go on. The batch is computed once."""
    alive = list(subscribers)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for s in list(alive):
                try:
                    s(batch, batch_id)
                except Exception:  # noqa: BLE001 - whatever ends a subscriber ends it alone
                    alive.remove(s)
        finally:
            batch.unpersist()

    return each


def admitted(tasks: DataFrame, status: str, order: list[Column], slots: int = 3) -> DataFrame:
    """STM-08, fixed value 3: the waiting tasks that start now: the first in order, as many as running ones leave of the slots."""
    free = tasks.agg(F.greatest(F.lit(0), F.lit(slots) - F.count_if(F.col(status) == "running")).alias("_free"))
    first = tasks.where(F.col(status) == "pending").orderBy(*order).limit(slots)
    ranked = first.withColumn("_n", F.row_number().over(Window.orderBy(*order)))  # of at most ``slots`` rows
    return ranked.join(F.broadcast(free)).where(F.col("_n") <= F.col("_free")).drop("_n", "_free")


def allowed_calls(calls: DataFrame, key: str, order: list[str], ids: str, known: str, ok: str, most: int = 8, errors: int = 5) -> DataFrame:
    """UDF-04, fixed values 8 and 5: the calls that are made of a conversation's requests: so many at most, none after an unknown tool or after so many errors in a row. One row a call: key, id, outcome."""

    def fresh() -> Callable:
        n, bad, ended = 0, 0, False

        def step(_: object, is_known: bool, is_ok: bool) -> tuple | None:
            nonlocal n, bad, ended
            if ended or n >= most:
                return None
            if not is_known:
                ended = True
                return ("unknown",)
            n, bad = n + 1, 0 if is_ok else bad + 1
            ended = bad >= errors
            return ("ok" if is_ok else "error",)

        return step

    return folded(calls, key, [*order, ids], [ids, known, ok], fresh, "outcome string")
