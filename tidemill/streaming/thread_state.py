"""Thread context of messages that keep arriving, from keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidemill.operators.threads import CONTEXT_MESSAGES, CONTEXT_SEPARATOR, context_block
from tidemill.streaming.triage import refuse_foreign_sink

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# A message may be this much older than the newest one of its thread and still be put in its place.
LATENESS_SECONDS = 30 * 86_400
# Sorts before every time, as NULL does.
NO_TIME = -(1 << 63)
# Rows of a thread that are put in their places at once.
STEP_ROWS = 10_000

CONTEXTS = "id string, thread string, thread_context string, revision bigint, late boolean"
_Context = Row("id", "thread", "thread_context", "revision", "late")


class ThreadTails(StatefulProcessor):
    """Keeps the last blocks of a thread, and those that a late message may still come before.

    ``recent`` holds (time, id, block) in order; ``counters`` how many changes the thread has seen and whether
    blocks were dropped.
    """

    def __init__(self, lateness_seconds: int):
        self.lateness = lateness_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at bigint, id string, block string")
        self.counters = handle.getValueState("counters", "revision bigint, dropped boolean")

    def contexts(self, steps: Iterable[Iterable[tuple]]) -> Iterator[tuple[int, list[tuple]]]:
        """Revision and (id, context, late) after each step of (time, id, block)."""
        # Each call on a state is a message to another process and back; what is empty need not be asked for first.
        held = [tuple(entry) for entry in self.recent.get() or ()]
        revision, dropped = self.counters.get() or (0, False)
        for entries in steps:
            known = {entry[1] for entry in held}
            new = {}
            for entry in sorted(entries):
                if entry[1] not in known:
                    new.setdefault(entry[1], entry)
            revision += 1
            # What comes before the kept blocks is unknown: a message among the first of them is too late.
            floor = held[min(CONTEXT_MESSAGES, len(held)) - 1][:2] if dropped else None
            late = [entry for entry in new.values() if dropped and entry[:2] < floor]
            fit = [entry for entry in new.values() if not (dropped and entry[:2] < floor)]
            merged = sorted(held + fit)
            place = {entry[1]: at for at, entry in enumerate(merged)}
            # A new message changes its own context and that of the next ones.
            touched = sorted({at + ahead for at in (place[entry[1]] for entry in fit) for ahead in range(CONTEXT_MESSAGES + 1)})
            out = [
                (merged[at][1], _joined(merged[max(0, at - CONTEXT_MESSAGES) : at]), False) for at in touched if at < len(merged)
            ]
            out += [(entry[1], _joined([old for old in merged if old[:2] < entry[:2]][-CONTEXT_MESSAGES:]), True) for entry in late]
            if out:
                yield revision, out
            horizon = merged[-1][0] - self.lateness if merged else 0
            first = next((at for at, entry in enumerate(merged) if entry[0] >= horizon), 0)
            cut = max(0, min(first, len(merged)) - CONTEXT_MESSAGES)
            dropped = dropped or cut > 0
            held = merged[cut:]
        self.recent.put(held)
        self.counters.update((revision, dropped))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        steps = (zip(frame["at"].tolist(), frame["id"].tolist(), frame["block"].tolist(), strict=True) for frame in rows)
        for revision, out in self.contexts(steps):
            ids, contexts, lates = zip(*out, strict=True)
            yield pd.DataFrame({"id": ids, "thread": key[0], "thread_context": contexts, "revision": revision, "late": lates})

    def close(self) -> None:
        pass


class ThreadTailRows(ThreadTails):
    """The same over plain rows: most threads bring a row or two to a batch, and a data frame for each costs more than its rows."""

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        steps = ([(row["at"], row["id"], row["block"]) for row in some] for some in batched(rows, STEP_ROWS))
        for revision, out in self.contexts(steps):
            for name, context, late in out:
                yield _Context(name, key[0], context, revision, late)


def _joined(entries: list[tuple]) -> str:
    return CONTEXT_SEPARATOR.join(entry[2] for entry in entries)


def threads_of(messages: DataFrame) -> DataFrame:
    """``thread``, ``at``, ``id``, ``block`` of messages; one without thread is a thread of its own."""
    own = F.when(F.col("thread_id").isNull(), F.concat(F.lit("message "), F.col("id").cast("string")))
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NO_TIME))
    return messages.filter(F.col("id").isNotNull()).select(
        F.coalesce(own, F.concat(F.lit("thread "), F.col("thread_id").cast("string"))).alias("thread"),
        at.alias("at"),
        F.col("id").cast("string").alias("id"),
        context_block(F.col("sender"), F.col("subject"), F.col("body")).alias("block"),
    )


@contextmanager
def _state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def thread_context_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    glob: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    lateness_seconds: int = LATENESS_SECONDS,
    form: str = "parquet",
    frames: bool = False,
) -> StreamingQuery:
    """Thread context of every message in files not seen before, then stop. Start again to go on.

    A message gets the text of up to three messages before it in its thread, by time and id, among all that
    have arrived. A message that arrives late changes the context of up to three that came before it: they are
    written again with a higher ``revision``, and ``latest_contexts`` has the last word on each. A message delivered
    again changes nothing. Messages without id take no part.

    State is kept by thread in RocksDB, with the checkpoint: the blocks (at most 2,500 characters of body each)
    of the last ``lateness_seconds`` of a thread and three before them. A message older than that is written with
    ``late``, with what is known to come before it, and changes no other; one without time is older than all. A batch is written by overwriting
    ``sink/batch=<n>``, so one repeated after a failure leaves one copy. Messages of a thread are handled in one
    task, and its contexts of one batch are held there together; a thread that has been filled over years belongs to
    ``thread_context``, which cuts it up. With ``frames`` they leave by 10,000 rows as data frames, which took short
    threads 1.5 times the task time; a checkpoint can only be gone on with as it was begun, and those made before there
    was a choice were begun with ``frames``.
    """
    refuse_foreign_sink(spark, sink, checkpoint)
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    threads = threads_of(prepare(reader.format(form).load(source))).groupBy("thread")
    if frames:
        contexts = threads.transformWithStateInPandas(ThreadTails(lateness_seconds), CONTEXTS, "Update", "None")
    else:
        contexts = threads.transformWithState(ThreadTailRows(lateness_seconds), CONTEXTS, "Update", "None")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    with _state_in_rocksdb(spark):
        return (
            contexts.writeStream.outputMode("update").foreachBatch(write)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )


def latest_contexts(contexts: DataFrame) -> DataFrame:
    """``id``, ``thread_context`` and ``late``: the last word on each message of a sink."""
    order = F.struct((~F.col("late")).alias("in_time"), "revision")
    return contexts.groupBy("id").agg(F.max_by(F.struct("thread_context", "late"), order).alias("_last")).select("id", "_last.*")
