"""Triage of arriving message files: drain a backlog or take what is new, then stop."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemill.operators.actions import changed_labels, plan_actions
from tidemill.operators.rules import MAIL_RULES, Rule, classify, merge_labels
from tidemill.operators.runstats import message_counters
from tidemill.operators.search import CLEANUP, unprocessed
from tidemill.sources.folders import exists
from tidemill.streaming.ledger import Ledger

# Attempts at a message that cannot be handled.
GIVE_UP_AFTER = 3

OUTPUT = (
    "id", "labels", "category", "reason", "rule_id", "source", "add_labels", "remove_labels", "labels_after", "cause",
)


def triage(
    messages: DataFrame,
    external: DataFrame | None = None,
    rules: Sequence[Rule] = MAIL_RULES,
    dry_run: bool = False,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Category, planned labels and labels afterwards for each message.

    A message that cannot be handled keeps its labels and gets a ``cause``. Bodies stay
    out of the join with the external labels. Further columns can be carried along.
    """
    cause = (
        F.when(F.col("id").isNull(), "missing id")
        .when(F.col("labels").isNull(), "missing labels")
        .when(F.col("body").isNull(), "unreadable body")
    )
    decided = classify(messages.withColumn("cause", cause), rules).select(
        "id", "labels", "cause", "category", "reason", "rule_id", *carry
    )
    if external is None:
        merged = decided.withColumn("source", F.when(F.col("category").isNotNull(), "rule"))
    else:
        merged = merge_labels(decided, external)
    usable = F.col("cause").isNull()
    merged = merged.withColumns(
        {name: F.when(usable, F.col(name)) for name in ("category", "reason", "rule_id", "source")}
    )
    planned = plan_actions(merged)
    after = changed_labels(F.col("labels"), F.col("add_labels"), F.col("remove_labels"))
    return planned.withColumn("labels_after", F.col("labels") if dry_run else after).select(*OUTPUT, *carry)


def refuse_foreign_sink(spark: SparkSession, sink: str, checkpoint: str) -> None:
    """A sink that a stream with another checkpoint filled is refused: its batches would be overwritten."""
    if exists(spark, sink) and not exists(spark, f"{checkpoint}/metadata"):
        raise ValueError(f"{sink} was filled by a stream with another checkpoint than {checkpoint}")


def ledger_of(sink: str) -> Ledger:
    """The ids that the runs of a sink have labelled."""
    return Ledger(f"{sink}_ledger")


def _without_labelled(batch: DataFrame, sink: str, batch_id: int) -> DataFrame:
    """Leave out messages an earlier batch labelled."""
    spark, ledger = batch.sparkSession, ledger_of(sink)
    if not exists(spark, f"{ledger.folder}/ids"):
        if not exists(spark, sink):
            return batch
        # The sink was filled without a ledger.
        done = spark.read.parquet(sink).filter((F.col("batch") < batch_id) & F.col("category").isNotNull())
        ledger.record(done.select("id"), -1)
    return ledger.unknown(batch, batch_id)


def _counters() -> list[Column]:
    errors = F.count_if(F.col("cause").isNotNull()).alias("errors")
    return [*(count.alias(name) for name, count in message_counters().items()), errors]


def _settle(
    spark: SparkSession, waiting: DataFrame, batch: int, sink: str,
    external: DataFrame | None, rules: Sequence[Rule], dry_run: bool, remember: bool,
) -> None:
    """Triage a batch into the sink; those left undecided wait, whole, for the next run."""
    counters = Observation(f"triage-{batch}")
    at = f"batch={batch}/attempt=0"
    result = triage(waiting, external, rules, dry_run).observe(counters, *_counters())
    result.write.mode("overwrite").parquet(f"{sink}/{at}")
    written = spark.read.parquet(f"{sink}/{at}")
    open_ids = written.filter(F.col("category").isNull()).select("id")
    undecided = waiting.join(open_ids, waiting["id"].eqNullSafe(open_ids["id"]), "left_semi")
    undecided.write.mode("overwrite").parquet(f"{sink}_waiting/{at}")
    if remember:
        ledger_of(sink).record(written.filter(F.col("category").isNotNull()).select("id"), batch)
    stats = spark.createDataFrame(list(counters.get.items()), "counter string, value bigint")
    # Written last: an attempt with statistics is complete.
    stats.coalesce(1).write.mode("overwrite").parquet(f"{sink}_stats/{at}")


def _by_attempt(df: DataFrame, folder: str) -> None:
    """Write rows of many batches; attempts that were written before by a broken run are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "attempt").parquet(folder)


def triage_waiting(
    spark: SparkSession, sink: str, external: DataFrame | None = None, rules: Sequence[Rule] = MAIL_RULES, dry_run: bool = False,
    give_up_after: int = GIVE_UP_AFTER,
) -> bool:
    """Take up all messages that earlier runs left undecided, with the labels there are now; False when none wait.

    All batches are settled at once, each under its own number with one attempt more. A message that cannot be
    handled (it has a ``cause``) goes, whole, to ``<sink>_rejects`` when ``give_up_after`` attempts have been made;
    one that only lacks a label goes on waiting. Run it between runs of the stream, not beside one.
    """
    if not exists(spark, f"{sink}_waiting"):
        return False
    # The last complete attempt of each batch.
    last = spark.read.parquet(f"{sink}_stats").groupBy("batch").agg(F.max("attempt").alias("attempt"))
    due = spark.read.parquet(f"{sink}_waiting").join(last, ["batch", "attempt"], "left_semi")
    if due.isEmpty():
        return False
    due = due.withColumn("attempt", F.col("attempt") + 1)
    place = ["batch", "attempt"]
    _by_attempt(triage(due, external, rules, dry_run, carry=place), sink)
    numbers = due.select(*place).distinct()
    written = spark.read.parquet(sink).join(numbers, place, "left_semi")
    open_rows = written.filter(F.col("category").isNull()).groupBy(*place, "id").agg(F.max("cause").alias("_cause"))
    given_up = F.col("_cause").isNotNull() & (F.col("attempt") + 1 >= give_up_after)
    same = [due[name] == open_rows[name] for name in place] + [due["id"].eqNullSafe(open_rows["id"])]
    undecided = due.join(open_rows, same).select(*(due[name] for name in due.columns), "_cause")
    _by_attempt(undecided.filter(given_up).withColumnRenamed("_cause", "cause"), f"{sink}_rejects")
    _by_attempt(undecided.filter(~given_up).drop("_cause"), f"{sink}_waiting")
    if exists(spark, ledger_of(sink).folder):
        labelled = written.filter(F.col("category").isNotNull())
        for row in labelled.groupBy("attempt").agg(F.max("batch").alias("batch")).collect():
            # By attempt, of which there are few; recorded under the last batch, so that only later ones look it up.
            ledger_of(sink).record(labelled.filter(F.col("attempt") == row["attempt"]).select("id"), row["batch"], row["attempt"])
    counted = written.groupBy(*place).agg(*_counters())
    _by_attempt(counted.unpivot(place, [name for name in counted.columns if name not in place], "counter", "value"), f"{sink}_stats")
    return True


def outcomes(spark: SparkSession, sink: str) -> DataFrame:
    """The last outcome of each message in a sink; messages without id are each their own."""
    results = spark.read.parquet(sink)
    decided = F.struct(F.col("category").isNotNull().alias("done"), "batch", "attempt")
    names = [name for name in results.columns if name not in ("batch", "attempt")]
    named = results.filter(F.col("id").isNotNull())
    last = named.groupBy("id").agg(F.max_by(F.struct(*names), decided).alias("_row")).select("_row.*")
    # All of a batch are taken up together, so its last attempt has them all.
    nameless = results.filter(F.col("id").isNull())
    tried = nameless.groupBy("batch").agg(F.max("attempt").alias("attempt"))
    return last.unionByName(nameless.join(tried, ["batch", "attempt"], "left_semi").select(*names))


def triage_stream(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    sink: str,
    checkpoint: str,
    scope: str = CLEANUP,
    external: DataFrame | None = None,
    rules: Sequence[Rule] = MAIL_RULES,
    files_per_batch: int | None = None,
    dry_run: bool = False,
    glob: str | None = None,
    prepare: Callable[[DataFrame], DataFrame] = lambda df: df,
    skip_labelled: bool = False,
    form: str = "parquet",
) -> StreamingQuery:
    """Process every file not seen before, then stop. Start again to go on.

    ``files_per_batch`` bounds each batch of a backlog; without it all new files are one
    batch. A batch writes ``sink/batch=<n>/attempt=0`` by overwriting, so a batch repeated after a
    failure leaves one copy. Its counters go to ``<sink>_stats``, messages it could not decide
    to ``<sink>_waiting``, from where ``triage_waiting`` takes them up again. ``skip_labelled`` also
    looks new messages up among those labelled before, for sources that deliver a
    message again without its labels: in ``<sink>_ledger``, of which a batch reads the buckets that may hold its ids.
    ``form`` is the file format of the source: with "text", ``prepare`` gets the lines of an export.
    A sink that a stream with another checkpoint filled is refused, as its batches would be overwritten.
    """
    refuse_foreign_sink(spark, sink, checkpoint)
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)

    def write(batch: DataFrame, batch_id: int) -> None:
        waiting = unprocessed(prepare(batch), scope)
        if skip_labelled:
            waiting = _without_labelled(waiting, sink, batch_id)
        # Read twice: for the outcome, and for what is left undecided.
        waiting.persist()
        try:
            _settle(batch.sparkSession, waiting, batch_id, sink, external, rules, dry_run, skip_labelled)
        finally:
            waiting.unpersist()

    return (
        reader.format(form).load(source)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
