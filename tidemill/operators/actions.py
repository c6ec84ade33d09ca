"""Label plans, their application, audit and retries."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.rules import ADVERTISEMENT, IMPORTANT, NORMAL, UNCERTAIN

# Label names, the labels each category adds and removes, and the
# categories each tool may act on.
PROCESSED_LABEL = "AI_PROCESSED"
CATEGORY_LABELS = {
    IMPORTANT: "AI_IMPORTANT",
    NORMAL: "AI_NORMAL",
    ADVERTISEMENT: "AI_ADVERTISEMENT",
    UNCERTAIN: "AI_UNCERTAIN",
}
AI_LABELS = (PROCESSED_LABEL, *CATEGORY_LABELS.values())
ADDED = {
    IMPORTANT: ("IMPORTANT", PROCESSED_LABEL, CATEGORY_LABELS[IMPORTANT]),
    NORMAL: (PROCESSED_LABEL, CATEGORY_LABELS[NORMAL]),
    ADVERTISEMENT: (PROCESSED_LABEL, CATEGORY_LABELS[ADVERTISEMENT]),
    UNCERTAIN: (PROCESSED_LABEL, CATEGORY_LABELS[UNCERTAIN]),
}
REMOVED = {ADVERTISEMENT: ("INBOX",)}
TOOL_CATEGORIES = {
    "mark_email_as_important": (IMPORTANT,),
    "archive_advertisement_email": (ADVERTISEMENT,),
    "leave_email_unchanged": (NORMAL, UNCERTAIN),
}
MAX_ATTEMPTS = 2

OK, BLOCKED, FALLBACK = "OK", "BLOCKED", "FALLBACK"


def _by_key(key: Column, table: Mapping[str, tuple[str, ...]]) -> Column:
    pairs = [item for name, values in table.items() for item in (F.lit(name), F.array(*map(F.lit, values)))]
    return F.try_element_at(F.create_map(*pairs), key)


def plan_actions(df: DataFrame) -> DataFrame:
    """Add the labels to add and to remove; a message without category gets no plan (NULL)."""
    known = F.col("category").isNotNull()
    none = F.array().cast("array<string>")
    return df.withColumns(
        {
            "add_labels": _by_key(F.col("category"), ADDED),
            "remove_labels": F.when(known, F.coalesce(_by_key(F.col("category"), REMOVED), none)),
        }
    )


def changed_labels(labels: Column, add: Column, remove: Column) -> Column:
    """Set semantics: add, then remove. Applying it twice changes nothing more."""
    none = F.array().cast("array<string>")
    return F.array_except(
        F.array_union(F.coalesce(labels, none), F.coalesce(add, none)), F.coalesce(remove, none)
    )


def apply_actions(messages: DataFrame, plan: DataFrame, dry_run: bool = False) -> DataFrame:
    """Messages with the planned label changes made; unchanged in a dry run.

    ``plan`` has one row per message (id, add_labels, remove_labels).
    """
    if dry_run:
        return messages
    planned = messages.join(plan.select("id", "add_labels", "remove_labels"), "id", "left")
    return planned.withColumn(
        "labels", changed_labels(F.col("labels"), F.col("add_labels"), F.col("remove_labels"))
    ).drop("add_labels", "remove_labels")


def audit_actions(actions: DataFrame, classified: DataFrame) -> DataFrame:
    """Add ``verdict`` and ``cause`` to each tool call.

    ``actions`` holds message_id (the message in hand), target_id (the id the call named)
    and tool. A call is BLOCKED when it names another message, or when the message's
    category is not one the tool may act on.
    """
    categories = classified.select(F.col("id").alias("message_id"), "category")
    allowed = F.coalesce(
        F.array_contains(_by_key(F.col("tool"), TOOL_CATEGORIES), F.col("category")), F.lit(False)
    )
    cause = F.when(~F.col("target_id").eqNullSafe(F.col("message_id")), "wrong message").when(
        ~allowed, "wrong category"
    )
    return (
        actions.join(categories, "message_id", "left")
        .withColumn("cause", cause)
        .withColumn("verdict", F.when(F.col("cause").isNull(), OK).otherwise(BLOCKED))
    )


def resolve_attempts(plan: DataFrame, log: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Which attempt settled each planned message.

    ``log`` holds message_id, attempt (1, 2, …), seq (order of calls within an attempt),
    tool and ok; with the verdict of ``audit_actions`` in it, a BLOCKED call is no success. The last call of an attempt decides it; the first attempt that
    succeeded counts; when none of the allowed ones did, the planned action is made as
    a fallback. Everything a message needs is one aggregate, so a message with very
    many calls is combined before the shuffle.
    """
    if "verdict" in log.columns:
        log = log.withColumn("ok", F.col("ok") & (F.col("verdict") == OK))
    attempts = range(1, max_attempts + 1)
    # At most one row per message and attempt leaves the map side.
    last = [
        F.max_by(F.struct("ok", "tool"), F.when(F.col("attempt") == n, F.col("seq"))).alias(f"_try{n}")
        for n in attempts
    ]
    tried = log.filter(F.col("attempt") <= max_attempts).groupBy(F.col("message_id").alias("id")).agg(*last)
    settled = plan.join(tried, "id", "left")
    won = F.coalesce(*(F.when(F.col(f"_try{n}.ok"), F.lit(n)) for n in attempts))
    tool = F.coalesce(*(F.when(F.col(f"_try{n}.ok"), F.col(f"_try{n}.tool")) for n in attempts))
    return settled.withColumns(
        {
            "attempt": won,
            "tool": tool,
            "outcome": F.when(won.isNotNull(), OK).otherwise(FALLBACK),
            "retries": F.when(F.coalesce(F.col("_try1.ok"), F.lit(False)), 0).otherwise(1),
        }
    ).drop(*(f"_try{n}" for n in attempts))


def with_cause(df: DataFrame, causes: Mapping[str, Column]) -> DataFrame:
    """Add the first ``cause`` whose condition holds; NULL for a row fit for use.

    A condition that comes out NULL counts as holding.
    """
    found = (F.when(F.coalesce(condition, F.lit(True)), F.lit(name)) for name, condition in causes.items())
    return df.withColumn("cause", F.coalesce(*found))


def quarantine(df: DataFrame, causes: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows fit for use, and the others with their cause."""
    judged = with_cause(df, causes)
    return judged.filter(F.col("cause").isNull()).drop("cause"), judged.filter(F.col("cause").isNotNull())
