"""Scopes, filters, counts, lists and label statistics of a message archive."""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import blank_if_null, preview
from tidemill.operators.actions import AI_LABELS, PROCESSED_LABEL

CLEANUP, LIVE = "cleanup", "live"

# Mailboxes never processed, search limits and text lengths.
OUT_OF_SCOPE = ("SENT", "DRAFT", "SPAM", "TRASH")
MIN_RESULTS, MAX_RESULTS, DEFAULT_RESULTS = 1, 100, 10
DETAIL_CHARS, LIST_CHARS = 1_200, 350
# Labels that stand for a mailbox or a state under another name.
BOX_LABELS = {
    "inbox": "INBOX", "sent": "SENT", "drafts": "DRAFT", "draft": "DRAFT", "spam": "SPAM", "trash": "TRASH",
    "unread": "UNREAD", "starred": "STARRED", "important": "IMPORTANT",
}
UNITS = {"d": "days", "m": "months", "y": "years"}


def _has(label: str) -> Column:
    return F.array_contains(F.coalesce("labels", F.array().cast("array<string>")), label)


def unprocessed(messages: DataFrame, scope: str) -> DataFrame:
    """Messages still to be processed: everywhere (cleanup) or in the inbox (live)."""
    if scope not in (CLEANUP, LIVE):
        raise ValueError(f"unknown scope {scope!r}")
    kept = messages.filter(~_has(PROCESSED_LABEL))
    for label in OUT_OF_SCOPE:
        kept = kept.filter(~_has(label))
    return kept.filter(_has("INBOX")) if scope == LIVE else kept


def _contains(column: str, text: str) -> Column:
    return F.contains(F.lower(blank_if_null(F.col(column))), F.lit(text.lower()))


def _box(name: str) -> Column:
    name = name.lower()
    if name == "read":
        return ~_has("UNREAD")
    return _has(BOX_LABELS[name])


def _ago(today: datetime.date | str, age: str) -> Column:
    count, unit = re.fullmatch(r"(\d+)([dmy])", age).groups()
    return F.expr(f"timestamp_ntz '{today} 00:00:00' - interval {count} {UNITS[unit]}")


def filter_messages(
    messages: DataFrame,
    *,
    from_: str | None = None,
    to: str | None = None,
    subject: str | None = None,
    after: str | None = None,
    before: str | None = None,
    newer_than: str | None = None,
    older_than: str | None = None,
    label: str | None = None,
    in_: str | None = None,
    is_: str | None = None,
    exclude_in: Iterable[str] = (),
    exclude_label: Iterable[str] = (),
    today: datetime.date | str | None = None,
) -> DataFrame:
    """Messages that meet every given term.

    ``after`` is inclusive and ``before`` exclusive, both dates. ``newer_than`` and
    ``older_than`` are ages such as 30d, 2m or 1y counted back from ``today``.
    """
    if (newer_than or older_than) and today is None:
        raise ValueError("ages are counted back from today, which must be given")
    tests = []
    for column, text in (("sender", from_), ("recipient", to), ("subject", subject)):
        if text is not None:
            tests.append(_contains(column, text))
    if after is not None:
        tests.append(F.col("ts") >= F.lit(after).cast("timestamp_ntz"))
    if before is not None:
        tests.append(F.col("ts") < F.lit(before).cast("timestamp_ntz"))
    if newer_than is not None:
        tests.append(F.col("ts") >= _ago(today, newer_than))
    if older_than is not None:
        tests.append(F.col("ts") < _ago(today, older_than))
    if label is not None:
        tests.append(_has(label))
    tests += [_box(name) for name in (in_, is_) if name is not None]
    tests += [~_box(name) for name in exclude_in]
    tests += [~_has(name) for name in exclude_label]
    for test in tests:
        messages = messages.filter(test)
    return messages


def count_messages(messages: DataFrame, **terms) -> DataFrame:
    """The exact number of matching messages."""
    return filter_messages(messages, **terms).agg(F.count("*").alias("message_count"))


def search_messages(messages: DataFrame, limit: int = DEFAULT_RESULTS, **terms) -> DataFrame:
    """The newest matching messages, at least 1 and at most 100 of them."""
    limit = min(max(limit, MIN_RESULTS), MAX_RESULTS)
    newest = filter_messages(messages, **terms).orderBy(F.desc("ts"), "id").limit(limit)
    # The previews are made for the chosen rows only.
    return newest.select(
        "id", "sender", "ts", "subject",
        preview(preview(F.col("body"), DETAIL_CHARS), LIST_CHARS).alias("body"),
    )


def message_details(messages: DataFrame, ids: DataFrame | Sequence[str]) -> DataFrame:
    """Details of the given messages; ``ids`` is a table with a column id or a short list."""
    if isinstance(ids, DataFrame):
        chosen = messages.join(ids.select("id"), "id", "left_semi")
    else:
        chosen = messages.filter(F.col("id").isin(list(ids)))
    return chosen.select(
        "id", "sender", "ts", "subject", "labels", preview(F.col("body"), DETAIL_CHARS).alias("body")
    )


def label_stats(messages: DataFrame, labels: Sequence[str] = AI_LABELS) -> DataFrame:
    """(label, message_count) for each of ``labels``, 0 where none has it: one scan, one row shuffled."""
    counts = messages.agg(*(F.count_if(_has(label)).alias(label) for label in labels))
    return counts.unpivot([], list(labels), "label", "message_count")
