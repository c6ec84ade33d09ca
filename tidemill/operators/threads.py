"""What came before a message in its thread, and the last lines of a chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.text import blank_if_null, clip
from tidemill.operators.ordering import CHUNK_ROWS, with_preceding

# The extent and the layout of the context text.
CONTEXT_MESSAGES = 3
CONTEXT_BODY_CHARS = 2_500
CONTEXT_SEPARATOR = "\n--- PREVIOUS MESSAGE ---\n"
HISTORY_LINES = 8


def context_block(sender: Column, subject: Column, body: Column) -> Column:
    return F.concat(
        F.lit("\nFROM:\n"), blank_if_null(sender),
        F.lit("\n\nSUBJECT:\n"), blank_if_null(subject),
        F.lit("\n\nBODY:\n"), clip(blank_if_null(body), CONTEXT_BODY_CHARS),
        F.lit("\n"),
    )


def thread_context(
    messages: DataFrame,
    out_col: str = "thread_context",
    thread: str = "thread_id",
    position: str = "ts",
    tie: str = "id",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the text of up to three messages before each one in its thread; "" for the first.

    Messages of a thread are in the order of their arrival and then of their ids. A message without thread
    is a thread of its own.
    """
    block = context_block(F.col("sender"), F.col("subject"), F.col("body"))
    own = F.when(F.col(thread).isNull(), F.concat(F.lit("message "), F.col(tie).cast("string")))
    named = messages.withColumn("_thread", F.coalesce(own, F.concat(F.lit("thread "), F.col(thread).cast("string"))))
    before = with_preceding(
        named, "_thread", position, tie, block, CONTEXT_MESSAGES, "_before", chunk_rows=chunk_rows
    )
    return before.withColumn(out_col, F.array_join("_before", CONTEXT_SEPARATOR)).drop("_before", "_thread")


def context_for(archive: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``wanted`` messages (a column id) with their thread context.

    Only threads that hold a wanted message go through the window.
    """
    ids = wanted.select("id")
    touched = archive.join(ids, "id", "left_semi").select("thread_id").distinct()
    members = archive.join(touched, "thread_id", "left_semi")
    return thread_context(members).join(ids, "id", "left_semi")


def turn_history(
    turns: DataFrame,
    n: int = HISTORY_LINES,
    out_col: str = "history",
    conversation: str = "conv_id",
    position: str = "turn",
    tie: str = "turn",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add the last ``n`` "ROLE: text" lines, this one included."""
    line = F.concat(F.upper("role"), F.lit(": "), blank_if_null(F.col("text")))
    lines = with_preceding(
        turns, conversation, position, tie, line, n, "_lines", include_current=True, chunk_rows=chunk_rows
    )
    return lines.withColumn(out_col, F.array_join("_lines", "\n")).drop("_lines")
