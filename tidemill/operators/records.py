"""One record per exported message: headers, body and what came before it in its thread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.bodies import normalise_headers, select_body
from tidemill.operators.threads import thread_context
from tidemill.sources.mailbox import export_messages, export_parts


def email_records(export: DataFrame) -> DataFrame:
    """id, thread_id, ts, labels, the headers in use, body and thread_context of each message of an export.

    A message delivered again is one record: the delivery with the latest arrival, at equal times the one whose hash
    is greatest, whatever the order of the lines. Lines without id have none (``export_rejects`` lists them); a
    message without a usable root or with html the parser rejects has a NULL body, which triage counts as
    an error.
    """
    delivered = normalise_headers(export_messages(export)).filter(F.col("id").isNotNull())
    last = F.max_by(F.struct(*delivered.columns), F.struct("ts", F.xxhash64(*delivered.columns)))
    messages = delivered.groupBy("id").agg(last.alias("_last")).select("_last.*")
    # Both sides lie by id already; bodies are not broadcast.
    bodies = select_body(export_parts(export)).withColumnRenamed("message_id", "id").hint("merge")
    return thread_context(messages.join(bodies, "id", "left"))
