"""Message archives, seen through tables of conversations and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.star import read_table


def _labels(*names: str) -> Column:
    return F.array(*map(F.lit, names))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """One message per turn; the conversation is the thread."""
    arrival = F.expr(
        "timestamp_ntz '2024-01-01 00:00:00'"
        " + make_dt_interval(0, cast(conv_id % 8760 as int), cast(turn as int), 0)"
    )
    labels = (
        F.when(F.col("role") == "assistant", _labels("SENT"))
        .when(F.col("role") == "system", _labels("INBOX", "AI_PROCESSED", "AI_NORMAL"))
        .when(F.col("turn") > 3, _labels("INBOX"))
        .when(F.col("turn") == 2, _labels("UNREAD", "STARRED"))
        .otherwise(_labels("INBOX", "UNREAD"))
    )
    return conversations.select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("conv_id").alias("thread_id"),
        F.col("turn").alias("thread_pos"),
        arrival.alias("ts"),
        labels.alias("labels"),
        F.concat("role", F.lit("@example.org")).alias("sender"),
        F.concat(F.lit("box"), (F.col("conv_id") % 50).cast("string"), F.lit("@example.org")).alias("recipient"),
        F.substring("text", 1, 60).alias("subject"),
        F.col("text").alias("body"),
        F.lit("").alias("list_unsubscribe"),
        F.lit("").alias("list_id"),
        F.lit("").alias("date"),
    )


def _pick(key: Column, values: dict[int, Column | str], otherwise: Column) -> Column:
    chosen = None
    for number, value in values.items():
        value = F.lit(value) if isinstance(value, str) else value
        chosen = F.when(key == number, value) if chosen is None else chosen.when(key == number, value)
    return chosen.otherwise(otherwise)


def document_messages(documents: DataFrame) -> DataFrame:
    """One message per document, with senders and subjects of the kinds the mail rules look for."""
    number = F.col("doc_id").cast("string")
    sender = _pick(
        F.col("doc_id") % 8,
        {0: "device@coolkit.cc", 1: "info@MojeDatovaSchranka.cz", 2: "updates-noreply@linkedin.com"},
        F.concat("source", F.lit("@example.org")),
    )
    subject = _pick(
        F.col("doc_id") % 9,
        {
            0: "Scene is triggered",
            1: F.concat(F.lit("Nová zpráva "), number),
            2: F.concat(F.lit("FAKTURA "), number),
            3: "Newsletter: promo and bonus",
            4: "Special offer",
            5: "Security alert",
            6: "Invoice overdue",
        },
        F.substring("text", 1, 60),
    )
    return documents.select(
        number.alias("id"),
        sender.alias("sender"),
        subject.alias("subject"),
        F.col("text").alias("body"),
        F.lit("").alias("list_unsubscribe"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("list."), "source")).otherwise("").alias("list_id"),
        F.lit("").alias("date"),
        F.lit("").alias("thread_context"),
        _labels("INBOX", "UNREAD").alias("labels"),
    )


def external_labels(labels: DataFrame) -> DataFrame:
    """Outside judgements as (id, category, reason)."""
    category = F.when(F.col("toxic") == 1, "ADVERTISEMENT").when(F.col("quality") == 1, "NORMAL")
    return labels.select(
        F.col("doc_id").cast("string").alias("id"),
        category.otherwise("UNCERTAIN").alias("category"),
        F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("reason"),
    )


def url_safe_base64(text: Column) -> Column:
    standard = F.base64(F.encode(text, "UTF-8"))
    return F.replace(F.replace(standard, F.lit("+"), F.lit("-")), F.lit("/"), F.lit("_"))


def document_parts(documents: DataFrame) -> DataFrame:
    """A part tree per document, in six shapes; markup characters are blanked in html parts."""
    text = F.col("text")
    html = F.concat(F.lit("<p>"), F.translate(text, "<>&", "   "), F.lit("</p>"))

    def part(path: tuple[int, ...], mime: str, data: Column | None = None) -> Column:
        return F.struct(
            F.array(*map(F.lit, path)).cast("array<int>").alias("path"),
            F.lit(mime).alias("mime_type"),
            (F.lit(None).cast("string") if data is None else url_safe_base64(data)).alias("data"),
        )

    shapes = [
        F.array(part((), "text/plain", text)),
        F.array(
            part((), "multipart/alternative"), part((0,), "text/plain", text), part((1,), "text/html", html)
        ),
        F.array(
            part((), "multipart/mixed"),
            part((0,), "text/html", F.lit("<b>left out</b>")),
            part((1,), "multipart/alternative"),
            part((1, 0), "text/html", html),
        ),
        F.array(part((), "multipart/mixed"), part((0,), "text/html", html)),
        F.array(
            part((), "multipart/mixed"),
            part((0,), "text/plain", F.col("source")),
            part((1,), "text/plain", text),
        ),
        F.array(part((), "multipart/mixed"), part((0,), "image/png", F.col("source"))),
    ]
    tree = F.when(F.lit(False), shapes[0])
    for number, shape in enumerate(shapes):
        tree = tree.when(F.col("doc_id") % len(shapes) == number, shape)
    return documents.select(F.col("doc_id").cast("string").alias("message_id"), F.explode(tree).alias("_part")).select(
        "message_id", "_part.*"
    )


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_messages(read_table(spark, folder, "conversations"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return document_messages(read_table(spark, folder, "documents"))
