"""Named queries over message archives."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.codec import with_base64_text
from tidemill.functions.text import duration_text
from tidemill.operators import actions, bodies, gram_index, records, rules, runstats, search, threads, writeback
from tidemill.operators import tallies as tally
from tidemill.operators.rules import ADVERTISEMENT, IMPORTANT, MAIL_RULES, MARKETING_TERMS, NORMAL, UNCERTAIN, Rule, Terms
from tidemill.plans.registry import Registry
from tidemill.session import checkpoint_folder
from tidemill.sources import archive, mailbox
from tidemill.sources.star import read_table
from tidemill.streaming.thread_state import latest_contexts, thread_context_stream
from tidemill.streaming.triage import outcomes, triage, triage_stream, triage_waiting

MAIL = Registry()

# Rules with words that occur in plain documents.
DOCUMENT_RULES = (
    Rule(1, IMPORTANT, "license text", (Terms(("body",), ("license", "all rights")),)),
    Rule(2, NORMAL, "contact data", (Terms(("body",), ("@",)),), exclude=(Terms(("body",), ("token", "apache")),)),
    Rule(3, ADVERTISEMENT, "common words", (Terms(("body",), ("mit ", "that ", "der ", "les "), at_least=2),)),
    Rule(4, UNCERTAIN, "listed", (Terms(("subject",), ("the",)),), list_header=True),
)
DOCUMENT_TERMS = ("license", "token", "@", "all rights", "apache", "mit ", "that ", "les ", "der ", "under")

CONVERSATIONS = """
WITH messages AS (
  SELECT conv_id || '-' || turn AS id, conv_id AS thread_id, turn AS thread_pos,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id % 8760) + to_minutes(turn) AS ts,
    CASE WHEN role = 'assistant' THEN ['SENT'] WHEN role = 'system' THEN ['INBOX', 'AI_PROCESSED', 'AI_NORMAL']
      WHEN turn > 3 THEN ['INBOX'] WHEN turn = 2 THEN ['UNREAD', 'STARRED'] ELSE ['INBOX', 'UNREAD'] END AS labels,
    role || '@example.org' AS sender, 'box' || (conv_id % 50) || '@example.org' AS recipient,
    left(text, 60) AS subject, text AS body
  FROM conversations)
"""

DOCUMENTS = """
WITH messages AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
    CASE doc_id % 8 WHEN 0 THEN 'device@coolkit.cc' WHEN 1 THEN 'info@MojeDatovaSchranka.cz'
      WHEN 2 THEN 'updates-noreply@linkedin.com' ELSE source || '@example.org' END AS sender,
    CASE doc_id % 9 WHEN 0 THEN 'Scene is triggered' WHEN 1 THEN 'Nová zpráva ' || doc_id
      WHEN 2 THEN 'FAKTURA ' || doc_id WHEN 3 THEN 'Newsletter: promo and bonus' WHEN 4 THEN 'Special offer'
      WHEN 5 THEN 'Security alert' WHEN 6 THEN 'Invoice overdue' ELSE left(text, 60) END AS subject,
    text AS body, '' AS list_unsubscribe,
    CASE WHEN doc_id % 4 = 0 THEN 'list.' || source ELSE '' END AS list_id,
    ['INBOX', 'UNREAD'] AS labels
  FROM documents)
"""

EXTERNAL = """, external AS (
  SELECT CAST(doc_id AS VARCHAR) AS id,
    CASE WHEN toxic = 1 THEN 'ADVERTISEMENT' WHEN quality = 1 THEN 'NORMAL' ELSE 'UNCERTAIN' END AS category,
    'quality ' || quality AS reason
  FROM labels)
"""


def _found(fields, term: str) -> str:
    return "(" + " OR ".join(f"contains(lower({field}), '{term}')" for field in fields) + ")"


def _terms_sql(terms: Terms) -> str:
    hits = " + ".join(f"CAST({_found(terms.fields, term)} AS INT)" for term in terms.terms)
    return f"({hits} >= {terms.at_least})"


def _rules_sql(rule_set, attribute: str) -> str:
    """The rules as a CASE, written out a second time for the other engine."""
    branches = []
    for rule in rule_set:
        tests = [_terms_sql(terms) for terms in rule.require]
        tests += [f"NOT {_terms_sql(terms)}" for terms in rule.exclude]
        if rule.list_header:
            tests.append("(list_unsubscribe <> '' OR list_id <> '')")
        value = getattr(rule, attribute)
        shown = f"'{value}'" if isinstance(value, str) else value
        branches.append(f"WHEN {' AND '.join(tests)} THEN {shown}")
    return f"CASE {' '.join(branches)} END"


def _classified_sql(rule_set) -> str:
    return (
        f", classified AS (SELECT *, {_rules_sql(rule_set, 'id')} AS rule_id,"
        f" {_rules_sql(rule_set, 'category')} AS category, {_rules_sql(rule_set, 'reason')} AS reason FROM messages)"
    )


MERGED = (
    _classified_sql(MAIL_RULES) + EXTERNAL
    + """, merged AS (SELECT c.id, c.labels, c.rule_id, coalesce(c.category, e.category) AS category,
      coalesce(c.reason, e.reason) AS reason,
      CASE WHEN c.category IS NOT NULL THEN 'rule' WHEN e.id IS NOT NULL THEN 'external' END AS source
    FROM classified c LEFT JOIN external e ON c.id = e.id),
    planned AS (SELECT *,
      CASE category WHEN 'IMPORTANT' THEN ['IMPORTANT', 'AI_PROCESSED', 'AI_IMPORTANT']
        WHEN 'NORMAL' THEN ['AI_PROCESSED', 'AI_NORMAL'] WHEN 'UNCERTAIN' THEN ['AI_PROCESSED', 'AI_UNCERTAIN']
        WHEN 'ADVERTISEMENT' THEN ['AI_PROCESSED', 'AI_ADVERTISEMENT'] END AS add_labels,
      CASE WHEN category = 'ADVERTISEMENT' THEN ['INBOX'] WHEN category IS NOT NULL THEN []::VARCHAR[] END AS remove_labels
      FROM merged),
    relabelled AS (SELECT *, list_filter(list_concat(labels, list_filter(coalesce(add_labels, []),
        lambda x: NOT list_contains(labels, x))), lambda x: NOT list_contains(coalesce(remove_labels, []), x)) AS labels_after
      FROM planned)"""
)


def _classified(spark: SparkSession, folder: str) -> DataFrame:
    return rules.classify(archive.documents(spark, folder))


def _merged(spark: SparkSession, folder: str) -> DataFrame:
    """Labels and decisions only; the bodies stay behind."""
    decided = _classified(spark, folder).select("id", "labels", "rule_id", "category", "reason")
    return rules.merge_labels(decided, archive.external_labels(read_table(spark, folder, "labels")))


@MAIL.named(
    "header_normalisation",
    DOCUMENTS + """SELECT id, sender, '' AS recipient, subject, '' AS date,
    CASE WHEN list_id <> '' THEN '<mailto:leave>' ELSE '' END AS list_unsubscribe, list_id FROM messages""",
)
def header_normalisation(spark, folder):
    """Headers with mixed case, repeats and gaps, made from the documents."""
    messages = archive.documents(spark, folder)

    def header(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    listed = F.col("list_id") != ""
    headers = F.concat(
        F.array(header("From", F.lit("someone@else")), header("FROM", F.col("sender")), header("X-Other", F.lit("1"))),
        F.array(header("Subject", F.lit("first")), header("subject", F.col("subject"))),
        F.when(
            listed, F.array(header("List-ID", F.col("list_id")), header("List-Unsubscribe", F.lit("<mailto:leave>")))
        ).otherwise(F.array().cast("array<struct<name:string,value:string>>")),
    )
    return bodies.normalise_headers(messages.select("id", headers.alias("headers")))


@MAIL.named(
    "part_decoding",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 2 AND octet_length(encode(text)) % 3 <> 0 THEN md5('') ELSE md5(text) END AS text_md5
    FROM documents""",
)
def part_decoding(spark, folder):
    """Documents in base64: as sent, in the other alphabet with line breaks, without padding, with too much."""
    text = F.col("text")
    plain = archive.url_safe_base64(text)
    broken = F.regexp_replace(F.base64(F.encode(text, "UTF-8")), "(.{70})", "$1\r\n")
    variant = (
        F.when(F.col("doc_id") % 4 == 0, plain)
        .when(F.col("doc_id") % 4 == 1, broken)
        .when(F.col("doc_id") % 4 == 2, F.rtrim(plain, F.lit("=")))
        .otherwise(F.concat(plain, F.lit("=====")))
    )
    data = read_table(spark, folder, "documents").select("doc_id", variant.alias("data"))
    return with_base64_text(data, "data", "text").select("doc_id", F.md5("text").alias("text_md5"))


LINES_OF_TEXT = r"""trim(regexp_replace(regexp_replace(translate(text, '<>&', '   '), ' *\n[ \n]*', chr(10), 'g'),
    ' +', ' ', 'g'), ' ' || chr(10))"""


BODIES = f"""SELECT CAST(doc_id AS VARCHAR) AS message_id,
    CASE doc_id % 6 WHEN 0 THEN text WHEN 1 THEN text WHEN 4 THEN source || chr(10) || text WHEN 5 THEN ''
      WHEN 2 THEN CASE WHEN {LINES_OF_TEXT} = '' THEN 'left out' ELSE {LINES_OF_TEXT} END
      ELSE {LINES_OF_TEXT} END AS body FROM documents"""


@MAIL.named("body_selection", BODIES)
def body_selection(spark, folder):
    return bodies.select_body(archive.document_parts(read_table(spark, folder, "documents")))


@MAIL.named("export_bodies", BODIES)
def export_bodies(spark, folder):
    """The same bodies by way of a JSON export with nested parts."""
    parts = archive.document_parts(read_table(spark, folder, "documents"))

    def nested(part, below):
        body = F.struct(part["data"].alias("data"))
        fields = [part["mime_type"].alias("mimeType"), body.alias("body")]
        return F.struct(*fields, *([below.alias("parts")] if below is not None else []))

    def under(path, depth, below=None):
        children = F.filter("tree", lambda part: (F.size(part["path"]) == depth) & (F.slice(part["path"], 1, depth - 1) == path))
        return F.transform(children, lambda part: nested(part, below(part["path"]) if below else None))

    trees = parts.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("path", "mime_type", "data"))).alias("tree"))
    root = F.element_at("tree", 1)
    payload = nested(root, under(root["path"], 1, lambda path: under(path, 2)))
    lines = trees.select(F.to_json(F.struct(F.col("message_id").alias("id"), payload.alias("payload"))).alias("value"))
    target = f"{checkpoint_folder(spark)}/export-{uuid.uuid4().hex}"
    lines.write.text(target)
    return bodies.select_body(mailbox.export_parts(mailbox.read_export(spark, target)))


EMAILS = """
WITH messages AS (
  SELECT conv_id || '-' || turn AS id, CAST(conv_id AS VARCHAR) AS thread_id,
    TIMESTAMP '2024-01-01 00:00:00' + to_hours(conv_id % 8760) + to_minutes(turn) AS ts,
    CASE (conv_id + turn) % 8 WHEN 0 THEN 'device@coolkit.cc' WHEN 1 THEN 'info@MojeDatovaSchranka.cz'
      WHEN 2 THEN 'updates-noreply@linkedin.com' ELSE role || '@example.org' END AS sender,
    'box' || (conv_id % 50) || '@example.org' AS recipient,
    CASE (3 * conv_id + turn) % 10 WHEN 0 THEN 'Scene is triggered' WHEN 1 THEN 'Nová zpráva' WHEN 2 THEN 'FAKTURA 7'
      WHEN 3 THEN 'Newsletter: promo and bonus' WHEN 4 THEN 'Special offer' WHEN 5 THEN 'Security alert'
      WHEN 6 THEN 'Invoice overdue' WHEN 7 THEN 'Mail Delivery Failed' ELSE 'Re: ' || role END AS subject,
    'day ' || turn AS date, CASE WHEN turn % 4 = 1 THEN '<mailto:leave>' ELSE '' END AS list_unsubscribe, '' AS list_id,
    CASE WHEN (conv_id + 2 * turn) % 7 <> 0 THEN text END AS body
  FROM conversations),
decided AS (SELECT *,
    CASE WHEN contains(lower(sender), 'coolkit.cc') AND contains(lower(subject), 'scene') THEN 1
      WHEN contains(lower(sender), 'mojedatovaschranka.cz') AND contains(lower(subject), 'nová zpráva') THEN 2
      WHEN contains(lower(subject), 'mail delivery failed') THEN 3
      WHEN contains(lower(subject), 'security alert') THEN 4
      WHEN contains(lower(subject), 'faktura') THEN 5
      WHEN contains(lower(sender), 'updates-noreply@linkedin.com') THEN 6
      WHEN list_unsubscribe <> '' AND (contains(lower(subject), 'newsletter') OR contains(lower(subject), 'special offer')) THEN 7
      WHEN contains(lower(subject), 'newsletter') THEN 8 END AS rule,
    coalesce(string_agg(chr(10) || 'FROM:' || chr(10) || sender || chr(10) || chr(10) || 'SUBJECT:' || chr(10) || subject
      || chr(10) || chr(10) || 'BODY:' || chr(10) || left(coalesce(body, ''), 2500) || chr(10),
      chr(10) || '--- PREVIOUS MESSAGE ---' || chr(10))
      OVER (PARTITION BY thread_id ORDER BY ts, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS thread_context
  FROM messages),
judged AS (SELECT *, CASE WHEN body IS NOT NULL THEN rule END AS rule_id,
    CASE WHEN body IS NULL THEN NULL WHEN rule IN (2, 3, 4) THEN 'IMPORTANT' WHEN rule IN (1, 5) THEN 'NORMAL'
      WHEN rule IN (6, 7, 8) THEN 'ADVERTISEMENT' END AS category FROM decided)
SELECT id, thread_id, ts, sender, recipient, subject, date, list_unsubscribe, md5(thread_context) AS context_md5,
  md5(body) AS body_md5, category, CAST(rule_id AS INT) AS rule_id, CASE WHEN body IS NULL THEN 'unreadable body' END AS cause,
  CASE category WHEN 'IMPORTANT' THEN ['INBOX', 'IMPORTANT', 'AI_PROCESSED', 'AI_IMPORTANT']
    WHEN 'NORMAL' THEN ['INBOX', 'AI_PROCESSED', 'AI_NORMAL'] WHEN 'ADVERTISEMENT' THEN ['AI_PROCESSED', 'AI_ADVERTISEMENT']
    ELSE ['INBOX'] END AS labels_after
FROM judged
"""


def _written(spark: SparkSession, lines: DataFrame, name: str) -> DataFrame:
    """An export of these lines (a column value), written as text and read as an export."""
    target = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    lines.write.text(target)
    return mailbox.read_export(spark, target)


def _conversation_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Turns as lines of a JSON export: mixed header names, nested parts, and html that no parser reads."""
    turns = read_table(spark, folder, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    subjects = (
        "Scene is triggered", "Nová zpráva", "FAKTURA 7", "Newsletter: promo and bonus", "Special offer", "Security alert",
        "Invoice overdue", "Mail Delivery Failed",
    )
    subject, sender = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for number, text in enumerate(subjects):
        subject = subject.when((3 * conv + turn) % 10 == number, text)
    for number, text in enumerate(("device@coolkit.cc", "info@MojeDatovaSchranka.cz", "updates-noreply@linkedin.com")):
        sender = sender.when((conv + turn) % 8 == number, text)
    seconds = F.lit(1_704_067_200) + (conv % 8760) * 3600 + turn * 60

    def header(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    def part(mime, data, below=None):
        body = F.struct(data.alias("data"))
        return F.struct(F.lit(mime).alias("mimeType"), body.alias("body"), *([F.array(*below).alias("parts")] if below else []))

    headers = F.array(
        header("From", sender.otherwise(F.concat("role", F.lit("@example.org")))),
        header("TO", F.concat(F.lit("box"), (conv % 50).cast("string"), F.lit("@example.org"))),
        header("subject", F.lit("an earlier one")),
        header("Subject", subject.otherwise(F.concat(F.lit("Re: "), "role"))),
        header("Date", F.concat(F.lit("day "), turn.cast("string"))),
        header("List-Unsubscribe", F.when(turn % 4 == 1, "<mailto:leave>").otherwise("")),
    )
    unreadable = (conv + 2 * turn) % 7 == 0
    html = F.concat(F.lit("<p>"), F.when(unreadable, F.repeat(F.lit("&#9"), 2)), F.repeat(F.lit("9"), 5_000), F.lit(";"))
    plain = part("text/plain", F.when(~unreadable, archive.url_safe_base64(F.col("text"))))
    nothing = F.lit(None).cast("string")
    page = part("text/html", F.when(unreadable, archive.url_safe_base64(html)))
    tree = part("multipart/mixed", nothing, [part("multipart/alternative", nothing, [plain, page])])
    payload = F.struct(headers.alias("headers"), *[tree[name].alias(name) for name in ("mimeType", "body", "parts")])
    message = F.struct(
        F.concat_ws("-", conv.cast("string"), turn.cast("string")).alias("id"),
        conv.cast("string").alias("threadId"),
        (seconds * 1000).cast("string").alias("internalDate"),
        F.array(F.lit("INBOX")).alias("labelIds"),
        payload.alias("payload"),
    )
    return turns.select(F.to_json(message).alias("value"))


@MAIL.named("email_triage", EMAILS)
def email_triage(spark, folder):
    """From an export to labels: headers, bodies and thread context put together, then the rules."""
    emails = records.email_records(_written(spark, _conversation_lines(spark, folder), "emails"))
    shown = ["thread_id", "ts", "sender", "recipient", "subject", "date", "list_unsubscribe", "context_md5", "body_md5"]
    hashed = emails.withColumns({"context_md5": F.md5("thread_context"), "body_md5": F.md5("body")})
    # Ids are unique: the fields go along, in place of a join of the emails with themselves.
    return triage(hashed, carry=shown).select("id", *shown, "category", "rule_id", "cause", "labels_after")


@MAIL.named("email_triage_stream", EMAILS[: EMAILS.rindex("SELECT id, thread_id")] + """SELECT id, category, CAST(rule_id AS INT) AS rule_id,
  CASE WHEN body IS NULL THEN 'unreadable body' END AS cause,
  CASE category WHEN 'IMPORTANT' THEN ['INBOX', 'IMPORTANT', 'AI_PROCESSED', 'AI_IMPORTANT']
    WHEN 'NORMAL' THEN ['INBOX', 'AI_PROCESSED', 'AI_NORMAL'] WHEN 'ADVERTISEMENT' THEN ['AI_PROCESSED', 'AI_ADVERTISEMENT']
    ELSE ['INBOX'] END AS labels_after FROM judged""")
def email_triage_stream(spark, folder):
    """The same labels from a stream over the lines of an export, in files that arrive over two runs."""
    target = f"{checkpoint_folder(spark)}/emails-{uuid.uuid4().hex}"
    lines = _conversation_lines(spark, folder).withColumn("arrival", F.pmod(F.xxhash64("value"), F.lit(3)))
    for number in range(3):
        lines.filter(F.col("arrival") == number).select("value").write.text(f"{target}/source/file{number}")
    for files in ("file[01]", "file[012]"):
        triage_stream(
            spark, f"{target}/source/{files}", spark.createDataFrame([], "value string").schema, f"{target}/sink", f"{target}/checkpoint",
            form="text", prepare=lambda lines: records.email_records(mailbox.parsed_lines(lines)),
        ).awaitTermination()
    return outcomes(spark, f"{target}/sink").select("id", "category", "rule_id", "cause", "labels_after")


@MAIL.named(
    "export_rejects",
    """SELECT CASE WHEN doc_id % 10 = 2 THEN CAST(doc_id AS VARCHAR) END AS id,
    CASE doc_id % 10 WHEN 0 THEN 'unreadable line' WHEN 1 THEN 'missing id' ELSE 'missing payload' END AS cause, count(*) AS lines
    FROM documents WHERE doc_id % 10 < 3 GROUP BY 1, 2""",
)
def export_rejects(spark, folder):
    """What is wrong with the lines of an export that is cut, or lacks ids or payloads, here and there."""
    kind = F.col("doc_id") % 10
    payload = F.struct(F.lit("text/plain").alias("mimeType"), F.struct(archive.url_safe_base64(F.col("text")).alias("data")).alias("body"))
    whole = F.to_json(
        F.struct(
            F.when(kind != 1, F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("threadId"),
            F.when(kind != 2, payload).alias("payload"),
        )
    )
    lines = read_table(spark, folder, "documents").select(
        F.when(kind == 0, F.left(whole, F.length(whole) - 3)).otherwise(whole).alias("value")
    )
    rejects = mailbox.export_rejects(_written(spark, lines, "rejects"))
    return rejects.groupBy("id", "cause").agg(F.count("*").alias("lines"))


@MAIL.named(
    "part_rejects",
    """WITH d AS (SELECT *, doc_id % 6 AS k, CAST(doc_id AS VARCHAR) AS name FROM documents)
    SELECT name AS message_id, []::INTEGER[] AS path, CAST(NULL AS VARCHAR) AS cause, md5(text) AS body_md5 FROM d WHERE k IN (0, 3, 5)
    UNION ALL SELECT name, [0], 'missing root', NULL FROM d WHERE k = 1
    UNION ALL SELECT name, [], NULL, md5('') FROM d WHERE k = 2
    UNION ALL SELECT name, [0, 0], 'missing parent', NULL FROM d WHERE k = 2
    UNION ALL SELECT name, [0], 'repeated part', NULL FROM d WHERE k = 3
    UNION ALL SELECT NULL, [], 'missing id', NULL FROM d WHERE k = 4""",
)
def part_rejects(spark, folder):
    """Part tables with gaps: every message comes out with a body or with causes, and nothing is counted twice."""
    text = archive.url_safe_base64(F.col("text"))
    none = F.lit(None).cast("string")

    def part(path, mime, data):
        at = F.array(*map(F.lit, path)).cast("array<int>")
        return F.struct(at.alias("path"), F.lit(mime).alias("mime_type"), data.alias("data"))

    deep = F.array(*[part([0] * level, "multipart/mixed", none) for level in range(20)], part([0] * 20, "text/plain", text))
    plain, mixed = part([0], "text/plain", text), part([], "multipart/mixed", none)
    trees = (F.array(part([], "text/plain", text)), F.array(plain), F.array(mixed, part([0, 0], "text/plain", text)), F.array(mixed, plain, plain))
    tree = F.when(F.lit(False), trees[0])
    for number, shape in enumerate((*trees, trees[0], deep)):
        tree = tree.when(F.col("doc_id") % 6 == number, shape)
    name = F.when(F.col("doc_id") % 6 != 4, F.col("doc_id").cast("string"))
    parts = read_table(spark, folder, "documents").select(name.alias("message_id"), F.explode(tree).alias("_p")).select("message_id", "_p.*")
    chosen = bodies.select_body(parts).select(
        "message_id", F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("cause"), F.md5("body").alias("body_md5")
    )
    return chosen.unionByName(bodies.part_rejects(parts).withColumn("body_md5", F.lit(None).cast("string")))


THREAD_CONTEXT = CONVERSATIONS + """SELECT id, coalesce(string_agg(
      chr(10) || 'FROM:' || chr(10) || sender || chr(10) || chr(10) || 'SUBJECT:' || chr(10) || subject
      || chr(10) || chr(10) || 'BODY:' || chr(10) || left(body, 2500) || chr(10),
      chr(10) || '--- PREVIOUS MESSAGE ---' || chr(10))
      OVER (PARTITION BY thread_id ORDER BY thread_pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS thread_context
    FROM messages"""


@MAIL.named("thread_context", THREAD_CONTEXT)
def thread_context(spark, folder):
    return threads.thread_context(archive.conversations(spark, folder)).select("id", "thread_context")


@MAIL.named("thread_context_stream", THREAD_CONTEXT)
def thread_context_of_a_stream(spark, folder):
    """The same context from messages that arrive in four files, out of order and some of them twice, over two runs.

    The second run is a new start from the checkpoint. A large table makes folders of files; a batch takes as many as
    the largest folder has, so there are as many batches at any size.
    """
    target = f"{checkpoint_folder(spark)}/threads-{uuid.uuid4().hex}"
    messages = archive.conversations(spark, folder)
    arrival, again = F.pmod(F.xxhash64("id"), F.lit(4)), F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    files = []
    for number in range(4):
        some = messages.filter((arrival == number) | (again & (F.pmod(arrival + 1, F.lit(4)) == number)))
        some.write.parquet(f"{target}/source/file{number}")
        files.append(len(spark.read.schema(messages.schema).parquet(f"{target}/source/file{number}").inputFiles()))
    for runs in ("file[01]", "file[0123]"):
        thread_context_stream(
            spark, f"{target}/source/{runs}", messages.schema, f"{target}/sink", f"{target}/checkpoint", files_per_batch=max(files),
        ).awaitTermination()
    return latest_contexts(spark.read.parquet(f"{target}/sink")).select("id", "thread_context")


@MAIL.named(
    "context_of_new_messages",
    CONVERSATIONS + """, context AS (SELECT id, labels, coalesce(string_agg(
      chr(10) || 'FROM:' || chr(10) || sender || chr(10) || chr(10) || 'SUBJECT:' || chr(10) || subject
      || chr(10) || chr(10) || 'BODY:' || chr(10) || left(body, 2500) || chr(10),
      chr(10) || '--- PREVIOUS MESSAGE ---' || chr(10))
      OVER (PARTITION BY thread_id ORDER BY thread_pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS thread_context
    FROM messages)
    SELECT id, thread_context FROM context WHERE list_contains(labels, 'INBOX')
    AND NOT list_has_any(labels, ['AI_PROCESSED', 'SENT', 'DRAFT', 'SPAM', 'TRASH'])""",
)
def context_of_new_messages(spark, folder):
    """Thread context of what the live scope still has to process."""
    messages = archive.conversations(spark, folder)
    return threads.context_for(messages, search.unprocessed(messages, search.LIVE)).select("id", "thread_context")


@MAIL.named(
    "turn_history",
    """SELECT conv_id, turn, string_agg(upper(role) || ': ' || text, chr(10))
      OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS history FROM conversations""",
)
def turn_history(spark, folder):
    return threads.turn_history(read_table(spark, folder, "conversations")).select("conv_id", "turn", "history")


@MAIL.named(
    "turn_history_with_gaps",
    """SELECT conv_id % 5 AS conv_id, turn, id, coalesce(string_agg(CASE WHEN (conv_id + turn) % 7 <> 0 THEN upper(role) || ': ' || text END, chr(10))
      OVER (PARTITION BY conv_id % 5 ORDER BY turn, id ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), '') AS history
    FROM (SELECT *, 1000 * conv_id + turn AS id FROM conversations)""",
)
def turn_history_with_gaps(spark, folder):
    """Few long conversations, cut into many stretches, in which some turns have no role and so no line."""
    conv, turn = F.col("conv_id"), F.col("turn")
    turns = read_table(spark, folder, "conversations").select(
        (conv % 5).alias("conv_id"), "turn", (1000 * conv + turn).alias("id"), F.when((conv + turn) % 7 != 0, F.col("role")).alias("role"), "text"
    )
    return threads.turn_history(turns, tie="id", chunk_rows=16).select("conv_id", "turn", "id", "history")


@MAIL.named(
    "rule_classes",
    DOCUMENTS + _classified_sql(MAIL_RULES) + "SELECT id, rule_id, category, reason FROM classified",
)
def rule_classes(spark, folder):
    return _classified(spark, folder).select("id", "rule_id", "category", "reason")


@MAIL.named(
    "rule_classes_other_rules",
    DOCUMENTS + _classified_sql(DOCUMENT_RULES) + "SELECT id, rule_id, category, reason FROM classified",
)
def rule_classes_other_rules(spark, folder):
    classified = rules.classify(archive.documents(spark, folder), DOCUMENT_RULES)
    return classified.select("id", "rule_id", "category", "reason")


@MAIL.named("rule_classes_by_vocabulary", DOCUMENTS + _classified_sql(MAIL_RULES) + "SELECT id, category, reason, rule_id FROM classified")
def rule_classes_by_vocabulary(spark, folder):
    """The mail rules from one pass of an automaton over all their terms."""
    return rules.classify_by_vocabulary(archive.documents(spark, folder)).select("id", "category", "reason", "rule_id")


VOCABULARY = 5_000


@MAIL.named(
    "vocabulary_of_thousands",
    f"""WITH words AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[ \n]+')) AS term FROM documents),
    terms AS (SELECT term FROM words WHERE length(term) BETWEEN 3 AND 40 ORDER BY md5(term), term LIMIT {VOCABULARY})
    SELECT term, count(*) AS documents FROM terms JOIN documents ON contains(lower(text), term) GROUP BY term""",
)
def vocabulary_of_thousands(spark, folder):
    """How many documents hold each of thousands of terms, which are words of the documents themselves."""
    documents = read_table(spark, folder, "documents")
    words = documents.select(F.explode(F.split(F.lower("text"), "[ \n]+")).alias("term")).distinct()
    chosen = words.filter(F.length("term").between(3, 40)).orderBy(F.md5("term"), "term").limit(VOCABULARY)
    terms = [row["term"] for row in chosen.collect()]
    found = rules.find_terms(documents.select("text"), terms, ["text"]).select(F.explode("found_text").alias("number"))
    numbered = spark.createDataFrame(list(enumerate(terms)), "number int, term string")
    counted = found.groupBy("number").agg(F.count("*").alias("documents"))
    return counted.join(numbered, "number").select("term", "documents")


def _signals_sql(terms) -> str:
    hits = " + ".join(f"CAST({_found(('subject', 'body'), term)} AS INT)" for term in terms)
    return DOCUMENTS + f"SELECT id, {hits} AS signal_count FROM messages"


@MAIL.named("signal_counts", _signals_sql(DOCUMENT_TERMS))
def signal_counts(spark, folder):
    return rules.count_signals(archive.documents(spark, folder), DOCUMENT_TERMS).select("id", "signal_count")


@MAIL.named("marketing_signals", _signals_sql(MARKETING_TERMS))
def marketing_signals(spark, folder):
    return rules.count_signals(archive.documents(spark, folder), MARKETING_TERMS).select("id", "signal_count")


@MAIL.named(
    "deferred_messages",
    DOCUMENTS + _classified_sql(MAIL_RULES) + """SELECT id, sender, subject, '' AS date, left(body, 8000) AS body,
    '' AS thread_context FROM classified WHERE category IS NULL""",
)
def deferred_messages(spark, folder):
    return rules.deferred(_classified(spark, folder))


@MAIL.named(
    "deferred_context",
    CONVERSATIONS + """, context AS (SELECT id, sender, subject, body, coalesce(string_agg(
      chr(10) || 'FROM:' || chr(10) || sender || chr(10) || chr(10) || 'SUBJECT:' || chr(10) || subject
      || chr(10) || chr(10) || 'BODY:' || chr(10) || left(body, 2500) || chr(10),
      chr(10) || '--- PREVIOUS MESSAGE ---' || chr(10))
      OVER (PARTITION BY thread_id ORDER BY thread_pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS thread_context
    FROM messages)
    SELECT id, sender, subject, '' AS date, left(body, 8000) AS body, right(thread_context, 6000) AS thread_context
    FROM context WHERE NOT contains(lower(subject), 'the') OR contains(lower(body), 'that ')""",
)
def deferred_context(spark, folder):
    """What an outside judge sees of the turns no rule decides, thread context included."""
    rule = Rule(1, NORMAL, "the", (Terms(("subject",), ("the",)),), exclude=(Terms(("body",), ("that ",)),))
    with_context = threads.thread_context(archive.conversations(spark, folder))
    return rules.deferred(rules.classify(with_context, [rule]))


@MAIL.named(
    "merged_labels",
    DOCUMENTS + MERGED + "SELECT id, category, reason, source FROM merged",
)
def merged_labels(spark, folder):
    return _merged(spark, folder).select("id", "category", "reason", "source")


@MAIL.named(
    "action_plan",
    DOCUMENTS + MERGED + "SELECT id, category, add_labels, remove_labels FROM planned",
)
def action_plan(spark, folder):
    return actions.plan_actions(_merged(spark, folder)).select("id", "category", "add_labels", "remove_labels")


@MAIL.named("applied_labels", DOCUMENTS + MERGED + "SELECT id, labels_after AS labels FROM relabelled")
def applied_labels(spark, folder):
    """The plan was made from these messages, so it already holds their labels."""
    plan = actions.plan_actions(_merged(spark, folder))
    return plan.select("id", actions.changed_labels(F.col("labels"), F.col("add_labels"), F.col("remove_labels")).alias("labels"))


@MAIL.named(
    "stored_labels_changed",
    DOCUMENTS + MERGED + """SELECT r.id, CASE WHEN CAST(r.id AS BIGINT) % 10 IN (3, 4) THEN labels_after ELSE r.labels END AS labels,
    md5(m.body) AS body_md5 FROM relabelled r JOIN messages m ON m.id = r.id""",
)
def stored_labels_changed(spark, folder):
    """Label changes written back to a stored table, of which two slices in ten hold changed messages."""
    target = f"{checkpoint_folder(spark)}/relabelled-{uuid.uuid4().hex}"
    slices = (F.col("id").cast("bigint") % 10).cast("int")
    writeback.store(archive.documents(spark, folder).withColumn("slice", slices), target, "slice")
    plan = actions.plan_actions(_merged(spark, folder)).filter(slices.isin(3, 4))
    writeback.relabel_stored(spark.read.parquet(target), target, "slice", plan)
    return spark.read.parquet(target).select("id", "labels", F.md5("body").alias("body_md5"))


@MAIL.named(
    "applied_labels_dry_run",
    DOCUMENTS + MERGED + "SELECT id, category, source, add_labels, remove_labels, labels AS labels_after FROM planned",
)
def applied_labels_dry_run(spark, folder):
    """The same plan as a real run, and labels as they were."""
    outside = archive.external_labels(read_table(spark, folder, "labels"))
    planned = triage(archive.documents(spark, folder), outside, dry_run=True)
    return planned.select("id", "category", "source", "add_labels", "remove_labels", "labels_after")


LABEL_STATS = """SELECT l AS label, (SELECT count(*) FROM {source} WHERE list_contains({labels}, l)) AS message_count
    FROM (VALUES ('AI_PROCESSED'), ('AI_IMPORTANT'), ('AI_NORMAL'), ('AI_ADVERTISEMENT'), ('AI_UNCERTAIN')) t(l)"""


@MAIL.named("label_stats", DOCUMENTS + MERGED + LABEL_STATS.format(source="relabelled", labels="labels_after"))
def label_stats(spark, folder):
    plan = actions.plan_actions(_merged(spark, folder))
    after = actions.changed_labels(F.col("labels"), F.col("add_labels"), F.col("remove_labels"))
    return search.label_stats(plan.select(after.alias("labels")))


CATEGORY_OF = "CASE {key} % 4 WHEN 0 THEN 'IMPORTANT' WHEN 1 THEN 'NORMAL' WHEN 2 THEN 'ADVERTISEMENT' ELSE 'UNCERTAIN' END"

CALLS = f"""
WITH calls AS (
  SELECT event_id, user_id || '/' || CAST(ts AS DATE) AS message_id, 1 + event_id % 3 AS attempt, event_id AS seq,
    CASE event_type WHEN 'view' THEN 'mark_email_as_important' WHEN 'click' THEN 'archive_advertisement_email'
      WHEN 'signup' THEN 'leave_email_unchanged' WHEN 'error' THEN 'no_such_tool' ELSE 'leave_email_unchanged' END AS tool,
    event_type <> 'error' AS ok,
    CASE WHEN event_id % 10 = 0 THEN 'other' ELSE user_id || '/' || CAST(ts AS DATE) END AS target_id
  FROM events),
known AS (SELECT DISTINCT user_id || '/' || CAST(ts AS DATE) AS id, {CATEGORY_OF.format(key='user_id')} AS category
  FROM events WHERE user_id % 5 <> 4),
audited AS (SELECT c.event_id, c.message_id, k.category, CASE WHEN c.target_id <> c.message_id THEN 'wrong message'
    WHEN (c.tool = 'mark_email_as_important' AND k.category = 'IMPORTANT')
      OR (c.tool = 'archive_advertisement_email' AND k.category = 'ADVERTISEMENT')
      OR (c.tool = 'leave_email_unchanged' AND k.category IN ('NORMAL', 'UNCERTAIN')) THEN NULL
    ELSE 'wrong category' END AS cause
  FROM calls c LEFT JOIN known k ON c.message_id = k.id),
last_calls AS (SELECT c.message_id, attempt, arg_max(ok AND cause IS NULL, seq) AS ok, arg_max(tool, seq) AS tool
  FROM calls c JOIN audited a ON c.event_id = a.event_id WHERE attempt <= 2 GROUP BY 1, 2),
resolved AS (SELECT k.id, k.category,
    CAST(CASE WHEN a.ok THEN 1 WHEN b.ok THEN 2 END AS INT) AS attempt,
    CASE WHEN a.ok THEN a.tool WHEN b.ok THEN b.tool END AS tool,
    CASE WHEN a.ok OR b.ok THEN 'OK' ELSE 'FALLBACK' END AS outcome,
    CASE WHEN a.ok THEN 0 ELSE 1 END AS retries
  FROM known k LEFT JOIN last_calls a ON a.message_id = k.id AND a.attempt = 1
  LEFT JOIN last_calls b ON b.message_id = k.id AND b.attempt = 2)
"""


def _message_of(events: DataFrame) -> DataFrame:
    day = F.col("ts").cast("date").cast("string")
    return events.withColumn("message_id", F.concat(F.col("user_id").cast("string"), F.lit("/"), day))


def _calls(spark: SparkSession, folder: str) -> DataFrame:
    """Events as tool calls: a user's events of a day are calls about one message."""
    tool = (
        F.when(F.col("event_type") == "view", "mark_email_as_important")
        .when(F.col("event_type") == "click", "archive_advertisement_email")
        .when(F.col("event_type") == "error", "no_such_tool")
        .otherwise("leave_email_unchanged")
    )
    return _message_of(read_table(spark, folder, "events")).select(
        "event_id",
        "message_id",
        (1 + F.col("event_id") % 3).alias("attempt"),
        F.col("event_id").alias("seq"),
        tool.alias("tool"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(F.col("event_id") % 10 == 0, "other").otherwise(F.col("message_id")).alias("target_id"),
    )


def _known_messages(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("user_id") % 4
    category = F.when(key == 0, IMPORTANT).when(key == 1, NORMAL).when(key == 2, ADVERTISEMENT)
    events = _message_of(read_table(spark, folder, "events")).filter(F.col("user_id") % 5 != 4)
    return events.select(F.col("message_id").alias("id"), category.otherwise(UNCERTAIN).alias("category")).distinct()


@MAIL.named(
    "action_audit",
    CALLS + """SELECT event_id, message_id, cause, CASE WHEN cause IS NULL THEN 'OK' ELSE 'BLOCKED' END AS verdict
    FROM audited""",
)
def action_audit(spark, folder):
    audited = actions.audit_actions(_calls(spark, folder), _known_messages(spark, folder))
    return audited.select("event_id", "message_id", "cause", "verdict")


@MAIL.named("attempt_resolution", CALLS + "SELECT id, category, attempt, tool, outcome, retries FROM resolved")
def attempt_resolution(spark, folder):
    known = _known_messages(spark, folder)
    audited = actions.audit_actions(_calls(spark, folder), known).drop("category")
    return actions.resolve_attempts(known, audited)


@MAIL.named(
    "run_stats",
    DOCUMENTS + MERGED + "," + CALLS.replace("WITH calls", "calls", 1) + """
    SELECT * FROM (
      SELECT 'processed' AS counter, count(category) AS value FROM merged
      UNION ALL SELECT c, (SELECT count(*) FROM merged WHERE category = c)
        FROM (VALUES ('IMPORTANT'), ('NORMAL'), ('ADVERTISEMENT'), ('UNCERTAIN')) t(c)
      UNION ALL SELECT 'rules', count(*) FROM merged WHERE source = 'rule'
      UNION ALL SELECT 'llm', count(*) FROM merged WHERE source = 'external'
      UNION ALL SELECT 'tool_calls', count(*) FROM audited
      UNION ALL SELECT 'tool_blocked', count(cause) FROM audited
      UNION ALL SELECT 'tool_retries', CAST(sum(retries) AS BIGINT) FROM resolved
      UNION ALL SELECT 'fallback_actions', count(*) FROM resolved WHERE outcome = 'FALLBACK'
      UNION ALL SELECT 'errors', count(*) FROM merged WHERE category IS NULL)""",
)
def run_stats(spark, folder):
    merged = _merged(spark, folder)
    known = _known_messages(spark, folder)
    audited = actions.audit_actions(_calls(spark, folder), known).drop("category")
    return runstats.run_stats(
        merged,
        audited,
        actions.resolve_attempts(known, audited),
        F.col("category").isNull(),
    )


@MAIL.named(
    "label_tallies",
    CONVERSATIONS + """, first AS (SELECT *, thread_id % 3 AS part FROM messages),
    final AS (SELECT ts, CASE WHEN part = 0 THEN list_filter(labels, lambda x: x <> 'UNREAD')
        WHEN part = 1 AND thread_pos % 2 = 0 THEN list_concat(list_filter(labels, lambda x: x NOT IN ('AI_PROCESSED', 'INBOX')), ['AI_PROCESSED'])
        ELSE labels END AS labels FROM first WHERE NOT (part = 2 AND thread_pos = 1))
    SELECT label, CAST(ts AS DATE) AS day, count(*) AS messages FROM (SELECT ts, unnest(list_distinct(labels)) AS label FROM final) GROUP BY 1, 2""",
)
def label_tallies(spark, folder):
    """Label counts by day from four change sets, one of them written twice, with a fold in between."""
    target = f"{checkpoint_folder(spark)}/tallies-{uuid.uuid4().hex}"
    messages = archive.conversations(spark, folder).withColumn("part", F.col("thread_id") % 3)
    none = F.array().cast("array<string>")
    labels = F.col("labels")
    moved = F.array_append(F.filter(labels, lambda x: ~x.isin("AI_PROCESSED", "INBOX")), F.lit("AI_PROCESSED"))
    batches = [
        (F.lit(True), none, labels),
        (F.col("part") == 0, labels, F.filter(labels, lambda x: x != "UNREAD")),
        ((F.col("part") == 1) & (F.col("thread_pos") % 2 == 0), labels, moved),
        ((F.col("part") == 2) & (F.col("thread_pos") == 1), labels, none),
    ]

    def record(number):
        which, before, after = batches[number]
        changes = messages.filter(which).select("ts", before.alias("labels_before"), after.alias("labels_after"))
        tally.record(changes, target, number)

    for number in (0, 1, 1):
        record(number)
    tally.fold(spark, target)
    for number in (1, 2, 3, 2):
        record(number)
    return tally.tallies(spark, target)


@MAIL.named(
    "quarantined_events",
    """SELECT event_id, CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS INT) IS NULL THEN 'unreadable properties'
      WHEN TRY_CAST(json_extract_string(props, '$.k') AS INT) > 90 THEN 'out of range'
      WHEN event_type = 'error' THEN 'failed' END AS cause FROM events""",
)
def quarantined_events(spark, folder):
    number = F.get_json_object("props", "$.k").try_cast("int")
    judged = actions.with_cause(
        read_table(spark, folder, "events").select("event_id", "event_type", "props"),
        {
            "unreadable properties": number.isNull(),
            "out of range": number > 90,
            "failed": F.col("event_type") == "error",
        },
    )
    return judged.select("event_id", "cause")


@MAIL.named(
    "run_time",
    """SELECT user_id, CAST(s AS BIGINT) AS seconds,
      CASE WHEN s >= 3600 THEN (s // 3600) || ' h ' || (s % 3600 // 60) || ' min ' || (s % 60) || ' s'
        WHEN s >= 60 THEN (s // 60) || ' min ' || (s % 60) || ' s' ELSE s || ' s' END AS run_time
    FROM (SELECT user_id, CAST(floor(sum(CAST(round(value * 100) AS BIGINT)) / 100) AS BIGINT) AS s FROM events GROUP BY 1)""",
)
def run_time(spark, folder):
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    spent = read_table(spark, folder, "events").groupBy("user_id").agg((cents / 100).alias("spent"))
    return spent.select("user_id", F.floor("spent").alias("seconds"), duration_text(F.col("spent")).alias("run_time"))


GUARD = "NOT list_has_any(labels, ['AI_PROCESSED', 'SENT', 'DRAFT', 'SPAM', 'TRASH'])"


@MAIL.named("backlog_scope", CONVERSATIONS + f"SELECT id, labels FROM messages WHERE {GUARD}")
def backlog_scope(spark, folder):
    return search.unprocessed(archive.conversations(spark, folder), search.CLEANUP).select("id", "labels")


@MAIL.named(
    "inbox_scope",
    CONVERSATIONS + f"SELECT id, labels FROM messages WHERE list_contains(labels, 'INBOX') AND {GUARD}",
)
def inbox_scope(spark, folder):
    return search.unprocessed(archive.conversations(spark, folder), search.LIVE).select("id", "labels")


@MAIL.named(
    "message_filter",
    CONVERSATIONS + """SELECT id, ts, sender, recipient, subject FROM messages
    WHERE contains(lower(sender), 'user@') AND contains(lower(recipient), 'box1') AND contains(lower(subject), 'th')
    AND ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-03-01'
    AND list_contains(labels, 'INBOX') AND list_contains(labels, 'UNREAD')""",
)
def message_filter(spark, folder):
    found = search.filter_messages(
        archive.conversations(spark, folder), from_="User@", to="box1", subject="Th",
        after="2024-01-02", before="2024-03-01", in_="inbox", is_="unread",
    )
    return found.select("id", "ts", "sender", "recipient", "subject")


INDEXED = {"few": {"sender": "User@", "subject": "Th"}, "rare": {"subject": "tion la"}, "short": {"recipient": "4"}, "none": {"subject": "no such text"}}


@MAIL.named(
    "message_search_indexed",
    CONVERSATIONS + " UNION ALL ".join(
        f"SELECT '{name}' AS search, id, subject FROM messages WHERE "
        + " AND ".join(f"contains(lower({column}), '{text.lower()}')" for column, text in texts.items())
        for name, texts in INDEXED.items()
    ),
)
def message_search_indexed(spark, folder):
    """Substring searches over an index of the messages by runs of three characters."""
    target = f"{checkpoint_folder(spark)}/grams-{uuid.uuid4().hex}"
    gram_index.build_index(archive.conversations(spark, folder), target, ["ts", "id"], block_rows=200)
    found = [
        gram_index.search_index(spark, target, **texts).select(F.lit(name).alias("search"), "id", "subject") for name, texts in INDEXED.items()
    ]
    return reduce(DataFrame.unionByName, found)


@MAIL.named(
    "message_filter_ages",
    CONVERSATIONS + """SELECT id, ts FROM messages
    WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 30 DAY AND ts < TIMESTAMP '2024-02-01' - INTERVAL 7 DAY
    AND NOT list_contains(labels, 'SENT') AND NOT list_contains(labels, 'AI_NORMAL')""",
)
def message_filter_ages(spark, folder):
    found = search.filter_messages(
        archive.conversations(spark, folder), newer_than="30d", older_than="7d", today="2024-02-01",
        exclude_in=["sent"], exclude_label=["AI_NORMAL"],
    )
    return found.select("id", "ts")


@MAIL.named(
    "message_count",
    CONVERSATIONS + """SELECT count(*) AS message_count FROM messages WHERE list_contains(labels, 'INBOX')
    AND ts >= TIMESTAMP '2024-01-05'""",
)
def message_count(spark, folder):
    return search.count_messages(archive.conversations(spark, folder), label="INBOX", after="2024-01-05")


def _preview_sql(text: str, length: int) -> str:
    return f"CASE WHEN length({text}) > {length} THEN left({text}, {length}) || '...' ELSE {text} END"


COLLAPSED = r"trim(regexp_replace(body, '\s+', ' ', 'g'))"


@MAIL.named(
    "message_search",
    CONVERSATIONS + f"""SELECT id, sender, ts, subject, {_preview_sql('body', 350)} AS body FROM (
      SELECT id, sender, ts, subject, {_preview_sql(COLLAPSED, 1200)} AS body FROM messages
      WHERE NOT list_contains(labels, 'SENT') ORDER BY ts DESC, id LIMIT 25)""",
)
def message_search(spark, folder):
    return search.search_messages(archive.conversations(spark, folder), limit=25, exclude_in=["sent"])


@MAIL.named(
    "message_details",
    CONVERSATIONS + f"""SELECT id, sender, ts, subject, labels, {_preview_sql(COLLAPSED, 1200)} AS body FROM messages
    WHERE thread_id IN (SELECT doc_id FROM labels WHERE toxic = 1)""",
)
def message_details(spark, folder):
    """Details of every message in a thread that a label table points at."""
    messages = archive.conversations(spark, folder)
    marked = read_table(spark, folder, "labels").filter(F.col("toxic") == 1)
    ids = messages.join(marked, F.col("thread_id") == F.col("doc_id"), "left_semi").select("id")
    return search.message_details(messages, ids)


@MAIL.named(
    "triage",
    DOCUMENTS + MERGED + """SELECT id, labels, category, reason, rule_id, source, add_labels, remove_labels, labels_after,
    CAST(NULL AS VARCHAR) AS cause FROM relabelled""",
)
def triage_documents(spark, folder):
    return triage(archive.documents(spark, folder), archive.external_labels(read_table(spark, folder, "labels")))


TRIAGE_STREAM = DOCUMENTS + MERGED + "SELECT id, category, source, labels_after FROM relabelled"


def _document_stream(spark, folder, target, external=None, prepare=archive.document_messages):
    """Triage of the files of the document table; the pattern takes a table of one file as well as a folder of files."""
    return triage_stream(
        spark,
        f"{folder}/documents.parque[t]",
        read_table(spark, folder, "documents").schema,
        f"{target}/sink",
        f"{target}/checkpoint",
        external=external,
        prepare=prepare,
    )


@MAIL.named("triage_stream", TRIAGE_STREAM)
def triage_from_stream(spark, folder):
    """The same triage as an incremental run over the document files, drained to the end."""
    target = f"{checkpoint_folder(spark)}/triage-{uuid.uuid4().hex}"
    labels = archive.external_labels(read_table(spark, folder, "labels"))
    _document_stream(spark, folder, target, labels).awaitTermination()
    return spark.read.parquet(f"{target}/sink").select("id", "category", "source", "labels_after")


@MAIL.named("triage_stream_resumed", TRIAGE_STREAM)
def triage_stream_resumed(spark, folder):
    """A run without outside labels, and a second one after they have arrived: as if they had been there at once."""
    target = f"{checkpoint_folder(spark)}/triage-{uuid.uuid4().hex}"
    _document_stream(spark, folder, target).awaitTermination()
    triage_waiting(spark, f"{target}/sink", archive.external_labels(read_table(spark, folder, "labels")))
    return outcomes(spark, f"{target}/sink").select("id", "category", "source", "labels_after")


@MAIL.named("triage_ledger", DOCUMENTS + MERGED + "SELECT id, category, 1::BIGINT AS times FROM relabelled WHERE category IS NOT NULL")
def triage_ledger(spark, folder):
    """Messages delivered up to three times without their labels: each is labelled once, as the ledger has its id."""
    target = f"{checkpoint_folder(spark)}/ledger-{uuid.uuid4().hex}"
    messages = archive.documents(spark, folder).withColumn("arrival", F.pmod(F.xxhash64("id"), F.lit(3)))
    for number in range(3):
        again = (F.col("arrival") == number) | ((F.col("arrival") < number) & (F.pmod(F.crc32("id"), F.lit(2)) == 0))
        messages.filter(again).drop("arrival").write.parquet(f"{target}/source/file{number}")
    labels = archive.external_labels(read_table(spark, folder, "labels"))
    for files in ("file0", "file[01]", "file[012]"):
        triage_stream(
            spark, f"{target}/source/{files}", messages.drop("arrival").schema, f"{target}/sink", f"{target}/checkpoint",
            external=labels, skip_labelled=True,
        ).awaitTermination()
    labelled = spark.read.parquet(f"{target}/sink").filter(F.col("category").isNotNull())
    return labelled.groupBy("id").agg(F.max("category").alias("category"), F.count("*").alias("times"))


@MAIL.named(
    "triage_given_up",
    DOCUMENTS + MERGED + """, kinds AS (SELECT *, CAST(id AS BIGINT) % 50 AS kind FROM relabelled)
    SELECT 'outcome' AS kind, CASE WHEN kind > 1 THEN category END AS category,
      CASE kind WHEN 0 THEN 'missing id' WHEN 1 THEN 'unreadable body' END AS cause, count(*) AS messages FROM kinds GROUP BY 1, 2, 3
    UNION ALL SELECT 'rejected', NULL, CASE kind WHEN 0 THEN 'missing id' ELSE 'unreadable body' END, count(*)
    FROM kinds WHERE kind < 2 GROUP BY 3
    UNION ALL SELECT 'waiting', NULL, NULL, count(*) FROM kinds WHERE kind > 1 AND category IS NULL""",
)
def triage_given_up(spark, folder):
    """Messages without id or body among the others, taken up until they are given up; the others keep waiting for a label."""
    target = f"{checkpoint_folder(spark)}/given-up-{uuid.uuid4().hex}"

    def prepare(documents):
        messages = archive.document_messages(documents)
        kind = F.col("id").cast("bigint") % 50
        return messages.withColumns({"body": F.when(kind != 1, F.col("body")), "id": F.when(kind != 0, F.col("id"))})

    sink = f"{target}/sink"
    _document_stream(spark, folder, target, prepare=prepare).awaitTermination()
    labels = archive.external_labels(read_table(spark, folder, "labels"))
    for _ in range(3):
        triage_waiting(spark, sink, labels)
    settled = outcomes(spark, sink).groupBy("category", "cause").agg(F.count("*").alias("messages"))
    rejected = spark.read.parquet(f"{sink}_rejects").groupBy("cause").agg(F.count("*").alias("messages"))
    last = spark.read.parquet(f"{sink}_stats").groupBy("batch").agg(F.max("attempt").alias("attempt"))
    waiting = spark.read.parquet(f"{sink}_waiting").join(last, ["batch", "attempt"], "left_semi").agg(F.count("*").alias("messages"))
    none = F.lit(None).cast("string")
    return (
        settled.select(F.lit("outcome").alias("kind"), "category", "cause", "messages")
        .unionByName(rejected.select(F.lit("rejected").alias("kind"), none.alias("category"), "cause", "messages"))
        .unionByName(waiting.select(F.lit("waiting").alias("kind"), none.alias("category"), none.alias("cause"), "messages"))
    )
