import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.operators import actions, rules, runstats, search
from tidemill.sources.archive import document_messages, external_labels
from tidemill.sources.star import read_table
from tidemill.streaming.triage import outcomes, triage, triage_stream, triage_waiting

MESSAGE = "id string, sender string, subject string, body string, list_unsubscribe string, list_id string"


def classified(spark, *messages):
    rows = [(str(n), *message, *[""] * (5 - len(message))) for n, message in enumerate(messages)]
    df = rules.classify(spark.createDataFrame(rows, MESSAGE))
    return [(row.category, row.rule_id) for row in df.orderBy(F.col("id").cast("int")).collect()]


def test_each_rule_and_its_near_miss(spark):
    got = classified(
        spark,
        ("x@coolkit.cc", "Scene is triggered", ""),
        ("x@coolkit.cc", "Invoice", ""),
        ("a@mojedatovaschranka.cz", "Nová ZPRÁVA", ""),
        ("b@else.cz", "Nová zpráva", ""),
        ("", "", "It Could not be delivered."),
        ("postmaster@x", "postmaster", "postmaster"),
        ("", "Verification code 1", ""),
        ("", "Faktura 12", ""),
        ("", "Faktura 12", "je po splatnosti"),
        ("", "", "faktura"),
        ("updates-noreply@linkedin.com", "", ""),
        ("jobs@linkedin.com", "", ""),
        ("", "", "sleva", "", "list"),
        ("", "", "sleva"),
        ("", "promo", "bonus"),
        ("", "promo promo", "promo"),
        ("", "Security alert", "newsletter promo"),
        ("", "", "sleva", "<mailto:x>", ""),
    )
    assert got == [
        ("NORMAL", 1), ("NORMAL", 5), ("IMPORTANT", 2), (None, None), ("IMPORTANT", 3), (None, None),
        ("IMPORTANT", 4), ("NORMAL", 5), (None, None), (None, None), ("ADVERTISEMENT", 6), (None, None),
        ("ADVERTISEMENT", 7), (None, None), ("ADVERTISEMENT", 8), (None, None), ("IMPORTANT", 4),
        ("ADVERTISEMENT", 7),
    ]


def test_missing_texts_are_empty(spark):
    df = spark.createDataFrame([("1", None, None, None, None, None)], MESSAGE)
    assert rules.classify(df).first().category is None
    assert rules.count_signals(df, rules.MARKETING_TERMS).first().signal_count == 0


def test_signals_count_different_terms(spark):
    df = spark.createDataFrame([("1", "", "Promo", "promo BONUS bonus sleva", "", "")], MESSAGE)
    assert rules.count_signals(df, rules.MARKETING_TERMS).first().signal_count == 3


def test_a_filter_on_the_outcome_does_not_repeat_the_rules(spark):
    df = spark.createDataFrame([("1", "", "", "", "", "")], MESSAGE)
    plan = rules.classify(df).filter("category IS NULL")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("delivery status notification") <= 2  # subject and body, once


def test_deferred_messages_are_clipped(spark):
    df = spark.createDataFrame([("1", "s", "u", "b" * 9_000, "d", "x" + "c" * 6_000, None)],
                               "id string, sender string, subject string, body string, date string, thread_context string, category string")
    row = rules.deferred(df).first()
    assert (len(row.body), row.thread_context) == (8_000, "c" * 6_000)


def test_external_labels_fill_in(spark):
    decided = spark.createDataFrame([("1", "NORMAL", "rule"), ("2", None, None), ("3", None, None), ("4", None, None)],
                                    "id string, category string, reason string")
    outside = spark.createDataFrame(
        [("1", "IMPORTANT", "x"), ("2", "UNCERTAIN", "y"), ("2", "UNCERTAIN", "y"), ("3", "SPAM", "z")],
        "id string, category string, reason string")
    got = {row.id: (row.category, row.reason, row.source) for row in rules.merge_labels(decided, outside).collect()}
    assert got == {"1": ("NORMAL", "rule", "rule"), "2": ("UNCERTAIN", "y", "external"),
                   "3": (None, None, None), "4": (None, None, None)}


def test_label_changes_are_idempotent(spark):
    messages = spark.createDataFrame([("1", ["INBOX", "INBOX"]), ("2", ["INBOX"]), ("3", None), ("4", ["X"])], "id string, labels array<string>")
    decided = spark.createDataFrame([("1", "ADVERTISEMENT"), ("2", "IMPORTANT"), ("3", "UNCERTAIN"), ("4", None)], "id string, category string")
    plan = actions.plan_actions(decided)
    once = actions.apply_actions(messages, plan)
    twice = actions.apply_actions(once, plan)
    expected = {
        "1": ["AI_PROCESSED", "AI_ADVERTISEMENT"],
        "2": ["INBOX", "IMPORTANT", "AI_PROCESSED", "AI_IMPORTANT"],
        "3": ["AI_PROCESSED", "AI_UNCERTAIN"],
        "4": ["X"],
    }
    assert {row.id: row.labels for row in once.collect()} == expected
    assert {row.id: row.labels for row in twice.collect()} == expected
    assert actions.apply_actions(messages, plan, dry_run=True) is messages


def test_audit(spark):
    decided = spark.createDataFrame([("1", "IMPORTANT"), ("2", "UNCERTAIN")], "id string, category string")
    calls = spark.createDataFrame(
        [(0, "1", "1", "mark_email_as_important"), (1, "1", "2", "mark_email_as_important"),
         (2, "1", "1", "archive_advertisement_email"), (3, "2", "2", "leave_email_unchanged"),
         (4, "2", "2", "unknown"), (5, "9", "9", "leave_email_unchanged"), (6, "1", None, "mark_email_as_important")],
        "n int, message_id string, target_id string, tool string")
    got = {row.n: (row.verdict, row.cause) for row in actions.audit_actions(calls, decided).collect()}
    assert got == {
        0: ("OK", None), 1: ("BLOCKED", "wrong message"), 2: ("BLOCKED", "wrong category"), 3: ("OK", None),
        4: ("BLOCKED", "wrong category"), 5: ("BLOCKED", "wrong category"), 6: ("BLOCKED", "wrong message"),
    }


def test_attempts(spark):
    plan = spark.createDataFrame([(str(n),) for n in range(1, 7)], "id string")
    log = spark.createDataFrame(
        [("1", 1, 1, "a", True), ("2", 1, 1, "a", False), ("2", 2, 1, "b", True), ("3", 1, 1, "a", False),
         ("3", 2, 1, "a", False), ("4", 1, 1, "a", True), ("4", 1, 2, "b", False), ("6", 3, 1, "a", True)],
        "message_id string, attempt int, seq int, tool string, ok boolean")
    got = {row.id: (row.outcome, row.attempt, row.tool, row.retries) for row in actions.resolve_attempts(plan, log).collect()}
    assert got == {
        "1": ("OK", 1, "a", 0), "2": ("OK", 2, "b", 1), "3": ("FALLBACK", None, None, 1),
        "4": ("FALLBACK", None, None, 1), "5": ("FALLBACK", None, None, 1), "6": ("FALLBACK", None, None, 1),
    }


ARCHIVE = "id string, sender string, recipient string, subject string, body string, labels array<string>, ts timestamp_ntz"


@pytest.fixture(scope="module")
def archive(spark):
    def row(n, day, labels, subject="s"):
        return (f"{n:03d}", "News <N@Seznam.cz>", "me", subject, "b " * 1_000, labels, datetime.datetime.fromisoformat(day))

    return spark.createDataFrame(
        [row(1, "2026-06-30T23:59:59", ["INBOX"]), row(2, "2026-07-01", ["INBOX", "UNREAD"]),
         row(3, "2026-07-31T23:59:59", ["SENT"]), row(4, "2026-08-01", ["INBOX", "AI_PROCESSED", "AI_NORMAL"]),
         row(5, "2026-07-27", ["SPAM"]), row(6, "2026-07-28", ["ARCHIVE"], "Účet")], ARCHIVE)


def ids(df):
    return sorted(row.id for row in df.collect())


def test_scopes(archive):
    assert ids(search.unprocessed(archive, "cleanup")) == ["001", "002", "006"]
    assert ids(search.unprocessed(archive, "live")) == ["001", "002"]
    with pytest.raises(ValueError):
        search.unprocessed(archive, "chat")


def test_filters(archive):
    def found(**terms):
        return ids(search.filter_messages(archive, **terms))

    assert found(after="2026-07-01", before="2026-08-01") == ["002", "003", "005", "006"]
    assert found(after="2026-07-01", before="2026-08-01", exclude_in=["sent"]) == ["002", "005", "006"]
    assert found(newer_than="30d", today="2026-08-26") == ["003", "004", "005", "006"]
    assert found(older_than="1m", today="2026-08-01") == ["001"]
    assert found(from_="seznam.CZ", is_="unread") == ["002"]
    assert found(is_="read", in_="spam") == ["005"]
    assert found(subject="účet") == ["006"]
    assert found(label="AI_NORMAL") == ["004"]
    with pytest.raises(ValueError):
        found(newer_than="1d")
    assert search.count_messages(archive, in_="inbox").first().message_count == 3


def test_search_limits_and_order(spark, archive):
    assert [row.id for row in search.search_messages(archive, limit=0).collect()] == ["004"]
    many = archive.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(50))))
    assert search.search_messages(many.drop("n"), limit=500).count() == 100
    newest = search.search_messages(archive).first()
    assert len(newest.body) == 353 and newest.body.endswith("...")


def test_details(spark, archive):
    wanted = spark.createDataFrame([("002",), ("404",)], "id string")
    for found in (search.message_details(archive, wanted), search.message_details(archive, ["002", "404"])):
        row = found.first()
        assert found.count() == 1 and len(row.body) == 1_203 and row.labels == ["INBOX", "UNREAD"]


def test_label_statistics_show_absent_labels(archive):
    got = {row.label: row.message_count for row in search.label_stats(archive).collect()}
    assert got == {"AI_PROCESSED": 1, "AI_IMPORTANT": 0, "AI_NORMAL": 1, "AI_ADVERTISEMENT": 0, "AI_UNCERTAIN": 0}


def test_run_statistics_of_messages_alone(spark):
    triaged = spark.createDataFrame([("NORMAL", "rule"), ("NORMAL", "external"), (None, None)], "category string, source string")
    got = {row.counter: row.value for row in runstats.run_stats(triaged).collect()}
    assert len(got) == 12
    assert (got["processed"], got["NORMAL"], got["rules"], got["llm"], got["errors"]) == (2, 2, 1, 1, 0)


def test_quarantine_keeps_the_first_cause(spark):
    df = spark.createDataFrame([(1, "x"), (None, "x"), (None, None)], "id int, v string")
    fit, rejected = actions.quarantine(df, {"no id": F.col("id").isNull(), "no value": F.col("v") != "x"})
    assert fit.count() == 1
    assert [row.cause for row in rejected.collect()] == ["no id", "no id"]


@pytest.fixture()
def stream(spark, small, tmp_path):
    """Six message files and the means to run over them."""
    messages = document_messages(read_table(spark, small, "documents"))
    first = messages.limit(1)
    extra = first.withColumn("id", F.lit(None).cast("string")).unionByName(
        first.withColumns({"id": F.lit("no body"), "body": F.lit(None).cast("string")})
    )
    source = tmp_path / "in"
    messages.unionByName(extra).repartition(6).write.parquet(str(source))
    outside = external_labels(read_table(spark, small, "labels"))

    def run(**options):
        query = triage_stream(
            spark, str(source), messages.schema, str(tmp_path / "out"), str(tmp_path / "ckpt"),
            external=outside, **options)
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    return run, messages, outside, source, tmp_path


def essentials(df):
    return sorted((row.id or "", row.category or "", row.source or "", tuple(row.labels_after)) for row in df.collect())


def test_stream_equals_batch_and_resumes(spark, stream):
    run, messages, outside, source, folder = stream
    out = run(files_per_batch=2)
    whole = triage(spark.read.parquet(str(source)), outside)
    assert essentials(out) == essentials(whole)
    assert out.select("batch").distinct().count() == 3
    assert sorted(row.cause for row in out.filter("cause IS NOT NULL").collect()) == ["missing id", "unreadable body"]
    stats = spark.read.parquet(str(folder / "out_stats"))
    totals = {row.counter: row.n for row in stats.groupBy("counter").agg(F.sum("value").alias("n")).collect()}
    assert totals["processed"] == whole.filter("category IS NOT NULL").count() and totals["errors"] == 2

    count = out.count()
    assert run(files_per_batch=2).count() == count
    # A file that brings old messages again, and one new one, adds the new one only
    # (besides those no one could decide before).
    undecided = out.filter("category IS NULL AND cause IS NULL").count()
    fresh = messages.limit(1).withColumns({"id": F.lit("new"), "subject": F.lit("Security alert")})
    messages.unionByName(fresh).coalesce(1).write.mode("append").parquet(str(source))
    again = run(skip_labelled=True)
    assert again.count() == count + undecided + 1
    assert again.filter("id = 'new'").first().category == "IMPORTANT"


def test_live_dry_run_takes_one_batch_and_changes_nothing(spark, stream):
    run, messages, _, _, _ = stream
    out = run(scope="live", dry_run=True)
    assert out.select("batch").distinct().count() == 1
    assert out.filter("labels_after <> labels").count() == 0
    assert out.filter("category IS NOT NULL").count() > 0


def test_repeated_batch_leaves_one_copy(spark, stream):
    """Losing the commit of the last batch makes the stream write that batch again."""
    run, _, _, _, folder = stream
    before = essentials(run(files_per_batch=3))
    last = max((folder / "ckpt" / "commits").glob("[0-9]*"), key=lambda path: int(path.name))
    for path in (last, last.with_name(f".{last.name}.crc")):
        path.unlink(missing_ok=True)
    assert essentials(run(files_per_batch=3)) == before


def test_undecided_messages_come_back(spark, stream):
    run, messages, outside, source, folder = stream
    ahead = outside.limit(0)
    out = str(folder / "later")
    triage_stream(spark, str(source), messages.schema, out, str(folder / "later-ckpt"), external=ahead, files_per_batch=2).awaitTermination()
    assert outcomes(spark, out).filter("category IS NULL").count() > 2
    assert triage_waiting(spark, out, outside)
    whole = triage(spark.read.parquet(str(source)), outside)
    assert essentials(outcomes(spark, out)) == essentials(whole)
    # What only lacks a label goes on waiting, once; what cannot be handled is given up after three attempts.
    waiting = whole.filter("category IS NULL").count()
    assert triage_waiting(spark, out, outside)
    assert outcomes(spark, out).filter("category IS NULL").count() == waiting
    rejects = spark.read.parquet(f"{out}_rejects")
    assert sorted(row.cause for row in rejects.collect()) == ["missing id", "unreadable body"]
    assert rejects.filter("cause = 'missing id'").first().body is not None
    assert triage_waiting(spark, out, outside) == (waiting > 2)
    assert rejects.count() == spark.read.parquet(f"{out}_rejects").count() == 2
    assert essentials(outcomes(spark, out)) == essentials(whole)
    assert not triage_waiting(spark, str(folder / "nothing"))


def test_messages_without_id_are_not_one(spark, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(None, "one", ["INBOX"]), (None, "two", ["INBOX"]), (None, "Security alert", ["INBOX"]), ("1", "Security alert", ["INBOX"])]
    fields = "id string, subject string, labels array<string>"
    texts = {name: F.lit("") for name in ("sender", "body", "list_unsubscribe", "list_id")}
    messages = spark.createDataFrame(rows, fields).withColumns(texts)
    messages.write.parquet(source)
    triage_stream(spark, source, messages.schema, sink, str(tmp_path / "ckpt")).awaitTermination()
    assert [row.category for row in outcomes(spark, sink).orderBy("id").collect()] == [None, None, None, "IMPORTANT"]
    assert triage_waiting(spark, sink)
    assert outcomes(spark, sink).count() == 4


def test_a_settled_attempt_is_not_taken_up_again(spark, stream):
    run, messages, outside, source, folder = stream
    out = str(folder / "settled")
    decided = messages.select("id", F.lit("NORMAL").alias("category"), F.lit("said so").alias("reason"))
    triage_stream(spark, str(source), messages.schema, out, str(folder / "settled-ckpt"), files_per_batch=2).awaitTermination()
    assert triage_waiting(spark, out, decided, give_up_after=2)
    assert outcomes(spark, out).filter("category IS NULL AND cause IS NULL").count() == 0
    assert not triage_waiting(spark, out, decided)
    # Statistics are written last: without them an attempt is made again and leaves one copy.
    before = essentials(outcomes(spark, out))
    attempts = spark.read.parquet(f"{out}_stats").filter("attempt = 1")
    assert attempts.select("batch").distinct().count() == 3
    for path in (folder / "settled_stats").glob("batch=*/attempt=1/*"):
        path.unlink()
    assert triage_waiting(spark, out, decided, give_up_after=2)
    assert essentials(outcomes(spark, out)) == before and not triage_waiting(spark, out, decided)


def test_a_new_checkpoint_over_an_old_sink_is_refused(spark, stream):
    run, messages, _, source, folder = stream
    run()
    with pytest.raises(ValueError, match="another checkpoint"):
        triage_stream(spark, str(source), messages.schema, str(folder / "out"), str(folder / "other"))
