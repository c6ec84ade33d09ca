"""Counts and indexes that are kept beside the messages, against the messages themselves."""

import random
from collections import Counter
from pathlib import Path

import pytest

from tidemill.operators import gram_index, tallies
from tidemill.operators.search import filter_messages, label_stats

CHANGES = "ts timestamp_ntz, labels_before array<string>, labels_after array<string>"


def changes(spark, rows):
    return spark.createDataFrame(rows, CHANGES.replace("timestamp_ntz", "string")).selectExpr("cast(ts as timestamp_ntz) AS ts", "labels_before", "labels_after")


def counted(spark, folder):
    return {(row["label"], str(row["day"])): row["messages"] for row in tallies.tallies(spark, folder).collect()}


def test_counts_follow_the_changes(spark, tmp_path):
    folder = str(tmp_path)
    chance = random.Random(2)
    now, held, batches = {}, Counter(), []
    for _ in range(4):
        rows = []
        for message in chance.sample(range(40), 25):
            before = now.get(message)
            after = None if chance.random() < 0.2 else chance.choices(["INBOX", "UNREAD", "AI_PROCESSED"], k=3)
            rows.append((f"2024-01-0{1 + message % 3} 10:00:00", before, after))
            now[message] = after
        batches.append(rows)

    def wanted(upto):
        state = {}
        held.clear()
        state = {}
        for rows in batches[: upto + 1]:
            for day, before, after in rows:
                for label in set(after or []) - set(before or []):
                    held[label, day[:10]] += 1
                for label in set(before or []) - set(after or []):
                    held[label, day[:10]] -= 1
        return {key: count for key, count in held.items() if count}

    for number, rows in enumerate(batches):
        for _ in range(2):
            tallies.record(changes(spark, rows), folder, number)
        assert counted(spark, folder) == wanted(number)
        if number in (1, 3):
            tallies.fold(spark, folder)
            assert counted(spark, folder) == wanted(number)
    tallies.record(changes(spark, batches[0]), folder, 0)
    assert counted(spark, folder) == wanted(3)
    messages = spark.createDataFrame([(labels,) for labels in now.values()], "labels array<string>")
    assert sorted(map(tuple, tallies.label_counts(spark, folder).collect())) == sorted(map(tuple, label_stats(messages).collect()))


def test_all_counts_at_zero_stay_folded(spark, tmp_path):
    folder = str(tmp_path)
    tallies.record(changes(spark, [("2024-01-01", None, ["A"])]), folder, 0)
    tallies.record(changes(spark, [("2024-01-01", ["A"], [])]), folder, 1)
    tallies.fold(spark, folder)
    tallies.fold(spark, folder)
    tallies.record(changes(spark, [("2024-01-01", None, ["A"])]), folder, 0)
    assert counted(spark, folder) == {}


MESSAGES = "id long, sender string, recipient string, subject string"


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    chance = random.Random(8)
    parts = ["an", "\u010d", "the ", "x", "Invoice ", "\U0001f600", "%", "_"]
    rows = [
        (n, f"user{n % 7}@example.org", None if n % 50 == 0 else "", f"word{n // 100} " + "".join(chance.choices(parts, k=chance.randrange(4))))
        for n in range(1000)
    ] + [(1000, "", "a", "\x00 nul"), (1001, "b", "zq", "ab")]
    messages = spark.createDataFrame(rows, MESSAGES)
    folder = str(tmp_path_factory.mktemp("grams"))
    gram_index.build_index(messages, folder, ["id"], block_rows=50)
    return messages, folder


def ids(df):
    return sorted(row["id"] for row in df.select("id").collect())


@pytest.mark.parametrize("texts", [
    {"subject": "word3"}, {"subject": "INVOICE \u010d"}, {"subject": "x"}, {"subject": "\u010d\u010d"}, {"sender": "R3@EX", "subject": "the"}, {"recipient": "q"},
    {"recipient": "zq"}, {"subject": "nothing like it"}, {"subject": ""}, {"subject": "%"}, {"subject": "\x00"}, {"subject": "b"}, {"subject": "\U0001f600"},
])
def test_answers_are_those_of_a_scan(spark, indexed, texts):
    messages, folder = indexed
    named = {{"sender": "from_", "recipient": "to"}.get(name, name): text for name, text in texts.items()}
    assert ids(gram_index.search_index(spark, folder, **texts)) == ids(filter_messages(messages, **named))


def test_other_blocks_are_not_read(spark, indexed):
    _, folder = indexed
    blocks = gram_index.blocks_with(spark, folder, "subject", "word4 ")
    assert 2 <= len(blocks) <= 4
    wanted = ids(gram_index.search_index(spark, folder, subject="word4 "))
    for path in Path(folder).glob("messages/block=*/*.parquet"):
        if int(path.parent.name.removeprefix("block=")) not in blocks:
            data = path.read_bytes()
            footer = 8 + int.from_bytes(data[-8:-4], "little")
            # The schema stays readable, the rows do not.
            path.write_bytes(data[:4] + b"\xff" * (len(data) - 4 - footer) + data[-footer:])
            path.with_name(f".{path.name}.crc").unlink(missing_ok=True)
    assert wanted == list(range(400, 500))
    assert ids(gram_index.search_index(spark, folder, subject="word4 ")) == wanted
    with pytest.raises(Exception):  # noqa: B017
        spark.read.parquet(f"{folder}/messages").select("subject").collect()
