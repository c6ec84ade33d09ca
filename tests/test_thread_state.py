"""The keyed state behind the thread context of a stream, against the context of all messages at once."""

import random
from collections import defaultdict
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemill.operators.threads import CONTEXT_SEPARATOR, thread_context
from tidemill.plans.mail import MAIL
from tidemill.session import checkpoint_folder
from tidemill.streaming import thread_state
from tidemill.streaming.thread_state import NO_TIME, ThreadTailRows, ThreadTails, latest_contexts, thread_context_stream, threads_of


class Held:
    """State of one key, as a store keeps it between batches."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return iter(self.value) if isinstance(self.value, list) else self.value

    def put(self, value):
        self.value = list(value)

    update = lambda self, value: setattr(self, "value", tuple(value))


class Handle:
    def __init__(self):
        self.states = defaultdict(Held)

    def getListState(self, name, schema):
        return self.states[name]

    getValueState = getListState


def run(batches, lateness=10**6, frames=1):
    """Rows that a new processor for each batch gives, with the state carried on."""
    handle, out = Handle(), []
    for batch in batches:
        tails = ThreadTails(lateness)
        tails.init(handle)
        parts = [batch[at::frames] for at in range(frames) if batch[at::frames]]
        rows = (pd.DataFrame(part, columns=["at", "id", "block"]) for part in parts)
        for frame in tails.handleInputRows(("t",), rows, None):
            out += frame.to_dict("records")
    return handle, out


def latest(rows):
    last = {}
    for row in sorted(rows, key=lambda row: (not row["late"], row["revision"])):
        last[row["id"]] = row["thread_context"]
    return last


def expected(entries):
    ordered = sorted(set(entries))
    return {entry[1]: CONTEXT_SEPARATOR.join(block for *_, block in ordered[max(0, at - 3) : at]) for at, entry in enumerate(ordered)}


@pytest.mark.parametrize("seed", range(30))
def test_any_order_of_arrival_gives_the_same_context(seed):
    chance = random.Random(seed)
    entries = [(chance.randrange(8), f"m{n}", f"<{n}>") for n in range(chance.randrange(1, 40))]
    arriving = entries + chance.choices(entries, k=5)
    chance.shuffle(arriving)
    cuts = sorted(chance.choices(range(len(arriving)), k=3))
    batches = [arriving[a:b] for a, b in zip([0, *cuts], [*cuts, len(arriving)], strict=True)]
    _, rows = run([batch for batch in batches if batch], frames=chance.choice((1, 2, 5)))
    assert latest(rows) == expected(entries)
    assert not any(row["late"] for row in rows)
    assert len({(row["id"], row["revision"]) for row in rows}) == len(rows)


def test_a_repeated_message_changes_nothing():
    entries = [(n, f"m{n}", str(n)) for n in range(6)]
    _, once = run([entries])
    _, twice = run([entries, entries[2:4], entries])
    assert once == twice


def test_state_stays_small_and_the_late_is_told():
    second = 1_000_000
    batches = [[(n * second, f"m{n}", str(n)) for n in range(at, at + 100)] for at in range(0, 1000, 100)]
    handle, rows = run(batches, lateness=20)
    assert len(handle.states["recent"].value) == 24
    assert latest(rows) == expected([entry for batch in batches for entry in batch])
    # Within the time allowed: its place, and three contexts written again. Beyond it: told, and nothing else changed.
    _, rows = run([*batches, [(985 * second + 1, "within", "w")], [(5 * second, "beyond", "b"), (500 * second, "m500", "500")]], lateness=20)
    last = [row for row in rows if row["revision"] > 10]
    assert [(row["id"], row["late"]) for row in last] == [("within", False), ("m986", False), ("m987", False), ("m988", False), ("beyond", True), ("m500", True)]
    assert last[0]["thread_context"] == CONTEXT_SEPARATOR.join(("983", "984", "985"))
    assert latest(rows)["m500"] == CONTEXT_SEPARATOR.join(("497", "498", "499"))
    assert latest(rows)["m987"] == CONTEXT_SEPARATOR.join(("985", "w", "986"))


MESSAGES = "id string, thread_id string, ts timestamp_ntz, sender string, subject string, body string"


def test_a_stream_over_odd_messages_and_a_new_start(spark, tmp_path):
    def message(n, thread, minute):
        return (None if n is None else f"m{n}", thread, None if minute is None else f"2024-01-01 00:{minute:02d}:00", None if n == 3 else "a@b", "s", "b" * 2600 if n == 2 else f"body {n}")

    parts = [
        [message(1, "x", 5), message(2, "x", 7), message(None, "x", 8), message(9, None, 1)],
        [message(3, "x", 6), message(1, "x", 5), message(4, "x", None), message(5, "y", 1)],
        [message(6, "x", 6), message(7, "x", 9), message(8, None, 1)],
    ]
    frames = [spark.createDataFrame(rows, MESSAGES.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz")) for rows in parts]
    for number, frame in enumerate(frames):
        frame.coalesce(1).write.parquet(str(tmp_path / "source" / f"file{number}"))
        names = "012"[: number + 1]
        thread_context_stream(
            spark, str(tmp_path / "source" / f"file[{names}]"), frames[0].schema, str(tmp_path / "sink"), str(tmp_path / "checkpoint")
        ).awaitTermination()
    got = {row["id"]: row["thread_context"] for row in latest_contexts(spark.read.parquet(str(tmp_path / "sink"))).collect()}
    whole = frames[0].unionByName(frames[1]).unionByName(frames[2]).filter("id IS NOT NULL").distinct()
    assert got == {row["id"]: row["thread_context"] for row in thread_context(whole).collect()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("HDFSBackedStateStoreProvider")
    with pytest.raises(ValueError, match="another checkpoint"):
        thread_context_stream(spark, str(tmp_path / "source/file0"), frames[0].schema, str(tmp_path / "sink"), str(tmp_path / "other"))


def test_blocks_are_cut_before_the_state(spark):
    long = spark.createDataFrame([("1", None, None, None, None, "b" * 9000)], MESSAGES)
    row = threads_of(long).first()
    assert len(row["block"]) < 2600 and row["thread"] == "message 1" and row["at"] == NO_TIME


def test_plain_rows_give_what_frames_give(monkeypatch):
    monkeypatch.setattr(thread_state, "STEP_ROWS", 7)
    chance = random.Random(3)
    batches = [[(chance.randrange(60), f"m{chance.randrange(50)}", "b") for _ in range(size)] for size in (1, 20, 7, 30)]
    handle, out = Handle(), []
    for batch in batches:
        tails = ThreadTailRows(0)
        tails.init(handle)
        rows = (Row(thread="t", at=at, id=name, block=block) for at, name, block in batch)
        out += [row.asDict() for row in tails.handleInputRows(("t",), rows, None)]
    steps = Handle()
    wanted = []
    for batch in batches:
        tails = ThreadTails(0)
        tails.init(steps)
        frames = (pd.DataFrame(batch[at : at + 7], columns=["at", "id", "block"]) for at in range(0, len(batch), 7))
        for frame in tails.handleInputRows(("t",), frames, None):
            wanted += frame.to_dict("records")
    assert out == wanted and any(row["late"] for row in out)
    assert handle.states["recent"].value == steps.states["recent"].value


def test_a_table_of_more_files_is_streamed_in_as_many_batches(spark, tmp_path):
    rows = [(conv, turn, "user", f"text {conv} {turn}") for conv in range(12) for turn in range(4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    for folder, files in (("one", 1), ("five", 5)):
        turns.repartition(files).write.parquet(str(tmp_path / folder / "conversations.parquet"))
    found = {}
    for folder in ("one", "five"):
        place = Path(checkpoint_folder(spark).removeprefix("file:"))
        before = set(place.glob("threads-*"))
        found[folder] = sorted(map(tuple, MAIL.queries["thread_context_stream"](spark, str(tmp_path / folder)).collect()))
        (target,) = set(place.glob("threads-*")) - before
        assert sorted(batch.name for batch in (target / "sink").glob("batch=*")) == [f"batch={number}" for number in range(4)]
    assert len(found["one"]) == len(rows) and found["one"] == found["five"]


def test_a_stream_of_frames_goes_on_from_its_checkpoint(spark, tmp_path):
    rows = [(f"m{n}", f"t{n % 3}", f"2024-01-01 00:{n * 7 % 30:02d}:00", "a@b", "s", f"body {n}") for n in range(30)]
    messages = spark.createDataFrame(rows, MESSAGES.replace("timestamp_ntz", "string")).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for number in range(2):
        messages.filter(F.pmod(F.xxhash64("id"), F.lit(2)) == number).coalesce(1).write.parquet(str(tmp_path / f"source/file{number}"))
        names = "01"[: number + 1]
        thread_context_stream(
            spark, str(tmp_path / f"source/file[{names}]"), messages.schema, str(tmp_path / "sink"), str(tmp_path / "checkpoint"), frames=True
        ).awaitTermination()
    got = {row["id"]: row["thread_context"] for row in latest_contexts(spark.read.parquet(str(tmp_path / "sink"))).collect()}
    assert got == {row["id"]: row["thread_context"] for row in thread_context(messages).collect()}
