import base64
import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.functions.markup import LINES, MAIL_DROPPED, parse_text
from tidemill.operators import bodies, threads
from tidemill.operators.ordering import with_preceding
from tidemill.sources import mailbox


def encoded(text):
    return base64.urlsafe_b64encode(text.encode()).decode()


def leaf(mime, text=None, parts=()):
    node = {"mimeType": mime, "parts": list(parts)}
    if text is not None:
        node["body"] = {"data": encoded(text)}
    return node


def expected_body(node):
    """The body rule, told recursively."""
    text = base64.urlsafe_b64decode(node.get("body", {}).get("data", "")).decode()
    if text and node["mimeType"] == "text/plain":
        return text
    if text and node["mimeType"] == "text/html":
        return parse_text(text, MAIL_DROPPED, LINES)
    plain, html = [], []
    for part in node["parts"]:
        content = base64.urlsafe_b64decode(part.get("body", {}).get("data", "")).decode()
        if content:
            {"text/plain": plain, "text/html": html}.get(part["mimeType"], []).append(content)
        if part["parts"]:
            nested = expected_body(part)
            if nested:
                plain.append(nested)
    return "\n".join(plain) if plain else parse_text("\n".join(html), MAIL_DROPPED, LINES)


def random_tree(draw, depth=0):
    mime = draw.choice(["text/plain", "text/html", "multipart/mixed", "image/png"])
    text = draw.choice([None, None, "a", "<p>b</p>", "<b>c", "<br>", "d\n e"])
    count = draw.choice([0, 0, 1, 2, 3]) if depth < 4 else 0
    return leaf(mime, text, [random_tree(draw, depth + 1) for _ in range(count if depth else max(count, 1))])


def export(spark, tmp_path, trees):
    lines = [
        json.dumps({"id": f"m{n}", "threadId": "t", "labelIds": ["INBOX"], "internalDate": str(1_700_000_000_000 + n),
                    "payload": {**tree, "headers": [{"name": "From", "value": "a"}, {"name": "FROM", "value": "b"}]}})
        for n, tree in enumerate(trees)
    ]
    path = tmp_path / "export.jsonl"
    path.write_text("\n".join(lines))
    return mailbox.read_export(spark, str(path))


def test_bodies_of_named_shapes(spark, tmp_path):
    shapes = [
        (leaf("text/plain", "p"), "p"),
        (leaf("text/html", "<p>h</p><p>i</p>"), "h\ni"),
        (leaf("multipart/alternative", None, [leaf("text/plain", "p"), leaf("text/html", "<p>h</p>")]), "p"),
        (leaf("multipart/alternative", None, [leaf("text/html", "<p>h</p>")]), "h"),
        (leaf("multipart/mixed", None, [
            leaf("text/html", "<p>outer</p>"),
            leaf("multipart/alternative", None, [leaf("text/html", "<p>inner</p>")])]), "inner"),
        (leaf("text/plain", None, [leaf("text/plain", "from a part")]), "from a part"),
        (leaf("multipart/mixed", None, [leaf("text/plain", "one"), leaf("text/plain", "two")]), "one\ntwo"),
        (leaf("multipart/mixed", None, [leaf("image/png", "xx")]), ""),
        (leaf("multipart/mixed", None, [leaf("text/plain", "twice", [leaf("image/png", "x")])]), "twice\ntwice"),
        (leaf("multipart/mixed", None, [leaf("text/html", "<b>a"), leaf("text/html", "<script>x")]), "a"),
    ]
    parts = mailbox.export_parts(export(spark, tmp_path, [tree for tree, _ in shapes]))
    got = {row.message_id: row.body for row in bodies.select_body(parts).collect()}
    assert got == {f"m{n}": body for n, (_, body) in enumerate(shapes)}


def test_undecodable_plain_part_keeps_html_out(spark):
    rows = [("m", [], "multipart/mixed", None), ("m", [0], "text/plain", "YWJ"), ("m", [1], "text/html", encoded("<p>h</p>"))]
    parts = spark.createDataFrame(rows, mailbox.PART_SCHEMA)
    assert bodies.select_body(parts).first().body == ""


def test_rejected_html_gives_no_body(spark):
    rejected, fine = encoded("<![foo[x]]>"), encoded("<p>h</p>")
    rows = [
        ("one", [], "text/html", rejected),
        ("two", [], "multipart/mixed", None), ("two", [0], "text/html", fine), ("two", [1], "text/html", rejected),
        ("three", [], "text/html", fine),
    ]
    parts = spark.createDataFrame(rows, mailbox.PART_SCHEMA)
    got = {row.message_id: row.body for row in bodies.select_body(parts).collect()}
    assert got == {"one": None, "two": None, "three": "h"}


def test_bodies_of_random_trees(spark, tmp_path):
    draw = random.Random(11)
    trees = [random_tree(draw) for _ in range(400)]
    parts = mailbox.export_parts(export(spark, tmp_path, trees)).repartition(5)
    got = {row.message_id: row.body for row in bodies.select_body(parts).collect()}
    assert got == {f"m{n}": expected_body(tree) for n, tree in enumerate(trees)}


def test_trees_of_any_depth(spark, tmp_path):
    tree = leaf("text/plain", "deep")
    for _ in range(40):
        tree = leaf("multipart/mixed", None, [tree])
    parts = mailbox.export_parts(export(spark, tmp_path, [tree]))
    assert parts.count() == 41
    assert bodies.select_body(parts).first().body == "deep"


def test_no_part_is_lost(spark):
    text = encoded("t")
    rows = [
        ("noroot", [0], "text/plain", text),
        ("gap", [], "multipart/mixed", None), ("gap", [0, 0], "text/plain", text), ("gap", [0, 0, 1], "text/plain", text),
        ("twice", [], "multipart/mixed", None), ("twice", [0], "text/plain", text), ("twice", [0], "text/plain", text),
        (None, [], "text/plain", text), (None, [], "text/plain", encoded("u")),
        ("good", [], "text/plain", text),
    ]
    parts = spark.createDataFrame(rows, mailbox.PART_SCHEMA)
    assert {row.message_id: row.body for row in bodies.select_body(parts).collect()} == {"gap": "", "twice": "t", "good": "t"}
    rejects = sorted(((row.message_id or "", row.path, row.cause) for row in bodies.part_rejects(parts).collect()))
    assert rejects == [
        ("", [], "missing id"), ("", [], "missing id"), ("gap", [0, 0], "missing parent"), ("gap", [0, 0, 1], "missing parent"),
        ("noroot", [0], "missing root"), ("twice", [0], "repeated part"),
    ]


def test_export_headers_and_broken_lines(spark, tmp_path):
    path = tmp_path / "mail.jsonl"
    good = {"id": "1", "threadId": "t", "internalDate": "1700000000000", "labelIds": ["INBOX"],
            "payload": {"mimeType": "text/plain", "headers": [
                {"name": "SUBJECT", "value": "first"}, {"name": "subject", "value": "last"},
                {"name": "List-ID", "value": "l"}]}}
    path.write_text(json.dumps(good) + "\nnot json\n" + json.dumps({"id": "2"}))
    loaded = mailbox.read_export(spark, str(path))
    assert loaded.filter("doc IS NULL").count() == 1
    rows = {row.id: row for row in bodies.normalise_headers(mailbox.export_messages(loaded)).collect()}
    assert rows["1"].subject == "last" and rows["1"].list_id == "l" and rows["1"].sender == ""
    assert str(rows["1"].ts) == "2023-11-14 22:13:20"
    assert rows["2"].subject == "" and rows["2"].labels is None
    rejects = {(row.id, row.cause) for row in mailbox.export_rejects(loaded).collect()}
    assert rejects == {(None, "unreadable line"), ("2", "missing payload")}


def test_thread_context(spark):
    rows = [(f"m{9 - n}", "t", n, "s", None, "b" * 3_000 if n == 1 else f"body {n}") for n in range(5)]
    rows += [("a", None, 1, "s", None, "alone"), ("b", None, 2, "s", None, "alone too")]
    messages = spark.createDataFrame(rows, "id string, thread_id string, ts int, sender string, subject string, body string")
    got = {row.id: row.thread_context for row in threads.thread_context(messages).collect()}

    def block(body):
        return f"\nFROM:\ns\n\nSUBJECT:\n\n\nBODY:\n{body}\n"

    joint = "\n--- PREVIOUS MESSAGE ---\n"
    assert got["m9"] == got["a"] == got["b"] == ""
    assert got["m7"] == block("body 0") + joint + block("b" * 2_500)
    assert got["m5"] == joint.join([block("b" * 2_500), block("body 2"), block("body 3")])


def test_history_keeps_the_last_eight_lines(spark):
    turns = spark.createDataFrame([(1, n, "user", f"t{n}") for n in range(10)], "conv_id int, turn int, role string, text string")
    last = threads.turn_history(turns).filter("turn = 9").first().history
    assert last == "\n".join(f"USER: t{n}" for n in range(2, 10))


@pytest.mark.parametrize("chunk_rows", [16, 1_000_000])
@pytest.mark.parametrize("include_current", [False, True])
def test_one_hot_group_in_small_chunks(spark, include_current, chunk_rows):
    """Groups far longer than a chunk, one of them NULL, with gaps, repeated positions and NULL values."""
    draw = random.Random(3)
    rows = []
    for group, size in (("hot", 600), (None, 90), ("warm", 40), ("a", 3), ("b", 1)):
        position = 0
        for n in range(size):
            position += draw.choice([0, 1, 1, 1, 2, 50])
            rows.append((group, position, f"{n:04d}"))
    df = spark.createDataFrame(rows, "g string, p int, tie string").repartition(7)
    value = F.when(F.col("tie") % 5 != 2, F.concat(F.coalesce("g", F.lit("-")), "tie"))
    got = with_preceding(df, "g", "p", "tie", value, 3, "before", include_current, chunk_rows=chunk_rows)
    expected = {}
    for group in {row[0] for row in rows}:
        members = sorted(row for row in rows if row[0] == group)
        for n, row in enumerate(members):
            window = members[max(0, n - 2): n + 1] if include_current else members[max(0, n - 3): n]
            expected[row] = [(g or "-") + tie for g, _, tie in window if int(tie) % 5 != 2]
    assert {(row.g, row.p, row.tie): row.before for row in got.collect()} == expected
