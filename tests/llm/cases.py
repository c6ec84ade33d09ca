"""Texts that go wrong easily."""

import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = " ".join(f"word{n % 977} x{n}" for n in range(20_000))
PASSAGE = " ".join(f"shared{n}" for n in range(60))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# id, text, lang: NULLs, empty and blank texts, a long one, ties, repeated rows, near copies.
ODD = [
    (1, None, None),
    (2, "", "en"),
    (3, " \t\n \r\x0b\x0c", None),
    (None, PASSAGE + " without an id", "en"),
    (4, LONG, "en"),
    (5, LONG, "en"),
    (5, LONG, "en"),
    (6, "one", "fr"),
    (7, "One", "fr"),
    (8, "before it " + PASSAGE + " after it", "en"),
    (9, "Other words. " + PASSAGE, "de"),
    (10, PASSAGE + " " + PASSAGE, "de"),
    (11, "\n".join(["a line of its own", "and one more", "and a third", "the end"]), "en"),
    (12, "\n".join(["new here", "a line of its own", "and one more", "and a third", "other end"]), "en"),
    (13, "a\n" * 12, "en"),
    (14, "\x00 nul ▁mark 漢字 \U0001f600 é́", "xx"),
    (15, " ".join(["again"] * 40), "en"),
    (16, "x" * 300 + "\n" + "y", "en"),
    (17, "z\n" + "x" * 300, "en"),
]
# Names that the operators use inside.
CLASHING = (
    "chunk", "payload", "bucket", "bits", "kept", "n_words", "mask", "items", "a", "b", "_id", "_line", "_print", "rank", "first", "ids",
    "score", "learn", "surprise", "doc", "component_id",
)
