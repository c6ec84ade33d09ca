"""Substring, line and near-duplicate operators against brute force."""

import random
from collections import defaultdict

import numpy as np
import xxhash
from cases import LOWER, ODD, words

from tidemill.llm.components import components
from tidemill.llm.line_dedup import line_dedup
from tidemill.llm.simhash import close_pairs, forest, links, simhash_groups
from tidemill.llm.substring_dedup import substring_dedup


def collected(df, *names):
    return sorted((tuple(row[name] for name in names) for row in df.collect()), key=repr)


def expected_substrings(rows, size=13):
    starts = defaultdict(list)
    for doc, text, *_ in rows:
        split = words(text)
        for at in range(len(split) - size + 1):
            if doc is not None:
                starts[tuple(split[at : at + size])].append(doc)
    out = []
    for doc, text, *_ in rows:
        split, gone = words(text), set()
        for at in range(len(split) - size + 1):
            if doc is not None and min(starts[tuple(split[at : at + size])]) < doc:
                gone.update(range(at, at + size))
        out.append((doc, len(split), len(gone), " ".join(word for at, word in enumerate(split) if at not in gone)))
    return sorted(out, key=repr)


def test_substrings_of_odd_rows(odd):
    assert collected(substring_dedup(odd), "doc_id", "n_words", "n_removed", "kept") == expected_substrings(ODD)


def test_removed_spans_are_what_is_missing(odd):
    for row in substring_dedup(odd).collect():
        assert sum(span["stop"] - span["start"] for span in row["removed"]) == row["n_removed"]
        edges = [edge for span in row["removed"] for edge in (span["start"], span["stop"])]
        assert edges == sorted(set(edges))


def test_substrings_of_many_copies(spark):
    chance = random.Random(5)
    base = [f"w{chance.randrange(40)}" for _ in range(200)]
    rows = []
    for doc in range(120):
        text = list(base)
        for _ in range(chance.randrange(6)):
            text[chance.randrange(200)] = "other"
        rows.append((doc, " ".join(text[chance.randrange(20) :])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert collected(substring_dedup(df), "doc_id", "n_words", "n_removed", "kept") == expected_substrings(rows)


def test_substrings_without_any_repeat(spark):
    rows = [(doc, " ".join(f"w{doc}x{n}" for n in range(40))) for doc in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert collected(substring_dedup(df), "doc_id", "n_words", "n_removed", "kept") == expected_substrings(rows)


def expected_lines(rows, least=3, long=300, most=51):
    distinct = {(doc, text) for doc, text, *_ in rows if text is not None}

    def order(key):
        doc, text = key
        return (doc is None, doc if doc is not None else 0, np.int64(np.uint64(xxhash.xxh64_intdigest(text.encode(), 42))))

    ordered = sorted(distinct, key=order)
    seen, gone = set(), defaultdict(set)
    for key in ordered:
        lines = key[1].split("\n")
        for at, line in enumerate(lines):
            for size in range(1, least + 1):
                run = tuple(lines[at : at + size])
                counts = size == least or len(words("\n".join(run))) >= most or (size == 1 and len(line) >= long)
                if len(run) == size and counts and run in seen:
                    gone[key].update(range(at, at + size))
                if len(run) == size:
                    seen.add(run)
    out = []
    for doc, text, *_ in rows:
        lines = text.split("\n") if text is not None else []
        away = gone[doc, text]
        kept = None if text is None else "\n".join(line for at, line in enumerate(lines) if at not in away)
        out.append((doc, len(lines), len(away), kept))
    return sorted(out, key=repr)


def test_lines_of_odd_rows(odd):
    assert collected(line_dedup(odd), "doc_id", "n_lines", "n_removed", "kept") == expected_lines(ODD)


def test_lines_of_many_copies(spark):
    chance = random.Random(3)
    rows = [(doc, "\n".join(chance.choice("abcd") for _ in range(chance.randrange(14)))) for doc in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for least, most in ((1, 99), (2, 99), (3, 99), (5, 99), (5, 3), (7, 6)):
        found = collected(line_dedup(df, min_lines=least, min_chars=3, min_words=most), "doc_id", "n_lines", "n_removed", "kept")
        assert found == expected_lines(rows, least, 3, most)


def test_short_runs_of_many_words_go(spark):
    def line(name, count):
        return " ".join(f"{name}{n}" for n in range(count))

    rows = [
        (1, "\n".join([line("a", 62), "end", line("b", 30), line("c", 21), "x"])),
        (2, "\n".join(["other", line("a", 62), "here"])),
        (3, "\n".join([line("b", 30), line("c", 21)])),
        (4, "\n".join([line("b", 30), line("d", 21), line("c", 21)])),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(len(text) > 1 and max(map(len, text.split("\n"))) < 300 for _, text in rows)
    assert {row["doc_id"]: row["n_removed"] for row in line_dedup(df).collect()} == {1: 0, 2: 1, 3: 2, 4: 0}


def test_no_long_passage_of_whole_lines_is_left_twice(documents):
    """In what is kept, no run of whole lines with over 50 words that is late in the input."""
    given = {row["doc_id"]: row["text"].split("\n") for row in documents.collect() if row["text"] is not None}
    kept = {row["doc_id"]: row["kept"].split("\n") for row in line_dedup(documents).collect() if row["kept"] is not None}
    first = {}
    for doc in sorted(given):
        for line in given[doc]:
            first.setdefault(line, doc)
    left = [doc for doc, lines in kept.items() for line in lines if len(words(line)) > 50 and first[line] < doc]
    assert left == []


def test_carried_names_may_clash(odd):
    names = ["chunk", "_id", "_line", "_print", "first", "ids", "rank"]
    rows = line_dedup(odd, carry=names).select("doc_id", "n_removed", *names).collect()
    assert len(rows) == len(ODD) and all(set(row[2:]) == {"?"} for row in rows)
    renamed = odd.withColumnsRenamed({"chunk": "_text", "kept": "_gone", "mask": "words"})
    assert line_dedup(renamed, carry=["_text", "_gone", "words"]).count() == len(ODD)


def test_line_dedup_runs_no_python(odd):
    plan = line_dedup(odd, carry=["chunk"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def fingerprint(text):
    split = words((text or "").translate(LOWER))
    if not split:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(split[at : at + 3]).encode(), 42) for at in range(max(1, len(split) - 2))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def expected_groups(rows):
    prints = [fingerprint(text) for _, text, *_ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    ids = defaultdict(list)
    for at, row in enumerate(rows):
        ids[find(at)].append(row[0])
    least = {at: min((doc for doc in group if doc is not None), default=None) for at, group in ids.items()}
    return sorted(((row[0], f"{prints[at]:016x}", least[find(at)]) for at, row in enumerate(rows)), key=repr)


def test_simhash_of_odd_rows(odd):
    assert collected(simhash_groups(odd), "doc_id", "fingerprint", "component_id") == expected_groups(ODD)


def test_simhash_of_documents(documents):
    rows = [(row["doc_id"], row["text"]) for row in documents.collect()]
    assert collected(simhash_groups(documents), "doc_id", "fingerprint", "component_id") == expected_groups(rows)


def test_close_pairs_leave_none_out():
    chance = np.random.default_rng(1)
    base = chance.integers(0, 1 << 63, 40, dtype=np.uint64)
    left = np.concatenate([base ^ (np.uint64(1) << np.uint64(bit)) for bit in range(40)])
    right = np.concatenate((base, left[:300]))
    wanted = {(a, b) for a in range(len(left)) for b in range(len(right)) if (int(left[a]) ^ int(right[b])).bit_count() <= 3}
    assert set(zip(*[x.tolist() for x in close_pairs(left, right, 3)], strict=True)) == wanted
    # The way by blocks of bit counts, which small tiles do not take.
    many = np.concatenate([left] * 40)
    a, b = close_pairs(many, right, 3)
    assert len(a) == 40 * len(wanted)


def test_links_of_split_tiles(spark):
    chance = random.Random(2)
    values = {0}
    while len(values) < 400:
        value = chance.choice(sorted(values)[-30:])
        for _ in range(chance.choice((1, 2, 3, 9))):
            value ^= 1 << chance.randrange(64)
        values.add(value)
    signed = [value - (1 << 64) if value >> 63 else value for value in values]
    df = spark.createDataFrame([(value,) for value in signed], "bits long")
    label = list(range(len(signed)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(signed)):
        for b in range(a):
            if ((signed[a] ^ signed[b]) & ((1 << 64) - 1)).bit_count() <= 3:
                label[find(a)] = find(b)
    groups = defaultdict(set)
    for at, value in enumerate(signed):
        groups[find(at)].add(value)
    wanted = {value: min(group) for group in groups.values() for value in group if value != min(group)}
    found = components(links(df, tile=16))
    assert {row["node"]: row["root"] for row in found.collect()} == wanted


def test_forest():
    assert forest(6, np.array([4, 3, 5]), np.array([3, 1, 5])).tolist() == [0, 1, 2, 1, 1, 5]


def test_components_of_a_chain(spark):
    links_ = spark.createDataFrame([(n, n + 1) for n in range(200)] + [(500, 500)], "a long, b long")
    assert {(row["node"], row["root"]) for row in components(links_).collect()} == {(n, 0) for n in range(1, 201)}


def test_empty_tables(none):
    for found in (substring_dedup(none), line_dedup(none), simhash_groups(none)):
        assert found.collect() == []
