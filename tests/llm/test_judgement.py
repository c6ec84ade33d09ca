"""Language, quality and benchmark operators against brute force and held-out labels."""

import math
import re
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
import pytest
from cases import LOWER, ODD, words
from pyspark.sql import functions as F

from tidemill.llm import language_id, quality_classifier, quality_rules
from tidemill.llm.decontaminate import contaminated_words
from tidemill.llm.kneser_ney import ORDER, KneserNey, discounts
from tidemill.llm.letters import CLASSES, class_table, shares_in_class
from tidemill.llm.queries import LLM, fold


def by_id(df, *names):
    return sorted((tuple(row[name] for name in names) for row in df.collect()), key=repr)


# Language identification.


def longest_phrases(sample, text):
    """Phrases of a text, each the longest that occurs in the sample or else one character."""
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at += size
        count += 1
    return count


def test_phrases_are_the_longest():
    chance = np.random.default_rng(4)
    sample = "".join(chance.choice(list("abc"), 300))
    texts = ["", "a", "abcabc", "zzz", *("".join(chance.choice(list("abcd"), 40)) for _ in range(30)), sample * 8]
    classes, lengths, lettered = language_id.classes_of(texts)
    table = language_id.automaton(language_id.classes_of([sample])[0])
    found = language_id.phrases(table, classes, lengths)
    piece = language_id.PIECE
    wanted = [sum(longest_phrases(sample, text[at : at + piece]) for at in range(0, len(text), piece)) for text in texts]
    assert found.tolist() == wanted
    assert lettered.tolist() == [bool(text) for text in texts]


def test_language_of_held_out_documents(spark, small, documents):
    judged = LLM.queries["op2_language_id"](spark, small).join(documents.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(judged) > 30
    assert sum(row["lang"] == row["lang_pred"] for row in judged) >= 0.95 * len(judged)
    assert all(0 <= row["score"] <= 1 for row in judged)


def test_language_of_odd_rows(odd):
    judged = by_id(language_id.identify_language(odd, F.lit(True)), "doc_id", "lang_pred", "score")
    assert len(judged) == len(ODD)
    for doc, lang, score in judged:
        assert 0 <= score <= 1
        assert (lang == "und" and score == 0) if doc in (1, 2, 3) else lang in ("en", "fr", "de", "xx")


def test_a_hundred_languages(spark):
    chance = np.random.default_rng(3)
    letters = list("abcdefghijklmnopqrst")
    vocabularies = [["".join(chance.choice(letters, 5)) for _ in range(12)] for _ in range(100)]
    rows = [(100 * n + k, " ".join(chance.choice(words_, 40)), f"l{n:02d}") for n, words_ in enumerate(vocabularies) for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learnt = F.col("doc_id") % 100 < 3
    found = {row["doc_id"]: row for row in language_id.identify_language(df, learnt, characters=1200, at_once=40).collect()}
    assert all(found[doc]["lang_pred"] == lang for doc, _, lang in rows)
    # However the languages are cut into blocks.
    again = {row["doc_id"]: row for row in language_id.identify_language(df, learnt, characters=1200, at_once=100).collect()}
    assert found == again


def test_language_against_plain_phrases(spark):
    rows = [(n, text * 3, lang) for n, (text, lang) in enumerate([("the cat and a hat ", "en"), ("le chat et un chapeau ", "fr"), ("la casa y el gato ", "es"), ("the chat la gato ", None), ("zzz", None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {row["doc_id"]: (row["lang_pred"], row["score"]) for row in language_id.identify_language(df, F.lit(True)).collect()}
    for doc, text, _ in rows:
        squeezed = [language_id.classes_of([other])[0] for _, other, lang in rows if lang]
        own = "".join(map(chr, language_id.classes_of([text])[0]))
        rates = []
        for (_, _, lang), classes in zip(rows, squeezed, strict=False):
            rates.append((longest_phrases("".join(map(chr, classes)), own) * np.log2(len(classes) + 1) / len(own), lang))
        rates.sort()
        assert found[doc][0] == min(rates)[1]
        assert abs(found[doc][1] - (1 - rates[0][0] / rates[1][0])) < 1e-12


def test_language_without_labels(odd, none):
    assert {row["lang_pred"] for row in language_id.identify_language(odd, F.lit(False)).collect()} == {"und"}
    assert language_id.identify_language(none, F.lit(True)).collect() == []


# Quality classifier.


def naive_measures(text):
    split = words(text)
    many = max(1, len(split))
    raw = (text or "").encode()
    letters = sum(byte > 127 or chr(byte).isalpha() for byte in raw)
    upper = sum(65 <= byte <= 90 for byte in raw)
    runs = Counter(tuple(split[at : at + 8]) for at in range(len(split) - 7))
    repeated = {at + k for at in range(len(split) - 7) if runs[tuple(split[at : at + 8])] > 1 for k in range(8)}
    different = sum(len(set(split[at : at + 32])) for at in range(0, len(split), 32))
    mean = sum(map(len, split)) / many
    inside = len(re.sub(r"[\x20\x09-\x0D]", "", text or "").encode())
    return [
        sum(bool(re.search(r"[#*$%&|<>{}\[\]=~^\\_]", word)) for word in split) / many,
        upper / max(1, letters),
        1 - letters / max(1, inside),
        sum(a == b for a, b in zip(split[1:], split[:-1], strict=True)) / many if split else 0,
        len(repeated) / many,
        sum(word.endswith("!") for word in split) / many,
        1 - different / many,
        abs(mean - 6) / 5,
        sum(not re.search(r"[A-Za-z0-9]|[^\x00-\x7f]", word) for word in split) / many,
    ]


def test_measures(documents):
    texts = [row["text"] for row in documents.limit(60).collect()] + [text for _, text, _ in ODD]
    values, count = quality_classifier.measures([None if text is None else text.encode() for text in texts])
    np.testing.assert_allclose(values, [naive_measures(text) for text in texts], atol=1e-12)
    assert count.tolist() == [len(words(text)) for text in texts]


def test_votes_are_told_apart_without_labels():
    chance = np.random.default_rng(8)
    bad = chance.random(4000) < 0.15
    size = len(quality_classifier.LABELLERS)
    sees = chance.random((4000, size)) < np.where(bad[:, None], 0.5, 0.004)
    patterns = (sees.astype(int) * 3 ** np.arange(size - 1, -1, -1)).sum(axis=1)
    kinds, counts = np.unique(patterns, return_counts=True)
    share, table = quality_classifier.posteriors(kinds, counts.astype(float))
    guess = dict(zip(kinds.tolist(), share.tolist(), strict=True))
    right = np.mean([(guess[p] > 0.5) == b for p, b in zip(patterns.tolist(), bad, strict=True)])
    assert right > 0.97
    np.testing.assert_allclose(table.sum(axis=2), 1)


def test_a_labeller_that_is_often_wrong_is_found_out():
    chance = np.random.default_rng(8)
    bad = chance.random(20_000) < 0.15
    size = len(quality_classifier.LABELLERS)
    wrong = np.full(size, 0.004)
    wrong[1] = 0.1
    sees = chance.random((len(bad), size)) < np.where(bad[:, None], 0.5, wrong)
    patterns = (sees.astype(int) * 3 ** np.arange(size - 1, -1, -1)).sum(axis=1)
    kinds, counts = np.unique(patterns, return_counts=True)
    _, table = quality_classifier.posteriors(kinds, counts.astype(float))
    assert abs(table[0, 1, 1] - 0.1) < 0.015
    assert abs(table[1, 1, 1] - 0.5) < 0.05


def test_quality_against_labels(spark, small, documents):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    rows = quality_classifier.classify_quality(documents, carry=["text"]).join(labels, "doc_id").collect()
    good = [row for row in rows if row["quality"] == 1]
    poor = [row for row in rows if row["quality"] == 0]
    assert sum(row["kept"] for row in good) >= 0.97 * len(good)
    assert sum(row["kept"] for row in poor) <= 0.15 * len(poor)
    assert all(row["kept"] == (row["score"] >= 0.5) for row in rows)


def test_quality_of_odd_rows(odd, none):
    rows = quality_classifier.classify_quality(odd, carry=["kept", "score", "_id"]).toDF("was_kept", "was_score", "_id", "doc_id", "weak", "score", "kept")
    found = by_id(rows, "doc_id", "score", "kept", "was_kept")
    assert len(found) == len(ODD)
    assert all((score, kept) == (0, False) for doc, score, kept, _ in found if doc in (1, 2, 3))
    assert all(was == "?" for *_, was in found)
    assert quality_classifier.classify_quality(none).collect() == []


def test_quality_does_not_depend_on_partitions(documents):
    found = [
        {row["doc_id"]: row["score"] for row in quality_classifier.classify_quality(documents.repartition(parts), sample=100).collect()}
        for parts in (1, 7)
    ]
    assert found[0].keys() == found[1].keys()
    assert all(abs(score - found[1][doc]) < 1e-9 for doc, score in found[0].items())


def naive_scores(rows):
    """The scorer told text by text: runs of four shapes and bins of the measures, averaged, through one weight each."""
    values, count = quality_classifier.measures([None if text is None else text.encode() for _, text in rows])
    kinds, often = np.unique(quality_classifier.votes(values, count), return_counts=True)
    share, _ = quality_classifier.posteriors(kinds, often.astype(float))
    chances = dict(zip(kinds.tolist(), share.tolist(), strict=True))
    batch = pa.RecordBatch.from_pydict({"text": [text for _, text in rows]})
    table = pa.Table.from_batches(list(quality_classifier._sampled(chances)(iter([batch]))))
    weights = quality_classifier._fit(table).column("weights")[0].as_py()
    shape, feature = quality_classifier.shape_table(), quality_classifier.feature_table()
    out = {}
    for (doc, text), row in zip(rows, values, strict=True):
        shapes = [min(int(shape[byte]), quality_classifier.SHAPES - 1) for byte in (text or "").encode() + b"\n"]
        total = 0.0
        for at in range(len(shapes)):
            run = [shapes[at - back] if at >= back else int(shape[0x20]) for back in range(quality_classifier.GRAM)]
            total += weights[feature[sum(value * quality_classifier.SHAPES**back for back, value in enumerate(run))]]
        bins = sum(weights[name] for name in quality_classifier.bin_features(row[None])[0])
        logit = total / len(shapes) + quality_classifier.BIN_WEIGHT * bins + weights[-1]
        out[doc] = 1 / (1 + math.exp(logit)) if words(text) else 0.0
    return out


def test_scores_against_one_text_at_a_time(spark, documents):
    rows = [(row["doc_id"], row["text"]) for row in documents.orderBy("doc_id").limit(60).collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {row["doc_id"]: row["score"] for row in quality_classifier.classify_quality(df).collect()}
    wanted = naive_scores(rows)
    assert found.keys() == wanted.keys()
    assert all(abs(score - wanted[doc]) < 1e-9 for doc, score in found.items())


# Benchmark decontamination.


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def expected_hits(rows, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        split = alnum(text)
        width = min(size, len(split))
        for at in range(len(split) - width + 1 if width and item is not None else 0):
            windows[tuple(split[at : at + width])].add(str(item))
    out = []
    for doc, text, *_ in rows:
        split, hit, found = alnum(text), set(), set()
        for width in {len(window) for window in windows}:
            for at in range(len(split) - width + 1):
                if tuple(split[at : at + width]) in windows:
                    hit.update(range(at, at + width))
                    found |= windows[tuple(split[at : at + width])]
        out.append((doc, len(split), len(hit), sorted(found)))
    return sorted(out, key=repr)


ITEMS = [
    (1, " ".join(f"shared{n}" for n in range(5, 30))), (2, "One"), (3, None), (4, "..."), (None, "again again"), (10, "again Again"),
    (11, "shared7 shared8 shared9"), (12, "a line of its own"), (13, "漢字"), (14, "One"), (14, "z"), (15, "again " * 14),
]


def test_hits_of_odd_rows(spark, odd):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    wanted = expected_hits(ODD, ITEMS)
    for block in (1 << 20, 40):
        assert by_id(contaminated_words(odd, benchmark, block_bytes=block), "doc_id", "n_words", "n_hit", "items") == wanted


def test_hits_carry_columns(spark, odd):
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = contaminated_words(odd, benchmark, block_bytes=40, carry=["mask", "text"]).collect()
    assert sorted((row["mask"], row["text"] or "") for row in rows) == sorted(("?", text or "") for _, text, _ in ODD)


def test_hits_of_empty_tables(spark, odd, none):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert {row["n_hit"] for row in contaminated_words(odd, nothing).collect()} == {0}
    assert contaminated_words(none, spark.createDataFrame(ITEMS, "item_id long, text string")).collect() == []


# Quality rules.


def test_base_counts(documents):
    texts = [row["text"] for row in documents.limit(80).collect()] + [text for _, text, _ in ODD]
    found = quality_rules.base_counts([None if text is None else text.encode() for text in texts])
    for number, text in enumerate(texts):
        split = words(text)
        runs = Counter(tuple(split[at : at + 8]) for at in range(len(split) - 7))
        hit = {at + k for at in range(len(split) - 7) if runs[tuple(split[at : at + 8])] > 1 for k in range(8)}
        lines = [line for line in (text or "").split("\n") if words(line)]
        wanted = (len(split), sum(map(len, split)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit))
        assert tuple(values[number] for values in found.values()) == wanted


def naive_codes(text):
    classes = [26] * (ORDER - 1) + [int(class_table()[ord(c)]) for c in text.lower()]
    out = []
    for at in range(ORDER - 1, len(classes)):
        code = 0
        for value in classes[at - ORDER + 1 : at + 1]:
            code = code * CLASSES + value
        out.append(code)
    return out


def test_codes_of_characters():
    texts = ["", None, "Ab c\né漢", "x"]
    codes, lengths = quality_rules.gram_codes(texts)
    assert lengths.tolist() == [len(text or "") for text in texts]
    assert codes.tolist() == [code for text in texts for code in naive_codes(text or "")]


def test_kneser_ney_sums_to_one():
    chance = np.random.default_rng(6)
    codes, counts = np.unique(chance.integers(0, CLASSES**ORDER, 3000) % 50_000, return_counts=True)
    model = KneserNey.of(codes, counts * chance.integers(1, 6, len(counts)))
    for context in (0, int(codes[7]) // CLASSES, 12_345, CLASSES**3 - 1):
        share = np.exp(model.score(np.arange(context * CLASSES, (context + 1) * CLASSES)))
        assert abs(share.sum() - 1) < 1e-5


def test_shares_of_characters_in_their_class():
    points = {"a": "жё12漢 ", "b": "ж1\t\n", "c": ""}
    counts = {lang: (np.array([ord(c) for c in text], np.uint32), np.arange(1, len(text) + 1)) for lang, text in points.items()}
    alphabet, shares = shares_in_class(counts)
    assert alphabet.tolist() == sorted({ord(c) for text in points.values() for c in text})
    for share in shares.values():
        assert np.allclose(np.bincount(class_table()[alphabet], np.exp(share), CLASSES)[np.unique(class_table()[alphabet])], 1)
    digits = np.exp(shares["b"])[np.isin(alphabet, [ord("1"), ord("2")])]
    assert np.allclose(digits, [(2 + 5 / 9) / 3, (4 / 9) / 3])


def test_characters_of_one_class_are_told_apart(spark):
    chance = np.random.default_rng(8)
    letters = [chr(0x430 + n) for n in range(32)]
    vocabulary = ["".join(chance.choice(letters, chance.integers(2, 9))) for _ in range(300)]
    texts = [" ".join(chance.choice(vocabulary, 80)) for _ in range(80)]
    # Ten times a thousand code points on: each character stays in its class.
    strange = texts[0].translate({ord(letter): ord(letter) + 10_000 for letter in letters})
    codes, lengths = quality_rules.gram_codes([texts[0], strange])
    assert codes[: lengths[0]].tolist() == codes[lengths[0] :].tolist()
    rows = [(n, text, "xx") for n, text in enumerate([*texts, strange])]
    judged = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    found = {row["doc_id"]: row for row in judged}
    assert not any(row["base_failed"] for row in judged)
    assert found[80]["perplexity"] > 2 * max(found[n]["perplexity"] for n in range(80))
    assert [found[n]["kept"] for n in range(81)] == [True] * 80 + [False]


def _vocabulary_texts(chance, letters, count):
    vocabulary = ["".join(chance.choice(letters, chance.integers(2, 9))) for _ in range(300)]
    return [" ".join(chance.choice(vocabulary, 80)) for _ in range(count)]


def test_characters_are_judged_by_what_stands_before_them(spark):
    chance = np.random.default_rng(9)
    letters = [chr(0x430 + n) for n in range(32)]
    texts = _vocabulary_texts(chance, letters, 80)
    # Each letter becomes another one of its class that the language has as often.
    turned = texts[0].translate({ord(letter): 0x430 + (n + 10 if n + 10 < 32 else n % 10) for n, letter in enumerate(letters)})
    codes, lengths = quality_rules.gram_codes([texts[0], turned])
    assert codes[: lengths[0]].tolist() == codes[lengths[0] :].tolist()
    rows = [(n, text, "xx") for n, text in enumerate([*texts, turned])]
    judged = quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    found = {row["doc_id"]: row for row in judged}
    assert found[80]["perplexity"] > 2 * max(found[n]["perplexity"] for n in range(80))
    assert [found[n]["kept"] for n in range(81)] == [True] * 80 + [False]


def _plain(text):
    """Digits, marks, white space and other ASCII as one character each."""
    return "".join("\t0!\x00"[int(class_table()[ord(c)]) - 26] if c < "\x80" and not "a" <= c <= "z" else c for c in text)


def _scores_by_hand(rows):
    """The log probability of (text number, its language, language, n-gram) as dictionaries have it."""
    counts = {}
    for number, (text, lang) in enumerate(rows):
        for gram in _grams(text):
            counts.setdefault(lang, {}).setdefault(gram, []).append(number)
    tables, bases, spelled = {}, {}, {}
    for lang, grams in counts.items():
        of = {gram: (len(numbers), set(numbers)) for gram, numbers in grams.items()}
        plain = {}
        for gram, (n, numbers) in of.items():
            before, have = plain.get(_plain(gram), (0, set()))
            plain[_plain(gram)] = (before + n, have | numbers)
        tables[lang] = {ORDER: plain}
        codes, often = Counter(), Counter()
        for gram, (n, _) in of.items():
            code = 0
            for c in gram:
                code = code * CLASSES + int(class_table()[ord(c)])
            codes[code] += n
            often[ord(gram[-1])] += n if class_table()[ord(gram[-1])] >= 26 else 0
        keys = np.array(sorted(codes))
        bases[lang] = KneserNey.of(keys, np.array([codes[key] for key in keys.tolist()]))
        spelled[lang] = (np.array(sorted(+often), np.uint32), np.array([often[point] for point in sorted(+often)]))
        for size in range(ORDER - 1, 0, -1):
            shorter = {}
            for gram, (_, numbers) in tables[lang][size + 1].items():
                n, have = shorter.get(gram[1:], (0, set()))
                shorter[gram[1:]] = (n + 1, have | numbers)
            tables[lang][size] = shorter
    alphabet, shares = shares_in_class(spelled)
    alphabet = alphabet.tolist()
    cuts = {(lang, size): discounts(np.array([n for n, _ in table.values()])) for lang in tables for size, table in tables[lang].items()}

    def share(lang, c):
        return shares[lang][alphabet.index(ord(c))] if ord(c) in alphabet else 0

    def base(lang, gram):
        code = 0
        for c in gram:
            code = code * CLASSES + int(class_table()[ord(c)])
        return math.exp(bases[lang].score(np.array([code]))[0] + (share(lang, gram[-1]) if gram[-1] > "\x7f" else 0))

    def chance(own, lang, gram, size):
        if not size:
            return base(lang, gram)
        end, table, cut = gram[-size:], tables[lang][size], cuts[lang, size]
        below = chance(own, lang, gram, size - 1)
        known = {g: v for g, v in table.items() if g[:-1] == end[:-1]}
        evidence = len(set().union(*[numbers for _, numbers in known.values()])) > own
        if not evidence:
            return below
        total = sum(n for n, _ in known.values())
        weight = sum(cut[min(n, 3)] for n, _ in known.values()) / total
        n, numbers = known.get(end, (0, set()))
        return (n - cut[min(n, 3)]) / total * (len(numbers) > own) + weight * below

    def score(own, lang, gram):
        return math.log(chance(own, lang, _plain(gram), ORDER)) + (share(lang, gram[-1]) if gram[-1] <= "\x7f" else 0)

    remembered = cache(score)
    return lambda home, lang, gram: remembered(int(home == lang), lang, gram)


def test_perplexity_by_hand(spark):
    chance = np.random.default_rng(10)
    texts = {
        "aa": _vocabulary_texts(chance, list("abcdeéè "), 4),
        "bb": _vocabulary_texts(chance, [chr(0x430 + n) for n in range(14)], 3),
        None: ["Some other thing, written once: 1,234 + 56 = 1,290; (#7).", "漢字 and 漢語 and 字漢"],
    }
    texts["aa"] += [texts["aa"][0], texts["bb"][0][:200] + texts["aa"][1][:200], "a" * 64, "q", ""]
    rows = [(text, lang or "") for lang, some in texts.items() for text in some]
    score = _scores_by_hand(rows)
    mean = {}
    for lang in {lang for _, lang in rows}:
        own = [score(lang, lang, gram) for text, home in rows if home == lang for gram in _grams(text)]
        mean[lang] = -sum(own) / len(own)
    wanted = {}
    for number, (text, lang) in enumerate(rows):
        own = [score(lang, lang, gram) for gram in _grams(text)]
        if own and -sum(own) / len(own) > mean[lang]:
            by_lang = [[score(lang, other, gram) for gram in _grams(text)] for other in ("aa", "bb")] + [own]
            own = [max(sum(scores[at : at + 64]) for scores in by_lang) for at in range(0, len(own), 64)]
        wanted[number] = math.exp(-sum(own) / len(text)) if text else None
    frame = spark.createDataFrame([(n, text, lang or None) for n, (text, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    results = []
    for held in (quality_rules.HELD, 100, 0):
        results.append(by_id(quality_rules.quality_rules(frame.repartition(3), held=held), "doc_id", "perplexity", "kept"))
        for number, perplexity, _ in results[-1]:
            assert perplexity == (wanted[number] if wanted[number] is None else pytest.approx(wanted[number], rel=1e-4))
    assert len({tuple(row[2] for row in rows) for rows in results}) == 1


def _grams(text):
    padded = "\n" * (ORDER - 1) + text.lower()
    return [_plain(padded[at : at + ORDER - 1]) + padded[at + ORDER - 1] for at in range(len(text))]


def test_characters_of_large_alphabets_are_numbered(monkeypatch):
    texts = ["Ab c\né漢 ab c", "", None, "".join(map(chr, range(0x4E00, 0x5600))) * 2]
    few = quality_rules._characters(texts)
    monkeypatch.setattr(quality_rules, "DENSE", 1)
    many = quality_rules._characters(texts)
    for grams, which, lengths in (few, many):
        assert len({tuple(gram) for gram in grams.tolist()}) == len(grams)
        assert ["".join(map(chr, gram)) for gram in grams[which].tolist()] == [gram for text in texts for gram in _grams(text or "")]
        assert lengths.tolist() == [len(text or "") for text in texts]


def test_kept_follows_the_bands(spark, small, documents):
    rows = quality_rules.quality_rules(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    bands = {}
    for lang in {row["lang"] for row in rows}:
        own = sorted(math.log(row["perplexity"]) for row in rows if row["lang"] == lang and not row["base_failed"])
        low, middle, high = (own[max(0, math.ceil(len(own) * share) - 1)] for share in (0.25, 0.5, 0.75))
        bands[lang] = (
            middle - max(quality_rules.REACH * (middle - low), quality_rules.LEAST_REACH),
            middle + max(quality_rules.REACH * (high - middle), quality_rules.LEAST_REACH),
        )
    for row in rows:
        assert row["base_failed"] == (row["n_words"] < 20 or 100 * row["n_repeat_words"] > 30 * row["n_words"])
        low, high = bands[row["lang"]]
        more = quality_rules.SCATTER / math.sqrt(max(1, row["word_chars"]))
        level = math.log(row["perplexity"])
        if min(abs(level - low + more), abs(level - high - more)) > 1e-9:
            assert row["kept"] == (not row["base_failed"] and low - more <= level <= high + more)
    labels = {row["doc_id"]: row["quality"] for row in spark.read.parquet(f"{small}/labels.parquet").collect()}
    clean = [row for row in rows if labels.get(row["doc_id"]) == 1 and not row["base_failed"]]
    assert sum(row["kept"] for row in clean) >= 0.97 * len(clean)


def test_rules_of_odd_rows(odd, none):
    rows = by_id(quality_rules.quality_rules(odd), "doc_id", "n_words", "perplexity", "base_failed", "kept")
    assert [(row[0], row[1]) for row in rows] == [(row[0], row[1]) for row in sorted(((d, len(words(t)), 0) for d, t, _ in ODD), key=repr)]
    assert all((row[2] is None) == (row[0] in (1, 2)) for row in rows)
    assert not any(row[4] for row in rows if row[3])
    assert quality_rules.quality_rules(none).collect() == []


def test_folds(spark):
    import zlib

    rows = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("fold", fold(4)).collect()
    assert all(row["fold"] == zlib.crc32(str(row["doc_id"]).encode()) % 4 for row in rows)
