"""Quality rules: plain counts of each text, and bands of n-gram perplexity by language."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.kneser_ney import ORDER, KneserNey, discounts_of
from tidemill.llm.letters import CLASSES, WHITE, class_table, code_points, plain_table, shares_in_class
from tidemill.llm.store import stored
from tidemill.llm.wordstream import Block, as_bytes, groups_of, is_in, mix, sized, window_hashes

# Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30

LANGUAGES = 64
NO_LANGUAGE = ""
# A band reaches this many times the distance from the median to a quartile.
REACH = 8.0
LEAST_REACH = 0.08
# The mean over n characters scatters; the band is wider by this over the root of n.
SCATTER = 1.0

# Length of the pieces that a surprising text is judged in, and how many languages they are tried in.
PIECE = 64
PIECE_LANGUAGES = 8

CHARS = [f"c{n}" for n in range(1, ORDER + 1)]
# The last character as it stands in the context of others.
PLAIN = [*CHARS[:-1], "plain"]
PARTS = ["known", "left", "own_known", "own_left"]
# So many n-grams are sent to all tasks at most; the others go to the texts that have them.
HELD = 1 << 18
# Sums of the pieces of a text that are known, under its own and under the best language.
CLOSED = ["closed_own", "closed_best"]
# Rows in a batch that a task gives.
SENT_ROWS = 1 << 16
# Values below this are numbered by a table of all of them.
DENSE = 1 << 22

_IS_SYMBOL = bytes(byte in SYMBOLS for byte in range(256))


def repeated_lines(text: bytes | None) -> int:
    """Lines with a word that equal an earlier line."""
    lines = (text or b"").split(b"\n")
    if len(lines) == 1:
        return 0
    with_words = [line for line in lines if line.split()]
    return len(with_words) - len(set(with_words))


def base_counts(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    block = Block(texts)
    data = block.data

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(flags)))
        return sums[block.offsets[1:]] - sums[block.offsets[:-1]] if len(texts) else sums[:0]

    at = np.flatnonzero(block.inside(REPEAT_WINDOW))
    keys = mix(window_hashes(block.hashes(), REPEAT_WINDOW)[at] + block.owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    sizes = np.diff(np.append(groups_of(keys[order]), len(keys)))
    again = np.zeros(len(keys), bool)
    if len(keys):
        again[order] = np.repeat(sizes > 1, sizes)
    return {
        "n_words": block.counts.astype(np.int64),
        "word_chars": per_text(((data & 0xC0) != 0x80) & ~block.gap),
        "n_symbols": per_text(np.frombuffer(block.bytes.translate(_IS_SYMBOL), np.uint8)),
        "n_dup_lines": np.fromiter(map(repeated_lines, texts), np.int64, len(texts)),
        "n_repeat_words": block.per_text(block.cover(at[again], REPEAT_WINDOW)).astype(np.int64),
    }


def _numbered(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of values below ``size``, and the place of each value among them."""
    if size > DENSE:
        coded = pa.array(values).dictionary_encode()
        return np.asarray(coded.dictionary), np.asarray(coded.indices)
    places = np.zeros(size, np.int32)
    places[values] = 1
    found = np.flatnonzero(places)
    places[found] = np.arange(len(found))
    return found, places[values]


def _characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams of the texts, a row of code points each; the one that ends at each character; the lengths of the texts.

    All but the last character of an n-gram are as ``plain_table`` has them.
    """
    points, starts, lengths = code_points(texts, ORDER - 1)
    own = np.zeros(len(points) + 1, np.int8)
    np.add.at(own, starts[lengths > 0], 1)
    np.subtract.at(own, (starts + lengths)[lengths > 0], 1)
    inside = np.cumsum(own[:-1], dtype=np.int8) > 0
    alphabet, plain = _numbered(plain_table()[points], 0x110000)
    grams, which = alphabet[:, None], plain
    for size in range(1, ORDER):
        following = plain[size:]
        if size == ORDER - 1:
            alphabet, exact = _numbered(points, 0x110000)
            which, following = which[:-1][inside[size:]], exact[inside]
        else:
            which = which[:-1]
        found, which = _numbered(which.astype(np.int64) * len(alphabet) + following, len(grams) * len(alphabet))
        grams = np.column_stack((grams[found // len(alphabet)], alphabet[found % len(alphabet)]))
    return grams, which, lengths


def class_codes(grams: np.ndarray) -> np.ndarray:
    """The classes of the characters of each n-gram as one number."""
    codes = np.zeros(len(grams), np.int64)
    for points in grams.T:
        codes = codes * CLASSES + class_table()[points]
    return codes


def gram_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The class code of the n-gram that ends at each character of the texts, and the lengths of the texts."""
    grams, which, lengths = _characters(texts)
    return class_codes(grams)[which], lengths


def _named(df: DataFrame, languages: list[str], lang_col: str):
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANGUAGE))
    return F.when(lang.isin(languages), lang).otherwise(F.lit(NO_LANGUAGE))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each n-gram of characters occurs by language, and the first and the last row that has it."""
    row = TaskContext.get().partitionId() << 33
    for batch in sized(batches, "text", 2 << 20):
        grams, which, lengths = _characters(batch.column(0).to_pylist())
        plain = plain_table()[grams[:, -1]]
        langs, lang = np.unique(np.array(batch.column(1).to_pylist(), dtype=object), return_inverse=True)
        owner = np.repeat(np.arange(row, row + len(lengths)), lengths)
        found, at = _numbered(np.repeat(lang, lengths) * len(grams) + which, len(langs) * len(grams))
        first, last = np.zeros((2, len(found)), np.int64)
        last[at] = owner
        first[at[::-1]] = owner[::-1]
        row += len(lengths)
        if len(found):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(langs[found // len(grams)], pa.string()),
                    *[pa.array(points[found % len(grams)].astype(np.int32)) for points in (*grams.T, plain)],
                    pa.array(np.bincount(at)),
                    pa.array(first),
                    pa.array(last),
                ],
                ["lang", *CHARS, "plain", "n", "first", "last"],
            )


def _points(batch: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([np.asarray(batch.column(name)) for name in CHARS])


def _classed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each class code occurs, and as -1 less its code point each character that shares its class."""
    for batch in batches:
        grams = _points(batch)
        codes = class_codes(grams)
        shared = codes % CLASSES >= WHITE
        lang, often = batch.column("lang"), batch.column("n")
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([lang, lang.filter(pa.array(shared))]),
                pa.array(np.concatenate((codes, -1 - grams[shared, -1].astype(np.int64))).astype(np.int32)),
                pa.concat_arrays([often, often.filter(pa.array(shared))]),
            ],
            ["lang", "code", "often"],
        )


def _models(table: pa.Table) -> pa.Table:
    codes, often = np.asarray(table.column("code")), np.asarray(table.column("often"))
    points, spelled = (-1 - codes[codes < 0]).astype(np.uint32), often[codes < 0]
    model = KneserNey.of(codes[codes >= 0], often[codes >= 0])
    arrays = [model.grams, model.scores, model.contexts, model.weights, points, spelled]
    return pa.table({"lang": table.column("lang").slice(0, 1), "part": pa.array([[a.tobytes() for a in arrays]], pa.list_(pa.binary()))})


def class_models(counted: DataFrame) -> tuple[dict[str, KneserNey], np.ndarray, dict[str, np.ndarray]]:
    """A model over classes for each language of ``counted``, all characters, and their shares in their classes by language.

    There are at most ``LANGUAGES`` + 1 of them, of CLASSES^ORDER n-grams and all of Unicode's characters each.
    """
    codes = counted.select("lang", *CHARS, "n").mapInArrow(_classed, "lang string, code int, often bigint")
    grams = codes.groupBy("lang", "code").agg(F.sum("often").alias("often"))
    rows = grams.groupBy("lang").applyInArrow(_models, "lang string, part array<binary>").collect()
    kinds = (np.uint64, np.float32, np.uint64, np.float32, np.uint32, np.int64)
    parts = {row["lang"]: [np.frombuffer(data, kind) for data, kind in zip(row["part"], kinds, strict=True)] for row in rows}
    alphabet, shares = shares_in_class({lang: (arrays[4], arrays[5]) for lang, arrays in parts.items()})
    return {lang: KneserNey(*arrays[:4]) for lang, arrays in parts.items()}, alphabet, shares


def _with_classes(sent):
    """Log probabilities of n-grams: what they are known for, and of what is left the part that their classes give them."""

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, alphabet, shares = sent.value
        # A character that is all of its class has none to share it with.
        shares = {lang: np.append(share, 0) for lang, share in shares.items()}
        for batch in batches:
            grams = _points(batch)
            codes, last = class_codes(grams), grams[:, -1]
            place = np.searchsorted(alphabet, last)
            place[~is_in(last, alphabet)] = len(alphabet)
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            base, share = np.zeros((2, len(grams)))
            for lang in set(langs):
                part = langs == lang
                base[part], share[part] = models[lang].score(codes[part]), shares[lang][place[part]]
            # Characters beyond ASCII are told apart by the n-grams, others of one class by their shares in it alone.
            beyond = last > 127
            base, share = np.exp(base + np.where(beyond, share, 0)), np.where(beyond, 0, share)
            scores = [
                np.log(np.asarray(batch.column(f"{kind}known")) + np.asarray(batch.column(f"{kind}left")) * base) + share
                for kind in ("", "own_")
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in ("lang", *CHARS, "n")], *[pa.array(values.astype(np.float32)) for values in scores]],
                ["lang", *CHARS, "n", "score", "own"],
            )

    return score


def _cuts(counts: dict[int, DataFrame]) -> DataFrame:
    """What a count of 1, 2 and of 3 or more gives up, by language and length of n-gram."""
    spark = counts[1].sparkSession
    parts = [
        table.groupBy("lang").agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)]).withColumn("size", F.lit(size))
        for size, table in counts.items()
    ]
    rows = reduce(DataFrame.unionByName, parts).collect()
    cuts = [(row["size"], row["lang"], *discounts_of([row[f"n{k}"] for k in range(1, 5)])[1:].tolist()) for row in rows]
    return spark.createDataFrame(cuts, "size int, lang string, cut1 double, cut2 double, cut3 double")


def _by_gram(table: DataFrame, chars: list[str], value: Column, asked: Column) -> DataFrame:
    """A row for each n-gram and language, its own ones and ``asked``, with the columns of ``value`` or NULLs."""
    return (
        table.groupBy(*chars)
        .agg(F.map_from_entries(F.collect_list(F.struct("lang", value))).alias("found"))
        .select(*chars, "found", F.explode(F.array_union(asked, F.map_keys("found"))).alias("lang"))
        .select("lang", *chars, F.col("found")[F.col("lang")].alias("found"))
        .select("lang", *chars, "found.*")
    )


def gram_scores(counted: DataFrame, often: list[str]) -> DataFrame:
    """``often`` and, by language, ``n`` and log probabilities of each n-gram of characters: modified Kneser-Ney.

    ``counted`` has each n-gram of a language once. A language scores its own n-grams and, if it is one of ``often``,
    all others'. ``own`` is for the rows of the language, which are no evidence for themselves: an n-gram or a
    context that a single row has counts as unseen there. What single characters leave is shared out by models over classes.
    """
    sent = counted.sparkSession.sparkContext.broadcast(class_models(counted))
    counts = {}
    for size in range(ORDER, 0, -1):
        # Below the longest: how many different characters stand before it.
        shorter = (counts[size + 1] if size < ORDER else counted).groupBy("lang", *PLAIN[-size:])
        number = F.count("*") if size < ORDER else F.sum("n")
        counts[size] = stored(
            shorter.agg(number.alias("n"), F.min("first").alias("first"), F.max("last").alias("last")), f"counted-{size}"
        )
    cuts = _cuts(counts)
    asked = F.array(*map(F.lit, often)).cast("array<string>")
    below = None
    for size in range(1, ORDER + 1):
        chars = PLAIN[-size:]
        cut = F.when(F.col("n") == 1, F.col("cut1")).when(F.col("n") == 2, F.col("cut2")).otherwise(F.col("cut3"))
        # A row for each of at most LANGUAGES + 1 languages.
        seen = counts[size].join(F.broadcast(cuts.filter(F.col("size") == size)), "lang").withColumn("cut", cut)
        contexts = seen.groupBy("lang", *chars[:-1]).agg(
            F.sum("n").alias("total"), F.sum("cut").alias("given"), (F.min("first") != F.max("last")).alias("others")
        )
        value = F.struct("n", "cut", (F.col("first") != F.col("last")).alias("shared"))
        scored = _by_gram(seen, chars, value, asked).join(contexts, ["lang", *chars[:-1]], "left")
        if below is not None:
            scored = scored.join(below, ["lang", *chars[1:]])
        # Single characters have nothing known below them, and all is left.
        lower = {name: F.col(f"below_{name}") if size > 1 else F.lit(float(name.endswith("left"))) for name in PARTS}
        share, weight = (F.col("n") - F.col("cut")) / F.col("total"), F.col("given") / F.col("total")
        kept, passed = F.coalesce(share, F.lit(0.0)), F.coalesce(weight, F.lit(1.0))
        own_kept, own_passed = F.when(F.col("shared"), share).otherwise(0.0), F.when(F.col("others"), weight).otherwise(1.0)
        values = {
            "known": kept + passed * lower["known"],
            "left": passed * lower["left"],
            "own_known": own_kept + own_passed * lower["own_known"],
            "own_left": own_passed * lower["own_left"],
        }
        below = scored.select("lang", *chars, *[value.alias(f"below_{name}") for name, value in values.items()])
    names = ["lang", *CHARS, F.coalesce("n", F.lit(0)).alias("n"), *[F.col(f"below_{name}").alias(name) for name in PARTS]]
    chars = ", ".join(f"{name} int" for name in CHARS)
    return (
        _by_gram(counted, [*CHARS, "plain"], F.struct("n"), asked)
        .join(below, ["lang", *PLAIN])
        .select(*names)
        .mapInArrow(_with_classes(sent), f"lang string, {chars}, n bigint, score float, own float")
        .groupBy(*CHARS)
        .agg(
            F.sum("n").alias("often"),
            F.map_from_entries(F.collect_list(F.struct("lang", F.struct("n", "score", "own")))).alias("by_lang"),
        )
    )


def _keys(grams: np.ndarray) -> np.ndarray:
    keys = np.zeros(len(grams), np.uint64)
    for points in grams.T:
        keys = mix(keys + points.astype(np.uint64) + np.uint64(1))
    return keys


class _Held:
    """Scores of n-grams that every task holds, ``own`` by language and ``score`` by frequent language."""

    def __init__(self, table: pa.Table, langs: int, often: int):
        grams = np.column_stack([np.asarray(table.column(name)) for name in CHARS]).astype(np.uint32)
        keys = _keys(grams)
        order = np.argsort(keys)
        self.keys, self.grams = keys[order], grams[order]
        self.own, self.score = (
            np.array([table.column(f"{kind}{n}").to_numpy() for n in range(count)], np.float32).reshape(count, len(grams)).T[order]
            for kind, count in (("own", langs), ("score", often))
        )

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each n-gram, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(grams), np.int64), np.zeros(len(grams), bool)
        at = np.minimum(np.searchsorted(self.keys, _keys(grams)), len(self.keys) - 1)
        return at, (self.grams[at] == grams).all(axis=1)


def _holding(scores: DataFrame, langs: list[str], often: list[str], held: int) -> tuple[_Held, bool]:
    """The most frequent of the n-grams, at most ``held``, and whether they are all."""
    bits = F.length(F.bin("often"))
    levels = sorted(scores.groupBy(bits.alias("bits")).count().collect(), key=lambda row: -row["bits"])
    sums = np.cumsum([row["count"] for row in levels])
    fit = int((sums <= held).sum())
    least = levels[fit - 1]["bits"] if fit else 64
    chosen = scores.filter(bits >= least).select(
        *CHARS,
        *[F.col("by_lang")[lang]["own"].alias(f"own{n}") for n, lang in enumerate(langs)],
        *[F.col("by_lang")[lang]["score"].alias(f"score{n}") for n, lang in enumerate(often)],
    )
    found = _Held(chosen.toArrow(), len(langs), len(often))
    return found, fit == len(levels) and len(np.unique(found.keys)) == len(found.keys)


def _surprise(
    scores: _Held, grams: np.ndarray, which: np.ndarray, lengths: np.ndarray, langs: np.ndarray, usual: np.ndarray, often: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Mean surprise of each text. One over the mean of its language is taken in pieces, each in the language that fits it best.

    A text with n-grams that are not held is left open, and so are its pieces that have them: text and number of these pieces with
    their sums, and of those n-grams, are given, and the sums of all other pieces of the text.
    """
    size = len(lengths)
    owner = np.repeat(np.arange(size), lengths)
    at, known = scores.find(grams)
    missing = ~known[which]
    own = scores.own[at[which], langs[owner]] if len(scores.keys) else np.zeros(len(which), np.float32)
    own[missing] = 0
    is_open = np.bincount(owner[missing], minlength=size) > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = -np.bincount(owner, own, size) / lengths
    over = (mean > usual[langs]) & ~is_open
    part = (over | is_open)[owner]
    piece = (np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths)) // PIECE
    first = groups_of(piece[part] + owner[part] * (int(lengths.max(initial=0)) // PIECE + 1))
    whose = owner[part][first]
    sums = np.zeros((len(first), 1 + len(often)))
    sent = np.zeros(len(first), bool)
    if len(first):
        sent = np.logical_or.reduceat(missing[part], first)
        sums[:, 0] = np.add.reduceat(own[part], first)
        for n, lang in enumerate(often):
            if len(scores.keys):
                sums[:, n + 1] = np.add.reduceat(np.where(known, scores.score[at, n], 0)[which[part]], first)
            # No row is evidence for itself.
            same = langs[whose] == lang
            sums[same, n + 1] = sums[same, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            pieced = -np.bincount(whose, sums.max(axis=1), size) / lengths
        mean[over] = pieced[over]
    closed = [np.bincount(whose[~sent], values[~sent], size) for values in (sums[:, 0], sums.max(axis=1, initial=-np.inf))]
    rest = (whose[sent], piece[part][first][sent], sums[sent]), (owner[missing], piece[missing], grams[which[missing]])
    return mean, is_open, np.array(closed), *rest


def _wide(kinds: dict[str, pa.DataType], size: int, values: dict[str, pa.Array]) -> Iterator[pa.RecordBatch]:
    """Rows of all columns, NULL in those that are not given."""
    columns = [values[name].cast(kind) if name in values else pa.nulls(size, kind) for name, kind in kinds.items()]
    rows = pa.RecordBatch.from_arrays(columns, [*kinds])
    for at in range(0, size, SENT_ROWS):
        yield rows.slice(at, SENT_ROWS)


def _score(sent):
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in sized(batches, "text", 2 << 20):
            held, numbers, usual, often = sent.value
            grams, which, lengths = _characters(batch.column(1).to_pylist())
            langs = np.array([numbers[lang] for lang in batch.column(2).to_pylist()], np.int64)
            surprise, is_open, closed, *rest = _surprise(held, grams, which, lengths, langs, usual, often)
            base = {name: pa.array(values) for name, values in base_counts(as_bytes(batch, "text")).items()}
            sums = [f"sum{n}" for n in range(len(often) + 1)]
            kinds = {"row": pa.int64(), "doc_id": batch.column(0).type, "lang": pa.string()}
            kinds |= dict.fromkeys([*base, "chars"], pa.int64()) | dict.fromkeys(["surprise", *CLOSED, *sums], pa.float64())
            kinds |= dict.fromkeys(["piece", *CHARS], pa.int32())
            own = {"row": pa.array(np.arange(row, row + len(lengths))), "lang": batch.column(2)}
            done = {"doc_id": batch.column(0), "chars": pa.array(lengths), "surprise": pa.array(surprise, mask=(lengths == 0) | is_open)}
            done |= {name: pa.array(values, mask=~is_open) for name, values in zip(CLOSED, closed, strict=True)}
            yield from _wide(kinds, len(lengths), own | base | done)
            for names, (whose, piece, values) in zip((sums, CHARS), rest, strict=True):
                at = pa.array(whose)
                found = {name: column.take(at) for name, column in own.items()} | {"piece": pa.array(piece)}
                yield from _wide(kinds, len(whose), found | {name: pa.array(column) for name, column in zip(names, values.T, strict=True)})
            row += len(lengths)

    return score


def _completed(scored: DataFrame, scores: DataFrame, usual: dict[str, float], often: list[str]) -> DataFrame:
    """``scored`` with the surprise of the texts that were left open, by the scores of the n-grams that no task holds."""
    sums = [f"sum{n}" for n in range(len(often) + 1)]
    names = ["row", "lang", "piece"]
    held = scored.filter("sum0 IS NOT NULL").select(*names, *sums)
    own = F.col("by_lang")[F.col("lang")]["own"]
    others = [F.when(F.col("lang") == lang, own).otherwise(F.col("by_lang")[lang]["score"]) for lang in often]
    values = [value.cast("double").alias(name) for value, name in zip([own, *others], sums, strict=True)]
    rare = scored.filter("c1 IS NOT NULL").select(*names, *CHARS).join(scores, CHARS).select(*names, *values)
    pieces = held.unionByName(rare).groupBy(*names).agg(*[F.sum(name).alias(name) for name in sums])
    best = F.array_max(F.array(*sums))
    # A row for each of at most LANGUAGES + 1 languages.
    means = F.broadcast(scored.sparkSession.createDataFrame(list(usual.items()), "lang string, usual double"))
    whole = pieces.groupBy("row").agg(F.sum(sums[0]).alias("own"), F.sum(best).alias("best"))
    texts = scored.filter("piece IS NULL").drop("piece", *sums, *CHARS).join(whole, "row", "left").join(means, "lang")
    own, best = [-(F.col(name) + F.col(closed)) / F.col("chars") for name, closed in zip(("own", "best"), CLOSED, strict=True)]
    later = F.when(own > F.col("usual"), best).otherwise(own)
    return texts.withColumn("surprise", F.coalesce("surprise", later)).drop("own", "best", "usual", *CLOSED)


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", reach: float = REACH, held: int = HELD
) -> DataFrame:
    """``doc_id``, counts, ``base_failed``, ``perplexity``, the band of its language and ``kept`` for each row.

    Counts: ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``. A row fails the
    base with fewer than 20 words or over 30 % repeated words. Perplexity is per character under the model of
    the row's language, counted over all rows of it: 4-grams of the lower-cased characters themselves, however many there are.
    White space, digits, marks and other ASCII stand as one character each in n-grams, times the share that each has
    among them. An n-gram that only the row itself has counts as unseen for it. What single characters leave is shared
    out by 4-grams of 40 character classes, times the share of a character beyond ASCII in its class. At most ``held``
    4-grams, the most frequent, are sent to all tasks, the others join the texts that have them. A text over the mean
    of its language is taken in pieces of 64 characters, each under the one of the eight most frequent languages that
    fits it best, so mixed languages alone are no fault.
    A row is kept if it passes the base and its log perplexity lies within
    ``reach`` times the quartile distances (at least ``LEAST_REACH``) around the median of the rows of its
    language that pass the base, wider for short texts by ``SCATTER`` over the root of their characters.

    NULL and empty texts have no words, NULL perplexity and are not kept. NULL languages, and those beyond
    the 64 most frequent, share one model. Repeated rows stay; other columns are left out.
    """
    spark = df.sparkSession
    counted = df.filter(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).cast("string").alias("lang")).count()
    languages = [row[0] for row in counted.orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()]
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _named(df, languages, lang_col).alias("lang"))
    chars = ", ".join(f"{name} int" for name in CHARS)
    counted = stored(
        source.select("text", "lang")
        .mapInArrow(_count, f"lang string, {chars}, plain int, n bigint, first bigint, last bigint")
        .groupBy("lang", *CHARS, "plain")
        .agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")),
        "counted",
    )
    known = {row[0] for row in counted.select("lang").distinct().collect()}
    often = [lang for lang in languages if lang in known][:PIECE_LANGUAGES]
    scores = stored(gram_scores(counted, often), "grams")
    by_lang = scores.select(F.explode("by_lang").alias("lang", "found")).select("lang", "found.*").filter("n > 0").groupBy("lang")
    # A text without characters has a language that may have no model.
    usual = {lang: 0.0 for lang in [*languages, NO_LANGUAGE]}
    usual |= {row[0]: row[1] for row in by_lang.agg(-F.sum(F.col("n") * F.col("own")) / F.sum("n")).collect()}
    numbers = {lang: number for number, lang in enumerate(usual)}
    chosen, all_held = _holding(scores, list(usual), often, held)
    sent = spark.sparkContext.broadcast(
        (chosen, numbers, np.array(list(usual.values())), np.array([numbers[lang] for lang in often], np.int64))
    )
    counts = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
    id_type = source.schema["doc_id"].dataType.simpleString()
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    closed = ", ".join(f"{name} double" for name in CLOSED)
    sums = ", ".join(f"sum{n} double" for n in range(len(often) + 1))
    schema = f"row bigint, doc_id {id_type}, lang string, {counts}, chars bigint, surprise double, {closed}, {sums}, piece int, {chars}"
    scored = stored(source.mapInArrow(_score(sent), schema), "scored")
    scored = scored.filter("piece IS NULL") if all_held else stored(_completed(scored, scores, usual, often), "completed")
    scored = scored.withColumn("base_failed", failed)
    bands = (
        scored.filter("NOT base_failed")
        .groupBy("lang")
        .agg(F.percentile_approx("surprise", [0.25, 0.5, 0.75], 10_000).alias("q"))
        .select(
            "lang",
            (F.col("q")[1] - F.greatest((F.col("q")[1] - F.col("q")[0]) * reach, F.lit(LEAST_REACH))).alias("low"),
            (F.col("q")[1] + F.greatest((F.col("q")[2] - F.col("q")[1]) * reach, F.lit(LEAST_REACH))).alias("high"),
        )
    )
    # A row for each of at most LANGUAGES + 1 languages.
    judged = scored.join(F.broadcast(bands), "lang", "left")
    more = SCATTER / F.sqrt(F.greatest("word_chars", F.lit(1)))
    fits = F.coalesce(F.col("surprise").between(F.col("low") - more, F.col("high") + more), F.lit(False))
    return judged.select(
        "doc_id",
        *[name.split()[0] for name in counts.split(", ")],
        "base_failed",
        F.exp("surprise").alias("perplexity"),
        F.exp("low").alias("lowest"),
        F.exp("high").alias("highest"),
        (~F.col("base_failed") & fits).alias("kept"),
    )
