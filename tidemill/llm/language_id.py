"""Language identification by cross-parsing against suffix automata of labelled text.

A text is cut into phrases, each the longest that occurs somewhere in a language's sample. The
fewer phrases, the better the language fits: phrases times the logarithm of the sample's length
over the text's length is its cross-parsing entropy, and the least one wins. An automaton knows
after each character whether the phrase goes on, so many texts are parsed side by side in numpy.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.letters import WHITE
from tidemill.llm.wordstream import sized

UNKNOWN = "und"
# Languages whose automata are sent to the tasks together; further ones follow in blocks.
LANGUAGES = 64
SAMPLE_TEXTS = 64
SAMPLE_CHARACTERS = 32_000
# Of a block of languages together; an automaton has at most twice as many states as characters.
ALL_CHARACTERS = 128_000
# A phrase ends at the end of a piece of this many characters.
PIECE = 2048
LETTERS = 48
_tables: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    """Class of each code point: a-z, other letters by number, and one class for all else."""
    if "letters" not in _tables:
        points = np.arange(0x110000)
        table = np.full(len(points), WHITE, np.uint8)
        is_letter = np.fromiter((chr(point).isalpha() for point in range(0x110000)), np.bool_, 0x110000)
        other = is_letter & (points > 127)
        table[other] = (WHITE + 1 + points[other] % (LETTERS - WHITE - 1)).astype(np.uint8)
        for first in (ord("a"), ord("A")):
            table[first : first + 26] = np.arange(26)
        _tables["letters"] = table
    return _tables["letters"]


def classes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes with a run of non-letters as one; how many each text has; whether it has a letter."""
    lowered = [(text or "").lower() for text in texts]
    lengths = np.fromiter(map(len, lowered), np.int64, len(lowered))
    classes = letter_table()[np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)]
    owner = np.repeat(np.arange(len(texts)), lengths)
    keep = classes != WHITE
    lettered = np.bincount(owner[keep], minlength=len(texts)) > 0
    keep[1:] |= (classes[:-1] != WHITE) & (owner[1:] == owner[:-1])
    return classes[keep], np.bincount(owner[keep], minlength=len(texts)), lettered


def automaton(classes: np.ndarray) -> np.ndarray:
    """Transitions of the suffix automaton, state by class: twice the next state, and one more where a phrase begins.

    Where a phrase cannot go on, the character starts a new one; a character the sample lacks is a phrase.
    """
    steps = np.full((2 * len(classes) + 2, LETTERS), -1, np.int32)
    link, length = [-1], [0]
    last = 0
    for code in classes.tolist():
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        at = last
        while at >= 0 and steps[at, code] < 0:
            steps[at, code] = new
            at = link[at]
        if at >= 0:
            to = int(steps[at, code])
            if length[to] == length[at] + 1:
                link[new] = to
            else:
                copy = len(link)
                link.append(link[to])
                length.append(length[at] + 1)
                steps[copy] = steps[to]
                while at >= 0 and steps[at, code] == to:
                    steps[at, code] = copy
                    at = link[at]
                link[to] = link[new] = copy
        last = new
    steps = steps[: len(link)]
    table = np.where(steps < 0, np.maximum(steps[0], 0) * 2 + 1, steps * 2)
    table[0] |= 1
    return table.astype(np.int32)


def phrases(table: np.ndarray, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many phrases each text is cut into."""
    pieces = -(-lengths // PIECE)
    owner = np.repeat(np.arange(len(lengths)), pieces)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = (np.cumsum(lengths) - lengths)[owner] + nth * PIECE
    size = np.minimum(PIECE, lengths[owner] - nth * PIECE)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    alive = np.searchsorted(-size, -np.arange(PIECE), "left")
    state = np.zeros(len(size), np.int64)
    count = np.zeros(len(size), np.int64)
    flat, width = table.ravel(), table.shape[1]
    for step in range(int(size[0]) if len(size) else 0):
        n = alive[step]
        got = flat[state[:n] * width + classes[begin[:n] + step]]
        count[:n] += got & 1
        state[:n] = got >> 1
    return np.bincount(owner[order], count, len(lengths)).astype(np.int64)


def sample(labelled: DataFrame, languages: list[str], texts: int = SAMPLE_TEXTS) -> DataFrame:
    """``lang`` and ``text`` of a fixed choice of at most ``texts`` rows of each of some languages."""
    # The filter on the row number is applied before the shuffle as well: at most ``texts`` rows a task and language.
    by_chance = Window.partitionBy("lang").orderBy("pick", "doc_id")
    chosen = (
        labelled.filter(F.col("lang").isin(languages))
        .select("lang", "doc_id", F.xxhash64(F.col("doc_id").cast("string")).alias("pick"))
        .withColumn("nth", F.row_number().over(by_chance))
        .filter(F.col("nth") <= texts)
        .select("lang", "doc_id")
    )
    # At most languages x texts rows; of rows with one id, the one whose text has the least hash.
    found = labelled.join(F.broadcast(chosen.distinct()), ["lang", "doc_id"]).groupBy("lang", "doc_id")
    return found.agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("lang", "text")


def _build(characters: int):
    def build(table: pa.Table) -> pa.Table:
        texts = sorted(text for text in table.column("text").to_pylist() if text)
        np.random.default_rng(1).shuffle(texts)
        # Texts are taken in turn, a stretch of each, until the sample is full.
        each = max(1, characters // max(1, len(texts)))
        classes, lengths, _ = classes_of(texts)
        starts = np.cumsum(lengths) - lengths
        spare, parts = characters, []
        for begin, share in ((0, each), (each, characters)):
            for start, length in zip(starts, lengths, strict=True):
                a = min(begin, int(length))
                stretch = classes[start + a : start + min(int(length), a + min(share, spare))]
                parts.append(stretch)
                spare -= len(stretch)
        joined = np.concatenate(parts) if parts else classes
        return pa.table(
            {
                "lang": table.column("lang").slice(0, 1),
                "size": pa.array([len(joined)]),
                "table": pa.array([automaton(joined).tobytes()], pa.binary()),
            }
        )

    return build


Model = tuple[str, int, np.ndarray]


def learn(labelled: DataFrame, characters: int = SAMPLE_CHARACTERS, at_once: int = LANGUAGES) -> Iterator[list[Model]]:
    """Language, sample size and automaton for each language of ``labelled`` (doc_id, text, lang), in blocks by name."""
    known = labelled.filter("text IS NOT NULL AND lang IS NOT NULL")
    languages = sorted(row[0] for row in known.select("lang").distinct().collect())
    share = min(characters, ALL_CHARACTERS // max(1, min(at_once, len(languages))))
    for first in range(0, len(languages), at_once):
        chosen = sample(known, languages[first : first + at_once])
        rows = chosen.groupBy("lang").applyInArrow(_build(share), "lang string, size bigint, table binary").collect()
        yield sorted((row[0], row[1], np.frombuffer(row[2], np.int32).reshape(-1, LETTERS)) for row in rows if row[1])


def _judge(sent):
    """Take a block of languages into the least rate so far, its language, and the second least rate."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, "text", 4 << 20):
            classes, lengths, lettered = classes_of(batch.column(1).to_pylist())
            least, second = batch.column(2).to_numpy().copy(), batch.column(3).to_numpy().copy()
            names = np.array(batch.column(4).to_pylist(), object)
            for name, size, table in sent.value:
                rate = phrases(table, classes, lengths) * np.log2(size + 1) / np.maximum(lengths, 1)
                # At equal rates the first name stays.
                less = lettered & (rate < least)
                second = np.where(lettered, np.minimum(second, np.where(less, least, rate)), second)
                least, names = np.where(less, rate, least), np.where(less, name, names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(least), pa.array(second), pa.array(names.tolist(), pa.string())],
                ["doc_id", "text", "least", "second", "name"],
            )

    return judge


def identify_language(
    df: DataFrame,
    learn_from: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    characters: int = SAMPLE_CHARACTERS,
    at_once: int = LANGUAGES,
) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` (0 to 1: how far the runner-up is behind) for each row.

    Languages are learnt from the rows where ``learn_from`` holds and text and language are not NULL:
    ``SAMPLE_TEXTS`` rows of each, chosen by a hash of the id, and ``characters`` characters of them. Languages are
    taken in blocks of ``at_once`` with ``ALL_CHARACTERS`` in all, so what is sent to the tasks for one is bounded; texts pass the
    blocks one after the other in one stage. A tie goes to the first name. A NULL text, one without letters, and any text when nothing was learnt, is ``und`` with
    score 0. Texts are parsed whole, in pieces of ``PIECE`` characters. Repeated rows stay; other columns
    are left out, whatever their names. Texts are not shuffled.
    """
    source = df.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
        F.coalesce(learn_from, F.lit(False)).alias("learn"),
    )
    id_type = source.schema["doc_id"].dataType.simpleString()
    far = F.lit(float("inf"))
    judged = source.select("doc_id", "text", far.alias("least"), far.alias("second"), F.lit(None).cast("string").alias("name"))
    kinds = f"doc_id {id_type}, text string, least double, second double, name string"
    for models in learn(source.filter("learn").select("doc_id", "text", "lang"), characters, at_once):
        judged = judged.mapInArrow(_judge(df.sparkSession.sparkContext.broadcast(models)), kinds)
    # Without a runner-up nothing is behind; two perfect fits are no choice.
    behind = F.when(F.col("second") == float("inf"), 1.0).otherwise(1 - F.col("least") / F.greatest("second", F.lit(1e-12)))
    score = F.when(F.col("name").isNull(), 0.0).otherwise(F.least(F.greatest(behind, F.lit(0.0)), F.lit(1.0)))
    return judged.select("doc_id", F.coalesce("name", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))
