"""From raw documents to encoded training text, in five stages.

Each stage takes the rows its predecessor kept and returns rows with the columns of ``documents``; the
last adds the encoding. A stage handles NULLs, empty tables, repeated rows and extra columns as its operator
says; what it drops or changes is told at its function.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.decontaminate import contaminated_words
from tidemill.llm.line_dedup import line_dedup
from tidemill.llm.quality_classifier import classify_quality
from tidemill.llm.queries import BEST, read, tokenizer_file
from tidemill.llm.sentencepiece_codec import encode_pieces
from tidemill.llm.simhash import simhash_groups
from tidemill.llm.store import stored


def _carried(docs: DataFrame, without: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], list[Column]]:
    """``docs`` with all but the id also under names that no operator uses, those names, and the way back."""
    inner = {name: f"_c{number}" for number, name in enumerate(docs.columns) if name not in ("doc_id", *without)}
    safe = docs.select("doc_id", "text", *[F.col(name).alias(alias) for name, alias in inner.items()])
    back = [F.col(inner[name]).alias(name) if name in inner else F.col(name) for name in docs.columns if name not in without]
    return safe, list(inner.values()), back


def quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows that the classifier keeps; NULL texts and texts without words go."""
    safe, names, back = _carried(docs)
    return classify_quality(safe, carry=names).filter("kept").select(back)


def lines(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts without the lines of later copies; a text that loses all that it said goes, a NULL text stays NULL."""
    safe, names, back = _carried(docs, without=("text", "n_chars"))
    kept = line_dedup(safe, carry=names).filter("n_removed = 0 OR kept IS NULL OR trim(kept) <> ''")
    texts = kept.select(*back, F.col("kept").alias("text"), F.length("kept").cast("long").alias("n_chars"))
    return texts.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The row with the least id of each SimHash group, at equal ids the least hash of the text; of rows equal in both, one. Rows without id stay."""
    safe, _, back = _carried(docs.filter("doc_id IS NOT NULL"))
    keyed = safe.withColumn("_print", F.xxhash64("text"))
    # Rows with one id and different texts are told apart.
    groups = simhash_groups(keyed.select(F.struct("doc_id", "_print").alias("key"), "text"), id_col="key")
    first = groups.filter("doc_id = component_id").select("doc_id.*").distinct()
    named = keyed.join(first, ["doc_id", "_print"], "left_semi").dropDuplicates(["doc_id", "_print"])
    return named.select(back).unionByName(docs.filter("doc_id IS NULL")).select(docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows without any window of a benchmark item."""
    safe, names, back = _carried(docs)
    return contaminated_words(safe, read(spark, folder, "benchmark"), carry=names).filter("n_hit = 0").select(back)


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All rows with ``ids``, ``n_pieces`` and ``round_trip`` (whether the ids, and those of the next best segmentations,
    decode to the text), in place of such columns."""
    kept = docs.drop("ids", "n_pieces", "round_trip")
    safe, names, back = _carried(kept, without=("text",))
    # Encoding and decoding are one pass: the text goes to the tasks once.
    pieces = encode_pieces(safe, tokenizer_file(), n=BEST, carry=["text", *names], decode=True)
    trip = ((F.coalesce("text", F.lit("")) == F.col("decoded")) & F.col("others_decode")).alias("round_trip")
    done = pieces.select(*back, "text", "ids", F.size("ids").cast("long").alias("n_pieces"), trip)
    return done.select(*kept.columns, "ids", "n_pieces", "round_trip")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", clean_of_benchmark),
    ("SentencePiece encoding and decoding", encoded),
]

# The classifier and the piece lattice are beyond SQL; tests/llm compares with a brute-force run.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, folder)
