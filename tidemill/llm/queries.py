"""The named queries of this subpackage, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.decontaminate import contaminated_words
from tidemill.llm.hard_negatives import hard_negatives
from tidemill.llm.language_id import identify_language
from tidemill.llm.line_dedup import line_dedup
from tidemill.llm.lm_scores import lm_scores
from tidemill.llm.projected_search import nearest_rows
from tidemill.llm.quality_classifier import classify_quality
from tidemill.llm.quality_rules import quality_rules
from tidemill.llm.reversed_search import search_items
from tidemill.llm.sentencepiece_codec import encode_pieces
from tidemill.llm.simhash import simhash_groups
from tidemill.llm.substring_dedup import substring_dedup
from tidemill.llm.token_counts import token_counts
from tidemill.plans.registry import Registry

LLM = Registry()

TOKENIZER = "piece_bpe_32k.model"
TOKEN_LIMIT = 4096
BEST = 4


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digest(items: str) -> F.Column:
    """SHA-256 of an array of strings, sorted as such and joined by commas."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


op4_sql = """
WITH split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') AS sequence
    FROM (SELECT item_id, words, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM items WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT size FROM windows), places AS (
    SELECT doc_id, size, i, array_to_string(words[i:i + size - 1], ' ') AS sequence
    FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM split, sizes)
), hits AS (SELECT doc_id, item_id, size, i FROM places JOIN windows USING (size, sequence)), per_doc AS (
    SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS word FROM hits) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN per_doc USING (doc_id) LEFT JOIN found USING (doc_id)
"""


@LLM.named("op4_decontamination", op4_sql)
def op4_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    hit = contaminated_words(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
    return hit.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        digest("items").alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@LLM.named("op8_token_counts")
def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts(read(spark, folder, "documents"), tokenizer_file())
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@LLM.named("op9_simhash_near_dedup")
def op9_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_groups(read(spark, folder, "documents"))


op1_sql = """
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), places AS (
    SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS run
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split)
), late AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY run) AS least FROM places) WHERE least < doc_id
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM late
), kept AS (
    SELECT doc_id, w.i, w.word, gone.i IS NOT NULL AS removed
    FROM (SELECT doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM split) AS w LEFT JOIN gone USING (doc_id, i)
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM split LEFT JOIN (
    SELECT doc_id, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS text
    FROM kept GROUP BY doc_id
) USING (doc_id)
"""


@LLM.named("op1_substring_dedup", op1_sql)
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = substring_dedup(read(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@LLM.named("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules(read(spark, folder, "documents"))
    return judged.drop("lowest", "highest")


def fold(count: int) -> F.Column:
    """CRC-32 of the id as text, modulo ``count``."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % count


@LLM.named("op2_language_id")
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    judged = identify_language(read(spark, folder, "documents"), fold(4) != 2)
    return judged.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


@LLM.named("op7_lm_scoring")
def op7_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    scored = lm_scores(read(spark, folder, "documents"), fold(5) != 1)
    return scored.withColumn("held_out", fold(5) == 1)


op5_sql = """
WITH lines AS (
    SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words
    FROM (SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
), runs AS (
    SELECT doc_id, i, line, lead(line, 1) OVER w AS second, lead(line, 2) OVER w AS third, words, words + lead(words, 1) OVER w AS words_of_two
    FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), late AS (
    SELECT doc_id, i, 1 AS size FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) AS n FROM runs)
    WHERE n > 1 AND (length(line) >= 300 OR words > 50)
    UNION ALL
    SELECT doc_id, i, 2 FROM (
        SELECT *, row_number() OVER (PARTITION BY line, second ORDER BY doc_id, i) AS n FROM runs WHERE second IS NOT NULL
    ) WHERE n > 1 AND words_of_two > 50
    UNION ALL
    SELECT doc_id, i, 3 FROM (
        SELECT *, row_number() OVER (PARTITION BY line, second, third ORDER BY doc_id, i) AS n FROM runs WHERE third IS NOT NULL
    ) WHERE n > 1
), gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS i FROM late), kept AS (
    SELECT doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
        coalesce(string_agg(line, chr(10) ORDER BY lines.i) FILTER (gone.i IS NULL), '') AS text
    FROM lines LEFT JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
    CASE WHEN d.text IS NOT NULL THEN sha256(kept.text) END AS kept_sha256
FROM documents AS d LEFT JOIN kept USING (doc_id)
"""


@LLM.named("op5_line_dedup", op5_sql)
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup(read(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@LLM.named("op3_quality_classifier")
def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classify_quality(read(spark, folder, "documents"))


@LLM.named("op6_sentencepiece_codec")
def op6_sentencepiece_codec(spark: SparkSession, folder: str) -> DataFrame:
    model = tokenizer_file()
    # Encoding and decoding are one pass: ids do not go to the JVM and back.
    coded = encode_pieces(read(spark, folder, "documents"), model, n=BEST, carry=["text"], decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        F.concat(F.array("score"), F.transform("others", lambda other: other["score"])).alias("scores"),
        (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"),
    )


op11_sql = """
WITH split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), held AS (
    SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM split) GROUP BY doc_id, term
), totals AS (
    SELECT count(*) AS documents, sum(len(words))::BIGINT AS length FROM split WHERE len(words) > 0
), asked AS (
    SELECT item_id, term, count(*) AS repeats FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)
    ) GROUP BY item_id, term
), weights AS (
    SELECT term, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
    FROM (SELECT term, count(*) AS df FROM held WHERE term IN (SELECT term FROM asked) GROUP BY term), totals
), sizes AS (
    SELECT doc_id, 25 + (75 * len(words) * documents) // length AS m FROM split, totals WHERE len(words) > 0
), scored AS (
    SELECT item_id, doc_id, sum(repeats * weight * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN sizes USING (doc_id) GROUP BY item_id, doc_id
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0
) WHERE rank <= 10
"""


@LLM.named("op11_ranked_search", op11_sql)
def op11_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search_items(read(spark, folder, "documents"), read(spark, folder, "benchmark"), k=10)


@LLM.named("op12_nearest_vectors")
def op12_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_rows(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


op13_sql = """
WITH rows AS (
    SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        [floor(256 * x::DOUBLE) FOR x IN embedding] AS vec
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
    SELECT a.id AS anchor_id, r.id, a.label = r.label AS alike, list_inner_product(a.vec, r.vec)::BIGINT AS score
    FROM rows AS a, rows AS r WHERE a.id % 100 = 0 AND a.id <> r.id
), positives AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS nth FROM scored WHERE alike) WHERE nth <= 5
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM (
    SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) AS rank
    FROM positives AS p JOIN scored AS n ON n.anchor_id = p.anchor_id AND NOT n.alike
        AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
) WHERE rank <= 5
"""


@LLM.named("op13_hard_negatives", op13_sql)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label_col=label)
