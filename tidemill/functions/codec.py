"""URL-safe base64 to text, lenient in the way mail clients need it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Outside both base64 alphabets and the padding. \w makes the search several times
# faster than spelt-out ranges.
STRAY = r"[^\w+/=-]"


def with_base64_text(df: DataFrame, data_col: str, out_col: str) -> DataFrame:
    """Add the UTF-8 text of ``data_col``.

    Characters outside both base64 alphabets are skipped, bad bytes become U+FFFD, data
    with wrong padding becomes "". Every step below is used more than once by the next,
    so Catalyst keeps them as projections and each regex runs once per row.
    """
    given = df.withColumn("_given", F.coalesce(F.col(data_col), F.lit("")))
    letters = given.withColumn(
        "_letters",
        F.when(F.col("_given").rlike(STRAY), F.regexp_replace("_given", f"{STRAY}+", "")).otherwise(F.col("_given")),
    )
    # A "=" that cannot end the data is skipped, so "YW=Jj" reads as "YWJj". The
    # rewrite runs only where data follows a "=", which proper padding never does.
    padding = F.lit("=")
    inside = F.contains(F.rtrim("_letters", padding), padding)
    quads = F.regexp_replace("_letters", r"\G=*([^=])=*([^=])=?([^=])([^=])", "$1$2$3$4")
    data = letters.withColumn("_data", F.when(inside, quads).otherwise(F.col("_letters")))
    placed = data.withColumn("_pad", F.instr("_data", "="))
    # Up to three characters before the "=" belong to the last, incomplete group.
    loose = F.col("_pad") - 1 - (F.col("_pad") - 1) % 4
    ends = placed.withColumn("_whole", loose).withColumn(
        "_rest", F.when(F.col("_pad") > 0, F.substring("_data", F.col("_whole") + 1, F.length("_data")))
    )
    last = ends.withColumn("_last", F.regexp_extract("_rest", r"^=*[^=]=*[^=](?:==|=?[^=]=)", 0))
    head = F.substring("_data", F.lit(1), F.col("_whole"))
    usable = (
        F.when(
            F.col("_pad") == 0, F.when(F.length("_data") % 4 == 0, F.col("_data")).otherwise("")
        )
        .when(F.col("_last") != "", F.concat(head, F.replace("_last", padding, F.lit(""))))
        .when(F.col("_rest").rlike("^=*$"), head)
        .otherwise("")
    )
    standard = F.replace(F.replace(usable, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    text = F.make_valid_utf8(F.unbase64(standard).cast("string"))
    return last.withColumn(out_col, text).drop("_given", "_letters", "_data", "_pad", "_whole", "_rest", "_last")
