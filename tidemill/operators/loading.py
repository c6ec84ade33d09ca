"""Loading the mart: defaults, keys, natural-key resolution, price lists, full reload."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.ordering import with_row_numbers
from tidemill.sources.sales import NOW, SALES_DEFAULTS, SALES_SCHEMAS
from tidemill.sources.versions import publish


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Fill columns the input omits. An explicit NULL stays NULL, as in an insert."""
    types = {field.name: field.dataType for field in SALES_SCHEMAS[table]}
    for column, value in SALES_DEFAULTS[table].items():
        if column not in df.columns:
            filled = F.localtimestamp() if value == NOW else F.lit(value)
            df = df.withColumn(column, filled.cast(types[column]))
    return df


def assign_ids(df: DataFrame, order: Sequence[str], id_col: str = "id") -> DataFrame:
    """Surrogate keys 1..n in ``order``."""
    return with_row_numbers(df, order, id_col)


def resolve_keys(
    staged: DataFrame, dimension: DataFrame, natural: Mapping[str, str], key: str, out_col: str
) -> DataFrame:
    """Replace natural keys by the dimension's key.

    ``natural`` maps staged columns to dimension columns. Rows without a match are
    dropped. A sort-merge join with skew splitting: the files of a dimension are much smaller
    than its keys in memory, so none is broadcast by the size of its files.
    """
    renamed = {name: f"_dim_{name}" for name in natural.values()}
    lookup = dimension.select(
        *(F.col(name).alias(alias) for name, alias in renamed.items()), F.col(key).alias(out_col)
    ).hint("merge")
    matches = [staged[column] == lookup[renamed[name]] for column, name in natural.items()]
    return staged.join(lookup, matches, "inner").drop(*renamed.values(), *natural)


def expand_price_list(
    motors: DataFrame, price_list: DataFrame, periods: Sequence[tuple[str, str | None]], by: str = "model"
) -> DataFrame:
    """One row per motor and period, priced by the list; NULL where the list has no entry.

    ``price_list`` holds ``by``, ``valid_from``, ``list_price`` and ``production_cost``.
    The periods are spread by an array, not by a cross join.
    """
    spans = F.array(
        *(
            F.struct(
                F.lit(start).cast("date").alias("valid_from"), F.lit(end).cast("date").alias("valid_to")
            )
            for start, end in periods
        )
    )
    spread = motors.select(F.col("id").alias("motor_id"), F.col(by), F.explode(spans).alias("_span")).select(
        "motor_id", by, "_span.valid_from", "_span.valid_to"
    )
    priced = price_list.select(by, "valid_from", "list_price", "production_cost")
    return spread.join(priced, [by, "valid_from"], "left").select(
        "motor_id", "valid_from", "valid_to", "list_price", "production_cost", F.lit("EUR").alias("currency")
    )


def map_values(df: DataFrame, column: str, mapping: DataFrame, values: Sequence[str]) -> DataFrame:
    """Add ``values`` looked up by ``column``; NULL for a key the mapping lacks."""
    return df.join(mapping.select(column, *values), column, "left")


# Foreign key -> the table it points at and the natural key that stands for it in staged rows.
REFERENCES: dict[str, dict[str, tuple[str, str]]] = {
    "orders": {"customer_id": ("customers", "customer_number")},
    "order_items": {"order_id": ("orders", "order_number"), "motor_id": ("motors", "article_number")},
    "motor_prices": {"motor_id": ("motors", "article_number")},
    "inventory": {"motor_id": ("motors", "article_number")},
}


def reload(staged: Mapping[str, DataFrame], folder: str, order: Mapping[str, Sequence[str]]) -> None:
    """Replace all tables under ``folder``; ids start at 1 again.

    Staged rows hold natural keys in place of foreign keys, which are resolved against the
    tables just written, as an insert-select does; rows without a match are dropped.
    ``order`` names each table's insert order. Omitted columns take their default, else
    NULL. The inputs must come from elsewhere than ``folder``.
    """
    waiting = dict(staged)
    while waiting:
        name = next(name for name in waiting if all(parent not in waiting for parent, _ in REFERENCES.get(name, {}).values()))
        df = waiting.pop(name)
        for column, (parent, natural) in REFERENCES.get(name, {}).items():
            df = resolve_keys(df, df.sparkSession.read.parquet(f"{folder}/{parent}"), {natural: natural}, "id", column)
        numbered = assign_ids(with_defaults(df.drop("id"), name), order[name])
        schema = SALES_SCHEMAS[name]
        typed = numbered.select(
            *(
                (F.col(field.name) if field.name in numbered.columns else F.lit(None)).cast(field.dataType).alias(field.name)
                for field in schema
            )
        )
        typed.write.mode("overwrite").parquet(f"{folder}/{name}")


def reload_whole(staged: Mapping[str, DataFrame], root: str, order: Mapping[str, Sequence[str]]) -> str:
    """``reload`` into a new version under ``root``: readers of ``current`` see all tables of it, or all of the one before."""
    spark = next(iter(staged.values())).sparkSession
    return publish(spark, root, lambda folder: reload(staged, folder, order))
