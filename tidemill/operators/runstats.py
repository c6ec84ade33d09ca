"""Counters of a triage run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.operators.actions import BLOCKED, FALLBACK
from tidemill.operators.rules import CATEGORIES


def message_counters() -> dict[str, Column]:
    """Counters over triaged messages (category, source)."""
    done = F.col("category").isNotNull()
    return {
        "processed": F.count_if(done),
        **{category: F.count_if(F.col("category") == category) for category in CATEGORIES},
        "rules": F.count_if(F.col("source") == "rule"),
        "llm": F.count_if(F.col("source") == "external"),
    }


def run_stats(
    triaged: DataFrame,
    audited: DataFrame | None = None,
    resolved: DataFrame | None = None,
    error: Column | None = None,
) -> DataFrame:
    """(counter, value) for the twelve counters of a run; 0 for a part not given.

    ``error`` says which triaged rows failed; they are counted in the pass over ``triaged``.
    """
    optional = {
        ("tool_calls", "tool_blocked"): audited is None,
        ("tool_retries", "fallback_actions"): resolved is None,
        ("errors",): error is None,
    }
    zeros = {name: F.lit(0).cast("bigint") for names, absent in optional.items() if absent for name in names}
    counters = message_counters() | ({} if error is None else {"errors": F.count_if(error)})
    parts = [triaged.agg(*(count.alias(name) for name, count in counters.items())).withColumns(zeros)]
    if audited is not None:
        parts.append(
            audited.agg(
                F.count("*").alias("tool_calls"),
                F.count_if(F.col("verdict") == BLOCKED).alias("tool_blocked"),
            )
        )
    if resolved is not None:
        parts.append(
            resolved.agg(
                F.coalesce(F.sum("retries"), F.lit(0)).cast("bigint").alias("tool_retries"),
                F.count_if(F.col("outcome") == FALLBACK).alias("fallback_actions"),
            )
        )
    counted = [part.unpivot([], part.columns, "counter", "value") for part in parts]
    return reduce(DataFrame.unionByName, counted)

