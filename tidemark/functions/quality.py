"""Contracts on DataFrames.

Row rules run inside the plan that uses the data: a broken row stops that job with
the rule's message, without a pass of its own over the input.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import fail_when


class ContractError(ValueError):
    """Data broke a contract."""


def require_columns(df: DataFrame, required: Sequence[str], label: str) -> None:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ContractError(f"Missing required {label} columns: {missing}")


def guard(df: DataFrame, *rules) -> DataFrame:
    """All rows of ``df``; the running job fails on the first row that breaks a rule.

    ``rules`` are (condition that must not hold, message). Kept as a filter, since a
    filter is never pruned away with unused columns. The row id, always true here, marks
    it as non-deterministic: otherwise the optimizer could move it below an earlier
    filter or join, where it would meet rows those remove.
    """
    passed = F.monotonically_increasing_id() >= 0
    for bad, message in reversed(rules):
        passed = fail_when(F.coalesce(bad, F.lit(False)), message, passed)
    return df.where(passed)


def shown(*names: str) -> Column:
    """The named columns as text for an error message."""
    return F.to_json(F.struct(*names))


def unique_by(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """``df``, failing if two rows share a key.

    An aggregate and not a window: equal keys meet in the map-side partial
    aggregate, so a key that holds a third of the rows is no hot task.
    """
    rest = [name for name in df.columns if name not in keys]
    grouped = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_copies"),
        *[F.any_value(name).alias(name) for name in rest],
    )
    message = F.concat(F.lit(f"Duplicate {label}: "), shown(*keys))
    return guard(grouped, (F.col("_copies") > 1, message)).select(*df.columns)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (missing equals missing) and how often."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count")).where("row_count > 1")


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with the number of broken rows per rule, plus ``row_count``."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, bad in rules.items()],
    )
