"""Exact medians of all earlier rows of a timeline."""

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.ordered import TILE, Timeline, null_safe_join
from tidemark.session import stage


def exclusive_median(values: np.ndarray) -> np.ndarray:
    """Median of the non-missing values before each position."""
    return pd.Series(values).expanding(min_periods=1).median().shift(1).to_numpy()


def expanding_median(line: Timeline, outputs: dict[str, str], row: str) -> Timeline:
    """Add, per input column, the median of its earlier non-missing values.

    ``row`` numbers the rows of each group. Groups cut into tiles stay exact: a tile's
    medians can only be its own values or the central values of all earlier tiles, so
    each tile is handed just those (about as many as it has rows).
    """
    if line.split:
        return _split_median(line, outputs, row)
    schema = T.StructType([*line.frame.schema.fields, *[T.StructField(o, T.DoubleType()) for o in outputs.values()]])

    def whole_group(pdf):
        pdf = pdf.sort_values(row)
        return pdf.assign(**{out: exclusive_median(pdf[name].to_numpy(float)) for name, out in outputs.items()})

    return replace(line, frame=line.frame.groupBy(*line.keys).applyInPandas(whole_group, schema))


def _fields(df: DataFrame, names: Sequence[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def _split_median(line: Timeline, outputs: dict[str, str], row: str) -> Timeline:
    by, keys = list(line.by), line.keys
    cells = F.posexplode(F.array(*[F.col(n) for n in outputs])).alias("_f", "_v")
    long = line.frame.select(*keys, row, cells)
    known = long.where("_v is not null")

    # Cut the values of each column into value tiles; equal values are cut by time tile.
    parts = max(1, -(-known.count() // line.rows_per_tile))
    valued = stage(
        known.select(*keys, row, "_f", "_v")
        .repartitionByRange(parts, *by, "_f", "_v", TILE)
        .withColumn("_vt", F.spark_partition_id())
    )
    # A central value tile serves many time tiles, so its rows are dealt out by row number:
    # no task has to produce all its copies.
    grouped = [*by, "_f"]
    wanted = stage(_central_tiles(line, valued, len(outputs), grouped)).withColumn(
        "_deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1)).cast("array<long>"))
    )
    dealt = valued.withColumn("_deal", F.pmod(F.col(row), F.lit(DEALS)))
    central = (
        null_safe_join(dealt, wanted, [*grouped, "_vt", "_deal"], "inner")
        .where(F.col(TILE) < F.col("_to"))
        .select(*grouped, F.col("_to").alias(TILE), "_v", "below", "total")
    )
    medians = (
        long.groupBy(*keys, "_f")
        .cogroup(central.groupBy(*keys, "_f"))
        .applyInPandas(
            lambda rows, prefix: _tile_medians(rows, prefix, [*keys, "_f", row], row),
            T.StructType([*_fields(long, [*keys, "_f", row]), T.StructField("_m", T.DoubleType())]),
        )
    )
    wide = medians.groupBy(*keys, row).agg(
        *[F.max(F.when(F.col("_f") == i, F.col("_m"))).alias(out) for i, out in enumerate(outputs.values())]
    )
    return replace(line, frame=null_safe_join(line.frame, wide, [*keys, row], "left"))


DEALS = 16


def _central_tiles(line: Timeline, valued: DataFrame, columns: int, grouped: Sequence[str]) -> DataFrame:
    """Value tiles with the possible medians of each time tile's earlier rows, from counts.

    A table of counts per (value tile, time tile) is summed twice by windows: along time per
    value tile, which tells how many earlier values a value tile has, then along the values
    per time tile, which gives the ranks these hold. A window sees one row per tile, and the
    cells are fewer than the rows up to ``rows_per_tile`` squared rows in a timeline.
    """
    by = list(line.by)
    counts = valued.groupBy(*grouped, "_vt", TILE).agg(F.count(F.lit(1)).alias("n"))
    # Time tiles that have none of a value tile's values need its earlier count as well.
    span = line.frame.groupBy(*by).agg(F.min(TILE).alias("_first"), F.max(TILE).alias("_last"))
    tiles = valued.select(*grouped, "_vt").distinct()
    if by:
        spans = null_safe_join(tiles, span, by, "inner")
    else:
        spans = tiles.withColumns(dict(zip(span.columns, map(F.lit, span.first()), strict=True)))
    empty = spans.select(*grouped, "_vt", F.explode(F.sequence("_first", "_last")).alias(TILE), F.lit(0).cast("long").alias("n"))
    cells = counts.unionByName(empty).groupBy(*grouped, "_vt", TILE).agg(F.sum("n").alias("own"))

    along_time = Window.partitionBy(*grouped, "_vt").orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*grouped, TILE)
    along_values = whole.orderBy("_vt").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = cells.withColumn("before", F.coalesce(F.sum("own").over(along_time), F.lit(0)))
    ranked = before.withColumns(
        {
            "upto": F.sum("before").over(along_values),
            "total": F.sum("before").over(whole),
            "added": F.sum("own").over(whole),
        }
    )
    # The ranks that can be the median at any row of the time tile, its own rows included.
    low = F.greatest(F.floor((F.col("total") - 1) / 2) - F.col("added") - 1, F.lit(0))
    high = F.least(F.floor((F.col("total") + F.col("added")) / 2) + 1, F.col("total") - 1)
    start = F.col("upto") - F.col("before")
    chosen = ranked.where((F.col("upto") > low) & (start <= high) & (F.col("before") > 0))
    return chosen.select(
        *grouped, "_vt", F.col(TILE).alias("_to"), F.min(start).over(whole).alias("below"), "total"
    )


def _tile_medians(rows: pd.DataFrame, prefix: pd.DataFrame, columns: Sequence[str], row: str) -> pd.DataFrame:
    """Expanding medians of one tile, given the central values of everything before it.

    Values outside the central ones only count. Equally many on both sides cancel, and
    the rest stand in as numbers beyond all others.
    """
    rows = rows.sort_values(row)
    inner = np.sort(prefix["_v"].to_numpy(float))
    low = int(prefix["below"].iloc[0]) if len(inner) else 0
    high = int(prefix["total"].iloc[0]) - low - len(inner) if len(inner) else 0
    both = min(low, high)
    far = np.finfo(float).max
    start = np.concatenate([np.full(low - both, -far), inner, np.full(high - both, far)])
    medians = exclusive_median(np.concatenate([start, rows["_v"].to_numpy(float)]))
    return rows[list(columns)].assign(_m=medians[len(start) :])
