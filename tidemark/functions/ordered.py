"""Order-dependent columns (lags, running sums, row numbers) that survive hot groups.

A plain window sends each group to one task. ``timeline`` measures the largest group
first. Groups that fit get the plain window and nothing else. Otherwise the rows are
range-partitioned by group and order, so that a large group is cut into consecutive
tiles; windows then run per (group, tile) and a small table of tile summaries carries
state across the cuts. Rows that tie in their order are put in order by a hash of all their
columns, however they are cut, so results are the same either way.
"""

import math
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import stage

TILE = "_tile"
TIE = "_tie"
COPY = "_copy"
ROWS_PER_TILE = 1_000_000
#: Wide rows make smaller tiles: a tile has at most so many cells.
CELLS_PER_TILE = 16_000_000


@dataclass(frozen=True)
class Sizes:
    """What one measuring job found out about a frame."""

    rows: int
    largest_group: int
    dropped: int


COSTLY = ("Exchange", "InPandas", "InArrow", "EvalPython")


def settled(df: DataFrame) -> DataFrame:
    """``df``, written once if computing its rows takes a shuffle or Python.

    For frames that are measured first and used afterwards: both then read what is written.
    A plain scan is left alone, since measuring it reads the key columns only.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    return stage(df) if any(step in plan for step in COSTLY) else df


def measure(df: DataFrame, by: Sequence[str], required: str | None = None) -> Sizes:
    """Row counts in one job over the key columns; ``required`` NULLs count as dropped."""
    kept = F.lit(True) if required is None else F.col(required).isNotNull()
    per_group = df.groupBy(*by).agg(
        F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped")
    )
    row = per_group.agg(
        F.coalesce(F.sum("kept"), F.lit(0)), F.coalesce(F.max("kept"), F.lit(0)), F.coalesce(F.sum("dropped"), F.lit(0))
    ).first()
    return Sizes(int(row[0]), int(row[1]), int(row[2]))


#: Few enough to be combined in every map task, many enough to part any but large keys.
SLOTS = 1 << 14


def measure_up_to(df: DataFrame, by: Sequence[str], limit: int) -> Sizes:
    """Row counts; ``largest_group`` may be too high, but not once that takes it over ``limit``.

    Groups are first counted together by a hash, which sends a few numbers a task and no
    keys. Only if one of these sums is over the limit are the groups counted one by one.
    """
    slot = F.pmod(F.xxhash64(*by), F.lit(SLOTS)) if by else F.lit(0)
    together = df.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    rows, largest = together.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    return Sizes(int(rows), int(largest), 0) if largest <= limit or not by else measure(df, by)


def last_nulls(names: Sequence[str]) -> list[Column]:
    return [F.col(name).asc_nulls_last() for name in names]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on ``keys`` where missing equals missing; keeps the left side's keys."""
    renamed = right.withColumnsRenamed({name: f"_k_{name}" for name in keys})
    same = F.lit(True)
    for name in keys:
        same = same & F.col(name).eqNullSafe(F.col(f"_k_{name}"))
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"_k_{name}" for name in keys])


@dataclass(frozen=True)
class Timeline:
    """Rows ordered by ``order`` within ``by``, cut into tiles if a group is large."""

    frame: DataFrame
    by: tuple[str, ...]
    order: tuple[str, ...]
    split: bool
    rows_per_tile: int = ROWS_PER_TILE

    @property
    def keys(self) -> list[str]:
        return [*self.by, TILE]

    @property
    def window(self):
        return Window.partitionBy(*self.keys).orderBy(*last_nulls(self.order))

    @property
    def _earlier_tiles(self):
        return Window.partitionBy(*self.by).orderBy(TILE)

    def rows(self) -> DataFrame:
        return self.frame.drop(TILE, TIE, COPY)

    def look_back(self, rows: int, make: Callable) -> "Timeline":
        """Add ``make(window)`` columns that read at most ``rows`` rows back."""
        if not self.split:
            return replace(self, frame=self.frame.withColumns(make(self.window)))
        # Blocks of row numbers, no smaller than the reach: a row belongs to its own block and,
        # if it is among the last rows of that, to the next one. Nothing but numbers decides
        # this, so no cell holds other rows and no row is in more than two blocks.
        size = max(self.rows_per_tile, rows)
        numbered = self.number("_at")
        block = lambda at: F.floor(at / F.lit(size)).cast("long")
        own = block(F.col("_at") - 1)
        reached = numbered.frame.withColumn("_block", F.explode(F.sequence(own, block(F.col("_at") - 1 + rows))))
        window = Window.partitionBy(*self.by, "_block").orderBy("_at")
        frame = reached.withColumns(make(window)).where(F.col("_block") == own).drop("_at", "_block")
        return replace(self, frame=frame)

    def running(self, sums: dict[str, Column]) -> "Timeline":
        """Add the sums of all earlier rows of the group (0 for its first row)."""
        earlier = self.window.rowsBetween(Window.unboundedPreceding, -1)
        frame = self.frame.withColumns(
            {out: F.coalesce(F.sum(expr).over(earlier), F.lit(0)) for out, expr in sums.items()}
        )
        if self.split:
            totals = self.frame.groupBy(*self.keys).agg(*[F.sum(e).alias(f"_c_{o}") for o, e in sums.items()])
            before = self._earlier_tiles.rowsBetween(Window.unboundedPreceding, -1)
            carried = totals.select(
                *self.keys, *[F.coalesce(F.sum(f"_c_{o}").over(before), F.lit(0)).alias(f"_c_{o}") for o in sums]
            )
            frame = self._join_tiles(frame, carried)
            frame = frame.withColumns({o: F.col(o) + F.col(f"_c_{o}") for o in sums})
            frame = frame.drop(*[f"_c_{o}" for o in sums])
        return replace(self, frame=frame)

    def number(self, out: str) -> "Timeline":
        """Add the 1-based row number within the group."""
        if not self.split:
            return replace(self, frame=self.frame.withColumn(out, F.row_number().over(self.window).cast("long")))
        counted = self.running({out: F.lit(1).cast("long")})
        return replace(counted, frame=counted.frame.withColumn(out, F.col(out) + 1))

    def carry_forward(self, out: str, value: Column) -> "Timeline":
        """Add the latest non-missing ``value`` up to and including each row."""
        upto = self.window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        frame = self.frame.withColumn(out, F.last(value, ignorenulls=True).over(upto))
        if self.split:
            # The last row of a tile already holds the tile's latest known value.
            order = F.struct(*[p for name in self.order for p in (F.col(name).isNull(), F.col(name))])
            known = frame.groupBy(*self.keys).agg(F.max_by(out, order).alias("_latest"))
            before = self._earlier_tiles.rowsBetween(Window.unboundedPreceding, -1)
            carried = known.select(*self.keys, F.last("_latest", ignorenulls=True).over(before).alias("_latest"))
            frame = self._join_tiles(frame, carried)
            frame = frame.withColumn(out, F.coalesce(out, "_latest")).drop("_latest")
        return replace(self, frame=frame)

    def first_known(self, outputs: dict[str, str]) -> "Timeline":
        """Add, on every row, the group's first non-missing value per input column."""
        if not self.split:
            whole = self.window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            firsts = {out: F.first(name, ignorenulls=True).over(whole) for name, out in outputs.items()}
            return replace(self, frame=self.frame.withColumns(firsts))
        order = F.struct(*[p for n in self.order for p in (F.col(n).isNull(), F.col(n))])
        firsts = self.frame.groupBy(*self.by).agg(
            *[F.min_by(name, F.when(F.col(name).isNotNull(), order)).alias(out) for name, out in outputs.items()]
        )
        if self.by:
            return replace(self, frame=null_safe_join(self.frame, firsts, self.by, "left"))
        row = firsts.first()
        literals = {out: F.lit(row[out]).cast(self.frame.schema[name].dataType) for name, out in outputs.items()}
        return replace(self, frame=self.frame.withColumns(literals))

    def _join_tiles(self, frame: DataFrame, carried: DataFrame) -> DataFrame:
        """Attach one row per (group, tile); both sides hash on the same keys."""
        return null_safe_join(frame, carried, self.keys, "left")


def timeline(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    *,
    sizes: Sizes | None = None,
    measured: DataFrame | None = None,
    bounded: bool = False,
    rows_per_tile: int | None = None,
) -> Timeline:
    """Order ``df`` by ``order`` (missing last) within ``by``.

    ``bounded=True`` says that the keys themselves bound every group, for instance
    one row per calendar day; then nothing is measured. ``measured`` is a smaller frame
    whose groups tell as much about sizes.
    """
    rows_per_tile = rows_per_tile or min(ROWS_PER_TILE, CELLS_PER_TILE // max(1, len(df.columns)))
    by, order = tuple(by), tuple(order)
    if not bounded:
        if sizes is None:
            df = settled(df) if measured is None else df
            sizes = measure_up_to(df if measured is None else measured, by, rows_per_tile)
        df = df.withColumn(TIE, F.xxhash64(*[f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]))
        order = (*order, TIE)
        if sizes.largest_group > rows_per_tile:
            # Row ids part full copies. Ids and tiles are staged, so that they stay what they
            # are when a task is rerun.
            numbered = stage(df.withColumn(COPY, F.monotonically_increasing_id()))
            order = (*order, COPY)
            tiles = math.ceil(sizes.rows / rows_per_tile)
            ranged = numbered.repartitionByRange(tiles, *last_nulls([*by, *order]))
            return Timeline(stage(ranged.withColumn(TILE, F.spark_partition_id())), by, order, True, rows_per_tile)
    return Timeline(df.withColumn(TILE, F.lit(0)), by, order, False, rows_per_tile)


def warn_dropped(sizes: Sizes, column: str) -> None:
    if sizes.dropped:
        warnings.warn(f"Dropping {sizes.dropped} rows with missing {column}.", RuntimeWarning, stacklevel=3)
