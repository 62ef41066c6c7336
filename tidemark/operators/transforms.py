"""Series transformations over ordered rows."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.ordered import timeline


def percent_change(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    order: Sequence[str],
    periods: int = 1,
    carry_forward: bool = True,
    out: str = "percent_change",
    **sizing,
) -> DataFrame:
    """``100 * (x / x[-periods] - 1)``; missing values are first carried forward."""
    line = timeline(df, by, order, **sizing)
    if carry_forward:
        line = line.carry_forward("_filled", S.number(df, value))
    else:
        line = line.look_back(1, lambda w: {"_filled": S.number(df, value)})
    line = line.look_back(
        periods, lambda w: {out: S.percent_over(F.col("_filled"), F.lag("_filled", periods).over(w))}
    )
    return line.rows().drop("_filled")


def difference(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    order: Sequence[str],
    periods: int = 1,
    out: str = "difference",
    **sizing,
) -> DataFrame:
    """``x - x[-periods]``."""
    now = S.number(df, value)
    line = timeline(df, by, order, **sizing)
    return line.look_back(periods, lambda w: {out: S.null_if_nan(now - F.lag(now, periods).over(w))}).rows()


def rolling_z_score(
    df: DataFrame,
    value: str,
    by: Sequence[str],
    order: Sequence[str],
    window: int,
    out: str = "rolling_z_score",
    **sizing,
) -> DataFrame:
    """Distance from the mean of the last ``window`` rows in sample deviations.

    Missing unless all rows of the window hold a value.
    """
    if window < 2:
        raise ValueError("A window needs two rows or more.")
    now = S.number(df, value)

    def score(w):
        last = w.rowsBetween(-(window - 1), 0)
        z = S.ratio(now - F.avg(now).over(last), F.stddev_samp(now).over(last))
        return {out: F.when(F.count(now).over(last) == window, z)}

    return timeline(df, by, order, **sizing).look_back(window - 1, score).rows()
