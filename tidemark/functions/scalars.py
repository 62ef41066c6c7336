"""Scalar expressions: parsing, missing values, keys and divisions.

Inside the package a missing value is NULL only; NaN is turned into NULL wherever
data enters. Infinities are legal values and survive.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.schemas import MISSING_RELEASE_KEY

# Fixed pattern: the decimal texts that count as numbers.
NUMBER_TEXT = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"
# The texts vendors send for a missing number.
MISSING_TEXTS = [".", ""]


def null_if_nan(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def fail_when(bad: Column, message, value: Column) -> Column:
    """``value``, or a run-time error on rows where ``bad`` holds."""
    text = message if isinstance(message, Column) else F.lit(message)
    return F.when(bad, F.raise_error(text)).otherwise(value)


def parsed_or_fail(parsed: Column, raw: Column, label: str, excused: Column | None = None) -> Column:
    """``parsed``, or an error where text is there but could not be parsed.

    Blank counts as missing. The error is the second choice of a coalesce, so that the
    parse runs once per row and the test only where it gave nothing.
    """
    bad = raw.isNotNull() & (F.trim(raw.cast("string")) != "")
    if excused is not None:
        bad = bad & ~excused
    return F.coalesce(parsed, F.when(bad, F.raise_error(F.concat(F.lit(label), raw.cast("string")))))


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def number(df: DataFrame, name: str, strict: bool = False) -> Column:
    """Column ``name`` as double; unreadable text is missing, or an error if strict."""
    raw = F.col(name)
    if not _is_text(df, name):
        return null_if_nan(raw.cast("double"))
    text = F.trim(raw)
    parsed = null_if_nan(F.when(text.rlike(NUMBER_TEXT), text.try_cast("double")))
    if not strict:
        return parsed
    return parsed_or_fail(parsed, raw, f"{name} is not a number: ", text.rlike(NUMBER_TEXT))


def day(df: DataFrame, name: str, strict: bool = True) -> Column:
    """Column ``name`` as a date; a time of day is refused, as it would be lost."""
    raw = F.col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return raw
    text = F.trim(raw) if _is_text(df, name) else raw
    label = f"{name} is not a plain date: "
    parsed = text.try_cast("date")
    if strict:
        parsed = parsed_or_fail(parsed, raw, label)
    moment = text.try_cast("timestamp")
    has_time = moment != F.date_trunc("day", moment)
    if _is_text(df, name):
        has_time = (F.length(text) > len("yyyy-MM-dd")) & has_time
    return fail_when(has_time, F.concat(F.lit(label), raw.cast("string")), parsed)


def moment(df: DataFrame, name: str, strict: bool = True) -> Column:
    """Column ``name`` as a timestamp."""
    raw = F.col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return raw
    parsed = (F.trim(raw) if _is_text(df, name) else raw).try_cast("timestamp")
    return parsed_or_fail(parsed, raw, f"{name} is not a timestamp: ") if strict else parsed


def vendor_number(text: Column) -> Column:
    """A vendor's value text as double; sentinels and non-numbers are missing."""
    trimmed = F.trim(text)
    usable = ~trimmed.isin(MISSING_TEXTS) & trimmed.rlike(NUMBER_TEXT)
    return null_if_nan(F.when(usable, trimmed.try_cast("double")))


def release_date_key(release_date: Column) -> Column:
    return F.coalesce(release_date.cast("string"), F.lit(MISSING_RELEASE_KEY))


def month_key(value: Column) -> Column:
    """``YYYY-MM`` of a date."""
    return F.substring(value.cast("date").cast("string"), 1, 7)


def reference_period(df: DataFrame, name: str = "reference_period") -> Column:
    """A date-like column as ``YYYY-MM``; missing, blank and unreadable are errors."""
    raw = F.col(name)
    parsed = (F.trim(raw) if _is_text(df, name) else raw).try_cast("date")
    shown = F.concat(F.lit(f"{name} is missing, blank or not a date: "), F.coalesce(raw.cast("string"), F.lit("NULL")))
    return fail_when(parsed.isNull(), shown, month_key(parsed))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division with floating-point rules: x/0 is infinite, 0/0 is missing."""
    infinite = F.signum(numerator) * F.lit(float("inf"))
    plain = F.try_divide(numerator, denominator)
    return null_if_nan(F.when(denominator == 0, infinite).otherwise(plain))


def percent_over(value: Column, previous: Column) -> Column:
    return 100 * (ratio(value, previous) - 1)


def close(left: Column, right: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Equal within tolerance; missing equals missing, infinity equals infinity."""
    near = F.abs(left - right) <= F.lit(atol) + F.lit(rtol) * F.abs(right)
    finite = F.abs(right) < F.lit(float("inf"))
    return left.eqNullSafe(right) | F.coalesce(near & finite, F.lit(False))


def last_key(name: str) -> list[Column]:
    """Order parts for ``name`` in which a missing value comes last."""
    return [F.col(name).isNull(), F.col(name)]
