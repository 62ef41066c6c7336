"""Vendor payloads as observations.

A landing table has one row per API response: what was asked for (``series_id`` and, for
FRED, ``vintage_mode`` and ``request_realtime_start``), when it was fetched, and the
response as JSON text in ``payload``. Responses are small, so all splitting of work is
Spark's splitting of the landing table.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import quality as Q
from tidemark.functions import scalars as S
from tidemark.schemas import OBSERVATION_COLUMNS

FRED_PAYLOAD = (
    "realtime_start string, realtime_end string, "
    "observations array<struct<realtime_start: string, realtime_end: string, date: string, value: string>>"
)
# Series entries stay maps: vendors spell the name key in two ways that differ by case.
BLS_PAYLOAD = "Results struct<series: array<map<string, string>>>"
BLS_DATA = "array<struct<year: string, period: string, value: string>>"
# The same observations with their keys, which tell a missing value from a missing field.
FRED_KEYED = "observations array<map<string, string>>"
BLS_KEYED = "array<map<string, string>>"

LANDING = T.StructType(
    [
        T.StructField("series_id", T.StringType()),
        T.StructField("vintage_mode", T.StringType()),
        T.StructField("request_realtime_start", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("payload", T.StringType()),
    ]
)

# The vintage modes, and the monthly periods of a BLS year.
VINTAGE_MODES = ["current", "initial_release", "realtime_period"]
MONTH_PERIOD = "^M(0[1-9]|1[0-2])$"


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses, one JSON document per line; a nested payload is kept as text."""
    return spark.read.schema(LANDING).json(path)


def _optional(df: DataFrame, name: str, default: str | None = None) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default).cast("string")


def _has_field(rows: str, name: str, keyed: Column) -> Column:
    """Whether some row of a response has this field, be it as a null.

    ``keyed`` parses the text again, which only responses without any value come to.
    """
    return F.when(F.exists(rows, lambda o: o[name].isNotNull()), True).otherwise(
        F.exists(keyed, lambda o: F.map_contains_key(o, name))
    )


def _field_absent(rows: str, name: str, keyed: Column) -> Column:
    """Whether a response has rows but none of them has this field."""
    return (F.size(rows) > 0) & ~_has_field(rows, name, keyed)


def normalize_fred(landed: DataFrame, merge_chunks: bool = False) -> DataFrame:
    """FRED responses as observations; ``merge_chunks`` drops rows that repeat fully."""
    Q.require_columns(landed, ["series_id", "payload", "fetched_at"], "landing")
    parsed = landed.select(
        "series_id",
        "fetched_at",
        _optional(landed, "vintage_mode", "current").alias("mode"),
        _optional(landed, "request_realtime_start").alias("requested"),
        "payload",
        F.from_json("payload", FRED_PAYLOAD).alias("p"),
    )
    keyed = F.from_json("payload", FRED_KEYED)["observations"]
    # Checked in the projection and exploded as outer, so that no derived filter makes
    # Spark parse the JSON a second time.
    observations = (
        F.when(~F.col("mode").isin(VINTAGE_MODES), F.raise_error(F.concat(F.lit("Unsupported vintage_mode: "), "mode")))
        .when(
            F.col("p.observations").isNull(),
            F.raise_error(F.concat(F.lit("FRED response without observations for "), "series_id")),
        )
        .when(_field_absent("p.observations", "date", keyed), F.raise_error(F.concat(F.lit("FRED observations lack dates for "), "series_id")))
        .when(_field_absent("p.observations", "value", keyed), F.raise_error(F.concat(F.lit("FRED observations lack values for "), "series_id")))
        .otherwise(F.col("p.observations"))
    )
    exploded = parsed.select(
        "series_id",
        "fetched_at",
        "mode",
        F.coalesce("requested", "p.realtime_start").alias("stated"),
        _has_field("p.observations", "realtime_start", keyed).alias("dated"),
        F.explode_outer(observations).alias("o"),
    ).where("o is not null")
    rows = exploded.select("series_id", "fetched_at", "o.date", "o.value", fred_release_date().alias("release_date"))
    typed = rows.select(
        "series_id",
        S.day(rows, "date").alias("date"),
        S.vendor_number(F.col("value")).alias("value"),
        F.lit("fred").alias("source"),
        S.day(rows, "release_date").alias("release_date"),
        "fetched_at",
    )
    return merge_vintage_chunks(typed) if merge_chunks else typed


def fred_release_date() -> Column:
    """Release date text of an exploded observation ``o``.

    Initial-release responses must date every observation. Others use the dates of their
    observations, or if none has one the requested or stated start of the response.
    """
    own = F.col("o.realtime_start")
    found = F.when(F.col("dated"), own).otherwise(F.col("stated"))
    undated = F.col("stated").isNull() & ~F.col("dated")
    return (
        F.when(
            F.col("mode") == "initial_release",
            S.fail_when(own.isNull(), "initial_release observations need their own realtime_start.", own),
        )
        .when(undated, F.raise_error(F.lit("The response and its rows have no realtime_start.")))
        .otherwise(found)
    )


def merge_vintage_chunks(observations: DataFrame) -> DataFrame:
    """Observations of overlapping responses without fully identical rows."""
    return observations.dropDuplicates(OBSERVATION_COLUMNS)


def union_distinct_chunks(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Stack separately fetched chunks and keep each distinct row once."""
    for other in others:
        first = first.unionByName(other)
    return first.distinct()


def bls_period_to_date(year: Column, period: Column) -> Column:
    """First day of a monthly period; any other period is an error."""
    monthly = F.coalesce(period.rlike(MONTH_PERIOD), F.lit(False))
    message = F.concat(F.lit("Non-monthly period cannot be stored: "), F.coalesce(period, F.lit("NULL")))
    date = F.concat(F.trim(year), F.lit("-"), F.substring(period, 2, 2), F.lit("-01")).try_cast("date")
    return S.fail_when(~monthly, message, S.fail_when(date.isNull(), F.concat(F.lit("Unreadable year: "), year), date))


def normalize_bls(landed: DataFrame) -> DataFrame:
    """BLS responses as monthly observations without release dates."""
    Q.require_columns(landed, ["series_id", "payload", "fetched_at"], "landing")
    parsed = landed.select(
        "series_id", "fetched_at", F.from_json("payload", BLS_PAYLOAD)["Results"]["series"].alias("series")
    )
    named = lambda s: F.coalesce(
        (s["seriesID"] == F.col("series_id")) | s["seriesId"].eqNullSafe(F.col("series_id")),
        s["seriesId"] == F.col("series_id"),
        F.lit(False),
    )
    picked = parsed.select(
        "series_id", "fetched_at", "series", F.try_element_at(F.filter("series", named), F.lit(1)).alias("entry")
    )
    asked = lambda text: F.raise_error(F.concat(F.lit(text), "series_id"))
    data = (
        F.when(F.coalesce(F.size("series"), F.lit(0)) <= 0, asked("BLS response without Results.series for "))
        .when(F.col("entry").isNull(), asked("BLS response without requested series "))
        .when(F.col("entry")["data"].isNull(), asked("BLS response without data for "))
        .otherwise(F.col("entry")["data"])
    )
    listed = picked.select("series_id", "fetched_at", data.alias("text"), F.from_json(data, BLS_DATA).alias("data"))
    readable = F.when(_field_absent("data", "value", F.from_json("text", BLS_KEYED)), asked("BLS observations lack values for ")).otherwise(
        F.coalesce("data", asked("BLS response with unreadable data for "))
    )
    exploded = listed.select("series_id", "fetched_at", F.explode_outer(readable).alias("o")).where("o is not null")
    incomplete = F.col("o.year").isNull() | F.col("o.period").isNull()
    return exploded.select(
        "series_id",
        S.fail_when(
            incomplete,
            "BLS observation without year or period.",
            bls_period_to_date(F.col("o.year"), F.col("o.period")),
        ).alias("date"),
        S.vendor_number(F.col("o.value")).alias("value"),
        F.lit("bls").alias("source"),
        F.lit(None).cast("date").alias("release_date"),
        "fetched_at",
    )


def _validated(observations: DataFrame, source: str, released: bool, strict_value: bool) -> DataFrame:
    Q.require_columns(observations, OBSERVATION_COLUMNS, f"{source} observation")
    typed = observations.select(
        "series_id",
        S.day(observations, "date").alias("date"),
        S.number(observations, "value", strict=strict_value).alias("value"),
        "source",
        S.day(observations, "release_date").alias("release_date"),
        S.moment(observations, "fetched_at").alias("fetched_at"),
    )
    rules = [
        (F.col("series_id").isNull(), "series_id is missing in a row."),
        (~F.col("source").eqNullSafe(F.lit(source)), f"Observations must have source='{source}'."),
        (F.col("date").isNull(), "date is missing in a row."),
    ]
    if released:
        rules.append((F.col("release_date").isNull(), "release_date is missing in a row."))
    return Q.guard(typed, *rules)


def validate_fred(observations: DataFrame) -> DataFrame:
    """FRED observations, typed: dated, released and numeric."""
    return _validated(observations, "fred", released=True, strict_value=True)


def validate_bls(observations: DataFrame) -> DataFrame:
    """BLS observations, typed: dated; release date optional, unreadable values missing."""
    return _validated(observations, "bls", released=False, strict_value=False)
