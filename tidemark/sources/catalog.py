"""The series dimension and its join."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CATALOG_SCHEMA = "series_id string, description string, source string, category string, frequency_hint string"

# The known series.
SERIES = [
    ("CPIAUCSL", "Headline CPI, seasonally adjusted", "fred", "inflation", "monthly"),
    ("CPILFESL", "Core CPI, seasonally adjusted", "fred", "inflation", "monthly"),
    ("PCEPI", "PCE price index", "fred", "inflation", "monthly"),
    ("PCEPILFE", "Core PCE price index", "fred", "inflation", "monthly"),
    ("PAYEMS", "Nonfarm payrolls", "fred", "labor", "monthly"),
    ("UNRATE", "Unemployment rate", "fred", "labor", "monthly"),
    ("AWHMAN", "Average weekly hours manufacturing", "fred", "labor", "monthly"),
    ("FEDFUNDS", "Effective federal funds rate", "fred", "rates", "monthly"),
    ("DGS2", "2-year Treasury yield", "fred", "rates", "daily"),
    ("DGS10", "10-year Treasury yield", "fred", "rates", "daily"),
    ("T10Y2Y", "10-year minus 2-year Treasury spread", "fred", "rates", "daily"),
    ("RSAFS", "Retail sales", "fred", "growth/activity", "monthly"),
    ("INDPRO", "Industrial production", "fred", "growth/activity", "monthly"),
    ("MANEMP", "Manufacturing employment", "fred", "growth/activity", "monthly"),
    ("BAMLH0A0HYM2", "ICE BofA US High Yield OAS", "fred", "risk/credit", "daily"),
    ("BAMLC0A0CM", "ICE BofA US Corporate OAS", "fred", "risk/credit", "daily"),
    ("CUSR0000SA0", "CPI-U All items, seasonally adjusted", "bls", "inflation", "monthly"),
    ("CUSR0000SA0L1E", "CPI-U All items less food, seasonally adjusted", "bls", "inflation", "monthly"),
    ("CUUR0000SA0", "CPI-U All items, not seasonally adjusted", "bls", "inflation", "monthly"),
    ("CUUR0000SA0L1E", "CPI-U All items less food, not seasonally adjusted", "bls", "inflation", "monthly"),
]


def series_catalog(spark: SparkSession, source: str | None = None) -> DataFrame:
    """The known series, of one source if given."""
    catalog = spark.createDataFrame(SERIES, CATALOG_SCHEMA)
    return catalog if source is None else catalog.where(F.col("source") == source)


def enrich_series(observations: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Observations with the series' description, category and frequency hint.

    The built-in catalog has a fixed size and is broadcast. For a caller's own catalog
    Spark picks the join by size.
    """
    dimension = catalog if catalog is not None else F.broadcast(series_catalog(observations.sparkSession))
    return observations.join(dimension, ["series_id", "source"], "left")
