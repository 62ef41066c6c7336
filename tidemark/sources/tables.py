"""Reading and writing the package's tables as Parquet or CSV."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schemas import FORECASTS, METRICS

READERS = ("parquet", "csv")


def write_table(
    df: DataFrame, path: str, format: str = "parquet", order: Sequence[str] = (), mode: str = "errorifexists"
) -> str:
    """Write ``df``; ``order`` sorts it across the output files, missing last."""
    if format not in READERS:
        raise ValueError(f"Unsupported format: {format}")
    rows = df.orderBy(*[F.col(c).asc_nulls_last() for c in order]) if order else df
    writer = rows.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    writer.format(format).save(path)
    return path


def read_dataset(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A model dataset. CSV columns stay text; every operator types what it reads."""
    return spark.read.parquet(path) if format == "parquet" else spark.read.csv(path, header=True)


def _typed(spark: SparkSession, path: str, format: str, schema) -> DataFrame:
    if format == "parquet":
        return spark.read.schema(schema).parquet(path)
    # Columns are matched by name, whatever their order in the file.
    found = spark.read.csv(path, header=True)
    return found.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema if f.name in found.columns]
    )


def read_forecasts(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _typed(spark, path, format, FORECASTS)


def read_metrics(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return _typed(spark, path, format, METRICS)


def write_comparison(
    forecasts: DataFrame,
    metrics: DataFrame,
    directory: str,
    prefix: str = "model_comparison",
    format: str = "parquet",
    mode: str = "overwrite",
) -> dict[str, str]:
    """Write forecasts and metrics side by side; returns both paths."""
    base = f"{directory.rstrip('/')}/{prefix}"
    paths = {"forecasts": f"{base}_forecasts", "metrics": f"{base}_metrics"}
    write_table(forecasts, paths["forecasts"], format, ["model_name", "forecast_timestamp", "target_id"], mode)
    write_table(metrics, paths["metrics"], format, mode=mode)
    return paths


def preview(df: DataFrame, rows: int = 10) -> tuple[DataFrame, int]:
    """The first rows and the row count."""
    return df.limit(rows), df.count()
