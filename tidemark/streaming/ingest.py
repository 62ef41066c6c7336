"""The batch merge as a streaming sink: each micro-batch is one idempotent upsert."""

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.payloads import LANDING
from tidemark.sources.store import ObservationStore


def landing_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New landed responses as they appear in a folder."""
    reader = spark.readStream.schema(LANDING)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path)


def upsert_stream(
    landed: DataFrame,
    store: ObservationStore,
    normalize: Callable[[DataFrame], DataFrame],
    validate: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    order_by: Sequence[str] = ("fetched_at", "value"),
    **trigger,
):
    """Start merging a landing stream into the store.

    A micro-batch that is replayed after a failure finds its rows stored and skips them,
    so results are exactly-once.
    """

    def merge(batch: DataFrame, _epoch: int) -> None:
        store.upsert(validate(normalize(batch)), order_by)

    writer = landed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
