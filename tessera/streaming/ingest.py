"""Continuous ingest: a stream of documents is upserted into a store, a version each micro-batch."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store, latest, upserted


def stream(spark: SparkSession, path: str, schema: str | T.StructType, per_batch: int = 1) -> DataFrame:
    """Documents of NDJSON files as they come; control records are no documents."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    lines = spark.readStream.option("maxFilesPerTrigger", per_batch).text(path)
    plain = lines.where((F.trim("value") != "") & F.get_json_object("value", "$._update_").isNull() & F.get_json_object("value", "$._end_").isNull() & F.get_json_object("value", "$._header_").isNull())
    return plain.select(F.from_json("value", kind).alias("d")).select("d.*")


def into(store: Store, docs: DataFrame, checkpoint: str, *, types: Mapping[str, str] | None = None, trigger: Mapping[str, Any] | None = None) -> StreamingQuery:
    """Upserts every micro-batch. A batch that runs again after a failure replaces the same keys, so it changes nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        store.update(batch, types=types)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def changes(df: DataFrame, key: str, order: str, deleted: str) -> DataFrame:
    """The state that a log of changes leaves: each key's last row, unless it is a deletion."""
    return latest(df, key, (order,)).where(~F.col(deleted)).drop(deleted)


def histogram(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Counts a window of event time, as append-only results: a window comes out once it can't change."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("count"))


__all__ = ["changes", "histogram", "into", "stream", "upserted"]
