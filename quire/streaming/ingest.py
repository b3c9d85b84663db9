"""Incremental ingest of chunk files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire import schemas
from quire.functions.encoding import Encoder
from quire.plans.build import ingest
from quire.sources.store import Store


def ingest_arrivals(
    spark: SparkSession, chunk_path: str, checkpoint: str, registry: DataFrame, store: Store,
    encoder: Encoder | None = None, files_per_batch: int = 1000,
) -> StreamingQuery:
    """Ingest chunk files not seen before, then stop.

    A document's chunks must arrive in one file or batch, as the chunk writer
    leaves them. Batches may be replayed after a failure: a document whose
    signature the manifest already holds is left alone.
    """
    arrivals = (
        spark.readStream.schema(schemas.CHUNKS)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(chunk_path)
    )

    def load(batch: DataFrame, _: int) -> None:
        arrived = batch.select(batch["book"].alias("key")).distinct()
        ingest(batch, registry.join(arrived, "key", "left_semi"), store, encoder=encoder)

    return (
        arrivals.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
