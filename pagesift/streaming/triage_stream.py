"""Triage on a stream of samples: stateless, with a static type table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from pagesift.operators.triage import triage_routes


def stream_triage(
    samples: DataFrame, types: DataFrame, output: str, checkpoint: str, keep: list[str]
) -> DataStreamWriter:
    """A writer that routes each micro-batch like a batch run; start it with `.start()`."""

    def route(batch: DataFrame, number: int) -> None:
        (
            triage_routes(batch, types, keep)
            .write.mode("overwrite")
            .partitionBy("route")
            .parquet(f"{output}/batch={number}")
        )

    return samples.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint)
