"""Run a streaming plan over what its source holds now and read the result back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from citeloom.session import scratch_dir

from .operators import event_stream


def _append(stream: DataFrame, root: str) -> None:
    query = (stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()


def run_append(stream: DataFrame) -> DataFrame:
    """Append-mode run into a parquet table with exactly-once files."""
    root = scratch_dir(stream.sparkSession)
    _append(stream, root)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/out")


def run_arrivals(arrivals: Sequence[DataFrame], build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Append-mode run over data that arrives in parts: each part is one trigger of the same, restarted query.

    The watermark of a part is that of the parts before it. ``build`` makes the plan from
    the source, an event feed with the columns of the parts.
    """
    spark = arrivals[0].sparkSession
    root = scratch_dir(spark)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrivals[0].schema)
    for part in arrivals:
        part.write.mode("append").parquet(f"{root}/in")
        _append(build(event_stream(spark, f"{root}/in", files_per_trigger=1_000_000, schema=schema)), root)
    return spark.read.parquet(f"{root}/out")


def run_update(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Update-mode run: each batch is written under its id, the newest row per key counts."""
    spark = stream.sparkSession
    root = scratch_dir(spark)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch_id={batch_id}")

    query = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/state")
             .outputMode("update").trigger(availableNow=True).start())
    query.awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch_id", *values)).alias("r")).select(*keys, *[F.col(f"r.{v}") for v in values])
