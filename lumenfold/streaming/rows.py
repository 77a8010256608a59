"""Queries over unbounded sources: the lowering is the same, the source is a readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine


def stream(engine: Engine, sql: str, params: list | None = None) -> DataFrame:
    """The query as a streaming DataFrame; one that needs the whole input is refused, with the reason."""
    why = engine.streamable(sql)
    if why is not None:
        raise ValueError(f"the query can't stream: {why}")
    out = engine.sql(sql, params)
    if not out.isStreaming:
        raise ValueError("no source of the query is a stream")
    return out


def start(engine: Engine, sql: str, sink: str, checkpoint: str, name: str | None = None, params: list | None = None, **options) -> StreamingQuery:
    """Append the query's rows to a sink; progress is kept in the checkpoint folder."""
    writer = stream(engine, sql, params).writeStream.outputMode("append").format(sink).option("checkpointLocation", checkpoint).options(**options)
    return (writer.queryName(name) if name else writer).start()


def upsert(changes: DataFrame, key: list[str], sequence: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the last write of each key of a change stream as a Parquet table, a folder for each batch.

    Batches are merged by operators.sets.latest; a batch that runs again writes the same folder again.
    """
    from ..operators.sets import latest

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest(batch, key, sequence)
        if number:
            new = latest(spark.read.parquet(f"{path}/batch-{number - 1}").unionByName(new), key, sequence)
        new.write.mode("overwrite").parquet(f"{path}/batch-{number}")

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).start()
