"""Requests as a stream: each micro-batch is answered by the batch engine.

The catalog and the history are static tables of the engine, so the query keeps no state;
a batch's answers are written under its number, so that a repeated batch replaces itself.
The stage tables of a batch are deleted once its answers are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fastenlake.plans.engine import Engine
from fastenlake.plans.stage import scope


def answer_stream(engine: Engine, requests: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """requests: a streaming DataFrame with the request columns; out: a folder of Parquet
    answers, partitioned by batch; once: answer what is there and stop."""

    engine.prepare()

    def write(batch: DataFrame, number: int) -> None:
        with scope():
            engine.match(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = requests.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
