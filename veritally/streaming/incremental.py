"""Reconciling a stream of new file-1 rows with a table, batch by batch. An extension: nothing here is needed for a single run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.reconcile import Spec, reconcile


def reconcile_stream(stream: DataFrame, table: DataFrame, spec: Spec, out: str, checkpoint: str, order: list[str] | None = None, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch is reconciled with the table; its pairs go to out/batch=N, so a batch that is run again replaces its own rows."""

    def one(batch: DataFrame, number: int) -> None:
        result = reconcile(batch, table, spec, order, None)
        result.pairs.drop("extra_1", "extra_2").write.mode("overwrite").parquet(f"{out}/batch={number}")
        result.release()

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
