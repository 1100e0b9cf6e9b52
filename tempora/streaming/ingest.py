"""Structured Streaming into a version store: each micro-batch becomes one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def upsert_stream(stream: DataFrame, store: Store, table: str, on: str, order: list[str], checkpoint: str, columns: dict | None = None, once: bool = False) -> StreamingQuery:
    """Merge a stream of facts into a table by its key; of a batch's facts for one key the last in `order` counts.

    Late facts are a matter of valid time, not of watermarks: they get the system time at which they arrive. A batch that
    is replayed after a failure is known by its name in the commit that holds it, and is left out.
    """

    def commit(batch: DataFrame, number: int) -> None:
        mark = f"{checkpoint}#{number}"
        if any(m.get("batch") == mark for m in store.manifests()):
            return
        latest = W.partitionBy(on).orderBy(*[F.col(c).desc() for c in order])
        last = batch.withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")
        d = store.resolve(table)
        arm = columns or {c: c for c in [*d.payload, *(d.valid or ())] if c in batch.columns}
        txn = store.begin()
        txn.batch = mark
        txn.merge(table, last, on, {k: v for k, v in arm.items() if k != d.key}, arm)
        txn.commit()

    writer = stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
