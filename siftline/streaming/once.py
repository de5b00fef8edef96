"""Insert-or-ignore as a stream: the first event of a key is kept, whatever comes again later, in any run."""

from __future__ import annotations

from pyspark.sql import DataFrame


def first_of_each(events: DataFrame, *, keys: list[str], at: str, within: str) -> DataFrame:
    """A streaming DataFrame with one row for each of ``keys``: the first that arrives.

    The keys are state for ``within`` of event time ``at``, so the state is bounded by what happens in that time: an event that
    comes again within it is ignored, and one that lies further behind the newest is dropped as too late.
    """
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def write_once(rows: DataFrame, path: str, checkpoint: str) -> None:
    """Run the stream over all that there is, and stop. Each micro-batch is a folder of its own number, which replaces itself: a batch that is run again after a failure writes nothing twice.

    A later run with the same checkpoint goes on where this one stopped, keys included.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    rows.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
