"""Process once: annotate only what hasn't been, in batches or as a stream, failures kept with their status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import append_once


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def pending(items: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Items whose key, or pair of keys, isn't in ``done`` yet."""
    return items.join(done.select(*_keys(key)).distinct(), _keys(key), "left_anti")


def resume(items: DataFrame, done: DataFrame, key: str, annotate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What was done, and what ``annotate`` makes of the rest."""
    return done.unionByName(annotate(pending(items, done, key)), allowMissingColumns=True)


def gate(items: DataFrame, allowed: DataFrame | None, key: str | list[str]) -> DataFrame:
    """Items whose key, or pair of keys, is allowed; without a list all are."""
    return items if allowed is None else items.join(allowed.select(*_keys(key)), _keys(key), "left_semi")


def flagged(items: DataFrame, listed: DataFrame, key: str | list[str], flag: str) -> DataFrame:
    """Items with a column ``flag`` that says whether their key is listed."""
    there = listed.select(*_keys(key)).distinct().withColumn(flag, F.lit(True))
    return items.join(there, _keys(key), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def with_status(annotated: DataFrame, required: str, default: str | None = None) -> DataFrame:
    """Mark rows whose ``required`` column is missing as failed, and give them ``default``; they count as done all the same."""
    failed = F.col(required).isNull()
    out = annotated.withColumn("status", F.when(failed, "failed").otherwise("ok"))
    return out.withColumn(required, F.coalesce(required, F.lit(default))) if default is not None else out


def annotate_stream(source: DataFrame, key: str | list[str], annotate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, log: str | None = None, run: str = "stream", failed: Column | None = None, once: bool = True) -> StreamingQuery:
    """Write ``annotate(batch)`` of a stream to the table ``out``, every key once, over restarts too.

    Which keys were there is state of the query, kept in its checkpoint by Spark's state store and dealt by key; ``out`` is never
    read, so a batch costs what it holds, not what was done before. A batch is a folder of ``out`` (:func:`append_once`): one that is replayed
    after a failure takes its own place again. A null key is a key like another. Of rows that share a key within a batch any one may
    stay; make ``source`` alike in them, or order them before. With ``log``, counts of each batch go beside it: ``processed`` and, where
    ``failed`` says of an annotated row that it is, ``failed``. With ``once`` the query ends when it has read what is there.
    """
    counters = {"processed": F.count(F.lit(1)), "failed": F.count_if(failed if failed is not None else F.lit(False))}

    def put(batch: DataFrame, number: int) -> None:
        append_once(annotate(batch), out, run, number, counters if log else None, log)

    fresh = source.dropDuplicates(_keys(key))
    writer = fresh.writeStream.foreachBatch(put).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_totals(events: DataFrame, time: str, by: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event time, for a stream or a table; a stream drops what is later than ``late``."""
    d = events.withWatermark(time, late) if events.isStreaming else events
    g = d.groupBy(F.window(time, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return g.select(F.col("w.start").alias("start"), by, "n", "total")
