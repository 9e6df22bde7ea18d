"""Fixed-context packing of a stream: what a source's tokens leave over waits for the next rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.corpus import chunks_of_ids
from corpusloom.streaming.commits import BatchLog

_PARTS = {"data": "source string, chunk long, ids array<long>", "state": "source string, chunks long, tail array<long>"}


def packing_log(spark: SparkSession, target: str, size: int, tag: str = "") -> BatchLog:
    """The tables of pack_stream(): data (source, chunk, ids) and state (source, chunks, tail), for a context length and a tag."""
    return BatchLog(spark, target, f"{size}-{tag}" if tag else str(size), _PARTS)


def tails(spark: SparkSession, log: BatchLog) -> DataFrame:
    """(source, chunks, tail): whole contexts so far, and the tokens that wait, as they are dropped at a stream's end."""
    last = log.last(spark)
    return spark.createDataFrame([], _PARTS["state"]) if last is None else log.one(spark, "state", last)


def pack_stream(rows: DataFrame, target: str, checkpoint: str, size: int, tag: str = "", source: str = "source", ids: str = "ids", ordinal: str = "ordinal", failing: Callable[[str], None] | None = None) -> StreamingQuery:
    """Pack a streaming (source, ordinal, ids) into whole contexts of ``size`` ids by source, until the input is taken; see packing_log() for what is written.

    A batch's rows go by ordinal (unique within a source and batch), after those of the batches before. So if ordinals grow from batch to batch
    the contexts are those of packing all rows at once, however the input is cut into batches. State is a row for each source with fewer than ``size`` ids.
    Within a batch neither a source nor its tokens pass through one task: offsets are running sums over buckets, and contexts are put together by (source, chunk).
    Batches are written once (see commits), with the state they leave; a replayed batch starts from the state before it.
    """
    log = packing_log(rows.sparkSession, target, size, tag)

    def work(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def tables() -> dict[str, DataFrame]:
            last = log.last(spark, number)
            before = spark.createDataFrame([], _PARTS["state"]) if last is None else log.one(spark, "state", last)
            new = batch.select(F.col(source).alias("source"), F.col(ordinal).cast("long").alias("ordinal"), F.col(ids).cast("array<long>").alias("ids"))
            # A tail begins a context, and stands before all rows of the batch.
            first = new.groupBy("source").agg(F.min("ordinal").alias("o"))
            waiting = before.join(first, before["source"].eqNullSafe(first["source"])).select(before["source"], (F.col("o") - 1).alias("ordinal"), F.col("tail").alias("ids"))
            chunks = chunks_of_ids(new.unionByName(waiting), "ordinal", size)
            known = before.select(F.col("source").alias("s"), F.col("chunks").alias("base"))
            placed = chunks.join(known, F.col("source").eqNullSafe(F.col("s")), "left").select("source", (F.col("chunk") + F.coalesce("base", F.lit(0))).alias("chunk"), "ids")
            whole = F.size("ids") == size
            left = placed.groupBy("source").agg(F.max(F.when(whole, F.col("chunk") + 1)).alias("after"), F.max(F.when(~whole, F.struct("chunk", "ids"))).alias("rest"))
            none = F.array().cast("array<long>")
            # Without a whole context the tail's own number is that of the contexts so far.
            moved = left.select(F.col("source").alias("s2"), F.coalesce("after", F.col("rest.chunk")).alias("n"), F.coalesce("rest.ids", none).alias("t"))
            state = before.join(moved, F.col("source").eqNullSafe(F.col("s2")), "full").select(F.coalesce("source", "s2").alias("source"), F.coalesce("n", "chunks").alias("chunks"), F.coalesce("t", "tail").alias("tail"))
            return {"data": placed.where(whole), "state": state}

        log.write(number, tables, spark, failing)

    return rows.writeStream.foreachBatch(work).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{log.tag}").trigger(availableNow=True).start()
