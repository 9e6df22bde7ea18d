"""Incremental ingestion: new files are cleaned and appended once; a checkpoint remembers what is done."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions.text import strip


def ingest_text(spark: SparkSession, folder: str, target: str, checkpoint: str, tokenizer_hash: str = "") -> StreamingQuery:
    """Append the cleaned lines of files that weren't taken yet to ``target`` (Parquet: path, text, by tokenizer_hash), then stop.

    Checkpoint and sink go by tokenizer hash, so another tokenizer takes all files again.
    """
    tag = tokenizer_hash or "none"
    lines = spark.readStream.option("recursiveFileLookup", "true").text(folder)
    rows = lines.select(F.col("_metadata.file_path").alias("path"), strip(F.col("value")).alias("text")).where(F.col("text") != "")
    writer = rows.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/{tag}")
    return writer.trigger(availableNow=True).start(f"{target}/tokenizer_hash={tag}")


def pending(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys (name and tokenizer hash) aren't marked complete."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")
