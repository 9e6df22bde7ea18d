"""Exactly-once batches: data under the batch's number, then a record of (batch, tag); readers see recorded batches only.

A batch that fails between its data and its record is written again by the stream's checkpoint under the same number and replaces what it
left. One that fails after the record is left alone. The tag names what the data depend on (a tokenizer's hash, a context length).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

_RECORD = "batch long, tag string"


class BatchLog:
    """Tables by batch below a folder. parts: name of each table and its columns."""

    def __init__(self, spark: SparkSession, target: str, tag: str, parts: dict[str, str]) -> None:
        self.target, self.tag, self.parts = target.rstrip("/"), tag, parts
        spark.createDataFrame([], _RECORD).write.mode("ignore").parquet(f"{self.target}/commits")

    def _records(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(_RECORD).parquet(f"{self.target}/commits").where(F.col("tag") == self.tag)

    def _path(self, part: str) -> str:
        return f"{self.target}/{part}/tag={self.tag}"

    def last(self, spark: SparkSession, before: int | None = None) -> int | None:
        """The last recorded batch, or the last below ``before``."""
        records = self._records(spark)
        return (records if before is None else records.where(F.col("batch") < before)).agg(F.max("batch")).first()[0]

    def write(self, batch: int, tables: Callable[[], dict[str, DataFrame]], spark: SparkSession, failing: Callable[[str], None] | None = None) -> None:
        """The batch's tables, then its record; nothing if it is recorded. ``failing`` is called after each step, for tests of failures."""
        if not self._records(spark).where(F.col("batch") == batch).isEmpty():
            return
        for part, table in tables().items():
            table.write.mode("overwrite").parquet(f"{self._path(part)}/batch={batch}")
            if failing:
                failing(part)
        spark.createDataFrame([(batch, self.tag)], _RECORD).coalesce(1).write.mode("append").parquet(f"{self.target}/commits")
        if failing:
            failing("record")

    def one(self, spark: SparkSession, part: str, batch: int) -> DataFrame:
        """A table of one recorded batch."""
        return spark.read.schema(self.parts[part]).parquet(f"{self._path(part)}/batch={batch}")

    def read(self, spark: SparkSession, part: str) -> DataFrame:
        """A table over all recorded batches, with column batch."""
        if self.last(spark) is None:
            return spark.createDataFrame([], f"{self.parts[part]}, batch long")
        rows = spark.read.schema(f"{self.parts[part]}, batch long").parquet(self._path(part))
        return rows.join(self._records(spark).select("batch"), "batch", "left_semi").select(*rows.columns)


def append_once(stream: DataFrame, target: str, checkpoint: str, tag: str, failing: Callable[[str], None] | None = None) -> StreamingQuery:
    """Append a stream's rows to the table ``data`` of a BatchLog, each batch once, until the input is taken. Another tag takes all input again."""
    log = appended(stream.sparkSession, target, tag, stream)

    def work(batch: DataFrame, number: int) -> None:
        log.write(number, lambda: {"data": batch}, batch.sparkSession, failing)

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", f"{checkpoint.rstrip('/')}/{tag}").trigger(availableNow=True).start()


def appended(spark: SparkSession, target: str, tag: str, rows: DataFrame) -> BatchLog:
    """The log that append_once() writes for rows like these."""
    return BatchLog(spark, target, tag, {"data": ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)})


def complete_sources(files: DataFrame, tokenizer_hash: str, force: bool = False) -> DataFrame:
    """(name) of the sources that are done, from (path, content) of what stands beside their shards.

    A source is done if it has both name.complete and name.meta.json, and the latter is an object whose tokenizer_sha256 is this hash; broken JSON
    counts as missing. ``force``: none is done.
    """
    path = F.col("path")
    marks = files.where(path.endswith(".complete")).select(F.regexp_replace("path", r"\.complete$", "").alias("name"))
    found = F.try_variant_get(F.try_parse_json(F.col("content").cast("string")), "$.tokenizer_sha256", "string")
    metas = files.where(path.endswith(".meta.json")).select(F.regexp_replace("path", r"\.meta\.json$", "").alias("name"), found.alias("hash"))
    done = marks.join(metas.where(F.col("hash") == tokenizer_hash), "name", "left_semi").distinct()
    return done.where("false") if force else done
