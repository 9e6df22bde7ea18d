"""Queries over files and shards that Spark writes from the test tables and reads back by this library's sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.catalogue import _docs, _long, query
from corpusloom.sources import json_split, lines, shard_source
from corpusloom.sources.scratch import scratch_path


@query("SELECT doc_id, lang, CAST(length(text) AS BIGINT) AS n, md5(text) AS digest FROM documents")
def json_split_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON values in a row, without line ends, read back by ranges."""
    path = scratch_path(spark, "json")
    _docs(spark, sf_dir).select(F.to_json(F.struct("doc_id", "lang", "text")).alias("value")).write.option("lineSep", " ").text(path)
    value = F.from_json("value", "doc_id long, lang string, text string")
    found = json_split.split_values(spark, path, "*.txt").select(value.alias("v"))
    return found.select("v.doc_id", "v.lang", _long(F.length("v.text")).alias("n"), F.md5("v.text").alias("digest"))


@query("SELECT doc_id, coalesce(source, '') AS source, coalesce(md5(text), '') AS digest FROM documents")
def zip_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, sources and digests as files of their own, a line a document, joined by line number."""
    path = scratch_path(spark, "lines")
    columns = {"ids": F.col("doc_id").cast("string"), "sources": F.coalesce("source", F.lit("")), "digests": F.coalesce(F.md5("text"), F.lit(""))}
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in columns.items()])).alias("x"))
    # Each task writes a file of each kind, in order of id; files of a task have the same number.
    rows.repartitionByRange("doc_id").sortWithinPartitions("x.kind", "doc_id").select("x.kind", "x.value").write.partitionBy("kind").text(path)
    kind, part = F.regexp_extract("path", r"/kind=(\w+)/", 1), F.regexp_extract("path", r"/part-(\d+)", 1)
    found = lines.zip_lines(lines.numbered_lines(spark, path), kind, list(columns), [part.alias("part")])
    return found.select(_long("ids").alias("doc_id"), F.col("sources").alias("source"), F.col("digests").alias("digest"))


@query(
    """WITH s AS (SELECT coalesce(source, '-') AS name, doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS t FROM documents),
    p AS (SELECT name, doc_id, t, coalesce(len(t), 0) AS n, coalesce(sum(coalesce(len(t), 0)) OVER (PARTITION BY name ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low FROM s),
    q AS (SELECT *, low // 65536 AS part, row_number() OVER (PARTITION BY name, low // 65536 ORDER BY doc_id) - 1 AS sample_index, low - min(low) OVER (PARTITION BY name, low // 65536) AS start FROM p)
    SELECT name || '-' || printf('%05d', CAST(part AS BIGINT)) AS name, sample_index, CAST(start AS BIGINT) AS start, CAST(start + n AS BIGINT) AS "end", md5(array_to_string(t, ',')) AS digest FROM q WHERE n > 0"""
)
def shard_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token shards of the documents' words, written as files and read back, by value."""
    path = scratch_path(spark, "shards")
    tokens = F.transform(F.split("text", " ", -1), lambda w: _long(F.length(w)))
    shard_source.write_shards(_docs(spark, sf_dir).select(F.coalesce("source", F.lit("-")).alias("name"), F.col("doc_id").alias("sample_index"), tokens.alias("tokens")), path, part_tokens=1 << 16)
    read = shard_source.shards(spark, path)
    return read.select("name", "sample_index", "start", "end", F.md5(F.array_join(F.col("tokens").cast("array<string>"), ",")).alias("digest"))
