"""File sources: text trees, Markdown templates, JSON of three layouts, CSV, token shards and archives.

All give (path, ordinal, ...), where ordinals follow the paths' parts and then the place in
the file. A JSON value is handed on as its text.
"""

from __future__ import annotations

import csv
import io
import json
import tarfile
import zipfile
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.corpus import first_rows, numbered, running_sum, with_index
from corpusloom.operators.jsontext import collect_text
from corpusloom.sources.json_split import split_values
from corpusloom.sources.lines import numbered_lines


def _with_path(df: DataFrame) -> DataFrame:
    return df.withColumn("path", F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/"))


def _ordered(df: DataFrame, listing: DataFrame, within: str | None = None) -> DataFrame:
    """ordinal: the paths of ``listing`` by their parts, then the place within the file.

    The listing holds no content, so files aren't read for it. It is ordered in one task, a row for each file.
    """
    ranks = listing.select("path", (F.row_number().over(Window.orderBy(F.split("path", "/"))) - 1).cast("long").alias("_r"))
    place = F.coalesce(F.col(within).cast("long"), F.lit(0)) if within else F.lit(0)
    return df.join(ranks, "path").withColumn("ordinal", F.col("_r") * (1 << 40) + place).drop("_r")


def _files(spark: SparkSession, folder: str, pattern: str, recursive: bool = True) -> DataFrame:
    """(path, content) of files; without content where that isn't asked for."""
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    read = read.option("recursiveFileLookup", "true") if recursive else read
    return read.load(folder).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length", "content")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files below a folder, names that begin with a dot left out. Nothing is read."""
    return _files(spark, folder, pattern).select("path", "length").where(~F.element_at(F.split("path", "/"), -1).startswith("."))


def first_named(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(path): the first file of a name below a folder, by path; no row without any."""
    return listing(spark, folder, name).agg(F.min_by("path", F.split("path", "/")).alias("path")).where("path is not null")


def split_ranked(files: DataFrame) -> DataFrame:
    """Files with rank: those of train before valid before test before others (by the name up to its first "_"), then by name."""
    name = F.element_at(F.split("path", "/"), -1)
    split = F.substring_index(name, "_", 1)
    order = F.when(split == "train", 0).when(split == "valid", 1).when(split == "test", 2).otherwise(99)
    return numbered(files, [order, name, F.col("path")], "rank").withColumn("rank", F.col("rank").cast("int"))


def data_blobs(tree: DataFrame, prefix: str = "data/", suffixes: tuple[str, ...] = (".json", ".jsonl"), without: str = "prompt") -> DataFrame:
    """(path) of a repository's tree listing (value: its JSON text): blobs below ``prefix`` with one of the suffixes and without a word in their path."""
    items = tree.select(F.explode(F.from_json("value", "tree array<struct<path: string, type: string>>").getField("tree")).alias("t")).select("t.*")
    ends = F.lit(False)
    for suffix in suffixes:
        ends = ends | F.col("path").endswith(suffix)
    return items.where((F.col("type") == "blob") & F.col("path").startswith(prefix) & ends & ~F.contains("path", F.lit(without))).select("path")


def _utf8(content: Column) -> Column:
    """Bytes as text, without those that aren't UTF-8."""

    @F.pandas_udf("string")
    def text(rows: pd.Series) -> pd.Series:
        return rows.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return text(content)


def text_files(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(path, ordinal, text) of the files below a folder: stripped, blank ones left out, names that begin with "._" skipped, invalid bytes dropped."""
    files = _files(spark, folder, pattern).where(~F.element_at(F.split("path", "/"), -1).startswith("._"))
    texts = files.select("path", strip(_utf8(F.col("content"))).alias("text")).where(F.col("text") != "")
    return _ordered(texts, files)


def markdown_leaves(spark: SparkSession, folder: str, bindings: dict[str, str] | None = None, skip: str = "data.md") -> DataFrame:
    """(path, ordinal, text) of a folder's own Markdown files without [[links]].

    Comments between %% go, a leading python block is cut and never run, {name} is replaced from ``bindings`` (unless one is missing:
    then the text stays raw), the text ends at `thatsAll`, and `name`: becomes <name>:.
    """
    found = _files(spark, folder, "*.md", recursive=False)
    files = found.select("path", _utf8(F.col("content")).alias("text"))
    leaves = files.where((F.element_at(F.split("path", "/"), -1) != skip) & ~F.col("text").rlike(r"(?s)\[\[.*?\]\]"))
    text = F.regexp_replace(F.regexp_replace("text", r"(?s)%%.*?%%\n", ""), r"(?s)\A```python\n.*?\n```\s*", "")
    filled = text
    for name, value in (bindings or {}).items():
        filled = F.replace(filled, F.lit("{" + name + "}"), F.lit(value))
    text = F.when(filled.rlike(r"\{[^{}]*\}"), text).otherwise(filled)
    text = F.substring_index(text, "`thatsAll`", 1)
    text = F.regexp_replace(text, r"`\s*([^`\n]+?)\s*`\s*[:：]", "<$1>:")
    return _ordered(leaves.select("path", strip(text).alias("text")), found)


def json_values(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """(path, ordinal, value) of JSON files: arrays, or values in a row on any lines; what can't be parsed fails the read. See json_split: a file may be of any size, and is read by many tasks."""
    return _ordered(split_values(spark, folder, pattern), listing(spark, folder, pattern), "place").drop("place")


def records(spark: SparkSession, folder: str, pattern: str = "*.json*") -> DataFrame:
    """(path, ordinal, value) of JSON or JSON-lines files: each value is a record, but an object whose data, examples or samples (the first it has) is a list gives that list's items."""
    values = json_values(spark, folder, pattern)
    parsed = F.parse_json("value")
    wrapped = F.coalesce(*[F.try_variant_get(parsed, f"$.{k}", "array<variant>") for k in ("data", "examples", "samples")])
    items = values.select("path", "ordinal", F.posexplode(F.coalesce(F.transform(wrapped, lambda x: F.to_json(x)), F.array("value"))).alias("pos", "value"))
    # A wrapped record counts after its file's values before it; a file is one wrapper or many records.
    return items.select("path", (F.col("ordinal") + F.col("pos")).alias("ordinal"), "value")


def _csv_objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, seq, value): rows of whole CSV files as JSON objects by their own header; empty and missing fields are left out."""
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            rows = csv.DictReader(io.TextIOWrapper(io.BytesIO(content.as_py()), encoding="utf-8-sig", errors="replace", newline=""))
            seq = 0
            while held := list(islice(rows, 1000)):
                values = [json.dumps({k: v for k, v in row.items() if k and v and isinstance(v, str)}, ensure_ascii=False) for row in held]
                yield pa.record_batch([pa.array([path] * len(held)), pa.array(range(seq, seq + len(held)), pa.int64()), pa.array(values)], names=["path", "seq", "value"])
                seq += len(held)


def mixed_corpus(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """(path, ordinal, text) of the .json, .jsonl, .txt and .csv files below a folder, in order of path; other files and names that begin with a dot are skipped.

    JSON values and CSV rows are turned to text (see operators.jsontext), text and CSV files are taken whole, each in a task (2 GB at most); blank texts are left out. ``most`` texts at most, the first.
    """
    every = listing(spark, folder).where(F.lower("path").rlike(r"\.(json|jsonl|txt|csv)$"))
    kinds = {r.kind for r in every.select(F.lower(F.regexp_extract("path", r"(?i)\.(json|jsonl|txt|csv)$", 1)).alias("kind")).distinct().collect()}
    parts = []
    for kind in ("json", "jsonl"):
        if kind in kinds:
            read = json_values if kind == "json" else json_lines
            parts.append(read(spark, folder, f"*.{kind}").select("path", (F.col("ordinal") % (1 << 40)).alias("seq"), collect_text(F.col("value")).alias("text")))
    if "txt" in kinds:
        texts = _files(spark, folder, "*.txt").select("path", F.lit(0).cast("long").alias("seq"), strip(_utf8(F.col("content"))).alias("text"))
        parts.append(texts)
    if "csv" in kinds:
        rows = _files(spark, folder, "*.csv").select("path", "content").mapInArrow(_csv_objects, "path string, seq long, value string")
        parts.append(rows.select("path", "seq", collect_text(F.col("value")).alias("text")))
    if not parts:
        return spark.createDataFrame([], "path string, ordinal long, text string")
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    out = _ordered(united.where(~F.element_at(F.split("path", "/"), -1).startswith(".")), every, "seq").select("path", "ordinal", strip(F.col("text")).alias("text")).where("text != ''")
    return first_rows(out, "ordinal", most)


def json_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, ordinal, value) of JSON lines: blank lines skipped, a malformed line fails the read. Files are split by Spark; ordinals follow the lines' numbers."""
    lines = numbered_lines(spark, folder, pattern)
    good = lines.where(strip(F.col("value")) != "").withColumn("value", F.to_json(F.parse_json("value")))
    return _ordered(good, listing(spark, folder, pattern), "line").drop("line")


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all strings; quotes double within fields, fields may hold line ends, and a byte-order mark goes."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    return rows.toDF(*[c.removeprefix("﻿") for c in rows.columns])


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, content) of zip and tar archives. Members that leave the archive's folder by their names are skipped."""
    files = spark.read.format("binaryFile").load(path)

    def members(content: bytes) -> Iterator[tuple[str, bytes]]:
        if zipfile.is_zipfile(io.BytesIO(content)):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
        else:
            with tarfile.open(fileobj=io.BytesIO(content)) as t:
                yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for member, data in members(content.as_py()):
                    if not member.startswith("/") and ".." not in member.split("/"):
                        yield pa.record_batch([pa.array([name]), pa.array([member]), pa.array([data], pa.binary())], names=["path", "member", "content"])

    return _with_path(files.select("content", "_metadata")).select("path", "content").mapInArrow(work, "path string, member string, content binary")


def token_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sample_index, start, end, tokens) of shards: name.bin holds unsigned 32-bit ids, name.idx unsigned 64-bit token offsets, little-endian.

    A sample ends where the next begins, the last at the end of the file; empty samples
    are left out but keep their number. An index without its .bin fails the read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = _with_path(files.select("content", "_metadata")).select(F.regexp_replace("path", r"\.(bin|idx)$", "").alias("name"), F.regexp_extract("path", r"\.(bin|idx)$", 1).alias("kind"), "content")
    idx = files.where("kind = 'idx'").select("name", F.col("content").alias("idx"))
    both = idx.join(files.where("kind = 'bin'").select("name", F.col("content").alias("bin")), "name", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw, data in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if not data.is_valid:
                    raise FileNotFoundError(f"{name}.bin")
                starts, ids = np.frombuffer(raw.as_py(), "<u8").astype(np.int64), np.frombuffer(data.as_py(), "<u4").astype(np.int64)
                ends = np.append(starts[1:], len(ids))
                kept = np.flatnonzero(ends > starts)
                columns = [pa.array([name] * len(kept)), pa.array(kept), pa.array(starts[kept]), pa.array(ends[kept]), pa.array([ids[starts[i] : ends[i]] for i in kept], pa.list_(pa.int64()))]
                yield pa.record_batch(columns, names=["name", "sample_index", "start", "end", "tokens"])

    return both.mapInArrow(work, "name string, sample_index long, start long, end long, tokens array<long>")


def shard_dataset(samples: DataFrame) -> DataFrame:
    """Samples (name, sample_index, ...) with index, their place in order of name and sample from 0, and path, name#sample."""
    rank = F.dense_rank().over(Window.orderBy("name")).cast("long") - 1
    names = samples.select("name").distinct().select("name", rank.alias("_n"))
    placed = samples.join(F.broadcast(names) if names.limit(10_001).count() <= 10_000 else names, "name").withColumn("_o", F.col("_n") * (1 << 40) + F.col("sample_index"))
    return with_index(placed, "_o").withColumn("path", F.concat("name", F.lit("#"), F.col("sample_index").cast("string"))).drop("_o", "_n")


def nth(df: DataFrame, i: int, index: str = "index") -> DataFrame:
    """The row with index ``i``; a negative one counts from the end."""
    if i >= 0:
        return df.where(F.col(index) == i)
    size = df.agg((F.max(index) + 1).alias("_size"))
    return df.crossJoin(F.broadcast(size)).where(F.col(index) == F.col("_size") + i).drop("_size")  # size is one row


def write_token_shards(df: DataFrame, path: str, name: str = "shard", rows: int = 1 << 16) -> None:
    """Samples as Parquet in a folder for each name, committed by Spark's writer; see shard_source for .bin and .idx files. Rows go by sample, in files of
    ``rows`` sample numbers, so a hot name is many tasks' work and a reader's filter on name and sample_index reads a row group."""
    dealt = [F.floor(F.col("sample_index") / rows)] if "sample_index" in df.columns else []
    keys = [name, "sample_index"] if dealt else [name]
    df.repartition(F.col(name), *dealt).sortWithinPartitions(*keys).write.mode("overwrite").partitionBy(name).parquet(path)


def read_token_sample(spark: SparkSession, path: str, name: str, sample_index: int) -> DataFrame:
    """One sample of shards written by write_token_shards(): the folder is pruned, and the sample's row group found by its statistics."""
    return spark.read.parquet(path).where((F.col("shard") == name) & (F.col("sample_index") == sample_index))


def legacy_shards(samples: DataFrame, name: str = "name", tokens: str = "tokens", ordinal: str = "sample_index") -> DataFrame:
    """(name, part, bin, idx, samples, n_tokens): the bytes of .bin and .idx files, ids as unsigned 32-bit and offsets as unsigned 64-bit numbers, little-endian.

    Empty samples are left out. A shard is made in parts of about 2^24 tokens, in order, whose .bin parts are put one after another, and whose offsets count from the
    shard's start; so no shard has to fit in one task. meta(): the shard's counts.
    """
    kept = samples.where(F.size(tokens) > 0)
    placed = running_sum(kept, F.size(tokens), ordinal, "_start", [name])
    placed = placed.select(F.col(name).alias("name"), F.floor(F.col("_start") / (1 << 24)).alias("part"), F.col(ordinal).alias("i"), F.col("_start").alias("start"), F.col(tokens).alias("t"))
    dealt = placed.repartition("name", "part").sortWithinPartitions("name", "part", "i")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True)

        for (shard, part), group in groupby(rows(), key=lambda r: r[:2]):
            starts, ids = [], []
            for _, _, start, t in group:
                starts.append(start)
                ids.append(np.asarray(t.values, "<u4"))
            data = np.concatenate(ids)
            columns = [pa.array([shard]), pa.array([part], pa.int64()), pa.array([data.tobytes()], pa.binary()), pa.array([np.array(starts, "<u8").tobytes()], pa.binary())]
            yield pa.record_batch([*columns, pa.array([len(starts)], pa.int64()), pa.array([len(data)], pa.int64())], names=["name", "part", "bin", "idx", "samples", "n_tokens"])

    return dealt.mapInArrow(work, "name string, part long, bin binary, idx binary, samples long, n_tokens long")


def shard_meta(parts: DataFrame) -> DataFrame:
    """(name, meta): the JSON that goes beside each shard of legacy_shards()."""
    meta = F.to_json(F.struct(F.lit("uint32").alias("token_dtype"), F.lit("uint64").alias("index_dtype"), F.sum("samples").alias("sample_count"), F.sum("n_tokens").alias("token_count")))
    return parts.groupBy("name").agg(meta.alias("meta"))


def missing_files(listing: DataFrame, expected: DataFrame) -> DataFrame:
    """Rows of ``expected`` (path, bytes) without a complete file in ``listing`` (path, length): absent, of other size, or still being loaded (a .aria2 beside it)."""
    loading = listing.where(F.col("path").endswith(".aria2")).select(F.regexp_replace("path", r"\.aria2$", "").alias("path"))
    done = listing.join(loading, "path", "left_anti").select("path", F.col("length").alias("bytes"))
    return expected.withColumn("bytes", F.col("bytes").try_cast("long")).join(done, ["path", "bytes"], "left_anti")

