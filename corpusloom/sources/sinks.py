"""Sinks: JSON lines, catalogues, routed shards, manifests, numbered reports and completion marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.corpus import chunks_of_ids


def write_jsonl(df: DataFrame, path: str, ordinal: str | None = None) -> None:
    """A JSON object for each row, nulls written. With an ordinal, files and lines are in its order (a range sort, not one task)."""
    ordered = df.orderBy(ordinal) if ordinal else df
    ordered.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_catalog(df: DataFrame, path: str) -> None:
    """A CSV catalogue with a header; quotes in fields are doubled."""
    df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def write_routed(df: DataFrame, path: str, keys: list[str]) -> None:
    """Rows as Parquet in a folder for each value of the keys (dataset, split). A reader's filter on them prunes folders."""
    df.write.mode("overwrite").partitionBy(*keys).parquet(path)


def manifest(before: DataFrame, after: DataFrame, source: str = "source") -> DataFrame:
    """One row: total, deduped_from and sources, a JSON object of samples by source in order of name."""
    counts = after.groupBy(F.col(source).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("s", "n")))
    one = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.to_json(F.map_from_entries(entries)).alias("sources"))
    return one.crossJoin(before.agg(F.count(F.lit(1)).alias("deduped_from"))).select("total", "deduped_from", "sources")  # two tables of one row


def mark_complete(done: DataFrame, path: str, tokenizer_hash: str) -> None:
    """Appends names to the table of complete sources, under their tokenizer's hash (see streaming.ingest.pending)."""
    done.withColumn("tokenizer_hash", F.lit(tokenizer_hash)).write.mode("append").parquet(path)


def next_report(listing: DataFrame, path: str = "path") -> DataFrame:
    """(name): the file name after the highest numbered report, N.txt, in a listing; 1.txt without any."""
    number = F.regexp_extract(F.col(path), r"(?:^|/)(\d+)\.txt$", 1).try_cast("long")
    return listing.agg(F.concat((F.coalesce(F.max(number), F.lit(0)) + 1).cast("string"), F.lit(".txt")).alias("name"))


def shard_integrity(samples: DataFrame, name: str = "name", tokens: str = "tokens") -> DataFrame:
    """By shard: samples, empty ones, tokens, and the smallest and largest id. All aggregates combine before the shuffle."""
    size = F.size(tokens)
    return samples.groupBy(name).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(size == 0).alias("empty"),
        F.sum(size.cast("long")).alias("n_tokens"),
        F.min(F.array_min(tokens)).alias("min_id"),
        F.max(F.array_max(tokens)).alias("max_id"),
    )


def cumulative_tokens(shards: DataFrame, name: str = "name") -> DataFrame:
    """shard_integrity() rows with the tokens of all shards up to each, by name. A row for each shard passes the window."""
    from pyspark.sql import Window

    return shards.withColumn("cumulative", F.sum("n_tokens").over(Window.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)))


def write_token_stream(df: DataFrame, path: str, ordinal: str, tokens: str = "tokens", size: int = 1 << 20) -> None:
    """All samples' tokens as one flat stream in Parquet: rows (chunk, ids) of ``size`` tokens each, the last with fewer, in order of sample and place."""
    one = df.select(F.lit("").alias("source"), F.col(ordinal).alias("o"), F.col(tokens).alias("ids"))
    chunks_of_ids(one, "o", size).select("chunk", "ids").repartitionByRange("chunk").sortWithinPartitions("chunk").write.mode("overwrite").parquet(path)


def write_result(df: DataFrame, path: str) -> None:
    """A table of one row (metrics, statistics) as a JSON file."""
    df.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def report_text(failures: DataFrame, title: str, fields: list[str]) -> DataFrame:
    """(text): a report of a short table, a block for each row with a line for each field; see next_report() for its name."""
    block = F.array_join(F.array(*[F.concat(F.lit(f"{f}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields]), "\n")
    blocks = failures.agg(F.array_join(F.array_sort(F.collect_list(block)), "\n\n").alias("b"), F.count(F.lit(1)).alias("n"))
    return blocks.select(F.concat(F.lit(f"{title}\ncount: "), F.col("n").cast("string"), F.when(F.col("n") > 0, F.concat(F.lit("\n\n"), "b")).otherwise("")).alias("text"))


def save_tokenizer(vocabulary: DataFrame, path: str, about: dict[str, str]) -> None:
    """A vocabulary (id, piece) as Parquet and what is told of it as JSON beside."""
    vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
    write_result(vocabulary.agg(F.count(F.lit(1)).alias("vocab_size"), *[F.lit(v).alias(k) for k, v in about.items()]), f"{path}/about")


def catalog_rows(entries: DataFrame, base: str) -> DataFrame:
    """Catalogue entries (index, name, category, repo, source_file, url, bytes, description) with local_path, the entry's folder and file below ``base``."""
    file = F.element_at(F.split("source_file", "/"), -1)
    return entries.withColumn("local_path", F.concat_ws("/", F.lit(base.rstrip("/")), catalog_dir(F.col("index"), F.col("name")), file))


def catalog_dir(index: Column, name: Column) -> Column:
    """A catalogue entry's folder: two digits and the name in small letters, with runs of other characters as one _."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.format_string("%02d_%s", index.cast("int"), slug)


def chart_points(losses: DataFrame, step: str = "step", value: str = "loss") -> DataFrame:
    """(step, x, y): a curve's points in the unit square, for any plotter; a flat curve lies at 0."""
    ends = losses.agg(F.min(step).alias("_s0"), F.max(step).alias("_s1"), F.min(value).alias("_v0"), F.max(value).alias("_v1"))
    scaled = lambda c, lo, hi: F.coalesce((F.col(c) - F.col(lo)) / F.nullif(F.col(hi) - F.col(lo), F.lit(0)), F.lit(0.0)).cast("double")
    return losses.crossJoin(F.broadcast(ends)).select(step, scaled(step, "_s0", "_s1").alias("x"), scaled(value, "_v0", "_v1").alias("y"))  # ends is one row


def first_with_rows(candidates: list[DataFrame]) -> DataFrame:
    """The first of several readings of a source that has a row, else the last. Each is asked for one row only."""
    for df in candidates[:-1]:
        if not df.isEmpty():
            return df
    return candidates[-1]
