"""Lines of text files with their exact numbers, and files joined by line number; large files are read in many splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(path, line, value) of the files below a folder; line counts from 0 in each file. Lines end with \\n, \\r\\n or \\r, the last one with or without.

    A count of the lines of each split, which reads no values out, and a running sum over a file's splits (a row each) give the number at
    which a split starts; Spark may put splits into tasks in any order. Empty files have no lines.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(folder)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    # Within a split lines follow each other, so the least number of a split tells a line's place in it.
    rows = read.select("value", path.alias("path"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_seq"))
    splits = rows.groupBy(F.col("path").alias("_path"), F.col("_split").alias("_of")).agg(F.min("_seq").alias("_low"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_path").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("_path", "_of", (before - F.col("_low")).alias("_shift"))
    placed = rows.join(starts, (F.col("path") == F.col("_path")) & (F.col("_split") == F.col("_of")))
    return placed.select("path", (F.col("_seq") + F.col("_shift")).alias("line"), "value")


def zip_lines(lines: DataFrame, part: Column, names: list[str], keys: list[Column]) -> DataFrame:
    """Lines of several files side by side: a row for each keys and line that any has, with a column for each of ``names``.

    ``part`` names the file that a line of ``lines`` (path, line, value) is of; other names, and null ones, are left out. A file that has no such
    line gives null; of files with equal keys and name the greatest value of a line counts.
    """
    named = lines.withColumn("_part", part).where(F.col("_part").isin(*names))
    values = [F.max(F.when(F.col("_part") == n, F.col("value"))).alias(n) for n in names]
    return named.groupBy(*keys, "line").agg(*values)
