"""Batches of token arrays: positions, shifts, padding, masks and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.corpus import with_index

#: Fixed value: the label of a token that isn't predicted.
IGNORE = -100


def positions(df: DataFrame, ordinal: str, size: int) -> DataFrame:
    """batch_id and position of each row, ``size`` rows to a batch."""
    out = with_index(df, ordinal, "_i")
    return out.withColumns({"batch_id": F.floor(F.col("_i") / size), "position": F.col("_i") % size}).drop("_i")


def shift(df: DataFrame, tokens: str, batch: str = "batch_id") -> DataFrame:
    """x and y = x shifted by one, both cut to the batch's shortest."""
    m = F.min(F.size(tokens) - 1).over(Window.partitionBy(batch))
    return df.withColumn("_m", m).withColumns({"x": F.slice(tokens, 1, F.col("_m")), "y": F.slice(tokens, 2, F.col("_m"))}).drop("_m")


def pad(df: DataFrame, tokens: str, labels: str, block: int, pad_id: int = 0, batch: str = "batch_id") -> DataFrame:
    """Masked batches: the last block + 1 tokens, shifted, padded on the right to the batch's longest with pad_id and IGNORE."""
    tail = lambda c: F.slice(c, F.greatest(F.lit(1), F.size(c) - block), block + 1)
    out = df.withColumns({"_t": tail(tokens), "_l": tail(labels)})
    out = out.withColumns({"x": F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0))), "y": F.slice("_l", F.lit(2), F.greatest(F.size("_l") - 1, F.lit(0)))})
    longest = F.max(F.size("x")).over(Window.partitionBy(batch))
    fill = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), (F.col("_n") - F.size(c)).cast("int")))
    return out.withColumn("_n", longest).withColumns({"x": fill("x", pad_id), "y": fill("y", IGNORE)}).drop("_t", "_l", "_n")


def strides(size: Column, block: int) -> Column:
    """Starts of windows of block + 1 tokens that share a border token, as an array; empty for short streams."""
    last = size - block - 2
    return F.when(last >= 0, F.sequence(F.lit(0).cast("long"), last.cast("long"), F.lit(block).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def random_windows(df: DataFrame, tokens: str, block: int, seed: int) -> DataFrame:
    """A random window of block tokens of each row that is long enough, the same for the same seed and plan."""
    start = F.floor(F.rand(seed) * (F.size(tokens) - block)).cast("int")
    return df.where(F.size(tokens) > block).withColumn("start", start).withColumns({"x": F.slice(tokens, F.col("start") + 1, block), "y": F.slice(tokens, F.col("start") + 2, block)})


def labels(segments: Column, ids: Column) -> Column:
    """Labels of a sample from each segment's predict flag and ids: the ids where predicted, IGNORE elsewhere."""
    return F.flatten(F.zip_with(segments, ids, lambda s, i: F.when(s.predict, i).otherwise(F.array_repeat(F.lit(IGNORE), F.size(i)))))


def labelled(df: DataFrame, column: str = "labels") -> DataFrame:
    """Samples with a labelled token after the first."""
    return df.where(F.exists(F.slice(F.col(column), 2, 1 << 30), lambda x: x != IGNORE))
