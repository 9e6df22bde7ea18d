"""Evaluation metrics over rows of predictions and losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def window_average(df: DataFrame, step: Column, value: Column, size: int = 100) -> DataFrame:
    """(window, n, average) of each whole run of ``size`` steps; an incomplete one is dropped."""
    return df.groupBy(F.floor(step / size).alias("window")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("average")).where(F.col("n") == size)


def weighted(value: Column, weight: Column) -> Column:
    return F.sum(value * weight) / F.nullif(F.sum(weight), F.lit(0.0))


def perplexity(loss: Column, tokens: Column, clamp: float = 20.0) -> Column:
    """exp of the token-weighted mean loss, which is held at ``clamp``."""
    return F.exp(F.least(weighted(loss, tokens), F.lit(clamp)))


def batch_perplexity(loss: Column) -> Column:
    """exp of the plain mean of batch losses."""
    return F.exp(F.avg(loss))


def accuracy(predicted: Column, target: Column, ignore: int = -100) -> Column:
    """Share of right tokens among those not ignored; 0 without any."""
    counted = target != ignore
    return F.coalesce(F.count_if(counted & (predicted == target)) / F.nullif(F.count_if(counted), F.lit(0)), F.lit(0.0))


def micro(predicted: Column, target: Column) -> list[Column]:
    """Aggregates over rows of two string sets: hits, predicted, wanted, precision and recall (0 without any)."""
    hits, p, t = F.sum(F.size(F.array_intersect(predicted, target))), F.sum(F.size(predicted)), F.sum(F.size(target))
    ratio = lambda n: F.coalesce(hits / F.nullif(n, F.lit(0)), F.lit(0.0))
    return [hits.cast("long").alias("hits"), p.cast("long").alias("predicted"), t.cast("long").alias("wanted"), ratio(p).alias("precision"), ratio(t).alias("recall")]


def misses(df: DataFrame, predicted: str, target: str, ordinal: str, most: int = 20) -> DataFrame:
    """(ordinal, missing, extra) of the ``most`` first rows whose sets differ."""
    rows = df.select(ordinal, F.array_except(target, predicted).alias("missing"), F.array_except(predicted, target).alias("extra"))
    return rows.where("size(missing) > 0 or size(extra) > 0").orderBy(ordinal).limit(most)


def histogram(df: DataFrame, value: Column) -> DataFrame:
    """(value, n) for each whole number from 0 to the largest, zeros included. The numbers are made in tasks, a range each."""
    counted = df.groupBy(value.cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    most = counted.agg(F.max("value")).first()[0]
    grid = df.sparkSession.range(0 if most is None else most + 1).withColumnRenamed("id", "value")
    return grid.join(counted, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def argmax(scores: Column) -> Column:
    """The place, from 0, of the first largest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def meets(result: dict[str, Column], targets: dict[str, float], lower_is_better: tuple[str, ...] = ("perplexity", "loss")) -> Column:
    """Whether every target is met; a metric that is missing or null doesn't meet its target."""
    out = F.lit(True)
    for name, target in targets.items():
        value = result.get(name, F.lit(None).cast("double"))
        out = out & F.coalesce(value <= target if name in lower_is_better else value >= target, F.lit(False))
    return out


def training_memory_mb(parameters: int, batch: int, block: int, layers: int, heads: int, width: int) -> int:
    """Whole MiB: 12 bytes a parameter, 4 for each cell of the attention maps, 8 for each activation of each layer."""
    per_token = layers * (heads * block * 4 + width * 8)
    return (parameters * 12 + batch * block * per_token) // (1 << 20)


def steps_per_epoch(samples: Column, batch: int) -> Column:
    return F.ceil(samples / batch)
