"""Random orders and draws that are the same for any partitioning: by keyed functions of row numbers and ids, without a global sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ROUNDS = 6
#: Steps that a number may need to come back below n; chains outside are shorter than the square root of n, and each step goes on with a chance of one in that many.
_STEPS = 40


def permuted(index: Column, n: Column, seed: int) -> Column:
    """The place of ``index`` (0 to n - 1) in a random order of n numbers: a bijection that each row reckons by itself.

    A Feistel network over pairs (l, r) of numbers below a and b, the least with a * b >= n that are nearly equal: each round adds a keyed hash of one
    part to the other, modulo its bound. What falls on n or above is sent through again. Null index or n, and an index outside, give null.
    """
    n = n.cast("long")
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.ceil(n / a).cast("long")

    def rounds(x: Column) -> Column:
        def turn(s: Column, i: Column) -> Column:
            bound = F.when(i % 2 == 0, a).otherwise(b)
            return F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.xxhash64(F.lit(seed), i, s["r"]) % bound, bound).alias("r"))

        start = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))
        return F.aggregate(F.array(*map(F.lit, range(_ROUNDS))), start, turn, lambda s: s["l"] + a * s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), rounds(index.cast("long")), lambda x, _: F.when(x < n, x).otherwise(rounds(x)))
    return F.when((index >= 0) & (index < n), walked)


def random_order(df: DataFrame, seed: int, index: str = "index", out: str = "place") -> DataFrame:
    """``df`` (with gapless numbers from 0 as ``index``, see corpus.with_index()) and each row's place in a random order."""
    size = df.agg(F.count("*").alias("_n"))
    return df.crossJoin(F.broadcast(size)).withColumn(out, permuted(F.col(index), F.col("_n"), seed)).drop("_n")  # one row


def draw_key(weight: Column, ident: Column, seed: int) -> Column:
    """An exponential variate with the rate ``weight``, from a hash of seed and id; null for weights that aren't above 0. The k least are a weighted draw without replacement."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), ident), 11)
    return F.when(weight > 0, -F.log((bits.cast("double") + 0.5) / float(1 << 53)) / weight)


def weighted_draw(df: DataFrame, k: int, weight: str, ident: str, seed: int, keys: Sequence[str] = ()) -> DataFrame:
    """``k`` rows (of each ``keys``) drawn without replacement, the chance of a row to be next in proportion to its weight; all rows above weight 0 where there are fewer.

    Rows with a null id or a weight that is null or not above 0 aren't drawn; equal keys go by id. Each task keeps
    the k least of what it reads before anything is shuffled, so a hot group costs no more than others.
    """
    keyed = df.withColumn("_key", draw_key(F.col(weight).cast("double"), F.col(ident), seed)).where(F.col("_key").isNotNull() & F.col(ident).isNotNull())
    if not keys:
        return keyed.orderBy("_key", ident).limit(k).drop("_key")
    order = Window.partitionBy(*keys).orderBy("_key", ident)
    return keyed.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k).drop("_key", "_rank")
