"""Corpora as rows of (source, ordinal, text): cleaning, statistics, dedupe, splits, offsets, packing, union and audit.

Order is a column, never the order of rows. Running sums go by buckets of ordinals, so
that neither the whole table nor one source has to pass through a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.sources.scratch import kept


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    """Stripped texts; null and blank ones go."""
    return df.withColumn(text, strip(F.col(text))).where(F.col(text) != "")


def running_sum(df: DataFrame, value: Column, ordinal: str, out: str, keys: Sequence[str] = (), width: int = 1 << 16, levels: int = 2) -> DataFrame:
    """``df`` with the sum of ``value`` over earlier rows of the same keys as ``out`` (0 for the first). ordinal: a unique whole number within the keys; a null one, which has no place, fails the job.

    Sums of buckets of ``width`` ordinals are summed in the same way, by buckets of buckets, before a window passes over what is left: with two levels
    one row for each width^2 ordinals. So ordinals may be as sparse as bytes of files are.
    """
    known = F.when(F.col(ordinal).isNull(), F.raise_error(F.lit(f"a null {ordinal} has no place in a running sum")).cast("double")).otherwise(F.col(ordinal))
    bucket = F.floor(known / F.lit(width))
    df = df.withColumns({"_v": value.cast("long"), "_b": bucket})
    sums = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_c")).agg(F.sum("_v").alias("_s"))
    names = [f"_k{i}" for i in range(len(keys))]
    if levels > 1:
        inner = {n: f"_l{levels}{n}" for n in [*names, "_c", "_s"]}
        sums = running_sum(sums.withColumnsRenamed(inner), F.col(inner["_s"]), inner["_c"], "_below", [inner[n] for n in names], width, levels - 1)
        base = sums.withColumnsRenamed({**{v: k for k, v in inner.items()}, "_below": "_base"}).drop("_s")
    else:
        over = Window.partitionBy(*names).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
        base = sums.withColumn("_base", F.coalesce(F.sum("_s").over(over), F.lit(0))).drop("_s")
    match = F.col("_b") == F.col("_c")
    for i, k in enumerate(keys):
        match = match & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = Window.partitionBy(*keys, "_b").orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(base, match).withColumn(out, F.col("_base") + F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return joined.drop("_v", "_b", "_c", "_base", *names)


def with_index(df: DataFrame, ordinal: str, out: str = "index", keys: Sequence[str] = (), width: int = 1 << 16) -> DataFrame:
    """Rows numbered from 0 in the order of a unique whole-number ordinal."""
    return running_sum(df, F.lit(1), ordinal, out, keys, width)


def source_stats(df: DataFrame, source: str = "source", path: Column | None = None, ordinal: str = "ordinal", text: str = "text") -> DataFrame:
    """By source: samples, characters, the longest text's length and the first path that has it."""
    size = F.length(text).cast("long")
    where = path if path is not None else F.col("path")
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.sum(size), F.lit(0)).alias("chars"),
        F.coalesce(F.max(size), F.lit(0)).alias("longest_chars"),
        F.max_by(where, F.struct(size, -F.col(ordinal))).alias("longest_path"),
    )


def corpus_stats(df: DataFrame, size: Column, path: Column, ordinal: str) -> DataFrame:
    """One row: files, tokens, the longest context, the first file that has it, and MiB at eight bytes a token, to three places."""
    return df.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.max(size), F.lit(0)).cast("long").alias("longest_context"),
        F.max_by(path, F.struct(size, -F.col(ordinal))).alias("longest_file"),
    ).withColumn("token_memory_mb", F.round(F.col("tokens") * 8 / float(1 << 20), 3))


def dedupe(df: DataFrame, keys: Sequence[str], ordinal: str) -> DataFrame:
    """The first row, by ordinal, of each key; nulls are equal to each other.

    Keys are shuffled as 128 bits of hashes, not as texts, and the smallest ordinals are found by combined minima, so a frequent key is no hot task.
    """
    # A null leaves a hash as it is, so which keys are null goes in, too.
    null = F.concat(*[F.when(F.col(k).isNull(), "1").otherwise("0") for k in keys])
    digest = {"_h": F.xxhash64(null, *keys), "_i": F.xxhash64(F.lit(7), null, *keys)}
    df = df.withColumns(digest)
    first = df.groupBy("_h", "_i").agg(F.min(ordinal).alias("_first")).withColumnsRenamed({"_h": "_h2", "_i": "_i2"})
    same = (F.col("_h") == F.col("_h2")) & (F.col("_i") == F.col("_i2")) & (F.col(ordinal) == F.col("_first"))
    return df.join(first, same, "left_semi").drop("_h", "_i")


def combined_stats(parts: Sequence[DataFrame]) -> DataFrame:
    """One row from several corpora's statistics (files, tokens, longest_context, longest_file; see corpus_stats): sums, and the longest of the first corpus that has it."""
    ranked = [df.select("files", "tokens", "longest_context", "longest_file", F.lit(i).alias("_rank")) for i, df in enumerate(parts)]
    every = ranked[0]
    for part in ranked[1:]:
        every = every.unionByName(part)
    out = every.agg(
        F.sum("files").alias("files"),
        F.sum("tokens").alias("tokens"),
        F.max("longest_context").alias("longest_context"),
        F.max_by("longest_file", F.struct("longest_context", -F.col("_rank"))).alias("longest_file"),
    )
    return out.withColumn("token_memory_mb", F.round(F.col("tokens") * 8 / float(1 << 20), 3))


def token_totals(df: DataFrame, size: Column, source: str = "source") -> DataFrame:
    """By source, and of all as a row with a null source: samples, tokens and the longest context."""
    return df.rollup(source).agg(F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.max(size), F.lit(0)).cast("long").alias("longest_context"))


def first_rows(df: DataFrame, ordinal: str, most: int | None) -> DataFrame:
    """The ``most`` first rows by ordinal (None: all); Spark takes the first of each task before it merges them."""
    return df if most is None else df.orderBy(ordinal).limit(most)


def first_rows_pending(df: DataFrame, done: DataFrame, keys: Sequence[str], ordinal: str, most: int) -> DataFrame:
    """Of the ``most`` first rows by ordinal those that aren't done: rows done already count, so a run that is taken up again ends where the first would have."""
    return first_rows(df, ordinal, most).join(done.select(*keys).distinct(), list(keys), "left_anti")


def split_tail(df: DataFrame, ordinal: str, ratio: float = 0.01) -> DataFrame:
    """split: the last max(int(n * ratio), 1 if n > 1) rows are valid, the others train; a ratio of 0 or less: all train."""
    if ratio <= 0:
        return df.withColumn("split", F.lit("train"))
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    valid = F.greatest(F.floor(F.col("_n") * F.lit(float(ratio))), F.when(F.col("_n") > 1, 1).otherwise(0))
    indexed = with_index(df, ordinal, "_i").crossJoin(F.broadcast(n))  # n is one row
    return indexed.withColumn("split", F.when(F.col("_i") >= F.col("_n") - valid, "valid").otherwise("train")).drop("_i", "_n")


def split_interval(df: DataFrame, ordinal: str, ratio: float = 0.01) -> DataFrame:
    """split where the number of rows isn't known: the last of every max(round(1 / ratio), 1) rows is valid."""
    if ratio <= 0:
        return df.withColumn("split", F.lit("train"))
    step = max(round(1.0 / ratio), 1)
    return with_index(df, ordinal, "_i").withColumn("split", F.when(F.col("_i") % step == step - 1, "valid").otherwise("train")).drop("_i")


def split_index(n: Column, ratio: float) -> Column:
    """First valid index: n less the valid count, which is at least 1 and at most n - 1; null for fewer than two rows."""
    valid = F.least(F.greatest(F.floor(n * F.lit(float(ratio))).cast("long"), F.lit(1)), n - 1)
    return F.when(n > 1, n - valid)


def numbered(df: DataFrame, order: Sequence[Column | str], out: str = "index") -> DataFrame:
    """Rows numbered from 0 in ascending order of any columns, which need be neither numbers nor unique (nulls come first, equal rows go in any order).

    Rows are sorted by ranges and written with their place in a range; a table of one row for each range says where it starts. So no task has more than a range.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns({n: F.col(c) if isinstance(c, str) else c for n, c in zip(names, order, strict=True)}).withColumn("_salt", F.monotonically_increasing_id())
    ranged = keyed.repartitionByRange(*names, "_salt").sortWithinPartitions(*names, "_salt").drop(*names, "_salt")
    placed = kept(ranged.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33)
    spans = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_place").alias("_low"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    starts = spans.select("_part", (before - F.col("_low")).alias("_shift"))
    return placed.join(starts, part == F.col("_part")).withColumn(out, F.col("_place") + F.col("_shift")).drop("_place", "_part", "_shift")


def split_tokens(n: Column, ratio: float, block: int) -> Column:
    """First valid token of a stream of n: the tail is at least block + 2 tokens and leaves as many."""
    return n - F.least(F.greatest(F.floor(n * F.lit(float(ratio))).cast("long"), F.lit(block + 2)), n - block - 2)


def offsets(df: DataFrame, size: Column, ordinal: str, source: str = "source") -> DataFrame:
    """start of each sample in its source's stream: the sizes of earlier samples."""
    return running_sum(df.withColumn("size", size.cast("long")), F.col("size"), ordinal, "start", [source])


def sample_refs(offsets_df: DataFrame, total: Column, source: str = "source", width: int = 1 << 16) -> DataFrame:
    """(source, sample_index, start, end) from start offsets: the end is the next start, the last end is ``total``; empty samples go.

    Samples go by buckets of ``width`` indexes; the last of a bucket takes its end from the next bucket that has any.
    """
    df = offsets_df.withColumn("_b", F.floor(F.col("sample_index") / width))
    heads = df.groupBy(F.col(source).alias("_s"), F.col("_b").alias("_c")).agg(F.min("start").alias("_first"))
    heads = heads.withColumn("_next", F.lead("_first").over(Window.partitionBy("_s").orderBy("_c"))).drop("_first")
    within = Window.partitionBy(source, "_b").orderBy("start", "sample_index")
    joined = df.join(heads, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_c")))
    ended = joined.withColumn("end", F.coalesce(F.lead("start").over(within), F.col("_next"), total.cast("long")))
    return ended.where("end > start").drop("_b", "_s", "_c", "_next")


def pack_fixed(df: DataFrame, ordinal: str, size: int, source: str = "source", text: str = "text") -> DataFrame:
    """(source, chunk, content): each source's texts in a row, cut into chunks of ``size`` characters; an incomplete last chunk is dropped.

    Documents are taken apart into chunk spans, never into single characters.
    """
    n = F.length(text).cast("long")
    placed = offsets(df.where(n > 0), n, ordinal, source)
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size)
    spans = placed.withColumn("chunk", F.explode(F.sequence(first, last)))
    lo = F.greatest("start", F.col("chunk") * size)
    hi = F.least(F.col("start") + F.col("size"), (F.col("chunk") + 1) * size)
    part = F.substring(F.col(text), (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int"))
    pieces = spans.select(source, "chunk", F.struct(lo.alias("at"), part.alias("part")).alias("p"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.part), "")
    return pieces.groupBy(source, "chunk").agg(joined.alias("content")).where(F.length("content") == size)


def chunks_of_ids(df: DataFrame, ordinal: str, size: int, source: str = "source", ids: str = "ids") -> DataFrame:
    """(source, chunk, ids): each source's ids in a row, cut into chunks of ``size``; the last may have fewer."""
    n = F.size(ids).cast("long")
    placed = offsets(df.where(n > 0), n, ordinal, source)
    spans = placed.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("size") - 1) / size))))
    lo = F.greatest("start", F.col("chunk") * size)
    hi = F.least(F.col("start") + F.col("size"), (F.col("chunk") + 1) * size)
    part = F.slice(F.col(ids), (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int"))
    pieces = spans.select(source, "chunk", F.struct(lo.alias("at"), part.alias("part")).alias("p"))
    return pieces.groupBy(source, "chunk").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p.part)).alias("ids"))


def pack_ids(df: DataFrame, ordinal: str, size: int, source: str = "source", ids: str = "ids") -> DataFrame:
    """pack_fixed() for arrays of token ids."""
    return chunks_of_ids(df, ordinal, size, source, ids).where(F.size("ids") == size)


def pack_audit(df: DataFrame, size: Column, length: int, source: str = "source") -> DataFrame:
    """By source: input samples and tokens, whole chunks, and tokens of the dropped tail."""
    out = df.groupBy(source).agg(F.count(F.lit(1)).alias("input_samples"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("input_tokens"))
    return out.withColumns({"sample_count": F.floor(F.col("input_tokens") / length).cast("long"), "dropped_tail": (F.col("input_tokens") % length).cast("long")})


def union_sources(members: Sequence[tuple[str, DataFrame]], only: Sequence[str] | None = None) -> DataFrame:
    """UNION ALL of (name, df with ordinal and text) in the order given: (source_rank, source, ordinal, text). Sources that aren't asked for aren't read."""
    parts = [
        df.select(F.lit(rank).alias("source_rank"), F.lit(name).alias("source"), F.col("ordinal").cast("long"), "text")
        for rank, (name, df) in enumerate(members)
        if only is None or name in only
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def union_audit(expected: DataFrame, united: DataFrame) -> DataFrame:
    """By source: expected and actual samples and what is missing. expected: (source, expected)."""
    actual = united.groupBy("source").agg(F.count(F.lit(1)).alias("actual"))
    out = expected.join(actual, "source", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return out.withColumn("missing", F.col("expected") - F.col("actual"))
