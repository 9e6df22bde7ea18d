"""Sample files: typed JSON lines, legacy records, filters, and the rows of a data set by place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.sampling import split_matches
from corpusloom.functions.text import collapse, strip
from corpusloom.operators.corpus import with_index
from corpusloom.sources.files import json_lines

TURNS = "array<struct<role: string, text: string, metadata: string>>"
DIALOGUE = f"id string, source string, split string, system string, turns {TURNS}, user string, agent string, metadata string"
LOGIC = "id string, source string, split string, task string, prompt string, completion string, metadata string"


def normal_turns(turns: Column, user: Column, agent: Column) -> Column:
    """Turns of usr and agent with text, stripped; a record without turns has those of its user and agent fields."""
    kept = F.filter(F.transform(turns, lambda t: F.struct(strip(t.role).alias("role"), strip(t.text).alias("text"), t.metadata.alias("metadata"))), lambda t: t.role.isin("usr", "agent") & (F.coalesce(t.text, F.lit("")) != ""))
    said = lambda role, c: F.when(F.coalesce(strip(c), F.lit("")) != "", F.struct(F.lit(role).alias("role"), strip(c).alias("text"), F.lit(None).cast("string").alias("metadata")))
    return F.when(turns.isNotNull(), kept).otherwise(F.array_compact(F.array(said("usr", user), said("agent", agent))))


def load_samples(spark: SparkSession, path: str, kind: str = "dialogue", pattern: str = "*.jsonl") -> DataFrame:
    """Typed samples of JSON-lines files with ordinal: dialogues (id, source, split, system, turns, metadata) or logic (id, source, split, task, prompt, completion, metadata).

    A malformed line or a field of another type fails the read. Objects in metadata stay JSON text.
    """
    schema = DIALOGUE if kind == "dialogue" else LOGIC
    lines = json_lines(spark, path, pattern)
    rows = lines.select("ordinal", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("ordinal", "r.*")
    if kind == "dialogue":
        rows = rows.withColumn("turns", normal_turns(F.col("turns"), F.col("user"), F.col("agent"))).drop("user", "agent")
    return rows


def select(samples: DataFrame, split: str | None = None, source: str | None = None, task: str | None = None, family: bool = False) -> DataFrame:
    """Samples with that split, source and task; with ``family`` a split stands for its family (see split_matches)."""
    if split is not None:
        samples = samples.where(split_matches(F.col("split"), F.col("source"), split) if family else F.col("split") == split)
    for name, value in (("source", source), ("task", task)):
        samples = samples if value is None else samples.where(F.col(name) == value)
    return samples


def indexed(samples: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Samples with index, their place from 0; see files.nth() for one of them."""
    return with_index(samples, ordinal)


def tagged_runs(tokens: DataFrame, group: str, ordinal: str, tag: str, word: str, least: int = 2) -> DataFrame:
    """(group, tag, first, words, phrase): maximal runs of words with the same tag, of ``least`` words or more, from any tagger's rows. A gap in ordinals ends a run."""
    from pyspark.sql import Window

    by_tag = Window.partitionBy(group, tag).orderBy(ordinal)
    runs = tokens.withColumn("_g", F.col(ordinal) - F.row_number().over(by_tag))
    out = runs.groupBy(group, tag, "_g").agg(F.min(ordinal).alias("first"), F.count(F.lit(1)).alias("words"), F.array_sort(F.collect_list(F.struct(ordinal, word))).alias("_w"))
    return out.where(F.col("words") >= least).select(group, tag, "first", "words", F.array_join(F.transform("_w", lambda w: w[word]), " ").alias("phrase"))


def without(df: DataFrame, column: str, words: tuple[str, ...]) -> DataFrame:
    """Rows whose collapsed, small-lettered value isn't one of a fixed list of words."""
    return df.where(~F.lower(collapse(F.col(column))).isin(*words)) if words else df


#: The beginnings of names in clauses, by what they name.
PREFIXES = {"proposition": "pqrstuw", "functor": "PQRSTUW", "constant": "abcdefghij"}
OPERATORS = ("~", "->", "<->", "and", "or", "forall", "exists")


def clause_part(name: Column) -> Column:
    """What a name in a clause is: operator, proposition, functor, constant, variable ("var x" also), else null."""
    out = F.when(name.isin(*OPERATORS), "operator").when(name.startswith("var "), "variable")
    for kind, letters in PREFIXES.items():
        out = out.when(F.substring(name, 1, 1).isin(*letters), kind)
    return out


def masked_preview(tokens: Column, labels: Column, most: int = 200, before: int = 12, ignore: int = -100) -> Column:
    """The ids to show of a sample: from ``before`` ids before the first labelled one to ``most`` after it; the first ``most`` without labels."""
    first = F.array_min(F.filter(F.transform(labels, lambda x, i: F.when(x != ignore, i)), F.isnotnull))
    start = F.greatest(F.lit(0), first - before)
    return F.when(first.isNull(), F.slice(tokens, 1, most)).otherwise(F.slice(tokens, start + 1, first + most - start))


def first_of_each(df: DataFrame, group: str, ordinal: str, value: str) -> DataFrame:
    """(group, value, blank): the first value of each group, and whether it shows nothing: a look at each shard."""
    first = df.groupBy(group).agg(F.min_by(value, ordinal).alias(value))
    return first.withColumn("blank", collapse(F.col(value)) == "")


def corpus_files(listing: DataFrame, catalogue: DataFrame, target_bytes: int) -> DataFrame:
    """One row: files, bytes, catalogue rows, and whether the bytes reach a target."""
    found = listing.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
    return found.crossJoin(catalogue.agg(F.count(F.lit(1)).alias("catalogue_rows"))).withColumn("target_reached", F.col("bytes") >= target_bytes)  # two tables of one row


def refilled(batches: DataFrame, size: int, seed: int, batch: str = "batch_id", position: str = "position") -> DataFrame:
    """Batches (see batching.positions) whose short last one is filled with rows drawn at random, again and again the same for a seed: those first by a hash of the row."""
    last = batches.groupBy(batch).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc(batch)).limit(1).where(F.col("_n") < size)
    key = F.xxhash64(F.lit(seed), batch, position)
    drawn = batches.withColumn("_k", key).orderBy("_k", batch, position).limit(size)  # at most a batch of rows
    placed = with_index(drawn.withColumn("_o", F.monotonically_increasing_id()), "_o", "_i").drop("_o", "_k", batch, position)
    fill = placed.crossJoin(F.broadcast(last.withColumnRenamed(batch, "_b"))).where(F.col("_i") + F.col("_n") < size)  # last is one row
    return batches.unionByName(fill.withColumns({batch: F.col("_b"), position: F.col("_i") + F.col("_n")}).drop("_b", "_i", "_n"))
