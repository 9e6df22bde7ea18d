"""Dialogues in long form (sample, turn, role, text) and as formatted samples.

Roles are usr, agent and system; an agent's text is wrapped in <bos> and <eos>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse, rstrip

#: The role names of corpora and of prompts.
ROLES = {"user": "usr", "assistant": "agent", "system": "system"}


def roles(df: DataFrame, role: str = "role") -> DataFrame:
    named = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return df.withColumn(role, F.coalesce(F.try_element_at(named, F.col(role)), F.col(role)))


def turns(df: DataFrame, sample: str = "conv_id") -> DataFrame:
    """(sample, system, turns): the system text (empty without one) and the valid turns (usr or agent, not blank, collapsed) in order."""
    item = F.struct("turn", "role", collapse(F.col("text")).alias("text"))
    out = df.groupBy(sample).agg(
        F.coalesce(F.max_by(F.when(F.col("role") == "system", F.col("text")), F.when(F.col("role") == "system", -F.col("turn"))), F.lit("")).alias("system"),
        F.array_sort(F.collect_list(F.when(F.col("role").isin("usr", "agent") & (collapse(F.col("text")) != ""), item))).alias("turns"),
    )
    return out


def valid(df: DataFrame) -> DataFrame:
    """Samples of two turns or more with an agent's."""
    return df.where((F.size("turns") >= 2) & F.exists("turns", lambda t: t.role == "agent"))


def line(role: Column, text: Column) -> Column:
    text = rstrip(text)
    return F.when(role == "agent", F.concat(F.lit("<agent>: <bos>"), text, F.lit("<eos>"))).otherwise(F.concat(F.lit("<"), role, F.lit(">: "), text))


def formatted(system: Column, items: Column) -> Column:
    """A dialogue as text: the system line, always there, then a line for each turn."""
    lines = F.transform(items, lambda t: line(t.role, t.text))
    return F.array_join(F.concat(F.array(F.concat(F.lit("<system>: "), rstrip(system))), lines), "\n")


def prompt_completion(df: DataFrame, sample: str = "conv_id") -> DataFrame:
    """(sample, prompt, completion): the last agent turn, and all that stands before it; without an agent turn the whole and an empty completion."""
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t.role == "agent", i)))
    before = F.when(F.isnull(last), F.col("turns")).otherwise(F.slice("turns", 1, F.coalesce(last, F.lit(0))))
    reply = F.when(F.isnull(last), F.lit("")).otherwise(F.get("turns", F.coalesce(last, F.lit(0))).text)
    return df.select(sample, formatted(F.col("system"), before).alias("prompt"), F.concat(F.lit("<agent>: <bos>"), rstrip(reply), F.lit("<eos>")).alias("completion"))


def role_runs(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Consecutive rows of one role merged: (keys, run, role, text). usr rows are joined by a space, agent rows by a new line.

    A leading agent run and what follows the last agent run are dropped; samples
    that are left with fewer than two runs or no agent are dropped.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = df.withColumn("_c", F.when(F.col("role") == F.lag("role").over(w), 0).otherwise(1)).withColumn("run", F.sum("_c").over(w).cast("long"))
    merged = changed.groupBy(*keys, "run").agg(F.max("role").alias("role"), F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("_t"))
    texts = F.transform("_t", lambda x: x.text)
    merged = merged.withColumn("text", F.when(F.col("role") == "usr", collapse(F.array_join(texts, "\n"))).otherwise(F.array_join(texts, "\n"))).drop("_t")
    whole = Window.partitionBy(*keys)
    last = F.max(F.when(F.col("role") == "agent", F.col("run"))).over(whole)
    kept = merged.withColumn("_last", last).where((F.col("run") <= F.col("_last")) & ~((F.col("run") == 1) & (F.col("role") == "agent")))
    kept = kept.withColumns({"_n": F.count(F.lit(1)).over(whole), "_a": F.max((F.col("role") == "agent").cast("int")).over(whole)})
    return kept.where("_n >= 2 and _a = 1").drop("_last", "_n", "_a")


def perspectives(df: DataFrame, dialogue: str, speaker: str, order: list[str]) -> DataFrame:
    """Each dialogue once for each of its speakers as target: that speaker's rows are the agent's, the others are usr."""
    targets = df.select(F.col(dialogue).alias("_d"), F.col(speaker).alias("target")).distinct()
    both = df.join(targets, F.col(dialogue) == F.col("_d")).drop("_d")
    return both.withColumn("role", F.when(F.col(speaker) == F.col("target"), "agent").otherwise("usr"))


def parity(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Roles by place: even rows of a sample are usr, odd rows agent."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", (F.row_number().over(w) - 1).cast("long")).withColumn("role", F.when(F.col("position") % 2 == 0, "usr").otherwise("agent"))


def sessions(df: DataFrame, keys: list[str], order: list[str], starts: Column) -> DataFrame:
    """session: how many rows so far, this one included, start a session."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("session", F.sum(starts.cast("int")).over(w).cast("long"))


def history(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The last k rows of each sample; k = 0 keeps none."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def segments(items: Column, system: Column) -> Column:
    """A sample as segments (text, predict): predicted are an agent's <bos>, text and <eos>."""
    piece = lambda text, predict=False: F.struct(text.alias("text"), F.lit(predict).alias("predict"))
    head = F.array(piece(F.lit("<bos>")), piece(F.lit("<system>")), piece(F.lit(": ")), piece(rstrip(system)))

    def of(t: Column) -> Column:
        text = rstrip(t.text)
        start = [piece(F.lit("\n")), piece(F.concat(F.lit("<"), t.role, F.lit(">"))), piece(F.lit(": "))]
        agent = F.array(*start, piece(F.lit("<bos>"), True), piece(text, True), piece(F.lit("<eos>"), True))
        return F.when(t.role == "agent", agent).otherwise(F.array(*start, piece(text)))

    return F.concat(head, F.flatten(F.transform(items, of)))
