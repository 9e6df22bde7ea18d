"""Sampling from scores and distributions, and the prompts around it: Column to Column, no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip

#: Where a reply ends because another speaker begins.
MARKERS = ["\n用户：", "\n助手：", "\nUser:", "\nuser:", "\n### 用户", "\nHuman:"]


def top_k(scores: Column, k: int, ties: bool = True) -> Column:
    """Scores (array of doubles) with those outside the k largest as null. ties: scores equal to the k-th stay; else exactly k stay, the first of equal ones."""
    if ties:
        least = F.get(F.reverse(F.array_sort(scores)), F.least(F.lit(k), F.size(scores)) - 1)
        return F.transform(scores, lambda s: F.when(s >= least, s))
    ranked = F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("s"), i.alias("i"))))
    chosen = F.transform(F.slice(ranked, 1, k), lambda r: r.i)
    return F.transform(scores, lambda s, i: F.when(F.array_contains(chosen, i), s))


def softmax(scores: Column, temperature: float = 1.0) -> Column:
    """Probabilities of scores, shifted by the largest so that none overflows; null scores get 0. A temperature of 0 or less counts as 1e-6."""
    high = F.array_max(scores)
    weights = F.transform(scores, lambda s: F.coalesce(F.exp((s - high) / F.lit(max(temperature, 1e-6))), F.lit(0.0)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    return F.transform(weights, lambda w: w / total)


def choose(weights: Column, at: Column) -> Column:
    """The index whose share of the summed weights holds ``at`` (0 to 1, such as F.rand(seed)); null for no weights."""
    sums = F.aggregate(weights, F.array().cast("array<double>"), lambda acc, w: F.concat(acc, F.array(F.coalesce(F.element_at(F.concat(F.array(F.lit(0.0)), acc), -1), F.lit(0.0)) + w)))
    target = at * F.element_at(F.concat(F.array(F.lit(0.0)), sums), -1)
    below = F.size(F.filter(sums, lambda s: s <= target))
    return F.when(F.size(weights) > 0, F.least(below, F.size(weights) - 1))


def assistant_prompt(text: Column, user: str = "<usr>", agent: str = "<agent>") -> Column:
    """A user's text as a prompt for a reply; a text that has speakers already stays."""
    return F.when(text.rlike(r"(^|\n)<[^>\n]+>:"), text).otherwise(F.concat(F.lit(f"{user}: "), text, F.lit(f"\n{agent}:")))


def chat_prompt(history: Column, text: Column, user: str = "<usr>", agent: str = "<agent>") -> Column:
    """history (array of struct<user, agent>) and the new text as a prompt for a reply."""
    said = F.flatten(F.transform(history, lambda h: F.array(F.concat(F.lit(f"{user}: "), h.user), F.concat(F.lit(f"{agent}: "), h.agent))))
    return F.array_join(F.concat(said, F.array(F.concat(F.lit(f"{user}: "), text), F.lit(f"{agent}:"))), "\n")


def trim_reply(text: Column) -> Column:
    """A reply up to where another speaker begins, stripped."""
    places = [F.instr(text, m) for m in MARKERS] + [F.regexp_instr(text, F.lit(r"\n<[^>\n]+>:"))]
    first = F.array_min(F.filter(F.array(*places), lambda p: p > 0))
    return strip(F.when(F.isnull(first), text).otherwise(F.substring(text, F.lit(1), F.coalesce(first, F.lit(1)) - 1)))


def split_matches(split: Column, source: Column, wanted: str) -> Column:
    """Whether a sample's split is the wanted one or of its family."""
    exact = split == wanted
    if wanted == "train":
        return exact | split.startswith("train") | ((source == "livechat") & (split == "subset"))
    if wanted in ("valid", "validation", "dev"):
        return exact | split.startswith("valid") | (split == "dev")
    return exact | split.startswith("test") if wanted == "test" else exact
