"""Phrases of tagged words: noun chunks, objects to the right of verbs, names, and what no phrase takes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The tags of words that chunks and objects are made of, and how far an object may be.
NOMINAL = ("ADJ", "NOUN", "PROPN", "NUM")
REACH, OBJECT = 4, 3


def phrase_spans(words: DataFrame, sentence: Sequence[str], place: str = "i", stops: Sequence[str] = (), deny: Sequence[str] = ()) -> DataFrame:
    """(sentence, kind, first, last, phrase) from words (sentence, i, tag, lemma, word) of any tagger; i counts from anywhere without gaps, phrase is an array.

    chunk: two nominal words or more in a row, names by their word, others by lemma. object: a verb's lemma with those of nominal words among the four
    to its right; words of no weight (an empty lemma or one of ``stops``) are passed over, another word ends an object that has begun, and three words count.
    name: the run of proper nouns around one that no phrase took. word: a noun, an adjective or a verb that is left over. Phrases come in order and the
    first takes its words, so a noun that a chunk or an earlier verb's object took isn't left over, while a chunk's words may be in an object, too.
    Words of ``stops`` begin nothing, and those of ``deny`` are no word or verb. Null tags and lemmas are others and empty ones.

    One shuffle of the words by sentence, and windows over it: verbs are never taken, so each object depends on the four words to the right alone, and
    whether a word is taken on its chunk and the four words to the left.
    """
    w = words.repartition(*sentence).withColumns({"lemma": F.coalesce("lemma", F.lit("")), "tag": F.coalesce("tag", F.lit("")), "i": F.col(place).cast("long")})
    stop = (F.col("lemma") == "") | F.col("lemma").isin(*stops)
    w = w.withColumns({"_stop": stop, "_nominal": F.col("tag").isin(*NOMINAL)})
    order = Window.partitionBy(*sentence).orderBy("i")
    # Runs: a word's place less its rank among words like it stays the same along a run.
    like = lambda flag: F.col("i") - F.row_number().over(Window.partitionBy(*sentence, flag).orderBy("i"))
    w = w.withColumn("_chunky", F.col("_nominal") & ~F.col("lemma").isin(*stops) if stops else F.col("_nominal")).withColumn("_proper", F.col("tag") == "PROPN")
    w = w.withColumns({"_chunk": F.when(F.col("_chunky"), like("_chunky")), "_run": F.when(F.col("_proper"), like("_proper"))})
    w = w.withColumn("_in_chunk", F.col("_chunky") & (F.count("*").over(Window.partitionBy(*sentence, "_chunky", "_chunk")) >= 2))

    seen = F.array(*[F.lead(F.struct("i", "lemma", "_stop", "_nominal"), k).over(order) for k in range(1, REACH + 1)])
    empty = F.struct(F.array().cast("array<struct<i:bigint,lemma:string>>").alias("took"), F.lit(False).alias("over"))

    def step(s, x):
        take = ~s["over"] & x["_nominal"] & ~x["_stop"]
        ends = ~x["_nominal"] & ~x["_stop"] & (F.size(s["took"]) > 0)
        return F.struct(F.when(take, F.concat(s["took"], F.array(F.struct(x["i"].alias("i"), x["lemma"].alias("lemma"))))).otherwise(s["took"]).alias("took"), (s["over"] | ends).alias("over"))

    verb = (F.col("tag") == "VERB") & ~F.col("_stop") & (~F.col("lemma").isin(*deny) if deny else F.lit(True))
    w = w.withColumn("_object", F.when(verb, F.aggregate(F.array_compact(seen), empty, step, lambda s: s["took"])))
    # A word is taken by an object if one of the four words before it is a verb that took it.
    before = [F.lag("_object", k).over(order) for k in range(1, REACH + 1)]
    by_object = F.lit(False)
    for took in before:
        by_object = by_object | F.coalesce(F.array_contains(F.transform(took, lambda t: t["i"]), F.col("i")), F.lit(False))
    w = w.withColumn("_free", ~F.col("_in_chunk") & ~by_object & ~F.col("_stop"))

    # Words give parts of phrases, which meet by run or place; the words already lie together by sentence, so nothing is shuffled for it.
    said = F.when(F.col("_proper"), F.col("word")).otherwise(F.col("lemma"))
    allowed = ~F.col("lemma").isin(*deny) if deny else F.lit(True)
    lone = (F.col("tag").isin("NOUN", "ADJ") & F.col("_free") & allowed) | F.coalesce(F.size("_object") == 0, F.lit(False))
    lemmas = F.concat(F.array("lemma"), F.slice(F.transform("_object", lambda t: t["lemma"]), 1, OBJECT))

    def part(kind, of, last, texts, counts):
        return F.struct(F.lit(kind).alias("kind"), of.alias("_of"), F.col("i").alias("_first"), last.cast("long").alias("_last"), texts.alias("_texts"), counts.alias("_counts"))

    here, always = F.col("i"), F.lit(True)
    parts = F.array(
        F.when(F.col("_in_chunk"), part("chunk", F.col("_chunk"), here, F.array(said), always)),
        F.when(F.size("_object") > 0, part("object", here, F.element_at("_object", -1)["i"], lemmas, always)),
        F.when(F.col("_proper"), part("name", F.col("_run"), here, F.array("word"), F.col("_free"))),
        F.when(lone, part("word", here, here, F.array("lemma"), always)),
    )
    each = w.select(*sentence, F.inline(F.array_compact(parts)))
    texts = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_first", "_texts"))), lambda x: x["_texts"]))
    found = each.groupBy(*sentence, "kind", "_of").agg(F.min("_first").alias("first"), F.max("_last").alias("last"), texts.alias("phrase"), F.max("_counts").alias("_counts"))
    return found.where("_counts").drop("_of", "_counts")
