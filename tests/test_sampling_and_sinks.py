"""Sampling, prompts, sinks and stream packing on hand-made rows."""

import json

from pyspark.sql import functions as F

from corpusloom.functions import sampling
from corpusloom.operators import corpus, synth
from corpusloom.sources import sinks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_top_k_and_softmax(spark):
    scores = F.array(*[F.lit(float(x)) for x in (1, 3, 3, 2, 3)])
    assert one(spark, sampling.top_k(scores, 2)) == [None, 3.0, 3.0, None, 3.0]
    assert one(spark, sampling.top_k(scores, 2, ties=False)) == [None, 3.0, 3.0, None, None]
    assert one(spark, sampling.top_k(scores, 9)) == [1.0, 3.0, 3.0, 2.0, 3.0]
    p = one(spark, sampling.softmax(F.array(F.lit(1000.0), F.lit(1000.0), F.lit(None).cast("double"))))
    assert p == [0.5, 0.5, 0.0]


def test_choose(spark):
    weights = F.array(F.lit(0.0), F.lit(1.0), F.lit(3.0))
    assert [one(spark, sampling.choose(weights, F.lit(u))) for u in (0.0, 0.2, 0.25, 0.99, 1.0)] == [1, 1, 2, 2, 2]
    assert one(spark, sampling.choose(F.array().cast("array<double>"), F.lit(0.5))) is None


def test_prompts(spark):
    assert one(spark, sampling.assistant_prompt(F.lit("hi"))) == "<usr>: hi\n<agent>:"
    assert one(spark, sampling.assistant_prompt(F.lit("a\n<x>: hi"))) == "a\n<x>: hi"
    history = F.array(F.struct(F.lit("a").alias("user"), F.lit("b").alias("agent")))
    assert one(spark, sampling.chat_prompt(history, F.lit("c"))) == "<usr>: a\n<agent>: b\n<usr>: c\n<agent>:"
    assert one(spark, sampling.trim_reply(F.lit(" yes \nUser: no\n<usr>: x"))) == "yes"
    assert one(spark, sampling.trim_reply(F.lit("yes\n<usr>: x\nUser: no"))) == "yes"
    assert one(spark, sampling.trim_reply(F.lit(" all of it "))) == "all of it"


def test_split_family(spark):
    rows = spark.createDataFrame([("training", "x"), ("subset", "livechat"), ("subset", "x"), ("dev", "x"), ("tests", "x")], "split string, source string")
    got = lambda wanted: [r.split for r in rows.where(sampling.split_matches(F.col("split"), F.col("source"), wanted)).collect()]
    assert got("train") == ["training", "subset"] and got("valid") == ["dev"] and got("test") == ["tests"] and got("subset") == ["subset"] * 2


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", "ä"), (3, "a", 'q"')], "ordinal long, source string, text string")
    sinks.write_jsonl(rows, str(tmp_path / "j"), "ordinal")
    lines = [json.loads(x) for f in sorted((tmp_path / "j").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x["ordinal"] for x in lines] == [1, 2, 3] and lines[1]["text"] is None
    sinks.write_catalog(rows, str(tmp_path / "c"))
    assert sorted(r.text or "" for r in spark.read.csv(str(tmp_path / "c"), header=True, escape='"').collect()) == ["", 'q"', "ä"]
    sinks.write_routed(rows, str(tmp_path / "r"), ["source"])
    assert spark.read.parquet(str(tmp_path / "r")).where("source = 'a'").count() == 2
    made = sinks.manifest(rows.union(rows), rows).first()
    assert (made.total, made.deduped_from, made.sources) == (3, 6, '{"a":2,"b":1}')
    listing = spark.createDataFrame([("r/2.txt",), ("r/10.txt",), ("r/x11.txt",)], "path string")
    assert sinks.next_report(listing).first().name == "11.txt" and sinks.next_report(listing.limit(0)).first().name == "1.txt"
    assert one(spark, sinks.catalog_dir(F.lit(3), F.lit("My Data-Set!"))) == "03_my_data_set"
    sinks.mark_complete(rows.select("source").distinct(), str(tmp_path / "m"), "h")
    assert spark.read.parquet(str(tmp_path / "m")).count() == 2
    assert sinks.first_with_rows([rows.limit(0), rows]).count() == 3


def test_chart_points(spark):
    flat = sinks.chart_points(spark.createDataFrame([(1, 5.0), (3, 5.0)], "step long, loss double")).orderBy("step").collect()
    assert [(r.x, r.y) for r in flat] == [(0.0, 0.0), (1.0, 0.0)]


def test_sample_refs_over_buckets(spark):
    rows = spark.createDataFrame([("s", i, 10 * (i // 2)) for i in range(10)], "source string, sample_index long, start long")
    got = [(r.start, r.end) for r in corpus.sample_refs(rows, F.lit(60), width=3).orderBy("sample_index").collect()]
    assert got == [(0, 10), (10, 20), (20, 30), (30, 40), (40, 60)]


def test_quantified_rules_and_renaming(spark):
    p, q = ["p"], ["q"]
    rules = synth.quantified()
    all_pq, some_p = ["forall", ["->", p, q]], ["exists", p]
    assert ["exists", q] in [c for _, _, c in synth.firings([all_pq, some_p], rules)]
    assert ["exists", q] not in [c for _, _, c in synth.firings([["exists", ["->", p, q]], some_p], rules)]
    assert synth.render(all_pq) == "forall x: (P(x) -> Q(x))" and synth.render(["of", p]) == "P(a)" and "someone" in synth.say(some_p)
    assert synth.renamed([["->", q, p], q]) == [["->", ["p"], ["q"]], ["p"]]
    made = synth.examples(spark, 100)
    counts = {r.rule: r.n for r in synth.rule_counts(made).collect()}
    assert set(counts) == {r.name for r in synth.ALL_RULES} and sum(counts.values()) > 0
    sides = synth.split_ood(made).groupBy("rules").agg(F.countDistinct("split").alias("n")).where("n > 1").count()
    assert sides == 0
