"""Toxicity: segments against brute force, held-out accuracy, passages and odd rows."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries, toxicity

SF = "/root/testdata/sf0.1"
FILL = "the river runs past old mills and quiet farms where people grow beans barley apples plums and trade them at market".split()


def brute_segments(scores, low, high):
    """Recursion over the best segment (the first, shortest of equal ones) and what is on both sides of it."""
    best = None
    for a in range(low, high):
        for b in range(a + 1, high + 1):
            total = sum(scores[a:b])
            if total > 0 and (best is None or total > best[2]):
                best = (a, b, total)
    if best is None:
        return []
    a, b, total = best
    return brute_segments(scores, low, a) + [(a, b - 1, total)] + brute_segments(scores, b, high)


def test_segments_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        scores = [rng.choice([-7, -3.5, -2.25, -1, -0.5, 0.75, 1.5, 3, 5]) + rng.randrange(100) / 1024 for _ in range(rng.randrange(0, 28))]
        got = toxicity.maximal_segments(np.array(scores))
        want = brute_segments(scores, 0, len(scores))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


@pytest.mark.parametrize("pattern", [[1, -2], [2, -1], [1, -1.5, 3, -2], [5], [-1]])
def test_segments_take_linear_time(pattern):
    def took(n):
        scores = np.resize(np.array(pattern, float), n)
        began = time.process_time()
        toxicity.maximal_segments(scores)
        return time.process_time() - began

    took(1000)
    assert took(400_000) < 30 * took(40_000) + 0.5


def some_texts(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(FILL) for _ in range(rng.randrange(40, 160))]
        toxic = int(i % 6 == 0)
        if toxic:
            at = rng.randrange(len(words) - 12)
            for k in range(0, 12, 3):
                words[at + k] = rng.choice(["vilescum", "Dimwits", "gitface", "wormtongue"]) + rng.choice(["", "s", "ling"])
        rows.append((i, " ".join(words), toxic))
    return rows


@pytest.fixture(scope="module")
def trained(spark):
    rows = some_texts(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 300], "doc_id long, toxic int")
    return rows, docs, labels, toxicity.fit(docs.repartition(5), labels)


def test_held_out_texts_and_passages(spark, trained):
    rows, docs, labels, model = trained
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    for i, text, toxic in rows:
        assert (got[i].score >= 0.7) == bool(toxic), (i, got[i].score)
        marks = [m for m in toxicity._WORD.finditer(text) if m[0].lower().startswith(("viles", "dimwi", "gitfa", "wormt"))]
        if toxic:
            first = got[i].passages[0]
            assert text[first.start : first.end].split()[0] in {m[0] for m in marks} and first.e_value <= toxicity.E_VALUE
        else:
            assert got[i].passages == []
    again = toxicity.fit(docs.repartition(2), labels.union(labels))
    assert np.array_equal(again.toxic, model.toxic) and again.curve == pytest.approx(model.curve)


def test_two_passages_of_a_long_text_are_found(spark, trained):
    model = trained[3]
    rng = random.Random(4)
    fill = lambda n: " ".join(rng.choice(FILL) for _ in range(n))
    text = f"{fill(30_000)} vilescum DIMWITS gitface {fill(30_000)} wormtonguelings and dimwits vilescums {fill(5_000)}"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    passages = toxicity.score_toxicity(docs, model).first().passages
    assert [text[p.start : p.end] for p in passages] == ["vilescum DIMWITS gitface", "wormtonguelings and dimwits vilescums"]


def test_near_copies_count_once(spark, trained):
    rows, docs, labels, model = trained
    copies = spark.createDataFrame([(1000 + i, rows[0][1] + f" farm{i}") for i in range(40)], "doc_id long, text string")
    more = toxicity.fit(docs.union(copies), labels.union(copies.select("doc_id", F.lit(1))))
    assert abs(float(more.toxic.sum() - model.toxic.sum())) < 200


def test_curve_of_classes_far_apart():
    for clean, toxic in ((46, 6), (1000, 120), (60, 60)):
        for noise in (0, 1):
            evidence = np.array([0.0] * clean + [toxicity.CERTAIN] * toxic)
            evidence[:noise] = 21.0
            low, slope = toxicity._curve(evidence, np.array([0.0] * clean + [1.0] * toxic))
            p = 1 / (1 + np.exp(-(low + slope * np.array([0.0, toxicity.CERTAIN]))))
            assert slope > 0 and p[0] < 0.1 and p[1] >= 0.7, (clean, toxic, noise, low, slope)


def test_texts_with_a_common_line_are_ranked(spark):
    line = "they say that seven old bakers never sold one loaf before the morning bell rang\n"
    rows = [(i, line + " ".join(text.split()[:40]) + (" vilescum and dimwits" if toxic else ""), toxic) for i, text, toxic in some_texts(400, 5)]
    # near copies of one clean text, some of them with insults
    rows += [(1000 + i, rows[1][1] + (" gitface wormtongue" if i % 4 == 0 else f" farm{i}"), int(i % 4 == 0)) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 5], "doc_id long, toxic int")
    kept = {r.toxic: r.n for r in toxicity._texts(docs, labels, "doc_id", "text", 1000).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    apart = {t: len([r for r in rows if r[0] < 1000 and r[0] % 5 and r[2] == t]) for t in (0, 1)}
    assert apart[1] < kept[1] <= apart[1] + 3 and apart[0] <= kept[0] <= apart[0] + 3
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, toxicity.fit(docs, labels)).collect()}
    held = [(got[r[0]], r[2]) for r in rows if r[0] % 5 == 0]
    assert min(s for s, t in held if t) >= 0.7 > max(s for s, t in held if not t)


def test_odd_rows(spark, trained):
    _, docs, labels, model = trained
    schema = "doc_id long, text string, score double, passages int, id string, evidence int, toxic int"
    odd = [(1, None, 1.0, 1, "a", 1, 1), (2, "", 1.0, 1, "a", 1, 1), (None, "vilescum dimwits gitface", 1.0, 1, "a", 1, 1), (3, " \n", 0.0, 1, "a", 1, 0), (4, "İ vilescum İ dimwits gitface", 1.0, 1, "a", 1, 1)]
    odd += [(5, "the river " * 100_000, 0.0, 1, "a", 1, 0)] * 2
    table = spark.createDataFrame(odd, schema)
    got = toxicity.score_toxicity(table, model).collect()
    assert len(got) == len(odd) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[1].score == by[2].score == by[3].score < 0.7 and by[1].passages == [] and by[None].score > 0.7 and by[4].score > 0.7 and by[5].score < 0.7
    assert toxicity.score_toxicity(table.where("false"), model).count() == 0
    for none in (labels.where("false"), labels.where("toxic = 0"), labels.where("toxic = 1"), labels.withColumn("doc_id", F.lit(None).cast("long"))):
        assert {r.score for r in toxicity.score_toxicity(table, toxicity.fit(docs, none)).collect()} == {0.0}
    assert toxicity.fit(table, table.select("doc_id", "toxic", "text", "score")).share > 0


def test_query_on_held_out_documents(spark):
    got = queries.op13_toxicity(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got.count() == docs.count()
    marked = got.where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    caught = {r.toxic: r.p for r in marked.groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()}
    assert caught[1] >= 0.85 and caught[0] <= 0.005
    assert got.where("held_out != coalesce(crc32(cast(string(doc_id) as binary)) % 3 = 1, false)").count() == 0
