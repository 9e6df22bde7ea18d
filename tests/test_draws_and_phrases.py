"""Random orders, weighted draws, clashing clauses and phrases against brute force."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import draws, logic, phrases


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 64, 97, 1000, 1601])
def test_permutations_are_bijections(spark, n):
    df = spark.range(n).withColumnRenamed("id", "index")
    got = [sorted(r.place for r in draws.random_order(df.repartition(k), seed, "index").collect()) for k, seed in ((1, 1), (5, 2))]
    assert got == [list(range(n))] * 2
    by = [{r["index"]: r.place for r in draws.random_order(df.repartition(k), 3).collect()} for k in (1, 7)]
    assert by[0] == by[1]


def test_permutations_are_random(spark):
    n, seeds = 8, 100
    counts = Counter()
    columns = [draws.permuted(F.col("id"), F.lit(n), s).alias(f"p{s}") for s in range(seeds)]
    for r in spark.range(n).select("id", *columns).collect():
        for s in range(seeds):
            counts[r.id, r[f"p{s}"]] += 1
    expected = seeds / n
    chi2 = sum((counts[i, p] - expected) ** 2 / expected for i in range(n) for p in range(n))
    assert chi2 < 100  # 49 degrees of freedom: 0.9999 quantile is about 95
    assert spark.range(1).select(draws.permuted(F.lit(9), F.lit(8), 1).alias("x")).first().x is None


def test_weighted_draws(spark):
    rows = [(g, i, w) for g in ("a", None) for i, w in enumerate([1.0, 2.0, 4.0, 0.0, None, -1.0])]
    df = spark.createDataFrame(rows, "g string, i long, w double")
    for k in (1, 2, 9):
        got = draws.weighted_draw(df.repartition(3), k, "w", "i", 5, ["g"]).collect()
        assert Counter(r.g for r in got) == {"a": min(k, 3), None: min(k, 3)} and {r.i for r in got} <= {0, 1, 2}
    assert draws.weighted_draw(df, 2, "w", "i", 5).count() == 2
    firsts = Counter()
    one = spark.createDataFrame([(i, w) for i, w in enumerate([1.0, 2.0, 4.0, 1.0])], "i long, w double")
    keys = one.select("i", F.array(*[draws.draw_key(F.col("w"), F.col("i"), s) for s in range(1600)]).alias("k")).collect()
    for s in range(1600):
        firsts[min(keys, key=lambda r: r.k[s]).i] += 1
    chi2 = sum((firsts[i] - 1600 * w / 8) ** 2 / (1600 * w / 8) for i, w in enumerate([1, 2, 4, 1]))
    assert chi2 < 21  # 3 degrees of freedom


def test_weighted_draws_are_cut_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id", "id % 2 as g", "1.0 as w")
    plan = draws.weighted_draw(df, 3, "w", "id", 1, ["g"])._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def strip_signs(c):
    while c[0] == "~" and c[1][0] == "~":
        c = c[1][1]
    if c[0] in ("forall", "exists", "of"):
        return [c[0], strip_signs(c[1])]
    if c[0] == "~" and c[1][0] in ("forall", "exists", "of"):
        return ["~", [c[1][0], strip_signs(c[1][1])]]
    return c


def clash(p, q):
    """Whether p denies q."""
    neg = lambda c: c[1] if c[0] == "~" else ["~", c]
    if q == neg(p) and p[0] != "~":
        return True
    return p[0] == "forall" and q in [["exists", neg(p[1])], ["of", neg(p[1])], neg(["exists", p[1]]), neg(["of", p[1]])]


def test_clashes_against_all_pairs(spark):
    rng = random.Random(1)

    def some(depth=0):
        kind = rng.randrange(6 if depth < 2 else 1)
        if kind == 0:
            return [rng.choice("pq")]
        if kind == 1:
            return [rng.choice(["->", "and"]), some(depth + 1), some(depth + 1)]
        if kind < 4:
            return ["~", some(depth)] if rng.random() < 0.6 else ["~", ["~", some(depth)]]
        return [rng.choice(["forall", "forall", "exists", "of"]), some(depth + 1)]

    rows = [(rng.choice(["a", "b", None]), json.dumps(some(), indent=rng.choice([None, 1]))) for _ in range(400)]
    bad = [("a", None), ("a", "no json"), ("a", '{"x": 1}'), ("a", "")]
    got = logic.clause_clashes(spark.createDataFrame(rows + bad, "g string, clause string"), ["g"]).collect()
    found = {(r.g, r.clause, r.against) for r in got}
    stated = {g: [] for g, _ in rows}
    for g, c in rows:
        c = strip_signs(json.loads(c))
        if c not in stated[g]:
            stated[g].append(c)
    text = lambda c: json.dumps(c, separators=(",", ":"))
    want = {(g, text(p), text(q)) for g, all_ in stated.items() for p in all_ for q in all_ if clash(p, q)}
    assert found == want and len(got) == len(found) and len(want) > 20


STOPS, DENY = ("the", "of"), ("be",)


def brute_phrases(words):
    """One sentence, word by word, with a set of taken places."""
    out, taken, n = [], set(), len(words)
    light = lambda k: not words[k][1] or words[k][1] in STOPS
    k = 0
    while k < n:
        end = k
        while end < n and words[end][0] in phrases.NOMINAL and words[end][1] not in STOPS:
            end += 1
        if end - k >= 2:
            out.append(("chunk", k, end - 1, [w if t == "PROPN" else lemma for t, lemma, w in words[k:end]]))
            taken |= set(range(k, end))
        k = max(end, k + 1)
    seen_names = set()
    for k, (tag, lemma, _) in enumerate(words):
        if k in taken or light(k):
            continue
        if tag == "PROPN":
            a = b = k
            while a and words[a - 1][0] == "PROPN":
                a -= 1
            while b + 1 < n and words[b + 1][0] == "PROPN":
                b += 1
            if a not in seen_names:
                seen_names.add(a)
                out.append(("name", a, b, [w for _, _, w in words[a : b + 1]]))
        if tag in ("NOUN", "ADJ") and lemma not in DENY:
            out.append(("word", k, k, [lemma]))
        if tag == "VERB" and lemma not in DENY:
            found = []
            for j in range(k + 1, min(k + 5, n)):
                if light(j):
                    continue
                if words[j][0] in phrases.NOMINAL:
                    found.append(j)
                elif found:
                    break
            taken |= set(found)
            out.append(("object", k, found[-1], [lemma, *[words[j][1] for j in found[:3]]]) if found else ("word", k, k, [lemma]))
    return out


def test_phrases_against_a_walk(spark):
    rng = random.Random(3)
    sentences = {s: [(rng.choice(["NOUN", "ADJ", "PROPN", "NUM", "VERB", "VERB", "DET", "ADP", ""]), rng.choice(["the", "of", "be", "", "a", "b", "c", "d"]), rng.choice("XYZ")) for _ in range(rng.randrange(1, 14))] for s in range(300)}
    rows = [(s, i + 3, t or None, lemma or None, w, "clash") for s, ws in sentences.items() for i, (t, lemma, w) in enumerate(ws)]
    df = spark.createDataFrame(rows, "s long, i int, tag string, lemma string, word string, phrase string").repartition(5)
    got = phrases.phrase_spans(df, ["s"], stops=STOPS, deny=DENY).collect()
    want = [(s, kind, a + 3, b + 3, p) for s, ws in sentences.items() for kind, a, b, p in brute_phrases(ws)]
    assert sorted((r.s, r.kind, r.first, r.last, r.phrase) for r in got) == sorted(want)
    assert phrases.phrase_spans(df.where("false"), ["s"]).count() == 0
