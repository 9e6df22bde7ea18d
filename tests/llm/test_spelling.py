"""Spelling variants against all pairs of words."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest

from corpusloom.llm import spelling


def one_error(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :]


def brute(counts, factor=10):
    near = {w: [o for o in counts if one_error(w, o)] for w in counts}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), counts[form[w]] if form[w] else None) for w, n in counts.items()), key=repr)


def some_words(rng, n, letters="abé"):
    made = set()
    while len(made) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(7, 12)))
        made.add(word)
        at = rng.randrange(len(word))
        made.add(rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]]) + "")
    return {w: rng.choice([2, 3, 25, 40, 300, 4000]) for w in made if len(w) >= 7}


def test_automaton_numbers_words_and_finds_one_error():
    rng = random.Random(5)
    words = sorted(some_words(rng, 400))
    automaton = spelling.Automaton(words)
    assert len(automaton.edges) < sum(map(len, words)) / 2
    asked = words[::3] + ["a" * 7, "aaaaaab", "zzzzzzzz"]
    for word in asked:
        for exact in (0, 3, len(word) // 2):
            want = {i for i, w in enumerate(words) if one_error(word, w) and (w[:exact] == word[:exact])}
            got = automaton.near(word, exact)
            assert got <= {i for i, w in enumerate(words) if one_error(word, w)} and want <= got
    assert [automaton._rest(automaton.start, w, 0, 0) for w in words] == list(range(len(words)))


@pytest.mark.parametrize("block", [spelling.BLOCK, 12])
def test_variants_against_all_pairs(spark, block):
    """A small block cuts halves further, down to single letters."""
    rng = random.Random(block)
    counts = some_words(rng, 500) | {"prefix" + "x" * i: 3**i for i in range(2, 12)} | {"q" * 40: 2, "q" * 41: 30, "q" * 42: 400}
    words = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5)
    got = spelling.variants(words, block=block).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=repr) == brute(counts)


def test_spelling_groups(spark):
    rows = [(i, " ".join(["Spelling"] * 12 + ["speling", "Naïvetés×", "short"]), "w", 1) for i in range(60)]
    rows += [(None, "spellings SPELLINGS", "w", 1), (7, None, "w", 1), (8, "", "w", 1), (9, "a" * 50_000 + " " + "a" * 50_001, "w", 1), (9, "a" * 50_000 + " " + "a" * 50_001, "w", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    for slips in (None, 31):
        counts = Counter()
        for doc, text, *_ in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
                run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
                h = crc32(f"{doc}:{run}".encode())
                if slips and doc is not None and h % slips == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 7:
                    counts[run] += 1
        counts = {w: n for w, n in counts.items() if n >= 2}
        got = spelling.spelling_groups(docs, slips=slips).select("word", "form", "root", "n", "n_near", "form_n").collect()
        assert sorted(map(tuple, got), key=repr) == brute(counts)
        assert {"speling", "naïvetés×"} <= set(counts)
    assert spelling.spelling_groups(docs.where("false")).count() == 0
