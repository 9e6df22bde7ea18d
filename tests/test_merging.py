"""This engine's merging against the tokenizer library's ids."""

import random

import numpy as np
import pytest

from corpusloom.operators import merging, tokens

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def ranks(path):
    return merging.Ranks.load(path)


def some_pieces(rng, n):
    letters = ["a", "b", "e", "th", "in", " ", "é", "漢", "\n", "1", "_", "'s", "aaaa", "ing", "🙂"]
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(n)] + ["a" * k for k in range(1, 70)] + ["", "ab" * 300, "x" * 5000]


def test_rounds_equal_one_by_one(ranks, monkeypatch):
    pieces = some_pieces(random.Random(1), 400)
    by_rounds = [r.as_py() for r in merging.merge_pieces(pieces, ranks)]
    for long in (0, 10_000):
        monkeypatch.setattr(merging, "LONG", long)
        assert [r.as_py() for r in merging.merge_pieces(pieces, ranks)] == by_rounds
    # the definition: the leftmost pair of least rank, one merge at a time
    table = {int(p): (int(r), int(m)) for p, r, m in zip(ranks.pairs, ranks.rank, ranks.merged, strict=True)}
    for piece, got in zip(pieces[:150], by_rounds, strict=False):
        ids = ranks.bytes[np.frombuffer(piece.encode(), np.uint8)].tolist()
        while True:
            found = min(((*table[a * ranks.size + b], i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if a * ranks.size + b in table), key=lambda x: (x[0], x[2]), default=None)
            if not found:
                break
            ids[found[2] : found[2] + 2] = [found[1]]
        assert ids == got


def test_ids_equal_the_library(spark, path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "  a\n\n b  "), (-4, "don't \t x 12 漢字🙂'll"), (-5, "z" * 3000 + " " + "ab" * 2000)]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids for r in merging.encode_pieces(docs.repartition(6), path, "doc_id").collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.doc_id] == library.encode(r.text or "", add_special_tokens=False).ids, r.doc_id
    assert merging.encode_pieces(docs.where("false"), path, "doc_id").count() == 0
    plan = merging.encode_pieces(docs, path, "doc_id")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and tokens.PATTERN[:5] in plan
