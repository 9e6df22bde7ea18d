"""Mixed corpora, records, sample files, shards and collectors on written files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import corpus, metrics, tokens
from corpusloom.sources import dialogues, files, samples, sinks


def put(folder, name, content):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content, encoding="utf-8")


def test_mixed_corpus(spark, tmp_path):
    put(tmp_path, "b/x.json", json.dumps([{"text": "one"}, {"content": "two"}, {"n": 3}], indent=1))
    put(tmp_path, "b/y.jsonl", '{"question": "q1", "answer": "a1"}\n\n{"text": "three"}\n')
    put(tmp_path, "a.txt", "  whole\ntext \n")
    put(tmp_path, "c.csv", 'title,text\n"t, 1",body\n')
    put(tmp_path, ".hidden.txt", "no")
    put(tmp_path, "d.bin", "no")
    rows = files.mixed_corpus(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r.text for r in rows] == ["whole\ntext", "one", "two", "q1\na1", "three", "body\nt, 1"]
    assert [r.text for r in files.mixed_corpus(spark, str(tmp_path), 2).orderBy("ordinal").collect()] == ["whole\ntext", "one"]
    assert [r.path.split("/")[-1] for r in files.first_named(spark, str(tmp_path), "x.json").collect()] == ["x.json"]
    assert files.first_named(spark, str(tmp_path), "no.json").count() == 0


def test_records_and_trees(spark, tmp_path):
    put(tmp_path, "r/a.json", '{"data": [{"i": 1}, {"i": 2}]}')
    put(tmp_path, "r/b.jsonl", '{"i": 3}\n{"i": 4}\n')
    put(tmp_path, "r/c.json", '{"samples": [], "i": 5}')
    put(tmp_path, "r/d.json", '[{"i": 6}]')
    got = [json.loads(r.value)["i"] for r in files.records(spark, f"{tmp_path}/r").orderBy("ordinal").collect()]
    assert got == [1, 2, 3, 4, 6]
    tree = {"tree": [{"path": "data/a.json", "type": "blob"}, {"path": "data/prompt.json", "type": "blob"}, {"path": "data", "type": "tree"}, {"path": "src/b.json", "type": "blob"}, {"path": "data/c.py", "type": "blob"}]}
    found = files.data_blobs(spark.createDataFrame([(json.dumps(tree),)], "value string"))
    assert [r.path for r in found.collect()] == ["data/a.json"]
    ranked = files.split_ranked(spark.createDataFrame([("x/test_a.txt",), ("x/other.txt",), ("x/train_b.txt",), ("x/valid_a.txt",), ("y/train_a.txt",)], "path string"))
    assert [r.path for r in ranked.orderBy("rank").collect()] == ["y/train_a.txt", "x/train_b.txt", "x/valid_a.txt", "x/test_a.txt", "x/other.txt"]


def test_samples(spark, tmp_path):
    rows = [
        {"id": "1", "source": "livechat", "split": "subset", "system": "s", "turns": [{"role": " usr ", "text": " hi "}, {"role": "other", "text": "x"}, {"role": "agent", "text": " "}, {"role": "agent", "text": "yo", "metadata": {"a": 1}}]},
        {"id": "2", "source": "x", "split": "test", "user": "u ", "agent": ""},
    ]
    put(tmp_path, "s/samples.jsonl", "\n".join(map(json.dumps, rows)))
    got = samples.load_samples(spark, f"{tmp_path}/s").orderBy("ordinal").collect()
    assert [[(t.role, t.text) for t in r.turns] for r in got] == [[("usr", "hi"), ("agent", "yo")], [("usr", "u")]]
    assert json.loads(got[0].turns[1].metadata) == {"a": 1}
    df = samples.load_samples(spark, f"{tmp_path}/s")
    assert samples.select(df, "train").count() == 0 and samples.select(df, "train", family=True).count() == 1 and samples.select(df, source="x").count() == 1
    placed = samples.indexed(df)
    assert files.nth(placed, 0).first().id == "1" and files.nth(placed, -1).first().id == "2" and files.nth(placed, 9).count() == 0
    put(tmp_path, "bad/samples.jsonl", '{"id": "1", "turns": 7}')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        samples.load_samples(spark, f"{tmp_path}/bad").collect()


def test_personachat_files(spark, tmp_path):
    put(tmp_path, "p/valid.json", json.dumps([{"dialogue": ["a", "b"], "persona": ["I sing."], "candidates": ["no", "c"]}, {"utterances": ["one"]}]))
    put(tmp_path, "p/train.jsonl", json.dumps({"history": ["x", "y"]}))
    put(tmp_path, "p/test_self.txt", "1 your persona: i row.\n2 hi\tho\n1 q\tr\n")
    got = dialogues.personachat_files(spark, f"{tmp_path}/p").collect()
    found = sorted((r.split, [t.text for t in r.turns], "Persona" in r.system) for r in got)
    assert found == [("test_self", ["hi", "ho"], True), ("test_self", ["q", "r"], False), ("train", ["x", "y"], False), ("valid", ["a", "b", "c"], True)]
    put(tmp_path, "l/train.txt", "1\n 2 \n")
    put(tmp_path, "l/test.txt", "2\n\n")
    lists = dialogues.split_lookup(spark, f"{tmp_path}/l").orderBy("rank", "dialog_id").collect()
    assert [(r.rank, r.split, r.dialog_id) for r in lists] == [(0, "train", "1"), (0, "train", "2"), (2, "test", "2")]


def test_logic_collectors(spark, tmp_path):
    put(tmp_path, "f/folio-train.jsonl", json.dumps({"premises": ["A.", "B."], "conclusion": "C.", "label": "True"}) + "\n" + json.dumps({"context": "X", "question": "Y?", "answer": "False"}))
    put(tmp_path, "d/dev.json", json.dumps({"examples": [{"id": 7, "context": "c", "question": "q", "options": ["a", "b"], "answer": "a"}, {"question": "q"}]}))
    put(tmp_path, "p.csv", "context,question,proof,label\nc,q,because,yes\n")
    got = dialogues.collect_logic(spark, f"{tmp_path}/f", f"{tmp_path}/d", f"{tmp_path}/p.csv").collect()
    assert sorted((r.source_rank, r.split, r.task, r.completion) for r in got) == [
        (0, "train", "first_order_logic_entailment", "False"),
        (0, "train", "first_order_logic_entailment", "True"),
        (1, "dev", "logical_reasoning_choice", "a"),
        (2, "train", "proof_generation", "because\nyes"),
    ]
    prompts = [r.prompt for r in got if r.source_rank == 0]
    assert any("A.\nB." in p and "Conclusion: C." in p for p in prompts) and any("Y?" in p and "Conclusion" not in p for p in prompts)


def test_shards(spark, tmp_path):
    rows = [("a", 0, [1, 2, 3]), ("a", 1, []), ("a", 2, [4294967295]), ("b", 0, [7, 8])]
    df = spark.createDataFrame(rows, "name string, sample_index long, tokens array<long>")
    shard = tmp_path / "shards"
    shard.mkdir()
    for r in files.legacy_shards(df).orderBy("name", "part").collect():
        for kind in ("bin", "idx"):
            with open(shard / f"{r.name}.{kind}", "ab") as f:
                f.write(bytes(r[kind]))
    back = files.token_shards(spark, str(shard))
    assert [(r.name.split("/")[-1], list(r.tokens)) for r in back.orderBy("name", "start").collect()] == [("a", [1, 2, 3]), ("a", [4294967295]), ("b", [7, 8])]
    assert np.fromfile(shard / "a.idx", "<u8").tolist() == [0, 3]
    meta = {r.name: json.loads(r.meta) for r in files.shard_meta(files.legacy_shards(df)).collect()}
    assert meta["a"] == {"token_dtype": "uint32", "index_dtype": "uint64", "sample_count": 2, "token_count": 4}
    files.write_token_shards(df.withColumnRenamed("name", "shard"), f"{tmp_path}/w")
    one = files.read_token_sample(spark, f"{tmp_path}/w", "a", 2)
    assert one.first().tokens == [4294967295]
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan and "PushedFilters: [IsNotNull(sample_index)" in plan
    flat = df.where("name = 'a'")
    sinks.write_token_stream(flat, f"{tmp_path}/flat", "sample_index", size=3)
    assert [r.ids for r in spark.read.parquet(f"{tmp_path}/flat").orderBy("chunk").collect()] == [[1, 2, 3], [4294967295]]


def test_small_ones(spark, tmp_path):
    values = [None, '"  a b "', '[" x ", "", "y"]', '{"b": 1, "a": "t"}', "3", "null"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").withColumn("j", F.parse_json("v"))
    assert [r.s for r in df.orderBy("i").select(text.stringify(F.col("j")).alias("s")).collect()] == ["", "a b", "x\ny", '{"a":"t","b":1}', "3", ""]
    assert [r.s for r in df.where("i < 3").orderBy("i").select(text.clean_value(F.col("j")).alias("s")).collect()] == ["", "a b", "x\ny"]
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(text.sorted_json([("a", F.lit("t\tab\u0001"))])) == '{"a": "t\\tab\\u0001"}'
    assert one(text.shard_prefix(F.lit("wiki/part 1.json"))) == "wiki__part_1" and one(text.shard_prefix(F.lit("a.b.txt"))) == "a_b"
    assert one(text.bullet_lists(F.array(F.lit("a")), F.array(F.lit("P"), F.lit("Q")))) == "entities:\n- a\n\npredicates:\n- P\n- Q"
    assert text.shard_folder("x/", 512) == "x/preprocess512"
    assert one(metrics.meets({"accuracy": F.lit(0.9), "perplexity": F.lit(3.0)}, {"accuracy": 0.8, "perplexity": 4.0})) is True
    assert one(metrics.meets({"accuracy": F.lit(0.9)}, {"accuracy": 0.8, "perplexity": 4.0})) is False
    words = spark.createDataFrame([("The",), (" fox ",)], "w string")
    assert [r.w for r in samples.without(words, "w", ("the",)).collect()] == [" fox "]
    alphabet = tokens.byte_alphabet()
    assert len(set(alphabet.values())) == 256 and alphabet[32] == "Ġ" and alphabet[65] == "A"
    entries = spark.createDataFrame([(1, "My Set", "d/f.json")], "index int, name string, source_file string")
    assert sinks.catalog_rows(entries, "base/").first().local_path == "base/01_my_set/f.json"
    failures = spark.createDataFrame([("b", 2), ("a", 1)], "name string, n int")
    assert sinks.report_text(failures, "Failed", ["name", "n"]).first().text == "Failed\ncount: 2\n\nname: a\nn: 1\n\nname: b\nn: 2"
    vocabulary = spark.createDataFrame([(0, "a"), (1, "b")], "id int, piece string")
    sinks.save_tokenizer(vocabulary, f"{tmp_path}/t", {"name": "x"})
    assert spark.read.json(f"{tmp_path}/t/about").first().vocab_size == 2


def test_dedupe_tells_nulls_apart(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, "a"), (3, "a", None), (4, None, None), (4, "a", None)], "k long, x string, y string")
    got = corpus.dedupe(df, ["x", "y"], "k")
    assert got.columns == df.columns and {(r.k, r.x, r.y) for r in got.collect()} == {(1, "a", None), (2, None, "a"), (4, None, None)}


def test_running_sum_with_sparse_ordinals(spark):
    ordinals = [0, 5, 70_000, 1 << 33, (1 << 33) + 1, 1 << 45, (1 << 45) + (1 << 20)]
    df = spark.createDataFrame([(k, o, i + 1) for k in ("a", None) for i, o in enumerate(ordinals)], "k string, o long, v long")
    got = corpus.running_sum(df, F.col("v"), "o", "before", ["k"]).collect()
    assert {(r.k, r.o, r.before) for r in got} == {(k, o, i * (i + 1) // 2) for k in ("a", None) for i, o in enumerate(ordinals)}
    plain = corpus.running_sum(df.where("k = 'a'"), F.col("v"), "o", "before").collect()
    assert {(r.o, r.before) for r in plain} == {(o, i * (i + 1) // 2) for i, o in enumerate(ordinals)}
