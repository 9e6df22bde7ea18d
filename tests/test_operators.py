"""Operators on hand-made rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text
from corpusloom.operators import batching, corpus, dialogue, jsontext, logic, metrics, synth, tokens

WHITE = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]))


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("c", WHITE)
def test_white_space_is_pythons(spark, c):
    raw = f"{c}a{c}{c}b{c}"
    assert one(spark, text.strip(F.lit(raw))) == raw.strip()
    assert one(spark, text.collapse(F.lit(raw))) == " ".join(raw.split())


def test_text_functions(spark):
    assert one(spark, text.sorted_json([("b", F.lit('x"y')), ("a", F.lit("1")), ("c", F.lit("")), ("d", F.lit(None).cast("string"))])) == '{"a": "1", "b": "x\\"y"}'
    assert one(spark, text.first_filled(F.lit(None).cast("string"), F.lit(""), F.lit("z"))) == "z"
    assert one(spark, text.safe_stem(F.lit("a b/ü-1.x"))) == "a_b_ü-1_x"
    assert one(spark, text.gib(F.lit(3 << 29))) == "1.5000G"


def test_split_and_index_edges(spark):
    df = spark.createDataFrame([(i * 1000,) for i in range(250)], "k long")
    got = {r.k: r.split for r in corpus.split_tail(df, "k", 0.01).collect()}
    assert [k for k, v in sorted(got.items()) if v == "valid"] == [248000, 249000]
    assert corpus.split_tail(df.limit(1), "k", 0.5).first().split == "train"
    assert corpus.split_tail(df, "k", 0).where("split = 'valid'").count() == 0
    assert corpus.with_index(df, "k", width=7000).where("index * 1000 != k").count() == 0
    assert corpus.with_index(df.limit(0), "k").count() == 0


def test_packing_conserves_tokens(spark):
    rows = [(i, "s" if i % 3 else None, list(range(i % 7))) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, source string, ids array<int>")
    packed = corpus.pack_ids(df, "k", 10)
    for source in ("s", None):
        stream = [x for _, s, ids in rows if s == source for x in ids]
        chunks = {r.chunk: r.ids for r in packed.where(F.col("source").eqNullSafe(source)).collect()}
        assert [chunks[i] for i in sorted(chunks)] == [stream[i : i + 10] for i in range(0, len(stream) - 9, 10)]


def test_dedupe_is_idempotent(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "k long, t string")
    once = corpus.dedupe(df, ["t"], "k")
    assert sorted(r.k for r in once.collect()) == [1, 2, 4]
    assert sorted(r.k for r in corpus.dedupe(once, ["t"], "k").collect()) == [1, 2, 4]


def test_role_runs_merge_and_trim(spark):
    rows = [(1, 0, "agent", "hi"), (1, 1, "usr", "a"), (1, 2, "usr", "b"), (1, 3, "agent", "c"), (1, 4, "agent", "d"), (1, 5, "usr", "e"), (2, 0, "usr", "x"), (3, 0, "agent", "y")]
    got = dialogue.role_runs(spark.createDataFrame(rows, "c long, t long, role string, text string"), ["c"], ["t"]).orderBy("c", "run").collect()
    assert [(r.c, r.role, r.text) for r in got] == [(1, "usr", "a b"), (1, "agent", "c\nd")]


def test_format_and_prompt(spark):
    rows = [(1, 0, "system", "S  "), (1, 1, "usr", " a  b "), (1, 2, "agent", "c"), (1, 3, "usr", " "), (1, 4, "usr", "d"), (2, 0, "usr", "x")]
    samples = dialogue.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    text_ = {r.conv_id: r.x for r in samples.select("conv_id", dialogue.formatted(F.col("system"), F.col("turns")).alias("x")).collect()}
    assert text_ == {1: "<system>: S\n<usr>: a b\n<agent>: <bos>c<eos>\n<usr>: d", 2: "<system>: \n<usr>: x"}
    split = {r.conv_id: (r.prompt, r.completion) for r in dialogue.prompt_completion(samples).collect()}
    assert split[1] == ("<system>: S\n<usr>: a b", "<agent>: <bos>c<eos>")
    assert split[2] == ("<system>: \n<usr>: x", "<agent>: <bos><eos>")
    assert [r.conv_id for r in dialogue.valid(samples).collect()] == [1]


def test_batches(spark):
    df = spark.createDataFrame([(0, 1, [1, 2, 3, 4]), (0, 2, [5, 6])], "batch_id long, k long, t array<int>")
    assert [(r.x, r.y) for r in batching.shift(df, "t").orderBy("k").collect()] == [([1], [2]), ([5], [6])]
    padded = batching.pad(df.withColumn("l", F.col("t")), "t", "l", 2).orderBy("k").collect()
    assert [(r.x, r.y) for r in padded] == [([2, 3], [3, 4]), ([5, 0], [6, -100])]
    assert one(spark, batching.strides(F.lit(12), 4)) == [0, 4]
    assert one(spark, batching.strides(F.lit(5), 4)) == []


def test_logic_options_and_reply(spark):
    options = F.array(F.lit("red"), F.lit("blue"))
    assert [one(spark, logic.selected_option(F.lit(a), options)) for a in ("A", "b.)", "0", "2", "9", "blu", "z")] == ["red", "blue", "red", "blue", "", "blue", ""]
    meta = F.create_map(F.lit("PROOF"), F.lit("p1"), F.lit("premises-FOL"), F.lit("P(a)"))
    assert one(spark, logic.build_reply(F.lit("B"), meta, options)) == "Reasoning:\np1\n\nFormal logic:\npremises-FOL:\nP(a)\n\nAnswer:\nB\nSelected option: blue"
    assert one(spark, logic.build_reply(F.lit("see p1"), F.create_map(F.lit("proof"), F.lit("p1")), options)) == "see p1"
    assert one(spark, logic.build_prompt(F.lit(""), F.lit("q"))) == "Question:\nq\n\nAnswer:"


def test_symbols(spark):
    entities, predicates = logic.symbols(F.lit("forall x (Dog(x) -> likes(x, rex)) & Cat(tom) & True & Rex"))
    assert one(spark, entities) == ["rex", "tom"]
    assert one(spark, predicates) == ["Cat", "Dog", "likes"]
    assert one(spark, logic.formal_text(F.lit("a\npremises-FOL:\nP(a)\n\nAnswer:\nx"))) == "P(a)"
    assert one(spark, logic.years(F.lit("in 1984 and 2101, 1999x"))) == ["year1984"]


def test_collect_text(spark):
    assert jsontext.text_of({"answer": " b ", "question": "a", "n": 5}) == "a\nb"
    assert jsontext.text_of({"foo": "ab", "bar": "c", "n": 5, "x": None, "nested": {"text": "t"}}) == "ab\nt"
    assert jsontext.text_of({"messages": [{"role": "user", "content": "hi"}, {"content": ["a", "b"]}]}) == "hi\na\nb"
    df = spark.createDataFrame([('{"text": "x"}',), (None,), ("{",)], "j string")
    assert [r.t for r in df.select(jsontext.collect_text(F.col("j")).alias("t")).collect()] == ["x", None, None]


def test_tokens_match_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello world, it's 42!", "größe  éà\n\n x", "日本 語", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, text string")
    library = Tokenizer.from_file(path)
    got = df.select("k", tokens.encode(F.col("text"), path, bos=7).alias("ids")).orderBy("k").collect()
    assert [r.ids for r in got] == [[7, *library.encode(t, add_special_tokens=False).ids] for t in texts]
    back = df.select("text", tokens.decode(tokens.encode(F.col("text"), path), path).alias("back")).collect()
    assert all(r.text == r.back for r in back)
    split = pre_tokenizers.ByteLevel(add_prefix_space=False)
    pieces = {r.piece: r.n for r in tokens.pretoken_counts(df).collect()}
    want: dict[str, int] = {}
    for t in texts:
        for _, (a, b) in split.pre_tokenize_str(t):
            want[t[a:b]] = want.get(t[a:b], 0) + 1
    assert pieces == want
    assert one(spark, tokens.trim_at(F.array(*map(F.lit, [4, 5, 3, 6, 3])), [3])) == [4, 5]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1), (2, 3), (4, -100)], "p int, y int")
    assert df.agg(metrics.accuracy(F.col("p"), F.col("y")).alias("a")).first().a == 0.5
    assert df.where("false").agg(metrics.accuracy(F.col("p"), F.col("y")).alias("a")).first().a == 0.0
    assert metrics.training_memory_mb(1 << 20, 1, 1, 0, 1, 1) == 12
    assert [(r.value, r.n) for r in metrics.histogram(df, F.col("p")).orderBy("value").collect()] == [(0, 0), (1, 1), (2, 1), (3, 0), (4, 1)]


def test_synthetic_logic(spark):
    p, q = ["p"], ["q"]
    assert len(synth.RULES) == 17 and len(synth.ALL_RULES) == 17 + 2 + 17 + sum(len(r.premises) for r in synth.RULES)
    assert synth.parse("p -> ~(q or r)") == ["->", p, ["~", ["or", q, ["r"]]]] and synth.parse("~of p") == ["~", ["of", p]]
    assert ("modus ponens", [["->", p, q], p], q) in synth.firings([["->", p, q], p])
    assert ("modus tollens", [["->", p, q], ["~", q]], ["~", p]) in synth.firings([["->", p, q], ["~", q]])
    assert ("modus tollens", [["->", p, ["~", q]], q], ["~", p]) in synth.firings([["->", p, ["~", q]], q])
    assert all(name != "incorrect modus tollens" for name, _, _ in synth.firings([["->", p, q], q], synth.ALL_RULES))
    assert synth.contradicts([p, q, ["~", p]]) and not synth.contradicts([p, q])
    assert synth.contradicts([["forall", p], ["exists", ["~", p]]]) and synth.contradicts([["->", p, q], p, ["~", q]], synth.RULES)
    assert synth.problem(5) == synth.problem(5)
    for seed in range(300):
        made = synth.problem(seed)
        assert len({json.dumps(x) for x in made.premises}) == len(made.premises)
        for clause, chain in made.inferences:
            known = list(made.premises)
            for used, inference, _ in chain:
                assert all(u in known for u in used)
                known.append(inference)
            # A chain ends as soon as its clause is known.
            assert clause in known and (not chain or clause not in known[: len(made.premises) + len(chain) - 1])
        again = synth.variation(made, random.Random(seed))
        assert sorted(map(len, map(json.dumps, again.premises))) == sorted(map(len, map(json.dumps, made.premises)))
    made = synth.examples(spark, 400, variations=2).cache()
    assert made.count() == made.select("inputs").distinct().count() > 300
    assert {r.example_type[:2] for r in made.select("example_type").distinct().collect()} == {"1", "2a", "2b", "3a", "3b"}
    counts = {r.example_type: r.n for r in synth.type_counts(made).collect()}
    assert sum(counts.values()) == made.count() and counts["3a"] > counts["1"]
    assert synth.split_length(made, 2).where("(split = 'train') != (n_premises <= 2)").count() == 0
    assert synth.uncovered_rules(synth.split_iid(synth.examples(spark, 3000))).count() == 0
    share = synth.problems(spark, 2000).selectExpr("avg(int(contradiction)) as c").first().c
    assert share <= 0.12


def test_white_space_takes_linear_time(spark):
    import time

    from corpusloom.functions.text import WHITE, collapse, rstrip, strip

    white = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert len(white) == 29
    odd = [white + "a" + white + "b" + white, white, "", None, "a", "\u200b a\ufeff "]
    df = spark.createDataFrame([(t,) for t in odd], "t string").select("t", strip("t").alias("s"), rstrip("t").alias("r"), collapse("t").alias("c"))
    for r in df.collect():
        assert (r.s, r.r, r.c) == ((None, None, "") if r.t is None else (r.t.strip(), r.t.rstrip(), " ".join(r.t.split())))
    long = spark.range(1).select(F.concat(F.lit("a"), F.repeat(F.lit(" "), 1_000_000), F.lit("b")).alias("t"))
    began = time.time()
    assert long.select(F.length(strip("t")) + F.length(rstrip("t")) + F.length(collapse("t"))).first()[0] == 2_000_007
    assert time.time() - began < 10


def test_null_ordinals_are_refused(spark):
    from corpusloom.operators import corpus

    df = spark.createDataFrame([(1, "a"), (None, "b")], "o long, s string")
    with pytest.raises(Exception, match="a null o has no place"):
        corpus.with_index(df, "o").collect()


def test_numbered_by_any_columns(spark):
    from corpusloom.operators import corpus

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40), i) for i in range(500)] + [("same", 1, 1)] * 50
    df = spark.createDataFrame(rows, "s string, n int, i int").repartition(6)
    got = corpus.numbered(df, ["s", -F.col("n")], "rank").orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(550)) and sorted((r.s or "", r.n, r.i) for r in got) == sorted((s or "", n, i) for s, n, i in rows)
    assert [(r.s, r.n) for r in got] == sorted(((s, n) for s, n, _ in rows), key=lambda x: (x[0] is not None, x[0] or "", -x[1]))
    assert corpus.numbered(df.where("false"), ["s"]).count() == 0


def worker_peak_mb(run):
    """The largest resident memory of a Python worker while ``run()`` goes on."""
    import threading

    import psutil

    peak, over = [0.0], threading.Event()

    def watch():
        while not over.wait(0.05):
            for p in psutil.Process().children(recursive=True):
                try:
                    if "pyspark" in " ".join(p.cmdline()) and "java" not in p.name():
                        peak[0] = max(peak[0], p.memory_info().rss / 1e6)
                except psutil.Error:
                    pass

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        run()
    finally:
        over.set()
        thread.join()
    return peak[0]


def test_encoding_takes_portions_of_a_batch(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").coalesce(1)
    ids = tokens.encode(F.col("text"), path)
    assert worker_peak_mb(lambda: docs.select(F.size(ids).alias("n")).write.format("noop").mode("overwrite").save()) < 700
    assert worker_peak_mb(lambda: docs.select(F.md5(tokens.decode(ids, path)).alias("m")).write.format("noop").mode("overwrite").save()) < 700


def test_portions():
    import pyarrow as pa

    sizes = [tokens.AT_ONCE + 5, 0, None, 7, tokens.AT_ONCE - 7, 1, 3 * tokens.AT_ONCE, 2]
    assert list(tokens._portions(pa.array(sizes, pa.int32()))) == [(0, 1), (1, 4), (5, 1), (6, 1), (7, 1)]
    assert list(tokens._portions(pa.array([], pa.int32()))) == []


def test_encoding_of_nulls_and_empty_texts(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([(0, None), (1, ""), (2, "a b<|endoftext|>"), (3, None)], "k long, text string").coalesce(1)
    got = df.select("k", tokens.encode(F.col("text"), path).alias("ids"), tokens.decode(tokens.encode(F.col("text"), path), path).alias("back")).orderBy("k").collect()
    assert [len(r.ids) for r in got] == [0, 0, 3, 0] and got[2].ids[-1] == 50256
    assert [r.back for r in got] == ["", "", "a b<|endoftext|>", ""]
    assert df.where("false").select(tokens.encode(F.col("text"), path, 1, 2)).collect() == []
    assert tuple(df.select(tokens.decode(F.lit(None).cast("array<int>"), path).alias("t")).first()) == ("",)
