"""Readers and normalisers on hand-made files and rows."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.sources import dialogues, files
from corpusloom.streaming import ingest


def test_text_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.txt").write_bytes("　zwei\xa0 ".encode() + b"\xff")
    (tmp_path / "b.txt").write_text("eins ")
    (tmp_path / "._c.txt").write_text("hidden")
    (tmp_path / "blank.txt").write_text(" \n")
    got = files.text_files(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [r.text for r in got] == ["zwei", "eins"]


def test_markdown(spark, tmp_path):
    (tmp_path / "leaf.md").write_text("```python\nx = 1\n```\n%%note\nmore%%\n` Ann B `: hi {who}\n`thatsAll` rest")
    (tmp_path / "raw.md").write_text("{missing} {who}")
    (tmp_path / "branch.md").write_text("see [[a\nb]]")
    (tmp_path / "data.md").write_text("skipped")
    got = {r.path.split("/")[-1]: r.text for r in files.markdown_leaves(spark, str(tmp_path), {"who": "you"}).collect()}
    assert got == {"leaf.md": "<Ann B>: hi you", "raw.md": "{missing} {who}"}


def test_json_layouts(spark, tmp_path):
    (tmp_path / "arr.json").write_text(' [{"a": 1}, ,{"a": 2},]')
    (tmp_path / "stream.json").write_text('{"a": 3}{"a":\n4}\n{"a": 5}')
    got = [json.loads(r.value)["a"] for r in files.json_values(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert got == [1, 2, 3, 4, 5]
    (tmp_path / "bad.json").write_text('[{"a": 1}')
    with pytest.raises(Exception, match="isn't closed"):
        files.json_values(spark, str(tmp_path)).collect()


def test_json_lines_and_csv(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert [json.loads(r.value)["a"] for r in files.json_lines(spark, str(tmp_path)).orderBy("ordinal").collect()] == [1, 2]
    (tmp_path / "bad.jsonl").write_text("{\n")
    with pytest.raises(Exception, match="(?i)malformed|json"):
        files.json_lines(spark, str(tmp_path)).collect()
    (tmp_path / "c.csv").write_text('﻿id,text\n1,"a ""b""\nc"\n', encoding="utf-8")
    assert files.csv_rows(spark, str(tmp_path / "c.csv")).first().asDict() == {"id": "1", "text": 'a "b"\nc'}


def test_archives_and_shards(spark, tmp_path):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("in/a.txt", "x")
        z.writestr("../evil.txt", "y")
    (tmp_path / "z.zip").write_bytes(raw.getvalue())
    assert [(r.member, bytes(r.content)) for r in files.archive_members(spark, str(tmp_path / "z.zip")).collect()] == [("in/a.txt", b"x")]
    shard = tmp_path / "shards"
    shard.mkdir()
    np.array([5, 6, 7, 4294967295], "<u4").tofile(shard / "s.bin")
    np.array([0, 2, 2], "<u8").tofile(shard / "s.idx")
    got = files.token_shards(spark, str(shard)).orderBy("sample_index").collect()
    assert [(r.sample_index, r.start, r.end, r.tokens) for r in got] == [(0, 0, 2, [5, 6]), (2, 2, 4, [7, 4294967295])]
    np.array([0], "<u8").tofile(shard / "lost.idx")
    with pytest.raises(Exception, match="lost.bin"):
        files.token_shards(spark, str(shard)).collect()


def test_missing_files(spark):
    listing = spark.createDataFrame([("a", 1), ("b", 2), ("b.aria2", 1), ("c", 9)], "path string, length long")
    expected = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "x")], "path string, bytes string")
    assert sorted(r.path for r in files.missing_files(listing, expected).collect()) == ["b", "c", "d"]


def _turns(row):
    return [(t.role, t.text) for t in row.turns]


def test_dailydialog(spark):
    rows = spark.createDataFrame([(0, None, [("user", " a "), ("system", "b"), ("user", " ")]), (1, "dev", [("user", "x")])], "ordinal long, data_split string, turns array<struct<speaker: string, utterance: string>>")
    got = dialogues.dailydialog(rows).collect()
    assert [(r.id, _turns(r)) for r in got] == [("dailydialog-train-0", [("usr", "a"), ("agent", "b")])]
    lines = spark.createDataFrame([("test", 3, "a __eou__ b __eou__ c __eou__", "4 9")], "split string, line long, text string, emotions string")
    r = dialogues.dailydialog_lines(lines).first()
    assert _turns(r) == [("usr", "a"), ("agent", "b"), ("usr", "c")] and r.emotions == ["happiness", "unknown", "unknown"]


def test_personachat(spark):
    rows = [("train", 0, ["a", "b", "c"], ["p 1", " "], ["x", "y"]), ("train", 1, ["a"], None, ["z"]), ("train", 2, ["a", "b"], None, None)]
    got = dialogues.personachat(spark.createDataFrame(rows, "split string, ordinal long, history array<string>, personality array<string>, candidates array<string>")).orderBy("id").collect()
    assert [r.id for r in got] == ["personachat-train-0", "personachat-train-2"]
    assert _turns(got[0]) == [("usr", "a"), ("agent", "b"), ("usr", "c"), ("agent", "y")] and got[0].system.endswith("Persona:\n- p 1")
    lines = ["1 your persona: I ski.", "2 hi\thello", "noline", "3 only", "1 your persona: none", "1 your persona: You?", "2 a\tb\tc", "3 partner's persona: x"]
    got = dialogues.parlai(spark.createDataFrame([("train", i, t) for i, t in enumerate(lines)], "split string, line long, text string")).orderBy("id").collect()
    assert [(r.id, _turns(r)) for r in got] == [("personachat-train-0", [("usr", "hi"), ("agent", "hello")]), ("personachat-train-1", [("usr", "a"), ("agent", "b")])]
    assert got[1].system.endswith("- You?")
    # Conversations over several buckets of lines, with gaps between the lines.
    far = [("train", 50_000 * i, f"{i % 3 + 1} q{i}\ta{i}") for i in range(30)]
    got = dialogues.parlai(spark.createDataFrame(far, "split string, line long, text string")).collect()
    assert {r.id: [t for _, t in _turns(r)] for r in got} == {f"personachat-train-{k}": [x for i in range(3 * k, 3 * k + 3) for x in (f"q{i}", f"a{i}")] for k in range(10)}


def test_livechat_and_naturalconv(spark):
    pairs = spark.createDataFrame([("s", 0, ["u", "a"]), ("s", 1, ["u"]), ("t", 0, ["u", " "])], "streamer string, ordinal long, pair array<string>")
    profiles = spark.createDataFrame([("s", '{"age": 3}')], "streamer string, profile string")
    lines = spark.createDataFrame([("s", [str(i) for i in range(12)])], "streamer string, lines array<string>")
    r = dialogues.livechat(pairs, profiles, lines).collect()
    assert len(r) == 1 and r[0].system.endswith('Basic profile: {"age": 3}\nText profile:\n0\n1\n2\n3\n4\n5\n6\n7')
    rows = spark.createDataFrame([(0, "d1", ["a", "b"]), (1, None, ["a", "", "c"])], "ordinal long, dialog_id string, content array<string>")
    splits = spark.createDataFrame([(0, "train", "d1"), (2, "test", "d1")], "rank int, split string, dialog_id string")
    assert [(r.id, r.split) for r in dialogues.naturalconv(rows, splits).orderBy("id").collect()] == [("naturalconv-1", "train"), ("naturalconv-d1", "test")]


def test_cped(spark):
    names = "TV_ID Dialogue_ID Utterance_ID Speaker Gender Age Neuroticism Extraversion Openness Agreeableness Conscientiousness Scene Utterance".split()
    said = [("u1", "A", "hi"), ("u2", "B", "yo"), ("u3", "B", "B here"), ("u5", "C", "end"), ("u4", "A", "ok"), ("u6", "", "?")]
    rows = [(i, "tv", "d", u, s, "f" if s == "A" else "", "", "", "", "", "", "", "home", t) for i, (u, s, t) in enumerate(said)]
    df = spark.createDataFrame(rows, ["ordinal", *names])
    got = {r.id: r for r in dialogues.cped(df, "train").collect()}
    assert set(got) == {"cped-train-d-B", "cped-train-d-A", "cped-train-d-C", "cped-train-d-"}
    assert _turns(got["cped-train-d-B"]) == [("usr", "A: hi"), ("agent", "B: yo\nB: B here")]
    assert _turns(got["cped-train-d-A"]) == [("usr", "B: yo B: B here"), ("agent", "A: ok")]
    assert got["cped-train-d-A"].system.endswith('Target speaker: A.\nTarget speaker profile: {"gender": "f"}\nConversation conditions: scene=home.')
    hidden = {r.id: r for r in dialogues.cped(df, "train", hide=True, names=["B", "B here"]).collect()}
    assert "B" not in hidden["cped-train-d-A"].turns[0].text


def test_logic_records(spark):
    r = dialogues.folio(spark.createDataFrame([(0, ["a.", " "], "c", "True")], "ordinal long, premises array<string>, conclusion string, label string"), "folio", "dev").first()
    assert r.id == "folio-dev-0" and r.prompt == "Context:\na.\n\nQuestion:\nDoes the conclusion follow from the premises? Conclusion: c\n\nOptions:\nTrue\nFalse\nUncertain\n\nAnswer:"
    rows = [("x/dev.json", 0, None, "c", "q", ["1", "2"], "A"), ("x", 1, "k", "c", "q", None, None)]
    got = dialogues.choices(spark.createDataFrame(rows, "path string, ordinal long, id string, context string, question string, options array<string>, answer string"), "determlr").collect()
    assert [(r.id, r.split) for r in got] == [("determlr-dev-0", "dev")]
    got = dialogues.proofs(spark.createDataFrame([(0, "s", "q", "pf", "T"), (1, "s", "q", "", "F"), (2, "s", "", "p", "T")], "ordinal long, story string, question string, proof string, label string"), "pfolio").orderBy("id").collect()
    assert [(r.task, r.completion) for r in got] == [("proof_generation", "pf\nT"), ("logical_reasoning_choice", "F")]


def test_ingestion_takes_files_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    run = lambda tag="h": ingest.ingest_text(spark, str(source), str(tmp_path / "out"), str(tmp_path / "cp"), tag).awaitTermination()
    (source / "a.txt").write_text("one\n\n two ")
    run()
    run()
    (source / "b.txt").write_text("three")
    run()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "three", "two"]
    run("other")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    done = spark.createDataFrame([("a", "h")], "name string, tokenizer_hash string")
    rows = spark.createDataFrame([("a", "h"), ("a", "g"), ("b", "h")], "name string, tokenizer_hash string")
    assert ingest.pending(rows, done, ["name", "tokenizer_hash"]).count() == 2
