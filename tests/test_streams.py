"""Streams that write each batch once, packing across batches, and the rule for complete sources."""

import random

import pytest

from corpusloom.operators import corpus
from corpusloom.streaming import commits, packing

ROWS = "source string, ordinal long, ids array<long>"


class Fails:
    """Fails once after a step."""

    def __init__(self, at):
        self.at = at

    def __call__(self, step):
        if step == self.at:
            self.at = None
            raise RuntimeError(f"lost after {step}")


def feed(spark, folder, rows, schema=ROWS):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def run(start):
    """Start again until it ends well, as a cluster would."""
    for _ in range(3):
        query = start()
        try:
            query.awaitTermination()
            return
        except Exception:
            continue
    raise AssertionError("never ended well")


@pytest.mark.parametrize("at", [None, "data", "record"])
def test_a_replayed_batch_leaves_one_copy(spark, tmp_path, at):
    source, failing = str(tmp_path / "in"), Fails(at)
    stream = lambda: spark.readStream.schema("i long, s string").parquet(source)
    for part in range(2):
        feed(spark, source, [(part * 10 + k, f"x{k}") for k in range(10)], "i long, s string")
        run(lambda: commits.append_once(stream(), str(tmp_path / "out"), str(tmp_path / "check"), "h1", failing))
    log = commits.appended(spark, str(tmp_path / "out"), "h1", stream())
    assert sorted(r.i for r in log.read(spark, "data").collect()) == list(range(20))
    assert failing.at is None
    # what isn't recorded isn't read
    spark.createDataFrame([(99, "y")], "i long, s string").write.parquet(str(tmp_path / "out/data/tag=h1/batch=7"))
    assert log.read(spark, "data").count() == 20 and commits.appended(spark, str(tmp_path / "out"), "h2", stream()).read(spark, "data").count() == 0
    run(lambda: commits.append_once(stream(), str(tmp_path / "out"), str(tmp_path / "check"), "h2"))
    assert commits.appended(spark, str(tmp_path / "out"), "h2", stream()).read(spark, "data").count() == 20


@pytest.mark.parametrize(("batches", "at"), [(1, None), (3, "data"), (4, "state"), (4, "record")])
def test_packing_in_batches_equals_packing_at_once(spark, tmp_path, batches, at):
    rng = random.Random(batches)
    rows = [(rng.choice(["hot", "hot", "b", None]), i, rng.choice([None, [], [i], list(range(i, i + rng.randrange(1, 25)))])) for i in range(120)]
    rows += [("hot", 120, list(range(70)))]
    source, size, failing = str(tmp_path / "in"), 8, Fails(at)
    for k in range(batches):
        feed(spark, source, rows[k * len(rows) // batches : (k + 1) * len(rows) // batches])
        run(lambda: packing.pack_stream(spark.readStream.schema(ROWS).parquet(source), str(tmp_path / "out"), str(tmp_path / "check"), size, failing=failing))
    log = packing.packing_log(spark, str(tmp_path / "out"), size)
    got = {(r.source, r.chunk): r.ids for r in log.read(spark, "data").collect()}
    whole = corpus.chunks_of_ids(spark.createDataFrame(rows, ROWS), "ordinal", size).collect()
    assert got == {(r.source, r.chunk): r.ids for r in whole if len(r.ids) == size} and len(got) == log.read(spark, "data").count()
    rest = {r.source: (r.chunk, r.ids) for r in whole if len(r.ids) < size}
    for r in packing.tails(spark, log).collect():
        assert rest.get(r.source, (r.chunks, [])) == (r.chunks, r.tail) and len(r.tail) < size


def test_complete_sources(spark):
    files = [("a.complete", ""), ("a.meta.json", '{"tokenizer_sha256": "h", "samples": 3}'), ("b.complete", ""), ("c.meta.json", '{"tokenizer_sha256": "h"}'), ("d.complete", ""), ("d.meta.json", '{"tokenizer_sha256": "old"}')]
    files += [("e.complete", ""), ("e.meta.json", '{"tokenizer_sha'), ("f.complete", ""), ("f.meta.json", "[1]"), ("g.bin", "")]
    df = spark.createDataFrame([(p, bytearray(c.encode())) for p, c in files], "path string, content binary")
    assert [r.name for r in commits.complete_sources(df, "h").collect()] == ["a"]
    assert commits.complete_sources(df, "h", force=True).count() == 0
