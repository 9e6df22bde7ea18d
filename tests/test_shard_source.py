"""Token shards written and read by the data source, by value and byte."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.sources import shard_source
from corpusloom.sources.shard_source import shards, write_shards

SCHEMA = "name string, sample_index long, tokens array<long>"


def some_samples(n):
    rng = random.Random(2)
    rows = [(rng.choice(["hot", "hot", "hot", "wiki", "é b"]), i, [rng.randrange(1 << 32) for _ in range(rng.choice([0, 1, 3, 40]))]) for i in range(n)]
    return [*rows, ("wiki", n, None), ("only", 5, []), ("only", 9, [4294967295])]


def by_name(rows):
    out = {}
    for name, i, tokens in sorted(rows, key=lambda r: (r[0], r[1])):
        out.setdefault(name, []).append((i, tokens or []))
    return out


@pytest.mark.parametrize("partitions", [1, 6])
def test_round_trip(spark, tmp_path, partitions):
    rows = some_samples(600)
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    write_shards(df, str(tmp_path), part_tokens=500)
    names = sorted(os.listdir(tmp_path))
    assert not [n for n in names if n.startswith("_")] and sum(n.startswith("hot-") for n in names) > 20
    for name, samples in by_name(rows).items():
        stems = sorted(n[:-4] for n in names if n.startswith(f"{name}-") and n.endswith(".idx"))
        ids = np.concatenate([np.fromfile(tmp_path / f"{s}.bin", "<u4") for s in stems])
        assert ids.tolist() == [t for _, tokens in samples for t in tokens]
        meta = [json.loads((tmp_path / f"{s}.meta").read_text()) for s in stems]
        assert sum(m["sample_count"] for m in meta) == len(samples) and sum(m["token_count"] for m in meta) == len(ids)
        for s in stems:  # an offset for each sample, empty ones, too
            assert len(np.fromfile(tmp_path / f"{s}.idx", "<u8")) == json.loads((tmp_path / f"{s}.meta").read_text())["sample_count"]
    for task_tokens in (1, 100, 1 << 20):
        back = shards(spark, str(tmp_path), task_tokens)
        got = sorted(((r.name, r.sample_index, r.tokens) for r in back.collect()))
        by = {}
        for name, _, tokens in got:
            by.setdefault(name.rsplit("-", 1)[0], []).append(tokens)
        assert by == {n: [t for _, t in s if t] for n, s in by_name(rows).items()}
    assert shards(spark, str(tmp_path), 100).rdd.getNumPartitions() > shards(spark, str(tmp_path), 1 << 20).rdd.getNumPartitions()


def test_filters_reach_the_files(spark, tmp_path):
    write_shards(spark.createDataFrame(some_samples(300), SCHEMA), str(tmp_path), part_tokens=1000)
    every = {(r.name, r.sample_index): (r.start, r.end, r.tokens) for r in shards(spark, str(tmp_path)).collect()}
    name, i = sorted(every)[len(every) // 2]
    one = shards(spark, str(tmp_path), 50).where((F.col("name") == name) & (F.col("sample_index") == i))
    assert [(r.start, r.end, r.tokens) for r in one.collect()] == [every[name, i]] and one.rdd.getNumPartitions() == 1
    few = shards(spark, str(tmp_path), 50).where(F.col("name").isin(name, "only-00000") & (F.col("sample_index") > 2) & (F.col("sample_index") <= 9))
    assert {(r.name, r.sample_index) for r in few.collect()} == {k for k in every if k[0] in (name, "only-00000") and 2 < k[1] <= 9}
    reader = shard_source.ShardReader(str(tmp_path), 1 << 20)
    left = list(reader.pushFilters([shard_source.EqualTo(("name",), name), shard_source.GreaterThan(("end",), 3), shard_source.LessThan(("sample_index",), i + 1), shard_source.GreaterThanOrEqual(("sample_index",), i)]))
    assert [type(f) for f in left] == [shard_source.GreaterThan]
    assert [(p.name, p.low, p.high) for p in reader.partitions()] == [(name, i, i + 1)]
    (tmp_path / f"{name}.bin").unlink()
    with pytest.raises(Exception, match="FileNotFoundError"):
        shards(spark, str(tmp_path)).collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    good = spark.createDataFrame(some_samples(50), SCHEMA)
    write_shards(good, str(tmp_path))
    before = {n: (tmp_path / n).read_bytes() for n in os.listdir(tmp_path)}
    bad = spark.createDataFrame([("a", 1, [1, 2]), ("wiki", 2, [1 << 32])], SCHEMA)
    with pytest.raises(Exception, match="32 bits"):
        write_shards(bad, str(tmp_path))
    assert {n: (tmp_path / n).read_bytes() for n in os.listdir(tmp_path)} == before
    write_shards(spark.createDataFrame([("a", 1, [1, 2])], SCHEMA), str(tmp_path), mode="overwrite")
    assert sorted(os.listdir(tmp_path)) == ["a-00000.bin", "a-00000.idx", "a-00000.meta"]
    write_shards(spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert [(r.name, r.tokens) for r in shards(spark, str(tmp_path)).collect()] == [("a-00000", [1, 2])]
    with pytest.raises(Exception, match="no file name"):
        write_shards(spark.createDataFrame([("a/b", 1, [1, 2])], SCHEMA), str(tmp_path))


def test_an_index_that_does_not_fit(spark, tmp_path):
    np.array([0, 9, 4], "<u8").tofile(tmp_path / "x.idx")
    np.arange(10, dtype="<u4").tofile(tmp_path / "x.bin")
    with pytest.raises(Exception, match="doesn't fit"):
        shards(spark, str(tmp_path)).collect()
    empty = tmp_path / "empty"
    empty.mkdir()
    assert shards(spark, str(empty)).count() == 0
