"""Token shards as a Spark data source: ``name.bin`` (unsigned 32-bit ids), ``name.idx`` (unsigned 64-bit token offsets) and ``name.meta`` (JSON), little-endian.

Reading: a shard is cut into ranges of samples that hold about the same number of tokens; cuts are found by looking up single offsets, so
planning reads a few numbers a cut, and a task reads its own part of both files. Filters on name and sample_index choose files and offsets.

Writing: rows come dealt into parts of bounded size (see write_shards()). A task writes whole parts beside the folder's files under names that readers
skip; the commit renames those of the attempts that succeeded, .meta last, and an abort removes what was written.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from corpusloom.operators.corpus import running_sum

SCHEMA = "name string, sample_index long, start long, end long, tokens array<long>"
#: Tokens of a range that is read by a task, of an Arrow batch, and of a shard part that is written.
TASK_TOKENS, BATCH_TOKENS, PART_TOKENS = 1 << 24, 1 << 18, 1 << 24
_STAGED = "_staged"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (whatever pyarrow knows: local, HDFS, object stores) and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _offsets(store: fs.FileSystem, path: str, low: int, high: int) -> np.ndarray:
    with store.open_input_file(f"{path}.idx") as f:
        return np.frombuffer(f.read_at((high - low) * 8, low * 8), "<u8").astype(np.int64)


class _Offsets:
    """The offsets of a shard as a sequence of which single ones are looked up."""

    def __init__(self, file: pa.NativeFile, size: int) -> None:
        self.file, self.size = file, size

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        return int.from_bytes(self.file.read_at(8, i * 8), "little")


@dataclass
class Range(InputPartition):
    """Samples ``low`` to ``high`` (less one) of a shard of ``samples`` samples and ``total`` tokens."""

    path: str
    name: str
    low: int
    high: int
    samples: int
    total: int


class ShardReader(DataSourceReader):
    def __init__(self, path: str, task_tokens: int) -> None:
        self.path, self.task_tokens = path, task_tokens
        self.names: set[str] | None = None
        self.low, self.high = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Names, and bounds of sample_index; the rest is left to Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("name",) and isinstance(f, (EqualTo, In)):
                wanted = {value} if isinstance(f, EqualTo) else set(value)
                self.names = wanted if self.names is None else self.names & wanted
            elif column == ("sample_index",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, value + (not isinstance(f, LessThan)))
            else:
                yield f

    def partitions(self) -> list[Range]:
        store, root = _store(self.path)
        files = {f.path: f.size for f in store.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and _STAGED not in f.path}
        found = []
        for path, size in sorted(files.items()):
            name = path.rsplit("/", 1)[-1].removesuffix(".idx")
            if not path.endswith(".idx") or self.names is not None and name not in self.names:
                continue
            stem = path.removesuffix(".idx")
            if f"{stem}.bin" not in files:
                raise FileNotFoundError(f"{stem}.bin")
            samples, total = size // 8, files[f"{stem}.bin"] // 4
            low, high = max(self.low, 0), min(self.high, samples)
            with store.open_input_file(path) as f:
                offsets = _Offsets(f, samples)
                while low < high:
                    # the first sample that starts so many tokens later, but a sample at least
                    end = min(max(bisect_left(offsets, offsets[low] + self.task_tokens, low, high), low + 1), high)
                    found.append(Range(stem, name, low, end, samples, total))
                    low = end
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no shard at all
            return
        store, _ = _store(self.path)
        edges = _offsets(store, partition.path, partition.low, min(partition.high + 1, partition.samples))
        starts, ends = edges[: partition.high - partition.low], np.append(edges[1:], partition.total)[: partition.high - partition.low]
        if len(starts) and (np.any(ends < starts) or ends[-1] > partition.total):
            raise ValueError(f"{partition.path}.idx doesn't fit its .bin")
        kept = np.flatnonzero(ends > starts)  # empty samples keep their numbers only
        # A batch has so many tokens, or one sample.
        cuts = [0, *(np.flatnonzero(np.diff(starts[kept] // BATCH_TOKENS)) + 1).tolist(), len(kept)]
        with store.open_input_file(f"{partition.path}.bin") as f:
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = kept[a:b]
                if not len(part):
                    continue
                first, last = int(starts[part[0]]), int(ends[part[-1]])
                ids = np.frombuffer(f.read_at((last - first) * 4, first * 4), "<u4").astype(np.int64)
                places = np.append(starts[part], last) - first
                tokens = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * len(part)), pa.array(part + partition.low), pa.array(starts[part]), pa.array(ends[part]), tokens], names=["name", "sample_index", "start", "end", "tokens"])


@dataclass
class Written(WriterCommitMessage):
    stems: list[tuple[str, str]]  # staged and final path, without the endings


class ShardWriter(DataSourceArrowWriter):
    """Rows (name, part, sample_index, tokens), each part whole and in order, as files of a shard for each part."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _root(self) -> tuple[fs.FileSystem, str]:
        store, root = _store(self.path)
        return store, root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = self._root()
        attempt = f"{root}/{_STAGED}-{self.job}/{uuid.uuid4().hex}"
        stems = []

        def rows() -> Iterator[tuple]:
            for batch in iterator:
                yield from zip(*(batch.column(c).to_pylist() for c in ("name", "part")), batch.column("tokens"), strict=True)

        for (name, part), group in groupby(rows(), key=lambda r: r[:2]):
            if not stems:
                store.create_dir(attempt, recursive=True)
            if "/" in name or not name:
                raise ValueError(f"no file name: {name!r}")
            staged = f"{attempt}/{len(stems)}"
            starts, total = [], 0
            with store.open_output_stream(f"{staged}.bin") as out:
                for *_, tokens in group:
                    ids = tokens.values.to_numpy(zero_copy_only=False) if tokens.is_valid else np.empty(0, np.int64)
                    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 32):
                        raise ValueError(f"{name}: ids must fit 32 bits")
                    starts.append(total)
                    total += len(ids)
                    out.write(ids.astype("<u4").tobytes())
            with store.open_output_stream(f"{staged}.idx") as out:
                out.write(np.array(starts, "<u8").tobytes())
            with store.open_output_stream(f"{staged}.meta") as out:
                out.write(json.dumps({"token_dtype": "uint32", "index_dtype": "uint64", "sample_count": len(starts), "token_count": total}).encode())
            stems.append((staged, f"{root}/{name}-{part:05d}"))
        return Written(stems)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = self._root()
        stems = [s for m in messages if m for s in m.stems]
        if self.overwrite:
            new = {final for _, final in stems}
            for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if f.is_file and f.path.endswith((".bin", ".idx", ".meta")) and f.path.rsplit(".", 1)[0] not in new:
                    store.delete_file(f.path)
        # A shard counts as complete by its .meta; a reader needs both others, of which .idx comes last.
        for ending in (".bin", ".idx", ".meta"):
            for staged, final in stems:
                store.move(staged + ending, final + ending)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = self._root()
        folder = f"{root}/{_STAGED}-{self.job}"
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


class TokenShards(DataSource):
    """format("token_shards"): option path, a folder; task_tokens, the tokens of a reading task."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ShardReader:
        return ShardReader(self.options["path"], int(self.options.get("task_tokens", TASK_TOKENS)))

    def writer(self, schema, overwrite: bool) -> ShardWriter:
        return ShardWriter(self.options["path"], overwrite)


def shards(spark: SparkSession, path: str, task_tokens: int = TASK_TOKENS) -> DataFrame:
    """(name, sample_index, start, end, tokens) of the shards below a folder.

    A sample ends where the next begins, the last at the end of the file; empty samples are left out but keep their number. An index without its
    .bin, or that doesn't fit it, fails the read. A filter on name (equal, in) opens those shards only, one on sample_index (equal, bounds) reads those samples' bytes only.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TokenShards)
    return spark.read.format("token_shards").option("path", path).option("task_tokens", task_tokens).load()


def write_shards(samples: DataFrame, path: str, name: str = "name", ordinal: str = "sample_index", tokens: str = "tokens", part_tokens: int = PART_TOKENS, mode: str = "append") -> None:
    """Samples as shards name-00000, name-00001, and so on below a folder, in order of ``ordinal`` (unique whole numbers within a name, not null).

    A part begins with each ``part_tokens`` tokens of a name, so a hot name is written by many tasks. Null and empty token lists are
    empty samples. Writing fails as a whole or not at all; a part of a name that stands there is replaced, ``overwrite`` also removes other shards.
    """
    size = F.greatest(F.size(tokens), F.lit(0))
    placed = running_sum(samples, size, ordinal, "_start", [name])
    rows = placed.select(F.col(name).cast("string").alias("name"), F.floor(F.col("_start") / part_tokens).cast("long").alias("part"), F.col(ordinal).alias("sample_index"), F.col(tokens).cast("array<bigint>").alias("tokens"))
    samples.sparkSession.dataSource.register(TokenShards)
    rows.repartition("name", "part").sortWithinPartitions("name", "part", "sample_index").write.format("token_shards").mode(mode).option("path", path).save()
