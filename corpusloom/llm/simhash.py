"""SimHash near-duplicates by anchor-point covering.

A fingerprint's bits are dealt into parts. Anchors are the words of a covering code of a part:
the perfect Hamming code (covering radius 1) on its first 2^r - 1 bits, with the bits after them free. Two
parts that differ in ``PART_BITS`` = 2 bits or fewer have a word between them, at most one bit from either, and
the anchor next to that word lies within 1 + 1 of both. So each part is copied to
every anchor within covering radius plus that share of the threshold, and only fingerprints that meet at an anchor are
compared. P parts meet whenever the whole differs in at most 3P - 1 bits.

``EXACT`` links 64-bit fingerprints of four-word shingles at 4 or fewer differing bits with two parts: no linked pair is
missed, at 33 copies a fingerprint and 2^27 anchors a part. ``SIMILAR`` is for near-duplicates at a Jaccard
similarity of 0.8 of five-word shingles, which is 19 of 128 bits: with five parts of 25 bits pairs of
up to 14 bits always meet, the others with a probability (see README).

Groups of near copies fill anchors. An anchor of more than ``CELL`` fingerprints is dealt into cells;
a task compares a cell and hands on links that span its groups, never all pairs. What the cells' links leave apart
at an anchor is then compared with the whole anchor, in cells again, so no link between groups is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import components, free_name, written

SEED = 42
PART_BITS = 2
#: Fingerprints of an anchor that a task compares with each other.
CELL = 2048
#: Anchors with up to so many fingerprints are compared together, by column operations.
_FEW = 16
#: Hot anchors up to which the list of them goes to every task; beyond, it is joined by shuffle.
SMALL = 50_000
#: Rows and shingles that a Python worker holds at a time, and rows of (anchor, fingerprint).
_ROWS, _BLOCK, _HELD = 256, 1 << 16, 1 << 17


@dataclass(frozen=True)
class Scheme:
    """Words of a shingle, bits of a fingerprint (64 or 128), differing bits that link, and the parts: (word, first bit, bits) spans put together."""

    shingle: int
    bits: int
    max_bits: int
    parts: tuple[tuple[tuple[int, int, int], ...], ...]

    @property
    def words(self) -> list[str]:
        return [f"w{k}" for k in range(self.bits // 64)]


EXACT = Scheme(4, 64, 4, (((0, 0, 32),), ((0, 32, 32),)))
SIMILAR = Scheme(5, 128, 19, (((0, 0, 25),), ((0, 25, 25),), ((1, 0, 25),), ((1, 25, 25),), ((0, 50, 14), (1, 50, 11))))


def fingerprint(text: str | None, scheme: Scheme = EXACT) -> int:
    """The SimHash of a whole text: A-Z in lower case, words between ASCII white space, shingles with repeats.

    Fewer words than a shingle's make one shingle; no word (also null) makes zero. A bit is 1 if it is set in over
    half the shingles' hashes: XXH64, or XXH3 of 128 bits, with seed 42.
    """
    words = (text or "").encode().lower().split()
    n, size = len(words), scheme.shingle
    if not n:
        return 0
    digest = xxhash.xxh64_digest if scheme.bits == 64 else xxhash.xxh3_128_digest
    joined = b" ".join(words)
    if n < size:
        return int.from_bytes(digest(joined, SEED))
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - size + 1]
    ends = ends[size - 1 :]
    ones = np.zeros(scheme.bits, np.int64)
    for i in range(0, len(starts), _BLOCK):
        spans = zip(starts[i : i + _BLOCK].tolist(), ends[i : i + _BLOCK].tolist(), strict=True)
        hashes = np.frombuffer(b"".join([digest(joined[s:e], SEED) for s, e in spans]), np.uint8)
        ones += np.unpackbits(hashes).reshape(-1, scheme.bits).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(starts)).tobytes())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = EXACT) -> DataFrame:
    """(id, w0 ...): each row's fingerprint as signed 64-bit words, the lowest bits first. One pass, no shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                found = [fingerprint(t.as_py(), scheme) for t in part.column(1)]
                words = [pa.array(np.array([f >> 64 * k & (1 << 64) - 1 for f in found], np.uint64).view(np.int64)) for k in range(len(scheme.words))]
                yield pa.record_batch([part.column(0), *words], names=["id", *scheme.words])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(work, ", ".join(["id long", *(f"{w} long" for w in scheme.words)]))


def near_masks(width: int) -> tuple[int, list[list[int]]]:
    """(length, masks) of the code of a part of ``width`` bits: by syndrome, what to flip to reach each anchor within two bits."""
    length = (1 << (width + 1).bit_length() - 1) - 1
    free = [1 << i for i in range(length, width)]
    masks = []
    for s in range(length + 1):
        if s == 0:
            flips = [0, *free, *(x | y for x in free for y in free if x < y)]
        else:
            one = 1 << (s - 1)
            flips = [one, *(one | x for x in free)]
            flips += [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, length + 1) if i < (i ^ s)]
        masks.append(flips)
    return length, masks


def _anchors(part: Column, width: int) -> Column:
    """The anchors of a part (a long; bits from ``width`` on stay)."""
    length, masks = near_masks(width)
    syndrome = F.lit(0)
    for k in range(length.bit_length()):
        covered = sum(1 << (i - 1) for i in range(1, length + 1) if i >> k & 1)
        syndrome = syndrome + (F.bit_count(part.bitwiseAND(F.lit(covered))) % 2) * F.lit(1 << k)
    table = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in masks])
    return F.transform(F.element_at(table, (syndrome + 1).cast("int")), lambda m: part.bitwiseXOR(m))


def _at_anchors(nodes: DataFrame, scheme: Scheme) -> DataFrame:
    """(node, w0 ..., anchor): each node at every anchor in reach of one of its parts; an anchor's upper half is the part's number."""
    parts = []
    for number, spans in enumerate(scheme.parts):
        value, width = F.lit(0).cast("long"), 0
        for word, first, bits in spans:
            piece = F.shiftrightunsigned(F.col(f"w{word}"), first).bitwiseAND(F.lit((1 << bits) - 1))
            value, width = value.bitwiseOR(F.shiftleft(piece, width)), width + bits
        tag = F.lit(number << 32)
        parts.append(_anchors(value.bitwiseOR(tag), width))
    return nodes.select("node", *scheme.words, F.explode(F.concat(*parts)).alias("anchor"))


def _near(left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """Which rows of ``left`` and ``right`` (words by columns, broadcast against each other) link."""
    bits = np.bitwise_count(left[..., 0] ^ right[..., 0])
    for k in range(1, left.shape[-1]):
        bits = bits + np.bitwise_count(left[..., k] ^ right[..., k])
    return bits <= max_bits


def spanning(fps: np.ndarray, max_bits: int) -> Iterator[tuple[int, int]]:
    """Links (places in ``fps``) that span each group of linked fingerprints."""
    left = np.arange(len(fps))
    while len(left):
        front, left = [int(left[0])], left[1:]
        while front and len(left):
            i = front.pop()
            hit = _near(fps[i], fps[left], max_bits)
            found = left[hit].tolist()
            yield from ((i, j) for j in found)
            front += found
            left = left[~hit]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of about _HELD rows that hold every run of equal ``keys`` whole. A run is bounded, as cells are."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < _HELD:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(rows, np.bool_)
        for k in keys:
            column = table.column(k).to_numpy()
            last &= column == column[-1]
        cut = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut:
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows -= cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _words(table: pa.Table, scheme: Scheme) -> np.ndarray:
    return np.stack([table.column(w).to_numpy().view(np.uint64) for w in scheme.words], 1)


def _bounds(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where runs of equal ``keys`` begin, and the end."""
    fresh = np.zeros(table.num_rows, np.bool_)
    fresh[0] = True
    for k in keys:
        column = table.column(k).to_numpy()
        fresh[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(fresh), table.num_rows)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
    return pa.record_batch([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], names=["a", "b"])


def _within(scheme: Scheme) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in order of (anchor, cell): links that span each cell's groups."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["anchor", "cell"]):
            nodes, fps = table.column("node").to_numpy(), _words(table, scheme)
            bounds = _bounds(table, ["anchor", "cell"])
            sizes = np.diff(bounds)
            left, right = [], []
            # Small runs: each row with the one d places on, for all runs together.
            few = np.repeat(np.where(sizes <= _FEW, bounds[1:], 0), sizes)
            rows = np.arange(len(nodes))
            for d in range(1, _FEW):
                rows = rows[rows + d < few[rows]]
                if not len(rows):
                    break
                hit = rows[_near(fps[rows], fps[rows + d], scheme.max_bits)]
                left.append(nodes[hit])
                right.append(nodes[hit + d])
            for run in np.flatnonzero(sizes > _FEW).tolist():
                pairs = list(spanning(fps[bounds[run] : bounds[run + 1]], scheme.max_bits))
                if pairs:
                    i, j = np.array(pairs).T + bounds[run]
                    left.append(nodes[i])
                    right.append(nodes[j])
            if left:
                yield _edges(np.concatenate(left), np.concatenate(right))

    return work


def _across(scheme: Scheme) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in order of (anchor, x, y): links between the groups of rows that are ``rest`` and those of the others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches, ["anchor", "x", "y"]):
            group, fps, rest = table.column("grp").to_numpy(), _words(table, scheme), table.column("rest").to_numpy(zero_copy_only=False)
            left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            bounds = _bounds(table, ["anchor", "x", "y"]).tolist()
            for start, end in zip(bounds[:-1], bounds[1:], strict=True):
                others = start + np.flatnonzero(~rest[start:end])
                if not len(others):
                    continue
                for i in (start + np.flatnonzero(rest[start:end])).tolist():
                    hit = others[_near(fps[i], fps[others], scheme.max_bits) & (group[others] != group[i])]
                    found = np.unique(group[hit])
                    left.append(np.full(len(found), group[i]))
                    right.append(found)
            a, b = np.concatenate(left), np.concatenate(right)
            if len(a):
                yield _edges(a, b)

    return work


def linked(nodes: DataFrame, scheme: Scheme = EXACT, cell: int = CELL) -> DataFrame:
    """(node, component) of the nodes (node, w0 ...; no two with equal words) that links connect, named by their smallest node."""
    # Nodes are small but for their copies: their few partitions would be few and large tasks.
    shuffles = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = _at_anchors(nodes.repartition(shuffles, "node"), scheme)
    hot = at.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell)
    hot = written(hot, "hot")
    many = hot.count()
    listed = F.broadcast(hot) if many <= SMALL else hot.hint("merge")
    place = F.xxhash64(*scheme.words)
    if many:
        dealt = at.join(listed, "anchor", "left").withColumn("cell", F.coalesce(F.pmod(place, F.ceil(F.col("n") / cell)), F.lit(0)).cast("int")).drop("n")
    else:
        dealt = at.withColumn("cell", F.lit(0))
    sorted_ = dealt.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell")
    edges = written(sorted_.mapInArrow(_within(scheme), "a long, b long").distinct(), "edges")
    named = components(edges)
    if not many:
        return named
    # At hot anchors, what isn't in the anchor's largest group yet is compared with the whole anchor.
    members = at.join(listed.select("anchor"), "anchor").join(named, "node", "left")
    members = written(members.withColumn("grp", F.coalesce("component", "node")).drop("component", "node"), "members")
    shares = members.groupBy("anchor", "grp").agg(F.count(F.lit(1)).alias("k"))
    whole = shares.groupBy("anchor").agg(F.max_by("grp", "k").alias("main"), F.sum("k").alias("n"), (F.sum("k") - F.max("k")).alias("apart")).where("apart > 0")
    whole = written(whole, "apart")
    if whole.isEmpty():
        return named
    cells = lambda c: F.ceil(F.col(c) / cell).cast("int")
    members = members.join(F.broadcast(whole) if many <= SMALL else whole.hint("merge"), "anchor").withColumn("place", place)
    each = lambda c: F.explode(F.sequence(F.lit(0), cells(c) - 1))
    kept = ["anchor", "grp", *scheme.words]
    rest = members.where("grp != main").select(*kept, F.lit(True).alias("rest"), F.pmod("place", cells("apart")).cast("int").alias("x"), each("n").alias("y"))
    every = members.select(*kept, F.lit(False).alias("rest"), each("apart").alias("x"), F.pmod("place", cells("n")).cast("int").alias("y"))
    both = rest.unionByName(every).repartition("anchor", "x", "y").sortWithinPartitions("anchor", "x", "y")
    more = components(both.mapInArrow(_across(scheme), "a long, b long")).withColumnRenamed("node", "grp").withColumnRenamed("component", "top")
    # A node that no cell linked is its own group.
    alone = more.join(named, F.col("grp") == F.col("node"), "left_anti").select(F.col("grp").alias("node"), F.col("top").alias("component"))
    joined = named.join(more, F.col("component") == F.col("grp"), "left").select("node", F.coalesce("top", "component").alias("component"))
    return joined.unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = EXACT, cell: int = CELL) -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    fingerprint: lower-case hex digits. component_id: the smallest id that
    links reach, the row's own included; equal fingerprints count as linked.
    Null and empty texts have fingerprint zero and link like any other. Rows
    with a repeated id keep their own fingerprints; rows with a null id are
    returned with a null component unless a row with an equal fingerprint has an id, and don't link others. An empty
    table gives no rows. Other columns don't matter.

    Rows with equal fingerprints are one node, made before anything is copied
    to anchors, so a group of exact copies costs as much as one row.
    """
    words = scheme.words
    fps = written(fingerprints(docs, id_col, text_col, scheme), "fingerprints")
    nodes = written(fps.where("id is not null").groupBy(*words).agg(F.min("id").alias("node")), "nodes")
    named = written(linked(nodes, scheme, cell), "named")
    label = nodes.join(named, "node", "left").select(*words, F.coalesce("component", "node").alias("component_id"))
    out = fps.join(label, words, "left")
    digits = F.concat(*[F.lower(F.lpad(F.hex(w), 16, "0")) for w in reversed(words)])
    return out.select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scheme: Scheme = SIMILAR) -> DataFrame:
    """The rows of ``docs`` with one row of each group of near-duplicates: that with the smallest id. Columns stay.

    Rows with a null id all stay; of rows with equal ids, the first component they are
    in decides. Null and empty texts are copies of each other; an empty table gives no rows.
    """
    found = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, scheme)
    gone, key = free_name(docs, "gone"), free_name(docs, "gone_id")
    drop = found.groupBy(F.col(id_col).alias(key)).agg(F.min("component_id").alias(gone)).where(f"{gone} != {key}").drop(gone)
    return docs.join(drop, docs[id_col] == drop[key], "left_anti")
