"""Large JSON files in many tasks: a prefix over the states of byte ranges, then each range from the state it starts in.

Spark's text source reads a file in ranges, cut at a separator that may stand anywhere, in strings, too. So
a range's beginning may lie in a string or not, at any depth. What a range does to both is found without knowing where it starts: whether it
has an odd number of quotes, and how brackets outside of strings change the depth, once if it starts outside and once if inside. These
summaries compose like functions, so a prefix over them, one small row for each range, gives the state at each range's start. Then every range
cuts its own text into values; what stands before its first cut and after its last is joined with its neighbours'.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.scratch import kept

_QUOTE, _BACKSLASH, _COMMA = b'"'[0], b"\\"[0], b","[0]
_BRACKET = np.zeros(256, np.int8)
_BRACKET[list(b"[{")], _BRACKET[list(b"]}")] = 1, -1
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\r\n")] = True
#: Ranges up to which their start states are broadcast, some 60 bytes each; beyond it texts are shuffled by range.
_SENT = 100_000
#: Bytes that are looked at together.
_BLOCK = 1 << 20
_DECODER = json.JSONDecoder()
_BLANK, _NEVER = " \t\r\n\ufeff", 1 << 40
#: Flags of a range's state, below its depth.
_INSIDE, _ARRAY, _CLOSED, _FIRST, _LAST, _DEPTH = 1, 2, 4, 8, 16, 5


def _outside(data: np.ndarray, inside: bool) -> np.ndarray:
    """Where ``data`` isn't in a string; a string's opening quote is in it, its closing one isn't."""
    quote = data == _QUOTE
    back = data == _BACKSLASH
    if back.any():
        # A quote after an odd number of backslashes doesn't count. Data starts after a separator, so no run goes on from before.
        at = np.arange(len(data))
        last = np.maximum.accumulate(np.where(back, -1, at))
        quote[1:] &= (at[:-1] - last[:-1]) % 2 == 0
    return (np.cumsum(quote) + inside) % 2 == 0


@dataclass
class Summary:
    """What a text does: parity of quotes; change and least value of the depth if it starts outside of strings, and if inside."""

    odd: int = 0
    change: tuple[int, int] = (0, 0)
    least: tuple[int, int] = (_NEVER, _NEVER)

    def then(self, other: Summary) -> Summary:
        """This text's summary with another one's after it; associative."""
        ends = (self.odd, 1 - self.odd)
        change = tuple(self.change[s] + other.change[ends[s]] for s in (0, 1))
        least = tuple(min(self.least[s], self.change[s] + other.least[ends[s]]) for s in (0, 1))
        return Summary(self.odd ^ other.odd, change, least)


def summary(text: bytes) -> Summary:
    data = np.frombuffer(text, np.uint8)
    outside, step = _outside(data, False), _BRACKET[data]
    depths = [np.cumsum(np.where(free, step, 0), dtype=np.int64) for free in (outside, ~outside)]
    # White space at the front has the depth before it, which counts there or, at a file's start, nowhere.
    begin = len(text) - len(text.lstrip(_BLANK.encode()))
    # The last character's state is that after it, as a closing quote counts as outside.
    return Summary(int(not outside[-1]), tuple(int(d[-1]) for d in depths), tuple(int(d[begin:].min()) if begin < len(d) else _NEVER for d in depths))


class Cutter:
    """Cuts a text, given in blocks, at the places between values: an array's commas and ends, or what is around values in a row.

    head: what stands before the first cut, if the text doesn't start a file; cuts: how many there were. The rest after the last cut stays in hand.
    """

    def __init__(self, inside: bool, depth: int, array: bool, closed: bool, first: bool) -> None:
        self.inside, self.depth, self.array, self.closed, self.cut = inside, depth, array, closed, first
        self.head, self.held = b"", []

    @property
    def rest(self) -> bytes:
        return b"".join(self.held)

    def _places(self, data: np.ndarray, outside: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end of what is before, start of what follows) of each cut."""
        step = np.diff(depth, prepend=self.depth)
        if self.array:
            at = np.flatnonzero(outside & ((data == _COMMA) & (depth == 1) | (step > 0) & (depth == 1) | (step < 0) & (depth == 0)))
            return at, at + 1
        quote = np.diff(outside.astype(np.int8), prepend=int(not self.inside))
        after = np.flatnonzero((depth == 0) & ((step < 0) | (quote > 0))) + 1
        before = np.flatnonzero((step > 0) & (depth == 1) | (quote < 0) & (depth == 0))
        space = np.flatnonzero(outside & (depth == 0) & _SPACE[data])
        ends = np.concatenate([after, before, space])
        order = np.argsort(ends, kind="stable")
        return ends[order], np.concatenate([after, before, space + 1])[order]

    def feed(self, text: bytes) -> Iterator[bytes]:
        """What is whole with this block."""
        if self.closed:
            return
        data = np.frombuffer(text, np.uint8)
        outside = _outside(data, self.inside)
        depth = self.depth + np.cumsum(np.where(outside, _BRACKET[data], 0), dtype=np.int64)
        ends, starts = self._places(data, outside, depth)
        if self.array:  # nothing counts after its end
            shut = np.flatnonzero((depth[ends] == 0) & (_BRACKET[data[ends]] < 0))
            if len(shut):
                self.closed = True
                ends, starts = ends[: shut[0] + 1], starts[: shut[0] + 1]
        at = 0
        for end, start in zip(ends.tolist(), starts.tolist(), strict=True):
            self.held.append(text[at:end])
            part, self.held, at = self.rest, [], start
            if self.cut:
                yield part
            else:
                self.head, self.cut = part, True
        if not self.closed:
            self.held.append(text[at:])
        self.inside, self.depth = not outside[-1], int(depth[-1])


def _values(text: bytes) -> Iterator[str]:
    """The values of what stands between two cuts: one, or scalars in a row. What is no value raises ValueError."""
    whole, at = text.decode().strip(_BLANK), 0
    while at < len(whole):
        value, at = _DECODER.raw_decode(whole, at)
        yield json.dumps(value, ensure_ascii=False)
        while at < len(whole) and whole[at] in " \t\r\n":
            at += 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bytes]]:
    """((path, range, ...), text): the texts of rows (value, path, range, ...) of a range, a batch's or a block's together, each with the separator after it."""
    for batch in batches:
        values, keys = batch.column(0), [batch.column(i) for i in range(1, batch.num_columns)]
        paths, ranges = keys[0].dictionary_encode().indices.to_numpy(), keys[1].to_numpy()
        size = np.cumsum(pc.binary_length(values).to_numpy()) // _BLOCK
        turns = (np.diff(ranges) != 0) | (np.diff(paths) != 0) | (np.diff(size) != 0)
        edges = [0, *(np.flatnonzero(turns) + 1).tolist(), batch.num_rows]
        for low, high in zip(edges, edges[1:], strict=False):
            if low < high:
                part = pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), values.slice(low, high - low))
                yield tuple(k[low].as_py() for k in keys), pc.binary_join(part, ",")[0].as_buffer().to_pybytes() + b","


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[list] = []
    for key, text in _blocks(batches):
        first = text[:-1].decode().lstrip(_BLANK)[:1] or None
        if rows and rows[-1][0] == key:
            rows[-1] = [key, rows[-1][1].then(summary(text)), rows[-1][2] or first]
        else:
            rows.append([key, summary(text), first])
    if rows:
        columns = zip(*((*key, s.odd, *s.change, *s.least, first) for key, s, first in rows), strict=True)
        kinds = [pa.string(), *[pa.int64()] * 6, pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "range", "odd", "out", "in", "out_least", "in_least", "first"])


def _starts(ranges: pd.DataFrame) -> pd.DataFrame:
    """The state at the start of each range of a file, by a running composition; a file that ends within a value, or closes what isn't open, is refused."""
    ranges = ranges.sort_values("range").reset_index(drop=True)
    path = ranges["path"].iloc[0]
    array = next((f for f in ranges["first"] if f), "") == "["
    so_far, states = Summary(), []
    for i, r in ranges.iterrows():
        closed = array and so_far.least[0] <= 0
        states.append(so_far.change[0] << _DEPTH | so_far.odd * _INSIDE | array * _ARRAY | closed * _CLOSED | (i == 0) * _FIRST | (i == len(ranges) - 1) * _LAST)
        so_far = so_far.then(Summary(int(r["odd"]), (int(r["out"]), int(r["in"])), (int(r["out_least"]), int(r["in_least"]))))
    if array and so_far.least[0] > 0:
        raise ValueError(f"the JSON array isn't closed: {path}")
    if not array and (so_far.odd or so_far.change[0] > 0 or so_far.least[0] < 0):
        raise ValueError(f"the JSON values don't end, or close more than they open: {path}")
    return pd.DataFrame({"path": ranges["path"], "range": ranges["range"], "state": states})


def _cut(batches: Iterator[pa.RecordBatch], edges: bool) -> Iterator[pa.RecordBatch]:
    """Of rows (value, path, range, state): the values that lie within a range, or else, for ``edges``, what is before and after its cuts."""
    key, cutter, seq = None, None, 0

    def edge() -> pa.RecordBatch:
        rest = cutter.rest[:-1] if key[2] & _LAST and cutter.rest[-1:] == b"," else cutter.rest  # no separator stands after a file's end
        row = (*key[:2], seq, cutter.cut, cutter.head.decode(), rest.decode())
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["path", "range", "n", "cut", "head", "rest"])

    for found, text in _blocks(batches):
        if found != key:
            if edges and cutter:
                yield edge()
            key, seq, state = found, 0, found[2]
            cutter = Cutter(bool(state & _INSIDE), state >> _DEPTH, bool(state & _ARRAY), bool(state & _CLOSED), bool(state & _FIRST))
        values = [v for part in cutter.feed(text) for v in _values(part)]
        if values and not edges:
            yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(values)), pa.array(range(key[1] + seq, key[1] + seq + len(values)), pa.int64()), pa.array(values)], names=["path", "place", "value"])
        seq += len(values)
    if edges and cutter:
        yield edge()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, place, text in zip(*(batch.column(c).to_pylist() for c in ("path", "place", "text")), strict=True):
            values = list(_values(text.encode()))
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(values), pa.string()), pa.array(range(place, place + len(values)), pa.int64()), pa.array(values, pa.string())], names=["path", "place", "value"])


def split_values(spark: SparkSession, folder: str, pattern: str = "*.json", sent: int = _SENT) -> DataFrame:
    """(path, place, value) of the JSON files below ``folder``: the items of an array, or values one after another with or without space between.

    place: in order within a file (not gapless), the same whatever else is read. Extra commas in an array, a byte-order mark and what follows an array's end count for nothing; what can't be parsed, and
    a file that ends too early, fail the read. Blank and empty files have no values.

    A file is read in ranges (spark.sql.files.maxPartitionBytes) by as many tasks, three times: for summaries, for values, and for those that lie across ranges. Only a
    value, and about a block of text, is held at a time. The source cuts at commas, so 2 GB at most may stand between two.
    """
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("lineSep", ",").text(folder)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    rows = read.select("value", path.alias("path"), F.col("_metadata.file_block_start").alias("range"))
    summaries = rows.mapInArrow(_summaries, "path string, range long, odd long, out long, in long, out_least long, in_least long, first string")
    states = kept(summaries.groupBy("path").applyInPandas(_starts, "path string, range long, state long"), "json-states")
    if states.count() <= sent:
        placed = rows.join(F.broadcast(states), ["path", "range"])  # rows stay in order
    else:
        order = rows.withColumn("_order", F.monotonically_increasing_id()).join(states.hint("merge"), ["path", "range"])
        placed = order.repartition("path", "range").sortWithinPartitions("path", "range", "_order")
    placed = placed.select("value", "path", "range", "state")
    whole = placed.mapInArrow(lambda b: _cut(b, False), "path string, place long, value string")
    edges = placed.mapInArrow(lambda b: _cut(b, True), "path string, range long, n long, cut boolean, head string, rest string")
    # What stands before a range's first cut goes to the last range before it that has one; the rest goes to the range itself, if it has a cut.
    before = F.last(F.when(F.col("cut"), F.struct("range", "n")), ignorenulls=True).over(Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    edges = edges.withColumn("before", before)
    own = F.when(F.col("cut"), F.struct("range", "n")).otherwise(F.col("before"))
    parts = edges.select("path", "range", F.inline(F.array(F.struct(F.col("before").alias("of"), F.col("head").alias("part")), F.struct(own.alias("of"), F.col("rest").alias("part"))))).where("part != ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "part"))), lambda p: p["part"]), "")
    across = parts.groupBy("path", "of").agg(text.alias("text")).select("path", (F.col("of.range") + F.col("of.n")).alias("place"), "text")
    return whole.unionByName(across.mapInArrow(_joined, "path string, place long, value string"))
