"""Byte-pair encoding by this engine's own merging: by rounds over the distinct pieces of a batch.

A piece's neighbouring pair of lowest rank is merged wherever it stands in it, again and again until no pair has a rank. A round does that
for all pieces of a batch at once: symbols stand in one array, pairs are looked up in the sorted table of ranks, and each piece's least rank
is a minimum over its stretch. Nothing is shuffled, and no row is made of a token.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.tokens import PATTERN, byte_alphabet

#: Pieces of more bytes are merged one by one with a heap, as rounds would each pass over all of a long one.
LONG = 64
#: Pieces that are merged together.
_TOGETHER = 20_000
_NONE = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Ranks:
    """Pairs of symbols as sorted numbers (left * size + right), each with its rank and what it becomes; the symbol of each byte. All as large as the vocabulary."""

    pairs: np.ndarray
    rank: np.ndarray
    merged: np.ndarray
    bytes: np.ndarray
    size: int

    @classmethod
    def load(cls, path: str) -> Ranks:
        """The table of a byte-level tokenizer file; merges may be pairs or texts with a space between."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, size = model["vocab"], max(model["vocab"].values()) + 1
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        numbers = np.array([vocab[a] * size + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # Of a pair that stands twice the last rank counts.
        numbers, last = np.unique(numbers[::-1], return_index=True)
        rank = len(pairs) - 1 - last
        alphabet = byte_alphabet()
        return cls(numbers, rank.astype(np.int64), merged[rank], np.array([vocab[alphabet[b]] for b in range(256)], np.int64), size)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place in the table of each pair, or -1."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[at] == wanted, at, -1) if len(self.pairs) else np.full(len(wanted), -1)


def merge_rounds(symbols: np.ndarray, starts: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all pieces after merging, and where each piece starts. ``starts``: where pieces, none of them empty, start now."""
    piece = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(symbols))))
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbols):
        place = np.full(len(symbols), -1)
        place[:-1] = ranks.of(symbols[:-1], symbols[1:])
        place[:-1][piece[:-1] != piece[1:]] = -1
        rank = np.where(place >= 0, ranks.rank[place], _NONE) if len(ranks.rank) else np.full(len(symbols), _NONE)
        first = np.flatnonzero(np.diff(piece, prepend=-1))
        least = np.minimum.reduceat(rank, first)
        # What has no pair left is done; the rounds go on with the others.
        over = np.repeat(least == _NONE, np.diff(np.append(first, len(symbols))))
        if over.any():
            done.append((piece[over], symbols[over]))
            symbols, piece, place, rank = symbols[~over], piece[~over], place[~over], rank[~over]
            least = least[least != _NONE]
            if not len(symbols):
                break
            first = np.flatnonzero(np.diff(piece, prepend=-1))
        hit = rank == np.repeat(least, np.diff(np.append(first, len(symbols))))
        # In a row of equal symbols hits overlap; from the left every second one counts.
        at = np.flatnonzero(hit)
        begins = np.diff(at, prepend=-2) != 1
        begins |= np.diff(piece[at], prepend=-1) != 0
        turn = np.arange(len(at)) - np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))
        at = at[turn % 2 == 0]
        symbols[at] = ranks.merged[place[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, piece = symbols[keep], piece[keep]
    if not done:
        return symbols, starts
    pieces, found = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(pieces, kind="stable")
    counts = np.bincount(pieces, minlength=len(starts))
    return found[order], np.cumsum(counts) - counts


def merge_long(symbols: list[int], ranks: Ranks) -> list[int]:
    """The same for one piece, with a heap of (rank, place): n log n steps for n symbols."""
    after, before = list(range(1, len(symbols) + 1)), list(range(-1, len(symbols) - 1))

    def look(pairs: list[int]) -> None:
        places = ranks.of(np.array([symbols[i] for i in pairs]), np.array([symbols[after[i]] for i in pairs])).tolist()
        for i, p in zip(pairs, places, strict=True):
            if p >= 0:
                heapq.heappush(heap, (int(ranks.rank[p]), i, symbols[i], symbols[after[i]], int(ranks.merged[p])))

    heap: list[tuple[int, int, int, int, int]] = []
    if len(symbols) > 1:
        look(list(range(len(symbols) - 1)))
    while heap:
        _, i, left, right, merged = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != left or j >= len(symbols) or symbols[j] != right:
            continue  # one of them has been merged meanwhile
        symbols[i], symbols[j], after[i] = merged, -1, after[j]
        if after[j] < len(symbols):
            before[after[j]] = i
        look([k for k in (before[i], i) if k >= 0 and after[k] < len(symbols)])
    return [s for s in symbols if s >= 0]


def merge_pieces(pieces: list[str], ranks: Ranks) -> pa.ListArray:
    """The ids of each piece."""
    raw = [p.encode() for p in pieces]
    ids: list[np.ndarray] = [np.empty(0, np.int64)] * len(raw)
    short = [i for i, b in enumerate(raw) if 0 < len(b) <= LONG]
    for low in range(0, len(short), _TOGETHER):
        part = short[low : low + _TOGETHER]
        sizes = np.array([len(raw[i]) for i in part])
        symbols = ranks.bytes[np.frombuffer(b"".join(raw[i] for i in part), np.uint8)]
        found, starts = merge_rounds(symbols, np.cumsum(sizes) - sizes, ranks)
        for i, one in zip(part, np.split(found, starts[1:]), strict=True):
            ids[i] = one
    for i, b in enumerate(raw):
        if len(b) > LONG:
            ids[i] = np.array(merge_long(ranks.bytes[np.frombuffer(b, np.uint8)].tolist(), ranks), np.int64)
    offsets = np.cumsum([0, *(len(x) for x in ids)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int64)]).astype(np.int32)))


def encode_pieces(df: DataFrame, path: str, ordinal: str, text: str = "text", rows: int = 256) -> DataFrame:
    """(ordinal, ids): texts encoded as the byte-level tokenizer at ``path`` does where they hold none of its added tokens.

    Pieces are cut in the JVM; tasks merge the distinct ones of ``rows`` texts at a time. A null or empty text has no ids. The table of
    ranks is read once, where the job is made, and sent to the tasks; it is as large as the vocabulary.
    """
    ranks = Ranks.load(path)
    pieces = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(PATTERN), F.lit(0))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, rows):
                part = batch.slice(low, rows)
                lists = part.column(1)
                flat = lists.flatten().dictionary_encode()
                merged = merge_pieces(flat.dictionary.to_pylist(), ranks)
                bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                found = merged.take(flat.indices)
                ends = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())])
                ids = pa.ListArray.from_arrays(pa.array(ends[bounds], pa.int32()), found.flatten())
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["ordinal", "ids"])

    found = df.select(F.col(ordinal).alias("ordinal"), pieces.alias("pieces"))
    return found.mapInArrow(work, f"ordinal {found.schema['ordinal'].dataType.simpleString()}, ids array<int>").withColumnRenamed("ordinal", ordinal)
