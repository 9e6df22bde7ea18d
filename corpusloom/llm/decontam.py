"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit verification.

A document holds an item if some stretch of its words is within 20 % of the item's
words by edit distance (words inserted, deleted or replaced), that is at a
similarity of 0.8 or more. Words are runs of letters, digits and underscores in lower case; in scripts
that put no space between words each character is one.

The CGK embedding walks a text with shared random bits: at each step it writes the word under the pointer, and a
random bit of (step, word) decides if the pointer moves on. Two windows at a small edit distance fall back into step, so
their walks agree in most places, and places sampled from a walk are locality-sensitive for edit distance. ``KINDS`` gives, by length of
item, how many walks of how many steps are drawn, and the bands of places sampled from each. Items are indexed at every offset, as far as a walk stays
within the item and its sample reads enough different places; documents are looked at from every word. Many short windows
of an item, not one as long as it, make recall independent of its length (README has figures). A verbatim copy is always found.
Candidates of an item that overlap are one span; every span is verified by the item's exact distance to a stretch of it.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIMILARITY = 0.8
#: The benchmark is taken in blocks of about so many characters: the bound of what a worker holds (some 120 MB). Each block walks the texts anew.
BLOCK_CHARS = 3_000_000
#: Documents, and characters of their texts, that a worker looks at in one go; words looked up at a time.
_ROWS, _CHARS, _LOOK = 512, 4 << 20, 1 << 16
#: Candidates that are held before overlapping ones become one span.
_MEET = 1 << 19
_PLAIN = re.compile(r"\w+")
#: Thai, Lao, Burmese, Khmer, kana and Chinese characters.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W{_UNSPACED}]+")


@dataclass(frozen=True)
class Kind:
    """How items of ``least`` words or more (up to the next kind) are sampled: walks of ``steps`` steps, each with ``bands`` samples of ``places`` steps that read ``read`` words at least."""

    least: int
    steps: int
    walks: int
    bands: int
    places: int
    read: int

    def samples(self, walk: int) -> list[list[int]]:
        rng = np.random.default_rng([self.least, walk])
        return [sorted(rng.choice(self.steps, self.places, replace=False).tolist()) for _ in range(self.bands)]


#: The first is for items below five words, which may hold no edit, and for others that no walk is good for: their longest word.
WORD_KIND = Kind(1, 1, 1, 1, 1, 1)
KINDS = (Kind(5, 4, 4, 3, 3, 2), Kind(10, 10, 4, 2, 4, 3), Kind(15, 10, 4, 2, 5, 4))


def words_of(text: str | None) -> list[str]:
    text = (text or "").lower()
    return (_PLAIN if text.isascii() else _WORD).findall(text)


def edits_allowed(n: int) -> int:
    """The largest number of edits of an item of ``n`` words that is a similarity of at least 0.8."""
    return n // 5


class Pattern:
    """An item for bit-parallel approximate search (Myers) in a sequence of word numbers."""

    def __init__(self, item: list[int]) -> None:
        self.n = len(item)
        self.at: dict[int, int] = defaultdict(int)
        for i, word in enumerate(item):
            self.at[word] |= 1 << i

    def distance(self, words: list[int]) -> tuple[int, int]:
        """The least edit distance of the item to any stretch of ``words``, and where the first such stretch ends."""
        full, high = (1 << self.n) - 1, 1 << (self.n - 1)
        plus, minus, score = full, 0, self.n
        best, end = score, 0
        for i, word in enumerate(words, 1):
            eq = self.at.get(word, 0)
            x = eq | minus
            h = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | (full & ~(h | plus)), plus & h
            score += bool(up & high) - bool(down & high)
            up, down = up << 1 & full, down << 1 & full
            plus, minus = down | (full & ~(x | up)), up & x
            if score < best:
                best, end = score, i
                if not best:
                    break
        return best, end


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hashes of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Walks:
    """The walks of a kind over word numbers below ``size``."""

    def __init__(self, kind: Kind, size: int) -> None:
        self.kind = kind
        numbers = np.arange(size, dtype=np.uint64)
        self.spread = _mixed((numbers + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        self.bits = [_mixed(self.spread + np.uint64(kind.least << 16 | walk + 1)) for walk in range(kind.walks)]
        self.plans = [kind.samples(walk) for walk in range(kind.walks)]

    def bands(self, ids: np.ndarray, many: int, trace: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]]:
        """For each walk and band the keys of the walks from the first ``many`` places; with ``trace`` the last place read and how many were, too.

        ids must have a place for each step after the last start.
        """
        spread = self.spread[ids]
        for walk, plan in enumerate(self.plans):
            bits = self.bits[walk][ids]
            at = np.arange(many)
            keys = [np.full(many, _mixed(np.array([walk << 8 | b + 1], np.uint64))[0]) for b in range(len(plan))]
            last = [np.full(many, -1) for _ in plan]
            read = [np.zeros(many, np.int64) for _ in plan]
            for step in range(max(p[-1] for p in plan) + 1):
                word = None
                for b, places in enumerate(plan):
                    if step in places:
                        word = spread[at] if word is None else word
                        keys[b] = _stirred(keys[b], word)
                        if trace:
                            read[b] += at != last[b]
                            last[b] = at.copy()
                at += (bits[at] >> np.uint64(step) & np.uint64(1)).view(np.int64)
            for b in range(len(plan)):
                yield (keys[b], last[b], read[b]) if trace else (keys[b], None, None)


def _stirred(keys: np.ndarray, word: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        keys = (keys ^ word) * np.uint64(0x9E3779B97F4A7C15)
    keys ^= keys >> np.uint64(29)
    return keys


class Table:
    """The keys of a kind's items, in order, with item and offset, and which first bits keys have."""

    def __init__(self, kind: Kind, size: int, items: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """items: (number, word numbers, offsets that may be indexed)."""
        self.walks = Walks(kind, size)
        keys, owner, offset = [], [], []
        for number, ids, offsets in items:
            padded = np.concatenate([ids, np.zeros(kind.steps, np.int64)])
            for key, last, read in self.walks.bands(padded, len(ids), trace=True):
                good = offsets[(last[offsets] < len(ids)) & (read[offsets] >= kind.read)]
                keys.append(key[good])
                owner.append(np.full(len(good), number))
                offset.append(good)
        flat = np.concatenate([np.empty(0, np.uint64), *keys])
        owners, offsets = (np.concatenate([np.empty(0, np.int64), *x]) for x in (owner, offset))
        order = np.lexsort((owners, flat))
        flat, owners, offsets = flat[order], owners[order], offsets[order]
        # Where an item repeats itself a key has many of its offsets; the first and the last are enough, as spans are verified whole.
        head = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (owners[1:] != owners[:-1])])[: len(flat)])
        self.keys, self.owner = flat[head], owners[head].astype(np.int32)
        self.low, self.high = ((f.reduceat(offsets, head) if len(head) else offsets).astype(np.int32) for f in (np.minimum, np.maximum))
        self.shift = np.uint64(64 - min(24, max(16, len(flat).bit_length() + 5)))
        self.seen = np.zeros(1 << 64 - int(self.shift), np.bool_)
        self.seen[self.keys >> self.shift] = True

    def candidates(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(item, place in ``ids``, least and greatest offset in the item) of what meets, about _MEET at a time; ids end with a place for each step."""
        steps = self.walks.kind.steps
        for at in range(0, len(ids) - steps, _LOOK):
            part = ids[at : at + _LOOK + steps]
            for keys, _, _ in self.walks.bands(part, len(part) - steps):
                every = np.flatnonzero(self.seen[keys >> self.shift])
                first, after = np.searchsorted(self.keys, keys[every], "left"), np.searchsorted(self.keys, keys[every], "right")
                portion = np.cumsum(after - first) // _MEET
                for starts, lo, hi in zip(*(np.split(x, np.flatnonzero(np.diff(portion)) + 1) for x in (every, first, after)), strict=True):
                    many = hi - lo
                    k = np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)
                    yield tuple(x.astype(np.int64) for x in (self.owner[k], np.repeat(starts + at, many), self.low[k], self.high[k]))


def _united(docs: np.ndarray, items: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the same document and item that overlap or touch, as one."""
    order = np.lexsort((lo, items, docs))
    docs, items, lo, hi = docs[order], items[order], lo[order], hi[order]
    group = np.cumsum(np.concatenate([[0], (docs[1:] != docs[:-1]) | (items[1:] != items[:-1])])[: len(docs)])
    # The greatest end so far within a group: groups are lifted apart, so one running maximum does for all.
    lift = group * (np.int64(1) << 40)
    ends = np.maximum.accumulate(hi + lift) - lift if len(hi) else hi
    fresh = np.ones(len(docs) + 1, np.bool_)
    fresh[1:-1] = (group[1:] != group[:-1]) | (lo[1:] > ends[:-1])
    heads, tails = np.flatnonzero(fresh[:-1]), np.flatnonzero(fresh[1:])
    return docs[heads], items[heads], lo[heads], ends[tails]


class Index:
    """Items of one block, with their keys. Small enough to go to every worker."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[list[int], list[int]]] = []  # ids of equal items, words
        spelt: list[tuple[str, ...]] = []
        known: dict[tuple[str, ...], int] = {}
        for item_id, text in items:
            if words := tuple(words_of(text)):
                if words not in known:
                    known[words] = len(spelt)
                    spelt.append(words)
                    self.items.append(([], [self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in words]))
                self.items[known[words]][0].append(item_id)
        size = len(self.vocabulary) + 1
        left = set(range(len(self.items)))
        self.tables = []
        for kind, above in zip(KINDS, (*KINDS[1:], None), strict=True):
            own = [(i, np.array(w), np.arange(len(w))) for i, (_, w) in enumerate(self.items) if kind.least <= len(w) and (above is None or len(w) < above.least)]
            if own:
                self.tables.append(Table(kind, size, own))
                left -= set(self.tables[-1].owner.tolist())
        if left:
            longest = [(i, max(range(len(spelt[i])), key=lambda k: len(spelt[i][k]))) for i in sorted(left)]  # noqa: B023
            self.tables.append(Table(WORD_KIND, size, [(i, np.array(self.items[i][1]), np.array([k])) for i, k in longest]))

    def hits(self, texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item_id, distance, words of the item, first word of the stretch), by item."""
        get, numbers = self.vocabulary.get, []
        for text in texts:
            words = words_of(text)
            numbers.append(np.fromiter(map(get, words, repeat(0)), np.int64, len(words)))
        # A spare place follows each text; a walk that goes on into the next is only a candidate.
        bases = np.concatenate([[0], np.cumsum([len(x) + 1 for x in numbers])])
        spare = max((t.walks.kind.steps for t in self.tables), default=0)
        ids = np.concatenate([*(y for x in numbers for y in (x, [0])), np.zeros(spare, np.int64)]).astype(np.int64)
        none = np.empty(0, np.int64)
        spans = [(none, none, none, none)]
        sizes = np.array([len(words) for _, words in self.items], np.int64)
        for table in self.tables:
            for items, starts, low, high in table.candidates(ids[: len(ids) - spare + table.walks.kind.steps]):
                docs = np.searchsorted(bases, starts, "right") - 1
                at, slack = starts - bases[docs], edits_allowed(sizes[items])
                # United while they are made, so texts and items that repeat themselves take no more memory than others.
                spans.append(_united(docs, items, at - high - slack, at - low + sizes[items] + slack))
        docs, items, lo, hi = _united(*(np.concatenate(x) for x in zip(*spans, strict=True)))
        best: list[dict[int, tuple[int, int]]] = [{} for _ in texts]
        patterns: dict[int, Pattern] = {}
        for doc, item, lo_, hi_ in zip(docs.tolist(), items.tolist(), lo.tolist(), hi.tolist(), strict=True):
            n = len(self.items[item][1])
            pattern = patterns.get(item) or patterns.setdefault(item, Pattern(self.items[item][1]))
            d, end = pattern.distance(numbers[doc][max(0, lo_) : hi_].tolist())
            if d <= edits_allowed(n) and d < best[doc].get(item, (n, 0))[0]:
                best[doc][item] = (d, max(0, max(0, lo_) + end - n))
        return [[(item_id, d, len(self.items[i][1]), at) for i, (d, at) in own.items() for item_id in self.items[i][0]] for own in best]


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """The benchmark in blocks of about BLOCK_CHARS characters, each fetched on its own. Rows with a null id or text have no part."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null")
    total = rows.agg(F.sum(F.length("t") + 1)).first()[0] or 0
    blocks = -(-int(total) // BLOCK_CHARS)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).orderBy("i", "t")
        yield Index([(r.i, r.t) for r in part.collect()])


def _found(docs: DataFrame, benchmark: DataFrame) -> list[Broadcast]:
    """The benchmark's blocks, each shared with the workers; the driver holds one at a time."""
    return [docs.sparkSession.sparkContext.broadcast(index) for index in indexes(benchmark)]


def _all_hits(blocks: list[Broadcast], texts: list[str | None]) -> list[list[tuple[int, int, int, int]]]:
    """The hits of all blocks. Of several a worker holds one at a time."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    for block in blocks:
        for own, more in zip(out, block.value.hits(texts), strict=True):
            own += more
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)  # what value keeps; the file stays
    return out


def _portions(batches: Iterator[pa.RecordBatch], at_col: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that none has more than _ROWS rows, or _CHARS bytes of text in more than one row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(at_col).cast(pa.string())), 0).to_pylist()
        begin = held = 0
        for i, size in enumerate(sizes):
            if i > begin and (held + size > _CHARS or i - begin >= _ROWS):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += size
        if batch.num_rows > begin:
            yield batch.slice(begin)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, item_id, distance, similarity, first_word): a row for each document and item that it holds.

    distance: the least edit distance (words) of the item to a stretch of the document among the places that were
    candidates; first_word: about where. Null and empty texts match nothing, nor do items without a word; items of fewer than five
    words match only where they stand word for word; equal items match side by side; repeated documents
    each have their rows; items with the same id keep a row each. Empty tables give no rows.
    Columns other than id and text aren't read. One pass over the documents without shuffle; a worker holds one block of the benchmark at a
    time, and work grows with the number of blocks.
    """
    schema = f"{id_col} long, item_id long, distance long, similarity double, first_word long"
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("t"))
    blocks = _found(docs, benchmark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches, 1):
            hits = _all_hits(blocks, part.column(1).to_pylist())
            flat = [(i, item, d, 1 - d / n, first) for i, own in zip(part.column(0).to_pylist(), hits, strict=True) for item, d, n, first in own]
            if flat:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                columns = [pa.array(c, t) for c, t in zip(zip(*flat, strict=True), types, strict=True)]
                yield pa.record_batch(columns, names=[id_col, "item_id", "distance", "similarity", "first_word"])

    return rows.mapInArrow(work, schema)


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item of the benchmark, with all columns. One pass without shuffle.

    Rows with a null or empty text stay, as do all rows if the benchmark is empty; repeated rows stay or go
    together; an empty table gives no rows. Only the text decides, so other columns may have any names.
    """
    blocks = _found(docs, benchmark)
    at_col = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _portions(batches, at_col):
            hits = _all_hits(blocks, part.column(at_col).cast(pa.string()).to_pylist())
            yield part.filter(pa.array([not h for h in hits]))

    return docs.mapInArrow(work, docs.schema)
