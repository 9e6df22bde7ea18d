"""Cost-balanced packing of tokenized documents into sequences.

A piece of l tokens costs l + l^2 / QUADRATIC: a linear part, and attention within
the piece. Pieces are taken in descending length, and each goes to the sequence of lowest
cost that still has room. Work is done on runs of documents that a task reads,
so nothing is shuffled and memory is bounded by the run.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END_ID = 1
#: Tokens at which attention within a piece costs as much as the rest.
QUADRATIC = 4096
#: A run ends at so many documents or tokens.
RUN_DOCS, RUN_TOKENS = 2048, 8_000_000
#: Words whose ids a worker remembers, and as many that it met before those; words of more letters aren't remembered.
_MEMO, _MEMO_LETTERS = 300_000, 40
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: ASCII signs but the apostrophe, which may begin a word's ending.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte-level tokenizers write each byte as a printable character: printable Latin-1 as itself, others from U+0100 on.
_PRINTABLE = dict(zip([b for b in range(256) if b < 33 or 126 < b < 161 or b == 173], range(256, 512)))
#: Texts are encoded together by so many rows or bytes; words are looked up, and ids gathered, by so many words.
_ROWS, _BYTES, _WORDS = 1024, 4 << 20, 1 << 17


def as_bytes(ids: list[Sequence[int]]) -> list[bytes]:
    flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
    ends = [4 * x for x in accumulate(map(len, ids), initial=0)]
    return [flat[i:j] for i, j in pairwise(ends)]


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, by a `tokenizers` file that drops white space.

    Such a tokenizer works on each run between ASCII white space alone, so each distinct word
    of some texts is looked up once, and ids are remembered by word. If it lowers letters, A-Z are lowered
    first, words of Latin letters go straight to the model, and if it parts letters from signs, the signs at a word's end are encoded on their own.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        same = lambda a, b: self._ids([a]) == self._ids([b])
        self.lowers = same("THE Quick", "the quick") and same("ONIONS", "onions")
        self.model, self.direct = self.tokenizer.model, True
        latin = "".join(filter(_LATIN.fullmatch, map(chr, range(192, 256))))
        self.direct = self.lowers and all(self._encoded([w]) == self._ids([w]) for w in ("the", "onions", "größenäß", "éçàênt", "ñaz", "xqzj", "École", "aÉz", latin))
        heads, tails = ["the", "onions", *latin, *map(chr, range(97, 123))], [*_SIGNS, "...", "-,", _SIGNS]
        self.parts = self._ids([h + t for h in heads for t in tails]) == [h + t for h in self._ids(heads) for t in self._ids(tails)]

    def _ids(self, words: list[str]) -> list[bytes]:
        return as_bytes([e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])

    def _plain(self, word: str) -> list[int] | None:
        """Ids of a word of Latin letters straight from the model, which takes bytes as printable characters; None: not such a word."""
        if word.isascii():
            letters = word.lower() if word.isalpha() else None
        else:
            letters = word.lower().encode().decode("latin-1").translate(_PRINTABLE) if _LATIN.fullmatch(word) else None
        return [t.id for t in self.model.tokenize(letters)] if letters else None

    def _encoded(self, words: list[str]) -> list[bytes]:
        """The ids of words that aren't remembered."""
        plain = [*map(self._plain, words)] if self.direct else [None] * len(words)
        ids = as_bytes([x or () for x in plain])
        others = [i for i, x in enumerate(plain) if x is None]
        for at in range(0, len(others), 1024):
            some = others[at : at + 1024]
            for i, x in zip(some, self._ids([words[i] for i in some]), strict=True):
                ids[i] = x
        return ids

    def _stem(self, word: str) -> str:
        """A word that ends with a Latin letter and then signs, without those signs; other words as they are."""
        stem = word.rstrip(_SIGNS) if self.parts else word
        return word if not _LATIN.fullmatch(stem[-1:]) or any(t in word.lower() for t in self.special) else stem

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of each of ``words``, which are remembered from now on."""
        found: list[bytes | None] = []
        for at in range(0, len(words), _WORDS):
            some = words[at : at + _WORDS]
            got = list(map(self.new.get, some))
            missing = [i for i, x in enumerate(got) if x is None]
            fresh = {some[i]: self.old.get(some[i]) for i in missing}
            unknown = [w for w, x in fresh.items() if x is None]
            fresh.update(zip(unknown, self._encoded(unknown), strict=True))
            for i in missing:
                got[i] = fresh[some[i]]
            if len(self.new) > _MEMO:
                self.old, self.new = self.new, {}
            self.new.update((w, x) for w, x in fresh.items() if len(w) <= _MEMO_LETTERS)
            found += got
        return found

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """The ids of each of ``texts``; none for a null or an empty one."""
        texts = texts.fill_null("")
        if self.lowers:
            lower = pc.ascii_lower(texts)
            for t in self.special:  # a special token isn't lowered
                lower = pc.if_else(pc.match_substring(lower, t, ignore_case=True), texts, lower)
            texts = lower
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        words, index = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        ends_so = pc.not_equal(pc.ascii_rtrim(coded.dictionary, _SIGNS), coded.dictionary)
        tails = []
        stems = words.copy()
        for i in np.flatnonzero(ends_so.to_numpy(zero_copy_only=False)).tolist():
            stems[i] = stem = self._stem(words[i])
            tails.append((i, words[i][len(stem) :]))
        ids = self._known(stems)
        for (i, _), x in zip(tails, self._known([signs for _, signs in tails]), strict=True):
            ids[i] += x
        pool, sizes = np.frombuffer(b"".join(ids), "<u4"), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        gathered = []
        for at in range(0, len(index), _WORDS):
            some = index[at : at + _WORDS]
            n = sizes[some]
            gathered.append(pool[np.repeat(starts[some] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes())
        flat = b"".join(gathered)
        ends = np.concatenate([[0], np.cumsum(4 * sizes[index])])[split.offsets.to_numpy()].tolist()
        return [flat[i:j] for i, j in pairwise(ends)]


def portions(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """(first row, rows) of portions of at most ``_ROWS`` rows and, but for a single text, ``_BYTES`` bytes."""
    sizes = pc.binary_length(texts).fill_null(0).to_pylist()
    at = held = 0
    for i, n in enumerate(sizes):
        if i > at and (i - at == _ROWS or held + n > _BYTES):
            yield at, i - at
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield at, len(sizes) - at


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """A worker process's encoder: what it remembers serves the tasks that follow."""
    return WordEncoder(path)


def cost(length: int) -> float:
    return length + length * length / QUADRATIC


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece, for documents of ``lengths`` tokens.

    Whole sequences' worth of a document stand alone. The rests fill as many
    sequences as they have tokens for, by descending length and lowest cost;
    what fits nowhere whole is cut into the gaps, and the last tokens, too few for a
    sequence, go to sequences of powers of two, which need no padding.
    """
    pieces: list[tuple[int, int, int, int, int]] = []
    rests, made = [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((d, start, capacity, made, 0))
            made += 1
        if n % capacity:
            rests.append((n % capacity, d, n - n % capacity))
    rests.sort(key=lambda x: (-x[0], x[1]))
    bins = sum(x[0] for x in rests) // capacity
    used = [0] * bins
    heap = [(0.0, b) for b in range(bins)]
    left = []
    most = capacity  # no sequence has more room
    for size, d, start in rests:
        if size > most:
            left.append((size, d, start))
            continue
        skipped, chosen = [], None
        while heap:
            top = heapq.heappop(heap)
            if used[top[1]] + size <= capacity:
                chosen = top
                break
            skipped.append(top)
        for x in skipped:
            heapq.heappush(heap, x)
        if chosen is None:
            most = max((capacity - used[b] for _, b in heap), default=0)
            left.append((size, d, start))
            continue
        total, b = chosen
        pieces.append((d, start, size, made + b, used[b]))
        used[b] += size
        if used[b] < capacity:
            heapq.heappush(heap, (total + cost(size), b))
    # Lowest cost first again, now for parts of pieces: each gap is filled to its end.
    gaps = [b for _, b in sorted(heap)]
    at = 0
    tail: list[tuple[int, int, int]] = []
    for size, d, start in left:
        while size and at < len(gaps):
            b = gaps[at]
            take = min(size, capacity - used[b])
            pieces.append((d, start, take, made + b, used[b]))
            used[b] += take
            start, size = start + take, size - take
            at += used[b] == capacity
        if size:
            tail.append((size, d, start))
    made += bins
    remaining = sum(x[0] for x in tail)
    while remaining:
        room = 1 << (remaining.bit_length() - 1)
        offset = 0
        while offset < room:
            size, d, start = tail[0]
            take = min(size, room - offset)
            pieces.append((d, start, take, made, offset))
            offset += take
            if take == size:
                tail.pop(0)
            else:
                tail[0] = (size - take, d, start + take)
        remaining -= room
        made += 1
    return pieces


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece.

    ids: the piece's token ids as little-endian unsigned 32-bit integers. A null or
    empty text is its end id alone; repeated and null ids are packed row by row. An
    empty table gives no rows. Other columns aren't read. sequence_id is the
    task's number and a count within it, the same whenever the task is run again.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        next_id = TaskContext.get().partitionId() << 40
        names: list[int] = []
        tokens: list[bytes] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal next_id, held
            lengths = [len(t) // 4 for t in tokens]
            pieces = assign(lengths)
            for i in range(0, len(pieces), 4096):
                some = pieces[i : i + 4096]
                d, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*some, strict=True))
                ids = [tokens[a][4 * b : 4 * (b + n)] for a, b, n, _, _ in some]
                columns = [pa.array([names[x] for x in d], pa.int64()), pa.array(start), pa.array(length), pa.array(ids, pa.binary())]
                columns += [pa.array(np.array(lengths, np.int64)[d]), pa.array(sequence + next_id), pa.array(offset)]
                yield pa.record_batch(columns, names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            next_id += 1 + max((p[3] for p in pieces), default=-1)
            names.clear()
            tokens.clear()
            held = 0

        for batch in batches:
            for at, n in portions(batch.column(1)):
                part = batch.slice(at, n)
                for name, got in zip(part.column(0).to_pylist(), coder.encode(part.column(1)), strict=True):
                    names.append(name)
                    tokens.append(got + end)
                    held += len(got) // 4 + 1
                    if len(names) >= RUN_DOCS or held >= RUN_TOKENS:
                        yield from flush()
        if names:
            yield from flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(work, f"id long, {SCHEMA}").withColumnRenamed("id", id_col)


def ids_crc32(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ids_crc32 (unsigned CRC-32 of the ids' bytes) in place of ids."""
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
