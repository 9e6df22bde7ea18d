"""Token counts by a count-only Viterbi over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary's matches, and the dynamic program carries only the
best score and its piece count. Ties and unknown characters follow the unigram model of the `tokenizers`
library: at each end the longest piece comes first and only a strictly higher score replaces it; a
character without a piece of its own may be unknown at the lowest score less ten; unknown
characters become their bytes where the vocabulary has byte pieces, else a
run of them is one piece. Text is prepared as sentence pieces are: a space before the text, and spaces as U+2581.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks of at most so many characters are remembered, and so many of them.
_MEMO_CHARS, _MEMO = 48, 500_000
_ROWS = 256


def load_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in order of id from a sentence-piece model file; the first is the unknown piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


@dataclass
class Counter:
    """Counts pieces of texts. Scores are added within chunks that no piece crosses, which is exact for whole-number scores."""

    vocabulary: list[tuple[str, float]]
    memo: dict[str, tuple[float, int]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for piece, score in self.vocabulary:
            if piece:
                self.found.add_word(piece, (len(piece), score))
        self.found.make_automaton()
        pieces = {p for p, _ in self.vocabulary}
        self.longest = max(map(len, pieces), default=1)
        self.single = {p for p in pieces if len(p) == 1}
        self.unknown = min(s for _, s in self.vocabulary) - UNKNOWN_PENALTY
        self.bytes = all(f"<0x{b:02X}>" in pieces for b in range(256))
        # A chunk may end before a space mark that follows something else if no piece goes on there.
        self.apart = self.bytes and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces)

    def chunk(self, text: str) -> tuple[float, int]:
        """Best score and piece count of a prepared text. Only as many places are held as the longest piece has characters."""
        n, m = len(text), self.longest + 1
        score, count = [0.0] * m, [0] * m  # of the last m places
        unknown_before, at, best, pieces = False, 0, None, 0
        single = self.single

        def close(end: int) -> None:
            nonlocal best, pieces, unknown_before
            lost = False
            char = text[end - 1]
            if char not in single:
                s = score[(end - 1) % m] + self.unknown
                if best is None or s > best:
                    step = len(char.encode()) if self.bytes else int(not unknown_before)
                    best, pieces, lost = s, count[(end - 1) % m] + step, True
            score[end % m], count[end % m], unknown_before = best, pieces, lost
            best = None

        for last, (length, value) in self.found.iter(text):
            while at < last:
                at += 1
                close(at)
            before = (last + 1 - length) % m
            s = score[before] + value
            if best is None or s > best:
                best, pieces = s, count[before] + 1
        while at < n:
            at += 1
            close(at)
        return score[n % m], count[n % m]

    def count(self, text: str | None) -> tuple[float, int]:
        """Best score and number of pieces of a whole text; null and empty: zero."""
        if not text:
            return 0.0, 0
        ready = SPACE + text.replace(" ", SPACE)
        if not self.apart:
            return self.chunk(ready)
        if len(self.memo) > _MEMO:
            self.memo.clear()
        score, pieces, memo = 0.0, 0, self.memo
        for chunk in re.findall(f"{SPACE}+[^{SPACE}]*", ready):
            known = memo.get(chunk)
            if known is None:
                known = self.chunk(chunk)
                if len(chunk) <= _MEMO_CHARS:
                    memo[chunk] = known
            score += known[0]
            pieces += known[1]
        return score, pieces


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score) for each row: pieces of the whole text and their best score. One pass, no shuffle.

    Null and empty texts have no tokens and score zero; repeated rows and null ids are
    counted row by row; an empty table gives no rows; other columns aren't read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(load_vocabulary(model_path))
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                got = [counter.count(t.as_py()) for t in part.column(1)]
                columns = [part.column(0), pa.array([c for _, c in got], pa.int64()), pa.array([s for s, _ in got], pa.float64())]
                yield pa.record_batch(columns, names=["id", "n_tokens", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(work, "id long, n_tokens long, score double").withColumnRenamed("id", id_col)
