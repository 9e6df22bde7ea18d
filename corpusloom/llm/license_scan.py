"""License scan: base phrases, and template-markup matching by token automata.

A template is plain wording with ``<<optional>> ... <<end>>`` regions that may be left
out and ``<<var N>>`` regions that stand for up to N words. It is compiled to an
automaton over word tokens; a text matches where some stretch of its words is accepted, so
that all mandatory wording is there, in order and word for word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.license_templates import TEMPLATES

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_MARK = re.compile(r"<<(optional|end|var \d+)>>")
_ROWS = 256


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8: A-Z in lower case; runs of digits, letters a-z and characters beyond ASCII."""
    return (text or "").encode().translate(_LOWER).split()


@dataclass(frozen=True)
class Automaton:
    """States are positions in the wording: a word to read (or None: any), and where else one may go without reading."""

    reads: tuple[bytes | None, ...]
    skips: tuple[frozenset[int], ...]
    needed: frozenset[bytes]

    @property
    def end(self) -> int:
        return len(self.reads)

    def first(self) -> set[bytes | None]:
        return {self.reads[s] for s in self.skips[0] if s < self.end}

    def longest(self, words: list[bytes], start: int) -> int:
        """The end of the longest accepted stretch from ``start``, or -1."""
        states, at, found = self.skips[0], start, -1
        while states:
            if self.end in states:
                found = at
            if at == len(words):
                break
            word = words[at]
            at += 1
            after = [self.skips[s + 1] for s in states if s < self.end and self.reads[s] in (None, word)]
            states = frozenset().union(*after) if after else frozenset()
        return found


def compile_template(template: str) -> Automaton:
    """The token automaton of a template. Optional regions may nest; they must be closed."""
    reads: list[bytes | None] = []
    jumps: list[tuple[int, int]] = []
    opened: list[int] = []
    needed: set[bytes] = set()
    for i, part in enumerate(_MARK.split(template)):
        if i % 2 == 0:
            words = words_of(part)
            reads += words
            if not opened:
                needed.update(words)
        elif part == "optional":
            opened.append(len(reads))
        elif part == "end":
            jumps.append((opened.pop(), len(reads)))
        else:
            n = int(part.split()[1])
            jumps += [(len(reads) + k, len(reads) + n) for k in range(n)]
            reads += [None] * n
    if opened:
        raise ValueError("an optional region isn't closed")
    skips = []
    for s in range(len(reads) + 1):
        reach, todo = {s}, [s]
        while todo:
            x = todo.pop()
            for a, b in jumps:
                if a == x and b not in reach:
                    reach.add(b)
                    todo.append(b)
        skips.append(frozenset(reach))
    return Automaton(tuple(reads), tuple(skips), frozenset(needed))


class Scanner:
    """Base phrases and templates over one text."""

    def __init__(self, phrases: dict[str, str], templates: dict[str, str]) -> None:
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.templates = [(label, compile_template(t)) for label, t in templates.items()]

    def scan(self, text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, list[tuple[str, int, int]]]:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first word, end) of templates."""
        words = words_of(text)
        kinds = set(words)
        places: list[tuple[int, int]] = []
        base: set[str] = set()
        for phrase, label in self.phrases:
            if kinds.issuperset(phrase):
                k, last = len(phrase), len(words) - len(phrase)
                at = -1
                while True:
                    try:
                        at = words.index(phrase[0], at + 1)
                    except ValueError:
                        break
                    if at > last:
                        break
                    if words[at : at + k] == phrase:
                        places.append((at, at + k))
                        base.add(label)
        spans: list[tuple[str, int, int]] = []
        for label, automaton in self.templates:
            if not kinds.issuperset(automaton.needed):
                continue
            first, at = automaton.first(), 0
            while at < len(words):
                end = automaton.longest(words, at) if None in first or words[at] in first else -1
                if end > at:
                    spans.append((label, at, end))
                at = max(end, at + 1)
        covered: set[int] = set()
        for a, b in [*places, *[(a, b) for _, a, b in spans]]:
            covered.update(range(a, b))
        starts = [a for a, _ in places]
        labels = base | {label for label, _, _ in spans}
        share = len(covered) / len(words) if words else 0.0
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), share, spans


COLUMNS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: long, stop: long>>"


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row. One pass, no shuffle.

    n_base counts every place of a base phrase; first_word and last_word are the smallest and
    largest start (null without a place). labels holds the base labels and those of
    matching templates; score is the share of words that phrases and templates cover. Null
    and empty texts have no words, empty labels and score 0. Repeated rows and null ids
    are scanned row by row, an empty table gives no rows, and other columns aren't read.
    """
    struct = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), struct]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                got = [scanner.scan(t.as_py()) for t in part.column(1)]
                got = [(*x[:7], [{"label": n, "start": a, "stop": b} for n, a, b in x[7]]) for x in got]
                columns = [pa.array([x[i] for x in got], kind) for i, kind in enumerate(types)]
                yield pa.record_batch([part.column(0), *columns], names=["id", *names])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(work, f"id long, {COLUMNS}").withColumnRenamed("id", id_col)
