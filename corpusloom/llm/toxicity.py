"""Toxicity: maximum-scoring segments of token log-odds, with extreme-value calibration.

A token's score is the log-odds of its standing in toxic texts against clean ones. The shares of toxic and clean texts
among those that hold it have a prior mixed of two Dirichlet laws: most tokens say nothing (the shares of all texts), a few mark
toxic texts. A token whose beginning of four or five letters marks them is likelier to do so, so inflected and rare forms take after
their stem. Less a small drift, tokens of clean texts sum to ever less, and a toxic passage stands out as a segment that no extension and no cut
makes larger; one scan finds all of these. The largest sum that chance gives in n tokens follows an extreme-value law, fitted on clean texts;
the significant segments of a text are combined by it, and a logistic curve turns what comes out into a probability.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled rows are drawn (by hash of the id) to fit; a parameter of fit().
MAX_LABELLED = 40_000
#: Counts are kept by hash, so what is sent to the tasks has a fixed size (two numbers of four bytes each).
BUCKETS = 1 << 20
#: The law of a marker's toxic and clean shares, its weight without and with a beginning that marks, and what each token's score is less.
MARKER, RARE, AKIN, DRIFT = (4.0, 0.5), 0.001, 0.5, 0.05
#: A word that stood less than so many tokens before scores nothing again.
AGAIN = 100
#: Texts of one label count as copies in fitting if one of so many keys, each of so many least shingle hashes, is equal: 97 of 100 pairs
#: that share 0.9 of their shingles, one of 10^7 that share 0.1 (as texts with a common line do).
KEYS, LEAST, SHINGLE = 6, 8, 5
#: A segment is significant if chance gives fewer of its like in a text; at most so many are combined by the sum statistic.
E_VALUE, COMBINED = 0.01, 8
#: Evidence beyond this tells no more.
CERTAIN = 40.0
_WORD = re.compile(r"\w+")
_MEMO, _MEMO_CHARS, _ROWS = 150_000, 32, 256


def _units(word: str) -> tuple[int, ...]:
    """Buckets of a word's beginnings of four and five letters, where it has them, and of itself."""
    parts = [f"{k}:{word[:k]}" for k in (4, 5) if len(word) >= k] + [f"w:{word}"]
    return tuple(xxhash.xxh64_intdigest(p) % BUCKETS for p in parts)


class _Memo(dict):
    """What ``make`` gives for words; so many are remembered, and only those of usual length."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= _MEMO_CHARS:
            if len(self) >= _MEMO:
                self.clear()
            self[word] = value
        return value


def _laws(toxic: float, n: float, share: float) -> tuple[float, float]:
    """Of a unit in n texts: how much likelier (a logarithm) its toxic ones are if it says nothing than if it marks, and its share as a marker."""
    (a, b), clean = MARKER, n - toxic
    marker = lgamma(toxic + a) + lgamma(clean + b) - lgamma(n + a + b) - lgamma(a) - lgamma(b) + lgamma(a + b)
    return toxic * log(share) + clean * log(1 - share) - marker, (toxic + a) / (n + a + b)


def _word_score(laws: list[tuple[float, float]], share: float) -> float:
    """The score of a word by the laws of its units."""
    marks, tilt = RARE, share
    for against, tilt in laws:
        weight = max(RARE, AKIN * marks)
        marks = 1 / (1 + (1 - weight) / weight * exp(min(against, 500.0)))
    mixed = marks * tilt + (1 - marks) * share
    return log(mixed / (1 - mixed)) - log(share / (1 - share)) - DRIFT


@dataclass(frozen=True)
class Model:
    """Texts with each bucket, toxic and all; the share of toxic texts; the extreme-value law's rate and size; the logistic curve."""

    toxic: np.ndarray
    all: np.ndarray
    share: float
    rate: float = 1.0
    size: float = 1.0
    curve: tuple[float, float] = (0.0, 0.0)

    def word(self, word: str, own: int = 0, counted: int = 0) -> float:
        """A word's score; with ``counted`` 1 as if a text with the label ``own``, which holds the word, hadn't been counted."""
        return _word_score([_laws(float(self.toxic[u]) - own, float(self.all[u]) - counted, self.share) for u in _units(word)], self.share)

    def words(self) -> Callable[[str], float]:
        """word() with the laws of all buckets laid out, each pair of counts reckoned once."""
        pairs, where = np.unique(np.stack([self.toxic, self.all], 1), axis=0, return_inverse=True)
        laws = np.array([_laws(float(t), float(n), self.share) for t, n in pairs])[where.reshape(-1)]
        against, tilt, share = laws[:, 0].astype(np.float32), laws[:, 1].astype(np.float32), self.share
        return lambda word: _word_score([(float(against[u]), float(tilt[u])) for u in _units(word)], share)

    def evidence(self, segments: Sequence[tuple[int, int, float]], n: int) -> float:
        """-log of the chance of segments as good in a text of ``n`` tokens: the best of the sum statistics of the first, the first two, and so on."""
        best = total = 0.0
        for r, (_, _, score) in enumerate(sorted(segments, key=lambda s: -s[2])[:COMBINED], start=1):
            total += self.rate * score - log(self.size * max(n, 1))
            if r == 1:
                best = total
            elif total > r:
                best = max(best, total - (r - 1) * log(total) + lgamma(r + 1) + lgamma(r))
        return min(max(best, 0.0), CERTAIN) if segments else 0.0

    def probability(self, evidence: float) -> float:
        return 1 / (1 + exp(-min(max(self.curve[0] + self.curve[1] * evidence, -50.0), 50.0)))


def _scores(words: list[str], memo: dict[str, float]) -> np.ndarray:
    """The scores of a text's tokens; a mark's repeats nearby aren't evidence of their own, so they have the drift alone."""
    out = np.fromiter(map(memo.__getitem__, words), float, len(words))
    last: dict[str, int] = {}
    for i in np.flatnonzero(out > 0).tolist():
        if i - last.get(words[i], -AGAIN) < AGAIN:
            out[i] = -DRIFT
        last[words[i]] = i
    return out


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """(first, last, sum) of all maximal scoring segments, in one scan.

    Such a segment has a positive sum, every beginning and every end of it, too, and no segment with this property
    holds it. Runs of one sign are summed first. Each candidate links to the last one before it that starts from a lower running sum,
    so looking for that costs constant time on average.
    """
    if not len(scores):
        return []
    up = scores > 0
    starts = np.flatnonzero(np.diff(up, prepend=not up[0]))
    sums = np.add.reduceat(scores, starts).tolist()
    ends = np.append(starts[1:], len(scores)).tolist()
    starts = starts.tolist()
    kept: list[tuple[int, int, float, float, int]] = []  # first, last, running sum before and after, link
    total = 0.0
    for run, value in enumerate(sums):
        if value <= 0:
            total += value
            continue
        first, last, low, total = starts[run], ends[run] - 1, total, total + value
        while True:
            at = len(kept) - 1
            while at >= 0 and kept[at][2] >= low:
                at = kept[at][4]
            if at < 0 or kept[at][3] >= total:
                kept.append((first, last, low, total, at))
                break
            first, low = kept[at][0], kept[at][2]
            del kept[at:]
    return [(first, last, high - low) for first, last, low, high, _ in kept]


def _labelled(labels: DataFrame, id_col: str, most: int) -> DataFrame:
    """(id, toxic): at most ``most`` labelled ids, by hash, the same for every partitioning; the worst of repeated labels."""
    one = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    return one.orderBy(F.xxhash64("id"), "id").limit(most)


#: Odd multipliers, each an order of hashes.
_ORDERS = np.array([xxhash.xxh64_intdigest(str(k)) | 1 for k in range(KEYS * LEAST)], np.uint64)


def _sketch(text: str) -> list[int]:
    """A hash of the text, and keys of the least hashes, by several orders, of its shingles; texts that share most shingles are likely to share a key."""
    words = _WORD.findall(text.lower())
    shingles = {" ".join(words[i : i + SHINGLE]) for i in range(max(len(words) - SHINGLE, 0) + 1)}
    hashes = np.array([xxhash.xxh64_intdigest(s) for s in shingles], np.uint64)
    least = np.array([(hashes * m).min() for m in _ORDERS], np.uint64).reshape(KEYS, LEAST)
    return [xxhash.xxh64_intdigest(x) >> 1 for x in (text, *(k.tobytes() for k in least))]


def _texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(text, toxic) of the labelled documents, one for each group of copies and near copies.

    Of equal texts the worst label counts. Near copies are joined only with those of their label: what differs may be what makes one toxic.
    Sketches of at most ``most`` ids go to the driver, which joins those that share a key.
    """
    chosen = F.broadcast(_labelled(labels, id_col, most))
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = [_sketch(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic"), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "toxic", "sketch"])

    rows = docs.join(chosen, "id").select("id", "toxic", "text")
    sketched = rows.mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, toxic int, sketch array<long>")
    # Of rows that repeat an id the least sketch counts, so no more than ``most`` come.
    sketched = sketched.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("sketch").alias("sketch")).toArrow().sort_by("id")
    up = list(range(sketched.num_rows))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    sketches, worst = sketched["sketch"].to_pylist(), {}
    for (text, *_), label in zip(sketches, sketched["toxic"].to_pylist(), strict=True):
        worst[text] = max(worst.get(text, 0), label)
    seen: dict[tuple[int, int, int], int] = {}
    for i, (text, *keys) in enumerate(sketches):
        for k, key in enumerate(keys):
            a, b = sorted((top(i), top(seen.setdefault((worst[text], k, key), i))))
            up[b] = a
    group = {i: worst[sketches[i][0]] for i in up if up[i] == i}
    kept = sketched.select(["id"]).take(pa.array(list(group), pa.int64())).append_column("toxic", pa.array(list(group.values()), pa.int32()))
    return docs.join(F.broadcast(docs.sparkSession.createDataFrame(kept)), "id").select("text", "toxic")


def _count(texts: DataFrame) -> Model:
    """How many texts hold each bucket; partial sums of a task go through one shuffle of at most BUCKETS keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, both, memo = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), _Memo(_units)
        n = np.zeros(2, np.int64)
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = list({u for w in set(_WORD.findall(text.lower())) for u in memo[w]})
                both[found] += 1
                toxic[found] += label
                n += (label, 1)
        used = np.flatnonzero(both)
        # the last bucket but one, so to speak, counts the texts themselves
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, BUCKETS)), pa.array(np.append(toxic[used], n[0])), pa.array(np.append(both[used], n[1]))], names=["bucket", "toxic", "n"])

    sums = texts.mapInArrow(work, "bucket long, toxic long, n long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n")).toArrow()
    bucket = sums["bucket"].to_numpy()
    toxic, both = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    toxic[bucket], both[bucket] = sums["toxic"].to_numpy(), sums["n"].to_numpy()
    return Model(toxic[:-1].astype(np.float32), both[:-1].astype(np.float32), float(toxic[-1] / both[-1]) if both[-1] else 0.0)


def _law(score: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Rate and size of the extreme-value law of maximal sums in n tokens, at the greatest likelihood."""

    def loss(rate: float) -> float:
        return -(len(score) * (log(rate) - log(float(np.sum(n * np.exp(-rate * score))))) - rate * float(score.sum()))

    rates = np.geomspace(0.05, 10, 400)
    rate = float(min(rates, key=loss))
    return rate, float(len(score) / np.sum(n * np.exp(-rate * score)))


def _curve(evidence: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Intercept and slope of the logistic curve, with targets drawn in a little so that parted classes give a finite slope."""
    yes, no = toxic.sum(), (1 - toxic).sum()
    target = np.where(toxic > 0, (yes + 1) / (yes + 2), 1 / (no + 2))
    x = np.stack([np.ones_like(evidence), evidence], 1)
    beta = np.array([log((yes + 1) / (no + 1)), 0.0])

    def loss(b: np.ndarray) -> float:
        return float(np.sum(np.logaddexp(0, x @ b) - target * (x @ b)))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        weight = np.maximum(p * (1 - p), 1e-9)
        down = x.T @ (target - p)
        step = np.linalg.solve(x.T @ (x * weight[:, None]) + 1e-6 * np.eye(2), down)
        # A whole step may go too far where evidence is large: it is halved until the loss falls with it, so slopes don't run away.
        size, now = 1.0, loss(beta)
        while size > 1e-9 and loss(beta + size * step) > now - 1e-4 * size * float(down @ step):
            size /= 2
        if size <= 1e-9:
            break
        beta += size * step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(max(beta[1], 0.0))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model of the documents that ``labels`` (id, toxic) marks; all that reaches the driver is BUCKETS counts and sketches and sums of ``max_labelled`` texts.

    Law and curve are fitted on the same texts, each scored as if it hadn't been counted. Null ids and labels are left
    out, repeated ones count once (the worst), as do near copies of a text with its label. Without texts of both kinds every score is 0.
    """
    texts = _texts(docs, labels, id_col, text_col, max_labelled)
    model = _count(texts)
    if not 0 < model.share < 1:
        return Model(model.toxic, model.all, 0.0)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _WORD.findall(text.lower())
                own = {w: model.word(w, label, 1) for w in set(words)}
                found = maximal_segments(_scores(words, own))
                found.sort(key=lambda s: -s[2])
                out.append(([s[2] for s in found[:COMBINED]], len(words), label))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.list_(pa.float64()), pa.int64(), pa.int32()), strict=True)], names=["sums", "n", "toxic"])

    sample = texts.mapInArrow(work, "sums array<double>, n long, toxic int").toArrow()
    sums, n, toxic = sample["sums"].to_pylist(), np.maximum(sample["n"].to_numpy(), 1), sample["toxic"].to_numpy().astype(float)
    top = np.array([s[0] if s else 0.0 for s in sums])
    model = Model(model.toxic, model.all, model.share, *_law(top[toxic == 0], n[toxic == 0].astype(float)))
    evidence = np.array([model.evidence([(0, 0, x) for x in s], k) for s, k in zip(sums, n.tolist(), strict=True)])
    return Model(model.toxic, model.all, model.share, model.rate, model.size, _curve(evidence, toxic))


def _passages(text: str, segments: list[tuple[int, int, float]], model: Model, n: int) -> list[dict]:
    """The significant segments as passages of the text, in its order."""
    found = [(first, last, score, exp(-min(model.rate * score - log(model.size * n), 700.0))) for first, last, score in segments]
    found = [s for s in found if s[3] <= E_VALUE]
    if not found:
        return []
    # The same words as in scoring wherever small letters have the length of what they stand for; else places are those of the small text.
    spans = [m.span() for m in _WORD.finditer(text)]
    return [{"start": spans[a][0], "end": spans[b][1], "score": s, "e_value": e} for a, b, s, e in found if b < len(spans)]


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, Column] | None = None) -> DataFrame:
    """A row for each document: id, the columns of ``keep``, score (0 to 1: the chance that it is toxic), evidence and passages.

    passages: start, end (characters), sum and E-value of every significant segment of the whole text. Only the text is
    looked at. A null or empty text has no token: the score of a text without evidence, and no passages. Repeated rows and null ids are scored each
    for itself, very long texts in linear time; an empty table gives an empty one. Other columns, whatever their names, don't count.
    """
    keep = keep or {}
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *[c.alias(f"keep{i}") for i, c in enumerate(keep.values())])
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("e_value", pa.float64())]))

    def one(text: str, memo: _Memo) -> tuple[float, float, list[dict]]:
        small = text.lower()
        words = _WORD.findall(small)
        segments = maximal_segments(_scores(words, memo))
        evidence = law.evidence(segments, len(words))
        return law.probability(evidence), evidence, _passages(text if len(small) == len(text) else small, segments, law, max(len(words), 1))

    known, law = model.words() if model.share else None, replace(model, toxic=None, all=None)  # tasks get the laws, not the counts

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Memo(known)
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                texts = part.column("text").to_pylist()
                out = list(zip(*(one(t, memo) for t in texts), strict=True)) if law.share else [[0.0] * len(texts), [0.0] * len(texts), [[]] * len(texts)]
                kept = {n: part.column(n) for n in part.schema.names if n != "text"}
                yield pa.RecordBatch.from_pydict(kept | {"score": pa.array(out[0]), "evidence": pa.array(out[1]), "passages": pa.array(out[2], passage)})

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.drop("text").schema.fields)
    found = rows.mapInArrow(work, f"{kinds}, score double, evidence double, passages array<struct<start:int,end:int,score:double,e_value:double>>")
    return found.select(F.col("id").alias(id_col), *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)], "score", "evidence", "passages")
