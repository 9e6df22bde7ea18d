"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A rating is graded 0 (toxic), 1 (low quality) or 2 (good). One score s = w.x, with the same
weights for all thresholds, and ordered cuts c0 <= c1 give P(grade <= k) =
sigmoid(c_k - s). x holds hashed text features of a whole document; expected
grade and tail probability P(grade >= k) follow.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.shared import free_name

#: At most so many labelled rows are drawn (by hash of the id) to fit the classifier; a parameter of fit().
MAX_RATED = 12_000
GRADES = 3
BUCKETS = 1 << 20
#: A feature is used if its chi-square against a cut exceeds that cut's value and it stands in so many rated documents.
MIN_CHI2, MIN_DOCS = (25.0, 40.0), 4
_ROWS = 256
_WORD = re.compile(r"\w+")
_SIGN_RUN = re.compile(r"[^\w\s]{2,}")
#: Words that a worker remembers, and their most characters.
_MEMO, _MEMO_CHARS = 100_000, 32


def _bucket(kind: str, value: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}:{value}") % BUCKETS


def _word_buckets(word: str) -> tuple[int, ...]:
    """Of a lower-cased word: itself and its beginnings, which catch inflected and compound forms."""
    return tuple(_bucket(kind, value) for kind, value in (("w", word), ("4", word[:4]), ("5", word[:5])) if kind == "w" or len(word) >= int(kind))


def _shape_buckets(text: str, words: list[str]) -> list[int]:
    """How a document looks, in steps: shares of capitals, signs, different words, words repeated at once, runs of signs and bars."""
    n, chars = max(len(words), 1), max(len(text), 1)
    letters = max(sum(map(len, words)), 1)
    upper = sum(map(len, re.findall(r"[A-ZÀ-Þ]", text))) / letters
    signs = (chars - letters - text.count(" ") - text.count("\n")) / chars
    kinds = len(set(words)) / n
    again = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    size = min(n.bit_length(), 8)
    steps = (("upper", upper, 10), ("signs", signs, 20), ("again", again, 10), (f"kinds{size}", kinds, 10), ("runs", len(_SIGN_RUN.findall(text)) / n, 10), ("bars", text.count(" | ") / n, 10))
    return [_bucket(kind, str(int(share * scale))) for kind, share, scale in steps] + [_bucket("size", str(size))]


class _Features:
    """Hashed features of texts; words' buckets are remembered up to a bound."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, ...]] = {}

    def of(self, text: str | None) -> list[int]:
        text = text or ""
        words = _WORD.findall(text.lower())
        if len(self.memo) > _MEMO:
            self.memo.clear()
        found = set(_shape_buckets(text, words))
        for word in set(words):
            known = self.memo.get(word)
            if known is None:
                known = _word_buckets(word)
                if len(word) <= _MEMO_CHARS:
                    self.memo[word] = known
            found.update(known)
        return sorted(found)


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by bucket (only those used) and the ordered cuts."""

    buckets: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - score[:, None], -50, 50)))


def rated(docs: DataFrame, ratings: DataFrame, max_rated: int = MAX_RATED, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[np.ndarray], np.ndarray]:
    """Features and grades of at most ``max_rated`` rated documents, the same for every partitioning.

    ratings: (id, quality, toxic). Of repeated ratings of an id the worst counts; rows with
    a null id or quality are left out, a null toxic is 0. Of documents that repeat an id the
    least text counts, so no more than ``max_rated`` rows reach the driver.
    """
    grade = F.when(F.coalesce("toxic", F.lit(0)) != 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    one = ratings.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(grade).alias("grade"))
    # limit() after an order is the bound on what is broadcast and collected.
    one = one.orderBy(F.xxhash64("id"), "id").limit(max_rated)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = _Features()
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                x = [features.of(t.as_py()) for t in part.column(2)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(x, pa.list_(pa.int32()))], names=["id", "grade", "x"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    # A row an id: of documents that repeat an id the least text counts.
    rows = texts.join(F.broadcast(one), "id").groupBy("id", "grade").agg(F.min("t").alias("t"))
    rows = rows.mapInArrow(work, "id long, grade int, x array<int>")
    got = rows.toArrow()
    grades = got.column("grade").to_numpy()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    lists = [part.flatten().to_numpy() for part in got.column("x").chunks]
    ends = np.cumsum(np.concatenate([[0], *[part.value_lengths().to_numpy() for part in got.column("x").chunks]]).astype(np.int64))
    flat = np.concatenate([np.empty(0, np.int32), *lists])
    return [flat[ends[i] : ends[i + 1]] for i in order], grades[order]


def fit(x: Sequence[Sequence[int]], grades: np.ndarray, steps: int = 300, l2: float = 1e-3, rate: float = 0.1) -> OrdinalModel | None:
    """The cumulative-link model by full-batch Adam. None without two grades to tell apart."""
    if len(np.unique(grades)) < 2:
        return None
    rows = np.repeat(np.arange(len(x), dtype=np.int32), [len(r) for r in x])
    cols = np.concatenate([np.asarray(r, np.int32) for r in x])
    total = np.bincount(cols, minlength=BUCKETS).astype(float)
    use = np.zeros(BUCKETS, bool)
    n = len(x)
    for k in range(GRADES - 1):
        low = grades <= k
        n1 = low.sum()
        if 0 < n1 < n:
            a = np.bincount(cols, weights=low[rows], minlength=BUCKETS)
            b, c = total - a, n1 - a
            d = n - n1 - b
            with np.errstate(divide="ignore", invalid="ignore"):
                chi = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * n1 * (n - n1))
            use |= (np.nan_to_num(chi) > MIN_CHI2[k]) & (total >= MIN_DOCS)
    buckets = np.flatnonzero(use)
    place = np.full(BUCKETS, -1)
    place[buckets] = np.arange(len(buckets))
    inside = place[cols] >= 0
    rows, cols = rows[inside], place[cols[inside]]
    w = np.zeros(len(buckets))
    share = np.clip([np.mean(grades <= k) for k in range(GRADES - 1)], 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    # cuts: the first, and the log of the steps between, so that they stay in order
    p = np.concatenate([w, [first[0]], np.log(np.maximum(np.diff(first), 1e-2))])
    m, v, nb = np.zeros_like(p), np.zeros_like(p), len(buckets)
    for t in range(1, steps + 1):
        gaps = np.exp(p[nb + 1 :])
        cuts = p[nb] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(rows, weights=p[cols], minlength=n)
        f = 1 / (1 + np.exp(-np.clip(cuts[None, :] - score[:, None], -50, 50)))
        edge = np.column_stack([np.zeros(n), f, np.ones(n)])
        slope = np.column_stack([np.zeros(n), f * (1 - f), np.zeros(n)])
        at = np.arange(n)
        prob = np.maximum(edge[at, grades + 1] - edge[at, grades], 1e-12)
        up, down = slope[at, grades + 1] / prob, slope[at, grades] / prob
        g_score = up - down  # of minus log-likelihood
        g_cuts = np.array([-(up[grades == k].sum() - down[grades == k + 1].sum()) for k in range(GRADES - 1)]) / n
        g = np.concatenate([np.bincount(cols, weights=g_score[rows], minlength=nb) / n + l2 * p[:nb], [g_cuts.sum()], [g_cuts[k + 1 :].sum() * gaps[k] for k in range(GRADES - 2)]])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    cuts = p[nb] + np.concatenate([[0], np.cumsum(np.exp(p[nb + 1 :]))])
    return OrdinalModel(buckets, p[:nb], cuts)


def scored(docs: DataFrame, model: OrdinalModel | None, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with expected_grade, p_ge_1 and p_ge_2 (doubles, null without a model). One pass, no shuffle.

    Null and empty texts are scored by their shape alone; repeated rows are scored row by row; an empty table
    gives no rows. Column names get ``prefix`` and, where taken, underscores.
    """
    names = []
    for c in ("expected_grade", "p_ge_1", "p_ge_2"):
        names.append(free_name(docs, prefix + c))
    if model is None:
        return docs.withColumns({c: F.lit(None).cast("double") for c in names})
    schema = pa.schema([(c, pa.float64()) for c in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = dict(zip(model.buckets.tolist(), model.weights.tolist(), strict=True))
        memo: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            at_col = batch.schema.get_field_index(text_col)
            for at in range(0, max(batch.num_rows, 1), _ROWS):
                part = batch.slice(at, _ROWS)
                score = np.zeros(part.num_rows)
                for i, value in enumerate(part.column(at_col)):
                    text = str(value.as_py() or "")
                    words = _WORD.findall(text.lower())
                    if len(memo) > _MEMO:
                        memo.clear()
                    found = {b for b in _shape_buckets(text, words) if b in weight}
                    for word in set(words):
                        known = memo.get(word)
                        if known is None:
                            known = tuple(b for b in _word_buckets(word) if b in weight)
                            if len(word) <= _MEMO_CHARS:
                                memo[word] = known
                        if known:
                            found.update(known)
                    score[i] = sum(weight[b] for b in sorted(found))
                tails = model.tails(score)
                new = [tails.sum(1), tails[:, 0], tails[:, 1]]
                out = [*part.columns, *[pa.array(c) for c in new]]
                yield pa.RecordBatch.from_arrays(out, schema=pa.schema([*part.schema, *schema]))

    return docs.mapInArrow(work, T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names]]))


def classify(docs: DataFrame, ratings: DataFrame, max_rated: int = MAX_RATED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fit on rated rows of ``docs``, then score every row of ``docs`` (see scored())."""
    return scored(docs, fit(*rated(docs, ratings, max_rated, id_col, text_col)), text_col)


def keep_good(docs: DataFrame, ratings: DataFrame, least: float = 0.5, max_rated: int = MAX_RATED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose P(grade >= 2) is ``least`` or more; all rows if no ratings tell grades apart. Columns stay, whatever their names.

    Null and empty texts are graded by their shape alone; repeated rows stay or go together; an empty table gives no rows.
    """
    tail = free_name(docs, "p_ge_2")
    return classify(docs, ratings, max_rated, id_col, text_col).where(F.col(tail).isNull() | (F.col(tail) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
