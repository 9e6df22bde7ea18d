"""Spelling variants: words one error apart, found by forward and backward minimal acyclic automata.

Of a word and one that is an error away, either the first halves are equal or what follows the first half is: the error
is in one of them. So a word looks for the others in a forward automaton, whose path its first half
takes exactly, and in a backward one (of reversed words) for its second half; the other half is completed with
one error. States carry the numbers of words below them, so a path's end is a word's number in order: a perfect hash.

The vocabulary is dealt out by halves: a task has the words that share a half with those that ask there, cuts
them into blocks of bounded size and makes an automaton of each. A half that too many words share is cut further: the error
is then in one quarter, and the rest, on both sides of it, is the key.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from string import ascii_lowercase, ascii_uppercase

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import written

MIN_LETTERS, MIN_COUNT = 7, 2
#: A form is at least so many times as frequent.
FACTOR = 10
RUN = "[A-Za-zÀ-ÿ]+"
#: Words of an automaton, and letters; beyond so many words a half is cut further.
BLOCK, BLOCK_LETTERS = 20_000, 1_000_000
#: Words that a task is dealt, about.
_DEALT = 200_000


class Automaton:
    """The minimal acyclic automaton of sorted, different words, with their numbers from 0."""

    def __init__(self, words: Sequence[str]) -> None:
        self.edges: list[dict[str, tuple[int, int]]] = []  # by state: letter to (state, words before those behind it)
        self.final: list[bool] = []
        below: list[int] = []
        known: dict[tuple, int] = {}
        path: list[list] = [[False]]  # the open states of the last word: final, then letter and state of each edge
        last = ""

        def close(depth: int) -> None:
            while len(path) > depth + 1:
                self._close(path.pop(), known, below)
                path[-1] += (last[len(path) - 1], self._made)

        for word in words:
            same = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                same += 1
            close(same)
            path += [[False] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        close(0)
        self._close(path.pop(), known, below)
        self.start = self._made

    def _close(self, state: list, known: dict[tuple, int], below: list[int]) -> None:
        """_made becomes the number of an equal state, or of this one as a new state."""
        key = tuple(state)
        made = known.get(key)
        if made is None:
            made = known[key] = len(self.edges)
            table, n = {}, int(state[0])
            for letter, child in zip(state[1::2], state[2::2], strict=True):
                table[letter] = (child, n)
                n += below[child]
            self.edges.append(table)
            self.final.append(state[0])
            below.append(n)
        self._made = made

    def _rest(self, state: int, word: str, at: int, number: int) -> int:
        """The number of the word that goes on exactly, or -1."""
        edges = self.edges
        for i in range(at, len(word)):
            step = edges[state].get(word[i])
            if step is None:
                return -1
            state, before = step
            number += before
        return number if self.final[state] else -1

    def near(self, word: str, exact: int) -> set[int]:
        """The numbers of the words that begin with the first ``exact`` letters and have one error after them."""
        state, number = self.start, 0
        for letter in word[:exact]:
            step = self.edges[state].get(letter)
            if step is None:
                return set()
            state, before = step
            number += before
        found, rest, size = set(), self._rest, len(word)
        for i in range(exact, size + 1):
            letter = word[i] if i < size else ""
            same = word[i - 1] if i > exact else ""  # an error at a letter's repeat gives what one at the letter gave
            for other, (child, before) in self.edges[state].items():
                if other != same:
                    found.add(rest(child, word, i, number + before))
                if letter and other != letter:
                    found.add(rest(child, word, i + 1, number + before))
            if not letter:
                break
            if letter != same:
                found.add(rest(state, word, i + 1, number))
            step = self.edges[state].get(letter)
            if step is None:
                break
            state, before = step
            number += before
        found.discard(-1)
        return found


def occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, run): the runs of letters of at least MIN_LETTERS, with A-Z in small letters."""
    runs = F.filter(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0)), lambda r: F.length(r) >= MIN_LETTERS)
    found = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    return found.withColumn("run", F.translate("run", ascii_uppercase, ascii_lowercase))


def with_slips(found: DataFrame, every: int = 31) -> DataFrame:
    """Some runs with a letter left out: where the CRC-32 of id and run says so. Made, not found, errors; runs of a null id have none."""
    hashed = F.crc32(F.concat(F.col("id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    place = (F.col("_h") % F.length("run")).cast("int")
    slip = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.length("run")))
    return found.withColumn("_h", hashed).withColumn("run", F.when(F.coalesce(F.col("_h") % every == 0, F.lit(False)), slip).otherwise(F.col("run"))).drop("_h")


def vocabulary(found: DataFrame) -> DataFrame:
    """(word, n): the different runs that are long and frequent enough; counts are combined before the shuffle."""
    return found.where(F.length("run") >= MIN_LETTERS).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def _key() -> Column:
    """What is exact before and after the place of the error; its lengths are those of the two parts."""
    return F.concat(F.expr("substr(word, 1, head)"), F.lit("|"), F.expr("substr(word, length(word) - tail + 1)"))


def _halves(words: DataFrame) -> DataFrame:
    """(word, n, head, tail, asks, key): a word under the halves of words as long as it, a letter shorter and a letter longer.

    asks: under this key the word looks for others; under the rest it only is there to be found.
    """
    size, half = F.length("word"), F.floor(F.length("word") / 2).cast("int")
    other = F.when(size % 2 == 0, half - 1).otherwise(half + 1)
    place = lambda head, tail, asks: F.struct(head.cast("int").alias("head"), tail.cast("int").alias("tail"), F.lit(asks).alias("asks"))
    none = F.lit(0)
    tail = size - half
    other_tail = F.when(size % 2 == 0, tail + 1).otherwise(tail - 1)
    places = F.array(place(half, none, True), place(other, none, False), place(none, tail, True), place(none, other_tail, False))
    return words.select("word", "n", F.inline(places)).withColumn("key", _key())


def _cut(rows: DataFrame) -> DataFrame:
    """The rows of keys that too many words share, under longer keys.

    Where one letter or none is between head and tail the key stays; as only words with two letters
    there at most can be found by it, these are few. Otherwise the middle is cut in two halves, again by the lengths that an asking word may have.
    """
    size = F.length("word")
    between = size - F.col("head") - F.col("tail")
    stay = rows.where(between <= 2).withColumn("asks", F.col("asks") & (between <= 1))
    places = []
    for other in (-1, 0, 1):
        middle = F.floor((F.col("head") + size + other - F.col("tail")) / 2).cast("int")
        asks = F.col("asks") & F.lit(other == 0)
        fits = between + other >= 2
        places.append(F.when(fits, F.struct(middle.alias("head"), F.col("tail").alias("tail"), asks.alias("asks"))))
        places.append(F.when(fits, F.struct(F.col("head").alias("head"), (size + other - middle).alias("tail"), asks.alias("asks"))))
    cut = rows.select("word", "n", F.inline(F.array_compact(F.array(*places)))).groupBy("word", "n", "head", "tail").agg(F.max("asks").alias("asks")).withColumn("key", _key())
    return cut.unionByName(stay.select(*cut.columns))


def _keyed(words: DataFrame, block: int) -> DataFrame:
    """The rows of _halves(), cut until no key has more than ``block`` words."""
    rows, done = _halves(words), None
    while True:
        hot = written(rows.groupBy("key").count().where(F.col("count") > block).select("key"), "hot")
        if hot.isEmpty():
            return rows if done is None else done.unionByName(rows)
        rest = rows.join(hot, "key", "left_anti").select(*rows.columns)
        done = rest if done is None else done.unionByName(rest)
        # Two letters between head and tail make few words, so such keys aren't hot again.
        rows = written(_cut(rows.join(hot, "key", "left_semi").select(*rows.columns)).distinct(), "cut")


def _pairs(block: list[tuple[str, int, str, bool]]) -> Iterator[tuple[str, str, int]]:
    """(word, near word, its n) of a block; forward for keys with the longer head, backward for the others."""
    counts = {word: n for word, n, _, _ in block}
    for backward in (False, True):
        part = [(word, key.index("|"), len(key) - key.index("|") - 1, asks) for word, _, key, asks in block]
        part = [(word, head, tail, asks) for word, head, tail, asks in part if (tail > head) == backward]
        if not any(asks for *_, asks in part):
            continue
        turn = slice(None, None, -1 if backward else 1)
        words = sorted({word[turn] for word, *_ in part})
        automaton = Automaton(words)
        for word, head, tail, asks in part:
            if asks:
                for number in automaton.near(word[turn], tail if backward else head):
                    other = words[number][turn]
                    yield word, other, counts[other]


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[tuple[str, int, str, bool]]]:
    """The rows, which come sorted by key, in blocks of whole keys."""
    block: list[tuple[str, int, str, bool]] = []
    key_at, letters = 0, 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("word", "n", "key", "asks")], strict=True):
            if block and row[2] != block[-1][2]:
                key_at = len(block)
                if key_at >= size or letters >= BLOCK_LETTERS:
                    yield block
                    block, letters = [], 0
            block.append(row)
            letters += len(row[0])
    if block:
        yield block


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, other, other_n): the pairs of ``words`` (word, n) that one inserted, deleted or replaced code point tells apart, in both orders."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches, block):
            found = list(_pairs(rows))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], names=["word", "other", "other_n"])

    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * words.count() // _DEALT + 1)
    rows = _keyed(words, block).select("word", "n", "key", "asks").repartition(parts, "key").sortWithinPartitions("key")
    # Both directions, and several blocks, may find a pair. A word has few near words, so pairs are dealt out by the word alone.
    return rows.mapInArrow(work, "word string, other string, other_n long").repartition("word").dropDuplicates(["word", "other"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms lead to from each word of ``forms`` (word, form), by pointer doubling."""
    up = written(forms.selectExpr("word", "form as root"), "roots")
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("top"))
        step = written(up.join(over, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "roots")
        up = step.select("word", "root")
        if step.where("moved").isEmpty():
            return up


def variants(words: DataFrame, factor: int = FACTOR, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of ``words`` (word, n; different, not null, without a bar).

    form: the most frequent near word (ties: the first in order of code points) if it is at least ``factor`` times as frequent as
    the word, else null; as counts grow by that, forms make no circle. root: where forms end, the word itself without one. An empty table gives
    an empty one; words of any length are treated alike, a letter of a very long one takes some 400 bytes of a task.
    """
    words = written(words.select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words, block).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("form"))).alias("best"))
    enough = -F.col("best.n") >= factor * F.col("n")
    forms = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")
    )
    forms = written(forms, "forms")
    up = roots(forms.where("form is not null"))
    return forms.join(up, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slips: int | None = None) -> DataFrame:
    """variants() of the words of ``docs``: maximal runs of letters, with A-Z in small letters.

    Words have at least MIN_LETTERS code points and MIN_COUNT occurrences. Null and empty texts have none; repeated rows and ids count
    as often as they stand; other columns, whatever their names, aren't read. ``slips``: leave a letter out of one run in so many (with_slips()).
    """
    found = occurrences(docs, id_col, text_col)
    return variants(vocabulary(with_slips(found, slips) if slips else found))


#: The query's rows for DuckDB: near words by the word with each letter left out.
SQL = r"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(unnest(list_filter(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+'), lambda r: length(r) >= 7)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
bytes AS (SELECT *, flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [195::UBIGINT, (unicode(c) - 64)::UBIGINT] END)) AS b FROM each),
crc AS (SELECT *, xor(list_reduce(b, lambda h, c: list_reduce([xor(h, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x // 2, 3988292384 * (x % 2))), CAST(4294967295 AS UBIGINT)), 4294967295) AS h FROM bytes),
slips AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM crc),
words AS (SELECT word, sum(n)::BIGINT AS n FROM slips WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
pairs AS (SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.rest = b.rest AND a.p = b.p AND a.word != b.word
  UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
  UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word),
best AS (SELECT word, count(*) AS n_near FROM pairs GROUP BY word),
first AS (SELECT word, other, other_n, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS k FROM pairs),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN first f ON f.word = w.word AND f.k = 1),
up AS (SELECT word, word AS root, 0 AS d FROM forms UNION ALL SELECT up.word, f.form, d + 1 FROM up JOIN forms f ON f.word = up.root WHERE f.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(root, d) FROM up WHERE up.word = forms.word) AS root, n, n_near, form_n FROM forms
"""
