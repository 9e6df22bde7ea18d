"""Line dedup over windows of three consecutive lines, in DataFrame functions alone.

Documents are read in order of id. Every window of three consecutive lines is
hashed; of windows with equal hash the first in (id, line) order stays, and the lines that a later
one covers are removed, merged over overlapping windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import free_name, written

WINDOW = 3
#: First lines of later windows, and documents that have such, up to which Spark may broadcast their list.
SMALL = 1_000_000


def later_windows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, starts): the sorted first lines (from 0) of the windows that an earlier one equals, only of documents that have such."""
    lines = F.split(F.col(text_col).cast("string"), "\n", -1)
    # Two hashes of 64 bits, the second with another seed: at 10^12 windows one would take thousands of pairs for equal that aren't.
    both = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    hashed = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), both.alias("h"))
    count = F.size("h") - (WINDOW - 1)
    at = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    mixed = lambda i, part: F.xxhash64(*[F.get("h", i + k)[part] for k in range(WINDOW)])
    windows = F.transform(at, lambda i: F.struct(mixed(i, "a").alias("v"), mixed(i, "b").alias("w"), i.alias("pos")))
    windows = hashed.select("id", F.explode(windows).alias("x")).select("id", "x.v", "x.w", "x.pos")
    first = windows.groupBy("v", "w").agg(F.min(F.struct("id", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(first.select("v", "w", "first"), ["v", "w"]).where("id != first.id or pos != first.pos")
    return later.groupBy("id").agg(F.array_sort(F.collect_set("pos")).alias("starts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", removed_col: str | None = "n_removed") -> DataFrame:
    """``docs`` with the text without lines of later windows, and with the number of lines removed as ``removed_col`` (None: left out).

    Lines are what stands between \\n, compared exactly by 128 bits of hashes;
    blank lines count. A text of fewer than three lines, an empty and a null
    text stay as they are; a text that loses every line becomes empty. The
    order is by id, then by line, so the copy in the smallest id stays; within
    a document the same rule holds. Rows with a null id are left alone. Ids should
    be unique: rows with equal ids lose the lines that any of them loses.
    An empty table gives an empty table. Other columns stay as they are.

    Window hashes are combined to minima before the shuffle, and the join back
    splits hot hashes (adaptive skew join), so a window that many documents
    share meets in no single task.
    """
    key, lines, starts = free_name(docs, "key_"), free_name(docs, "lines_"), free_name(docs, "starts_")
    later = written(later_windows(docs, id_col, text_col), "windows")
    # The list's file is so compressed that its size says little of what a broadcast would hold.
    if (later.agg(F.sum(F.size("starts") + 1)).first()[0] or 0) > SMALL:
        later = later.hint("merge")
    later = later.select(F.col("id").alias(key), F.col("starts").alias(starts))
    # Lines are cut below the join: above it they are a column, not an expression to repeat for each slice.
    cut = docs.withColumn(lines, F.split(F.col(text_col), "\n", -1)).drop(text_col)
    joined = cut.join(later, cut[id_col] == later[key], "left").drop(key)
    after = lambda s, i: F.slice(lines, s + (WINDOW + 1), F.greatest(F.coalesce(F.get(starts, i + 1), F.size(lines)) - s - WINDOW, F.lit(0)))
    kept = F.concat(F.slice(lines, F.lit(1), F.get(starts, F.lit(0))), F.flatten(F.transform(starts, after)))
    joined = joined.withColumn(starts, F.when(F.col(starts).isNotNull(), kept))
    text = F.array_join(F.coalesce(starts, lines), "\n")
    columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if removed_col:
        columns.append(F.coalesce(F.size(lines) - F.size(starts), F.lit(0)).cast("long").alias(removed_col))
    return joined.select(*columns)


#: The query's rows for DuckDB over whole tables; windows are compared by their lines instead of hashes.
SQL = r"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, p, l[p + 1] || chr(10) || l[p + 2] || chr(10) || l[p + 3] AS w
      FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS p FROM s WHERE len(l) >= 3)),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM w),
g AS (SELECT DISTINCT doc_id, p + d AS p FROM r, (VALUES (0), (1), (2)) AS v(d) WHERE k > 1),
x AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS p FROM s),
k AS (SELECT x.doc_id, string_agg(CASE WHEN g.p IS NULL THEN x.line END, chr(10) ORDER BY x.p) AS text, count(g.p) AS n_removed
      FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id
"""
