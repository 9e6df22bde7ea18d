"""Merkle manifest of a table: a tree for each group of rows, and one over the groups' roots.

A row's leaf is the SHA-256 of its fields. Leaves are numbered by group; ``fanout ** levels``
consecutive ones are a superblock, which one task collapses to its root, some levels at once.
Superblock roots are collapsed in the same way until a group has one, and then proofs
are handed down: a node's is that within its superblock, followed by its superblock root's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.shared import written

#: Fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Levels that a superblock spans: 4,096 nodes of it at a fanout of 2.
LEVELS = 12
_NODE = "tree string, index long, total long, digest string"


def leaf_digest(fields: Sequence[Column]) -> Column:
    """The leaf of a row: SHA-256 of its fields, each as its length in bytes, a colon and its text; a null one as ``-``."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)


def _parent(nodes: Sequence[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def _height(total: int, fanout: int, most: int) -> int:
    """Levels from ``total`` nodes to a single one, ``most`` at most."""
    height = 0
    while total > 1 and height < most:
        total, height = -(-total // fanout), height + 1
    return height


def _climb(nodes: list[str], fanout: int, height: int) -> list[list[str]]:
    """The nodes of each level of a superblock, its own first."""
    out = [nodes]
    for _ in range(height):
        nodes = [_parent(nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        out.append(nodes)
    return out


def _siblings(levels: list[list[str]], fanout: int, at: int) -> tuple[list[str], list[str]]:
    """What stands before and after a node in its run, level by level."""
    before, after = [], []
    for nodes in levels[:-1]:
        first = at - at % fanout
        before.append("".join(nodes[first:at]))
        after.append("".join(nodes[at + 1 : first + fanout]))
        at //= fanout
    return before, after


def _numbered(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with index (from 0, in the ``order`` within a ``tree``) and total, the rows of the tree.

    Rows are sorted by ranges, so a large tree is split over tasks; a table of one row for each range and
    tree then says where the ranges start. Wholly equal rows are told apart by a salt, so they can't fill a range.
    """
    keys = [tree, *order, "_salt"]
    ranged = rows.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = written(ranged.withColumn("_salt", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("_salt", 33)
    spans = placed.groupBy(F.col(tree).alias("_tree"), part.alias("_part")).agg(F.min("_salt").alias("_low"), F.count("*").alias("_n"))
    spans = spans.selectExpr("_tree", "_part", "_low - sum(_n) over (partition by _tree order by _part) + _n as _shift", "sum(_n) over (partition by _tree) as total")
    spans = written(spans, "spans")
    numbered = placed.join(spans, (F.col(tree) == F.col("_tree")) & (part == F.col("_part")))
    return numbered.withColumn("index", F.col("_salt") - F.col("_shift")).drop("_salt", "_tree", "_part", "_shift")


def _collapse(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """The roots of the superblocks of ``nodes`` as the nodes above."""
    size = fanout**levels

    def work(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("index")
        total = int(part["total"].iloc[0])
        top = _climb(part["digest"].tolist(), fanout, _height(total, fanout, levels))[-1]
        return pd.DataFrame({"tree": part["tree"].iloc[:1], "index": [int(part["index"].iloc[0]) // size], "total": [-(-total // size)], "digest": top})

    block = F.floor(F.col("index") / size).cast("long").alias("block")
    return nodes.select("tree", "index", "total", "digest").groupBy("tree", block).applyInPandas(work, _NODE)


def _hand_down(nodes: DataFrame, above: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` with subroot, root and proof: siblings within the superblock, then those of its root in ``above``."""
    size = fanout**levels
    out = T.StructType([*nodes.schema.fields, *(above.schema[c] for c in ("subroot", "root", "before", "after"))])

    def work(part: pa.Table, top: pa.Table) -> pa.Table:
        part = part.sort_by("index")
        total = part["total"][0].as_py()
        tree = _climb(part["digest"].to_pylist(), fanout, _height(total, fanout, levels))
        up_before, up_after = top["before"][0].as_py(), top["after"][0].as_py()
        proofs = [_siblings(tree, fanout, i) for i in range(part.num_rows)]
        for name in ("subroot", "root"):
            part = part.append_column(name, pa.array([top[name][0].as_py()] * part.num_rows, pa.string()))
        for name, side, rest in (("before", 0, up_before), ("after", 1, up_after)):
            part = part.append_column(name, pa.array([p[side] + rest for p in proofs], pa.list_(pa.string())))
        return part.drop_columns(["block"])

    blocked = nodes.withColumn("block", F.floor(F.col("index") / size).cast("long"))
    return blocked.groupBy("tree", "block").cogroup(above.withColumn("block", F.col("index")).groupBy("tree", "block")).applyInArrow(work, out)


def _proofs(leaves: DataFrame, crown: Callable[[DataFrame], DataFrame], fanout: int, levels: int) -> DataFrame:
    """``leaves`` with subroot, root, before and after; ``crown`` gives those of the trees' own roots."""
    steps = [leaves]
    while (steps[-1].agg(F.max("total")).first()[0] or 0) > 1:
        steps.append(written(_collapse(steps[-1], fanout, levels), "nodes"))
    above = crown(steps[-1])
    for nodes in steps[-2::-1] or [leaves]:
        above = _hand_down(nodes, above, fanout, levels)
        if nodes is not leaves:
            above = written(above, "proofs")
    return above


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS, fanout: int = FANOUT, levels: int = LEVELS, carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of ``docs``: its id, group, index in the group, leaf, subroot, root and proof, and the columns of ``carry``.

    before and after hold, for each level from the leaf up to the root, the joined digests of
    what stands before and after the node in its run of ``fanout``; both are empty where it is alone.
    Rows of a group are in order of (id, leaf), a null id first; wholly equal rows are as many leaves. A null group is a group of its own,
    first in order; groups follow the bytes of their text. Empty texts have a length of 0, null fields are a sign of their own. An empty table gives an empty
    manifest. Other columns count for nothing unless they are in ``fields`` or ``carry``, whatever their names.

    Only digests are sorted and shuffled, never texts, and no task has more than ``fanout ** levels`` nodes of a superblock at a time.
    """
    carry = carry or {}
    extra = {f"carry{i}": c for i, c in enumerate(carry.values())}
    group = docs[group_col].cast("string")
    # The sign before the text keeps a null group apart, and before the others in the order of bytes.
    tree = F.coalesce(F.concat(F.lit("="), group), F.lit("-"))
    leaves = docs.select(tree.alias("tree"), docs[id_col].alias("id"), leaf_digest([docs[f] for f in fields]).alias("digest"), *[c.alias(n) for n, c in extra.items()])
    # Written, as sorting by ranges looks at its input twice.
    leaves = _numbered(written(leaves, "leaves"), "tree", ["id", "digest"])

    def whole(root: DataFrame) -> DataFrame:
        none = F.array().cast("array<string>")
        return written(root.select("tree", "index", F.lit("").alias("subroot"), F.col("digest").alias("root"), none.alias("before"), none.alias("after")), "root")

    def crown(subroots: DataFrame) -> DataFrame:
        """The tree over the groups' roots."""
        groups = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("digest"))
        proofs = _proofs(_numbered(groups, "tree", ["of"]), whole, fanout, levels)
        return written(proofs.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("index"), F.col("digest").alias("subroot"), "root", "before", "after"), "crown")

    found = _proofs(leaves, crown, fanout, levels)
    group = F.when(F.col("tree") != "-", F.expr("substr(tree, 2)"))
    return found.select(F.col("id").alias(id_col), group.alias(group_col), F.col("index").alias("position"), F.col("digest").alias("leaf"), "subroot", "root", "before", "after", *[F.col(n).alias(c) for n, c in zip(extra, carry, strict=True)])


def fold(leaf: Column, before: Column, after: Column) -> Column:
    """The root that a leaf and a proof give."""
    steps = F.zip_with(before, after, lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    return F.aggregate(steps, leaf, lambda digest, s: F.sha2(F.concat(s["b"], digest, s["a"]), 256))


def proof_digest(before: Column, after: Column) -> Column:
    """SHA-256 of a proof's digests, level by level, left to right."""
    return F.sha2(F.array_join(F.zip_with(before, after, lambda b, a: F.concat(b, a)), ""), 256)


def audit(kept: DataFrame, docs: DataFrame, id_col: str = "doc_id", fields: Sequence[str] = FIELDS) -> DataFrame:
    """(id, status) of the rows of ``docs`` and of a manifest: same, changed, added (no such id in the manifest) or missing (none in ``docs``).

    A row is the same if its own leaf gives the root with the proof kept for its id. Null ids are an id, too. With
    repeated ids a row is the same if any proof of its id gives the root.
    """
    key = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-"))
    now = docs.select(key(docs[id_col]).alias("k"), docs[id_col].alias("id_now"), leaf_digest([docs[f] for f in fields]).alias("now")).distinct()
    then = kept.select(key(kept[id_col]).alias("k"), kept[id_col].alias("id_then"), "before", "after", "root", F.lit(True).alias("known"))
    both = then.join(now, "k", "full")
    status = F.when(F.col("now").isNull(), "missing").when(F.col("known").isNull(), "added").when(fold(F.col("now"), F.col("before"), F.col("after")) == F.col("root"), "same").otherwise("changed")
    rank = F.max(F.when(status == "same", 1).otherwise(0))
    return both.groupBy("k", "now").agg(F.first(F.coalesce("id_now", "id_then")).alias(id_col), F.max(status).alias("s"), rank.alias("r")).select(id_col, F.when(F.col("r") == 1, "same").otherwise(F.col("s")).alias("status"))


#: The query's rows for DuckDB: levels by recursion, proofs by following each leaf up.
SQL = r"""
WITH RECURSIVE bits AS (SELECT doc_id, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT)) AS b FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)),
crc AS (SELECT doc_id, xor(list_reduce(b, lambda h, c: list_reduce([xor(h, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x // 2, 3988292384 * (x % 2))), CAST(4294967295 AS UBIGINT)), 4294967295) AS h FROM bits),
field AS (SELECT doc_id, lang, n_chars, coalesce(h % 7 = 0, false) AS bad,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents LEFT JOIN crc USING (doc_id)),
leaf AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(CAST(n_chars + bad::INT AS VARCHAR)) || ':' || (n_chars + bad::INT), '-') || tail) AS now FROM field),
placed AS (SELECT *, coalesce('=' || lang, '-') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaf),
up AS (SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM up WHERE n > 1 GROUP BY tree, level, pos // 2),
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos FROM up WHERE n = 1),
top AS (SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM sub
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 1) // 2 FROM top WHERE n > 1 GROUP BY level, pos // 2),
root AS (SELECT h AS root FROM top WHERE n = 1),
way AS (SELECT p.tree, p.pos AS leaf_pos, p.now AS h, '' AS proof, 0 AS level, p.pos, u.n FROM placed p JOIN up u ON u.tree = p.tree AND u.level = 0 AND u.pos = p.pos
  UNION ALL SELECT w.tree, w.leaf_pos, sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END), w.proof || coalesce(s.h, ''), w.level + 1, w.pos // 2, (w.n + 1) // 2
  FROM way w LEFT JOIN up s ON s.tree = w.tree AND s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1),
way2 AS (SELECT w.tree, w.leaf_pos, w.h, w.proof, 0 AS level, s.pos, (SELECT count(*) FROM sub) AS n FROM way w JOIN sub s ON s.tree = w.tree WHERE w.n = 1
  UNION ALL SELECT w.tree, w.leaf_pos, sha256(CASE WHEN w.pos % 2 = 1 THEN s.h || w.h ELSE w.h || coalesce(s.h, '') END), w.proof || coalesce(s.h, ''), w.level + 1, w.pos // 2, (w.n + 1) // 2
  FROM way2 w LEFT JOIN top s ON s.level = w.level AND s.pos = xor(w.pos, 1) WHERE w.n > 1)
SELECT p.doc_id, p.leaf, sub.subroot, root.root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = root.root AS verified
FROM placed p JOIN sub ON sub.tree = p.tree CROSS JOIN root JOIN way2 w ON w.tree = p.tree AND w.leaf_pos = p.pos AND w.n = 1
"""
