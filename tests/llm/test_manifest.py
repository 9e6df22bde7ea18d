"""The Merkle manifest against a tree that is built whole."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long, root string, index int, tree string"


def H(text):
    return sha256(text.encode()).hexdigest()


def brute_leaf(row):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H("".join(field(row[f]) for f in merkle.FIELDS))


def brute_tree(nodes, fanout):
    """The root, and each node's proof as (before, after) by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for proof, i in zip(proofs, range(len(at)), strict=True):
            p = at[i]
            first = p // fanout * fanout
            proof.append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + fanout])))
            at[i] = p // fanout
        nodes = [H("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
    return nodes[0], proofs


def brute_manifest(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, brute_leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: brute_tree([leaf for *_, leaf in sorted(groups[g])], fanout) for g in order}
    root, upper = brute_tree([trees[g][0] for g in order], fanout)
    out = []
    for g, up in zip(order, upper, strict=True):
        for i, ((known, doc, leaf), proof) in enumerate(zip(sorted(groups[g]), trees[g][1], strict=True)):
            whole = proof + up
            out.append((doc if known else None, g, i, leaf, trees[g][0], root, [b for b, _ in whole], [a for _, a in whole]))
    return sorted(out, key=repr)


def some_rows(n):
    langs = ["en"] * 6 + ["de", "é", "", None]
    rows = [(i, f"text {i}" * (i % 3), langs[i * 7 % 10], None if i % 5 == 0 else f"s{i % 4}", None if i % 11 == 0 else i, "r", 1, "t") for i in range(n)]
    rows += [(None, None, None, None, None, "r", 1, "t"), (None, "x", "en", "s", 3, "r", 1, "t"), (3, "other", "en", "s", 3, "r", 1, "t"), (n, "lone", "xx", "s", 3, "r", 1, "t"), (n + 1, "é" * 100_000, "en", "s", 3, "r", 1, "t")]
    return rows + [(1, "same", "en", "s", 4, "r", 1, "t")] * 9


@pytest.mark.parametrize(("n", "fanout", "levels"), [(300, 2, 3), (120, 3, 2), (40, 5, 12)])
def test_manifest_against_brute_force(spark, n, fanout, levels):
    docs = spark.createDataFrame(some_rows(n), DOCS)
    got = merkle.manifest(docs.repartition(7), fanout=fanout, levels=levels, carry={"tree": F.col("tree")})
    rows = sorted((tuple(r)[:-1] for r in got.collect()), key=repr)
    assert rows == brute_manifest([r.asDict() for r in docs.collect()], fanout)
    assert got.where("tree != 't'").count() == 0
    folded = got.withColumn("ok", merkle.fold(F.col("leaf"), F.col("before"), F.col("after")) == F.col("root"))
    assert folded.where("not ok").count() == 0


def test_manifest_of_small_tables(spark):
    docs = spark.createDataFrame(some_rows(20), DOCS)
    assert merkle.manifest(docs.where("false")).count() == 0
    one = merkle.manifest(docs.where("doc_id = 20")).first()
    assert one.leaf == one.subroot == one.root and one.before == one.after == [] and one.lang == "xx"
    lone = docs.where("doc_id in (6, 20)").withColumn("lang", F.col("doc_id").cast("string"))  # only groups of one row
    first, last = merkle.manifest(lone).orderBy("lang").collect()
    assert (first.before, first.after, last.before, last.after) == ([""], [last.leaf], [first.leaf], [""])


def test_audit(spark):
    docs = spark.createDataFrame(some_rows(40), DOCS)
    kept = merkle.manifest(docs, levels=2)
    now = docs.withColumn("text", F.when(F.col("doc_id") == 7, "altered").otherwise(F.col("text"))).where("doc_id is null or doc_id != 9")
    now = now.unionByName(docs.where("doc_id = 5").withColumn("doc_id", F.lit(999).cast("long")))
    status = {}
    for r in merkle.audit(kept, now).collect():
        status.setdefault(r.status, set()).add(r.doc_id)
    assert status["changed"] == {7} and status["missing"] == {9} and status["added"] == {999}
    assert status["same"] == {None, *range(42)} - {7, 9}
