"""Helpers that the operators of this folder share: shared-folder tables and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    A cluster names it in ``spark.checkpoint.dir``. Only where that is unset (a
    local session, as in tests) a folder of this machine is made and set.
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and no executor's loss undoes it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected ``edges``: (node, component), the smallest id reachable.

    Contraction rounds: each node takes the smallest id among itself and its
    neighbours, follows it one step further, and edges are renamed to what
    their ends took; equal and inner edges vanish. A component's smallest node
    always keeps its own id, so the last name is the smallest id. Minima are
    combined before the shuffle, so a hub costs no more than another node, and
    joins on a hub are split by adaptive execution. Nodes without an edge
    aren't returned. Null ends are ignored.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a != b")
    edges = written(edges.distinct(), "edges")
    names = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        low = written(low, "low")
        top = low.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = written(low.join(top, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "step")
        for end in ("a", "b"):
            edges = edges.join(step.withColumnRenamed("node", end), end).drop(end).withColumnRenamed("up", end)
        edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct(), "edges")
        if names is None:
            names = step
        else:
            after = step.select(F.col("node").alias("up"), F.col("up").alias("top"))
            names = written(names.join(after, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "names")
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).where("false")
    return names.select("node", F.col("up").alias("component"))
