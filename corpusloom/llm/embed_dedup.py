"""Embedding near-duplicates by cover-tree dual traversal: exact threshold pairs.

Vectors of equal label are compared on the unit sphere, where a cosine of at least c is a
distance of at most r = sqrt(2 - 2c). Equal vectors are one weighted point. The upper levels of a label's tree are
laid in the cluster: a cell with more than ``BLOCKS`` blocks of points of its own is cut by pivots, each point is at home with its nearest pivot, and is a guest of the
others whose home points may be within r: those whose covering radius and r reach it, and whose bisecting plane is at most r away. That is done again for cells that are
still too large, as long as it at least halves the work. Cells that can't be cut so are dealt in blocks, every pair of which is a task.
In a task blocks become cover trees (nested levels, radii halved from level to level), and pairs of nodes are
followed from the roots. A pair whose centres are farther apart than both covering radii and the threshold is
pruned; a pair that lies wholly within the threshold is counted as a whole; what is left at the leaves is
compared by cosine. Only counts by home point and a spanning set of links leave a task, never the pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import components, written

COSINE = 0.98
#: Points in a block; a task holds two.
BLOCK = 2048
#: A cell is cut by a pivot for so many points (as expected of a draw by hash), by eight at least and PIVOTS at most.
POINTS, PIVOTS = 50, 4096
#: A cell of up to so many blocks is dealt in blocks without a cut: its copies are as few.
BLOCKS = 4
#: Members of a cell that one task holds against its pivots.
_SHARE = 1 << 16
LEAF = 64
#: More than rounding does to a distance taken from a product.
_SLACK = 1e-6


@dataclass
class Node:
    """A ball around the point ``center``: its points, its covering radius and the nodes of the next level."""

    center: int
    points: np.ndarray
    radius: float
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray) -> Node:
    """The cover tree of unit vectors ``x`` (rows). A node's first child keeps its centre, so levels are nested.

    Only distances from a centre to the points of its parent are taken, to within _SLACK.
    """
    away = lambda center, points: np.sqrt(np.maximum(0, 2 - 2 * (x[points] @ x[center])))
    every = np.arange(len(x))
    root = Node(0, every, float(away(0, every).max()) + _SLACK)
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.points) <= LEAF or node.radius <= 4 * _SLACK:
            continue
        bound, left, center = node.radius / 2, node.points, node.center
        while len(left):
            near = away(center, left)
            inside = near <= bound
            inside[left == center] = True
            child = Node(center, left[inside], float(near[inside].max()) + _SLACK)
            node.children.append(child)
            if len(child.points) > LEAF:
                todo.append(child)
            left = left[~inside]
            center = int(left[0]) if len(left) else 0
    return root


class Links:
    """What a pair of trees has in common: link counts by point, and links that span each linked group."""

    def __init__(self, xa: np.ndarray, xb: np.ndarray, wa: np.ndarray, wb: np.ndarray, cosine: float, same: bool) -> None:
        self.xa, self.xb, self.wa, self.wb, self.same = xa, xb, wa, wb, same
        self.na, self.nb = np.linalg.norm(xa, axis=1), np.linalg.norm(xb, axis=1)
        self.ua, self.ub = xa / self.na[:, None], xb / self.nb[:, None]
        self.cosine, self.reach = cosine, float(np.sqrt(max(0.0, 2 - 2 * cosine)))
        self.count_a, self.count_b = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
        n = len(xa) if same else len(xa) + len(xb)
        self.up = list(range(n))
        self.shift = 0 if same else len(xa)

    def top(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.top(i), self.top(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def whole(self, a: Node, b: Node) -> None:
        """All points of both nodes link. In one tree, a node against itself leaves each point its others."""
        if self.same and a is b:
            self.count_a[a.points] += self.wa[a.points].sum() - self.wa[a.points]
        else:
            self.count_a[a.points] += self.wb[b.points].sum()
            (self.count_a if self.same else self.count_b)[b.points] += self.wa[a.points].sum()
        first = int(a.points[0])
        for i in a.points.tolist():
            self.join(first, i)
        for j in b.points.tolist():
            self.join(first, j + self.shift)

    def leaves(self, a: Node, b: Node) -> None:
        """Exact cosines between two nodes' points."""
        pa_, pb = a.points, b.points
        linked = self.xa[pa_] @ self.xb[pb].T / (self.na[pa_][:, None] * self.nb[pb][None, :]) >= self.cosine
        if self.same and a is b:
            np.fill_diagonal(linked, False)
            self.count_a[pa_] += linked @ self.wa[pa_]
        else:
            self.count_a[pa_] += linked @ self.wb[pb]
            (self.count_a if self.same else self.count_b)[pb] += self.wa[pa_] @ linked
        for i, j in zip(*(k.tolist() for k in np.nonzero(linked)), strict=True):
            self.join(int(pa_[i]), int(pb[j]) + self.shift)

    def run(self, a: Node, b: Node) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            itself = self.same and a is b
            gap = 0.0 if itself else float(np.linalg.norm(self.ua[a.center] - self.ub[b.center]))
            if gap > a.radius + b.radius + self.reach + _SLACK:
                continue
            if (2 * a.radius if itself else gap + a.radius + b.radius) <= self.reach - _SLACK:
                self.whole(a, b)
            elif not a.children and not b.children:
                self.leaves(a, b)
            elif itself:
                todo += [(p, q) for p, q in self.close(a.children, a.children) if p.center <= q.center]
            else:
                todo += self.close(a.children or [a], b.children or [b])

    def close(self, left: list[Node], right: list[Node]) -> list[tuple[Node, Node]]:
        """The pairs of nodes that aren't pruned, found in one product of centres."""
        ra, rb = np.array([n.radius for n in left]), np.array([n.radius for n in right])
        ca, cb = self.ua[[n.center for n in left]], self.ub[[n.center for n in right]]
        out = []
        for at in range(0, len(left), 512):
            gaps = np.sqrt(np.maximum(0, 2 - 2 * ca[at : at + 512] @ cb.T))
            near = gaps <= ra[at : at + 512, None] + rb[None, :] + self.reach + _SLACK
            out += [(left[at + i], right[j]) for i, j in zip(*(k.tolist() for k in np.nonzero(near)), strict=True)]
        return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of vectors of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _links_of(table: pa.Table, cosine: float) -> pa.Table:
    """Of a pair's points (id, n, embedding, side, home): (id, links, low) with the smallest id of the linked group; only points with links, and links only of points at home."""
    side = table.column("side").to_numpy()
    ids, weights = table.column("id").to_numpy(), table.column("n").to_numpy()
    home, x = table.column("home").to_numpy(), _matrix(table.column("embedding"))
    order = np.lexsort((ids, side))
    side, ids, weights, home, x = side[order], ids[order], weights[order], home[order], x[order]
    same = not (side == 1).any()
    a = np.flatnonzero(side == 0)
    b = a if same else np.flatnonzero(side == 1)
    out_ids, links, low = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    if len(a) and len(b):
        work = Links(x[a], x[b], weights[a], weights[b], cosine, same)
        tree = cover_tree(work.ua)
        work.run(tree, tree if same else cover_tree(work.ub))
        members = a if same else np.concatenate([a, b])
        out_ids = ids[members]
        links = work.count_a if same else np.concatenate([work.count_a, work.count_b])
        tops = np.array([work.top(i) for i in range(len(out_ids))])
        low = np.full(len(out_ids), np.iinfo(np.int64).max)
        np.minimum.at(low, tops, out_ids)
        low = low[tops]
        some = links > 0
        out_ids, links, low = out_ids[some], np.where(home[members], links, 0)[some], low[some]
    return pa.table({"id": pa.array(out_ids, pa.int64()), "links": pa.array(links, pa.int64()), "low": pa.array(low, pa.int64())})


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1)[:, None]


def places(pivots: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For unit vectors ``x``: the nearest pivot, and how far it is."""
    products = x @ pivots.T
    own = products.argmax(1)
    return own, np.sqrt(np.maximum(0, 2 - 2 * products[np.arange(len(x)), own])) + _SLACK


def visits(pivots: np.ndarray, radii: np.ndarray, x: np.ndarray, own: np.ndarray, reach: float) -> np.ndarray:
    """For unit vectors ``x`` with nearest pivots ``own``: by pivot whether a point at home there, within its covering radius, may be within ``reach``.

    A point at home with pivot p is no nearer to q, the nearest of y; if it is within reach of y, then y is at
    most reach beyond the plane between p and q.
    """
    products = x @ pivots.T
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
    near = products[np.arange(len(x)), own][:, None] - products <= (reach + _SLACK) * apart[own] + _SLACK
    return near & (np.sqrt(np.maximum(0, 2 - 2 * products)) <= radii[None, :] + reach + _SLACK)


_KEPT = ["cell", "home", "id", "n", "embedding"]


def _with_pivots(reach: float | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows in order of (cell, share, member), pivots before members: the members with their nearest pivot and its distance, or, given ``reach``, with the pivots to which they go."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, radii = None, [], []
        for batch in batches:
            cells, shares, member, own, away = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "share", "member", "own", "away"))
            fresh = np.ones(batch.num_rows, np.bool_)
            fresh[1:] = (cells[1:] != cells[:-1]) | (shares[1:] != shares[:-1]) | (member[1:] != member[:-1])
            cuts = [*np.flatnonzero(fresh).tolist(), batch.num_rows]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if (cells[start], shares[start]) != key:
                    key, held, radii = (cells[start], shares[start]), [], []
                part = batch.slice(start, end - start)
                if not member[start]:
                    held.append(_unit(_matrix(part.column("embedding"))))
                    radii.append(away[start:end])
                    continue
                pivots = np.concatenate(held) if held else _unit(_matrix(part.column("embedding").slice(0, 1)))
                for at in range(start, end, 1024):
                    some = batch.slice(at, min(1024, end - at))
                    x, columns = _unit(_matrix(some.column("embedding"))), [some.column(c) for c in _KEPT]
                    if reach is None:
                        # Without a pivot all are at home with number 0, and the cell stays as it is.
                        got, far = places(pivots, x) if held else (np.zeros(len(x), np.int64), np.zeros(len(x)))
                        yield pa.record_batch([*columns, pa.array(got, pa.int32()), pa.array(far)], names=[*_KEPT, "own", "away"])
                    else:
                        mine = own[at : at + len(x)]
                        goes = visits(pivots, np.concatenate(radii), x, mine, reach) if held else np.ones((len(x), 1), np.bool_)
                        goes[np.arange(len(x)), mine] = True
                        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], goes.sum(1).cumsum()]), pa.int32()), pa.array(np.nonzero(goes)[1], pa.int32()))
                        yield pa.record_batch([*columns, some.column("own"), lists], names=[*_KEPT, "own", "goes"])

    return work


def cut(members: DataFrame, reach: float, block: int = BLOCK) -> DataFrame:
    """(cell, home, id, n, embedding, h, a): ``members`` (cell, home, id, n, embedding; all at home) in cells, with how many are at home and there in all.

    Each id is at home in one cell, and there are all of its cell that are within ``reach`` of it.
    """
    members_are = "cell long, home boolean, id long, n long, embedding array<double>, own int"
    blocks = lambda c: F.ceil(F.col(c) / block)
    done = None
    for level in range(64):
        sizes = members.groupBy("cell").agg(F.count_if("home").alias("h"), F.count(F.lit(1)).alias("a"))
        sizes = written(sizes, "sizes")
        sized = members.join(sizes, "cell")
        final = sized.where(F.col("h") <= BLOCKS * block)
        done = final if done is None else done.unionByName(final)
        large = sizes.where(F.col("h") > BLOCKS * block)
        if large.isEmpty():
            break
        many = F.least(F.greatest(F.col("h") / POINTS, F.lit(8)), F.lit(PIVOTS))
        drawn = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 30)) < many / F.col("h") * (1 << 30)
        shares = F.ceil(F.col("a") / _SHARE).cast("int")
        share = F.pmod(F.xxhash64("id"), shares).cast("int").alias("share")
        each = F.explode(F.sequence(F.lit(0), shares - 1)).alias("share")
        in_large = sized.where(F.col("h") > BLOCKS * block)
        pivots = in_large.where(F.col("home") & drawn).drop("h")
        pivots = written(pivots.withColumn("p", F.row_number().over(Window.partitionBy("cell").orderBy("id")) - 1), "pivots")
        dealt = lambda df: df.repartition("cell", "share").sortWithinPartitions("cell", "share", "member", "p")
        first = in_large.select(*_KEPT, share, F.lit(True).alias("member"), F.lit(0).alias("p"), F.lit(0).alias("own"), F.lit(0.0).alias("away"))
        first = first.unionByName(pivots.select(*_KEPT, each, F.lit(False).alias("member"), "p", F.lit(0).alias("own"), F.lit(0.0).alias("away")))
        near = written(dealt(first).mapInArrow(_with_pivots(None), f"{members_are}, away double"), "near")
        radii = near.where("home").groupBy("cell", F.col("own").alias("p")).agg(F.max("away").alias("away"))
        # A pivot with nobody at home but an equal one has radius -9: nobody goes there.
        reached = pivots.join(radii, ["cell", "p"], "left").withColumn("away", F.coalesce("away", F.lit(-9.0)))
        second = near.join(large, "cell").select(*_KEPT, share, F.lit(True).alias("member"), F.lit(0).alias("p"), "own", "away")
        second = second.unionByName(reached.select(*_KEPT, each, F.lit(False).alias("member"), "p", F.lit(0).alias("own"), "away"))
        placed = written(dealt(second).mapInArrow(_with_pivots(reach), f"{members_are}, goes array<int>"), "placed")
        gone = placed.select("cell", F.explode("goes").alias("to"), "home", "own")
        gone = gone.groupBy("cell", "to").agg(F.count_if(F.col("home") & (F.col("own") == F.col("to"))).alias("h"), F.count(F.lit(1)).alias("a")).where("h > 0")
        work = gone.groupBy("cell").agg(F.sum(F.col("h") * F.col("a")).alias("work"), F.sum(F.col("a") * blocks("h")).alias("copies"))
        fine = (F.col("work") <= F.col("h") * F.col("a") / 2) & (F.col("copies") <= F.col("a") * blocks("h"))
        worth = written(work.join(large, "cell").select("cell", "h", "a", fine.alias("worth")), "worth")
        done = done.unionByName(placed.join(worth.where("not worth").drop("worth"), "cell").select(*_KEPT, "h", "a"))
        chosen = worth.where("worth").select("cell")
        if chosen.isEmpty():
            break
        parts = gone.join(chosen, "cell", "left_semi").select("cell", "to")
        moved = placed.join(chosen, "cell", "left_semi").select("cell", "id", "n", "embedding", "home", "own", F.explode("goes").alias("to")).join(parts, ["cell", "to"])
        moved = moved.select(F.xxhash64("cell", "to", F.lit(level)).alias("cell"), (F.col("home") & (F.col("own") == F.col("to"))).alias("home"), "id", "n", "embedding")
        members = written(moved, "members")
    return done


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) for each row.

    Rows link if their labels are equal and not null and their cosine is at least ``cosine``. Vectors that are
    null, empty, zero or hold null or non-finite components, rows with a null id or label, and vectors of other
    length link with nothing: n_links 0, component_id their own id (null for a null id). Equal vectors of a label link with each other.
    Ids should be unique; rows with an equal id share a component. An empty table gives no rows; other columns aren't read.
    """
    wide = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), wide.alias("embedding"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    fit = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0)
    rows = written(rows.withColumn("fit", F.coalesce(fit, F.lit(False))), "vectors")
    valid = rows.where("fit")
    points = valid.groupBy("label", "embedding").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    points = written(points.withColumn("g", F.xxhash64("label", F.size("embedding"))), "points")
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    members = cut(points.select(F.col("g").alias("cell"), F.lit(True).alias("home"), "id", "n", "embedding"), reach, block)
    # A cell's home points are dealt into blocks that meet each other once, and every block of its guests.
    homes, guests = (F.ceil(c / block).cast("int") for c in (F.col("h"), F.col("a") - F.col("h")))
    mine = F.pmod(F.xxhash64("id"), F.when(F.col("home"), homes).otherwise(guests)).cast("int")
    dealt = members.withColumns({"homes": homes, "guests": guests, "mine": mine})
    meets = lambda x, y, side: F.struct(x.alias("x"), y.alias("y"), side.alias("side"))
    home = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda o: meets(F.least("mine", o), F.greatest("mine", o), F.when(F.col("mine") <= o, 0).otherwise(1)))
    visited = F.when(F.col("guests") > 0, F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda o: meets(F.col("mine"), F.col("homes") + o, F.lit(0)))).otherwise(F.expr("array()"))
    guest = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda o: meets(o, F.col("homes") + F.col("mine"), F.lit(1)))
    pairs = dealt.select("cell", "home", "id", "n", "embedding", F.explode(F.when(F.col("home"), F.concat(home, visited)).otherwise(guest)).alias("m"))
    # Else the join's partitioning by cell would do for the pairs, and a cell would be one task.
    pairs = pairs.select("cell", "home", "id", "n", "embedding", "m.x", "m.y", "m.side").repartition("cell", "x", "y")

    def work(table: pa.Table) -> pa.Table:
        return _links_of(table, cosine)

    found = written(pairs.groupBy("cell", "x", "y").applyInArrow(work, "id long, links long, low long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = components(found.select("id", "low"), "id", "low")
    about = points.select("label", "embedding", "id", "n").join(counts, "id", "left").join(named.withColumnRenamed("node", "id"), "id", "left")
    about = about.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("c"))
    out = rows.join(about, F.col("fit") & (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e")), "left")
    component = F.coalesce("c", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


#: The query's rows for DuckDB: every pair of a label, and components by following links.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT a AS id, a AS low FROM l UNION SELECT l.b, r.low FROM r JOIN l ON l.a = r.id WHERE r.low < l.b),
c AS (SELECT id, min(low) AS low FROM r GROUP BY id),
n AS (SELECT a AS id, count(*) AS k FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.k, 0) AS BIGINT) AS n_links, coalesce(c.low, e.vec_id) AS component_id, coalesce(c.low, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.id = e.vec_id
"""
