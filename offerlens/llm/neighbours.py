"""Nearest neighbours by largest inner product, with a vantage-point tree for each shard.

Vectors are dealt to shards of bounded size; each shard builds its tree once and keeps it as a row of a table.
Queries are dealt to blocks of bounded size, and every block meets every shard's tree. Inner products become
distances when each vector gets one more component that lifts it to the length of the longest: then the nearest
on the sphere has the largest product. A tree node holds a vantage point and the distances of its two halves;
by the triangle inequality a half can be skipped if no vector in it can be closer than the worst of the
neighbours found so far. The factor scales that worst distance in the test: one, as in the query, gives the
exact answer, less skips more. Scores are summed in double precision, component by component.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, pick, stored


@dataclass(frozen=True)
class Setting:
    """factor 1 is exact; shard, block and leaf are numbers of vectors. A shard has a sixteenth of its size at least
    where that gives every task of a shuffle one."""

    factor: float = 1.0
    shard: int = 32_768
    block: int = 8192
    leaf: int = 2048
    seed: int = 11


@lru_cache(maxsize=None)
def splits_of(n: int, leaf: int) -> int:
    """Inner nodes of a tree over so many vectors."""
    return 0 if n <= leaf else 1 + splits_of(n // 2, leaf) + splits_of(n - n // 2, leaf)


def built(x: np.ndarray, leaf: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Halves of equal size by distance from a vantage point, down to leaves: the rows of x from leaf to leaf, and
    for each inner node, parents first, the place of its point in that order, the greatest distance of the
    inner half, and the least and the greatest of the outer one."""
    rng = np.random.default_rng(seed)
    order = np.arange(len(x))
    nodes: list[tuple[int, float, float, float]] = []

    def split(a: int, b: int) -> None:
        if b - a > leaf:
            rows, half = order[a:b], (b - a) // 2
            point = rows[rng.integers(b - a)]
            d = np.linalg.norm(x[rows] - x[point], axis=1)
            by = np.argsort(d, kind="stable")
            order[a:b] = rows[by]
            nodes.append((point, d[by[half - 1]], d[by[half]], d[by[-1]]))
            split(a, a + half)
            split(a + half, b)

    split(0, len(x))
    place = np.argsort(order)
    return order, np.array([(place[int(n[0])], *n[1:]) for n in nodes]).reshape(-1, 4)


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors with one more component, so that all have length top."""
    return np.hstack([x, np.sqrt(np.maximum(0, top * top - (x * x).sum(axis=1)))[:, None]])


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of components: the same for equal vectors wherever they stand."""
    out = np.zeros(len(q))
    for k in range(q.shape[1]):
        out += q[:, k] * x[:, k]
    return out


class Search:
    """The k best of one shard for each query of a block. x and x_ids are in the order of the shard's tree."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, nodes: np.ndarray, top: float, k: int, s: Setting):
        self.q, self.q_ids, self.x, self.x_ids, self.nodes, self.k, self.s = q, q_ids, x, x_ids, nodes, k, s
        # Queries are scaled to the sphere: this changes no order. All points then have length top.
        self.vantage = lifted(x[nodes[:, 0].astype(np.int64)], top)
        self.points = np.hstack([q * (top / np.linalg.norm(q, axis=1))[:, None], np.zeros((len(q), 1))])
        self.score = np.full((len(q), k), -np.inf)
        self.found = np.full((len(q), k), np.iinfo(np.int64).max)
        self.worst = np.full(len(q), np.inf)  # distance of the k-th found
        self.top = top
        self.scale = np.linalg.norm(q, axis=1) / top
        #: Rows that one id has at most, and products taken in all.
        self.same = int(np.unique(x_ids, return_counts=True)[1].max(initial=1))
        self.scanned = 0

    def run(self) -> None:
        if len(self.x) and len(self.q):
            self.visit(0, len(self.x), 0, np.arange(len(self.q)))

    def visit(self, a: int, b: int, node: int, who: np.ndarray) -> None:
        if b - a <= self.s.leaf:
            for i in range(0, len(who), 1024):
                self.scan(slice(a, b), who[i : i + 1024])
            return
        _, radius, start, end = self.nodes[node]
        half = a + (b - a) // 2
        d = np.linalg.norm(self.points[who] - self.vantage[node], axis=1)
        near = d <= (radius + start) / 2
        inner = (a, half, node + 1, np.maximum(0, d - radius))
        outer = (half, b, node + 1 + splits_of(half - a, self.s.leaf), np.maximum(np.maximum(0, start - d), d - end))
        for first in (True, False):  # the likelier half first, for a small worst distance early
            for (low, high, child, gap), mine in ((inner, near == first), (outer, near != first)):
                go = mine & (gap <= self.s.factor * self.worst[who] * (1 + 1e-9))
                if go.any():
                    self.visit(low, high, child, who[go])

    def scan(self, rows: slice, who: np.ndarray) -> None:
        x, x_ids = self.x[rows], self.x_ids[rows]
        self.scanned += len(x) * len(who)
        rough = self.q[who] @ x.T
        # What matrix products round off is less than this; all that may be among the best is summed again.
        slack = 1e-12 * (1 + self.top * np.linalg.norm(self.q[who], axis=1))
        hit = rough >= (self.score[who, -1] - slack)[:, None]
        # The k best ids and the query's own can have so many rows between them.
        most = (self.k + 1) * self.same
        if rough.shape[1] > most and hit.sum() > 4 * self.k * len(who):
            kth = -np.partition(-rough, most - 1, axis=1)[:, most - 1]
            hit &= rough >= (kth - slack)[:, None]
        hit &= x_ids[None] != self.q_ids[who][:, None]
        i, j = np.nonzero(hit)
        if not len(i):
            return
        exact = products(self.q[who[i]], x[j])
        own = np.unique(i)
        row = np.concatenate([i, np.repeat(own, self.k)])
        score = np.concatenate([exact, self.score[who[own]].ravel()])
        ids = np.concatenate([x_ids[j], self.found[who[own]].ravel()])
        if self.same > 1:  # of the rows of one id the best stays
            order = np.lexsort((-score, ids, row))
            row, score, ids = row[order], score[order], ids[order]
            again = np.zeros(len(row), bool)
            again[1:] = (row[1:] == row[:-1]) & (ids[1:] == ids[:-1]) & np.isfinite(score[1:])
            row, score, ids = row[~again], score[~again], ids[~again]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        begin = np.searchsorted(row, own)
        take = begin[:, None] + np.arange(self.k)
        self.score[who[own]], self.found[who[own]] = score[take], ids[take]
        kth = self.score[who[own], -1] / self.scale[who[own]]
        # Rounding may not make the worst distance of near-equal points too small: equal scores go by id.
        square = 2 * self.top * self.top - 2 * np.where(np.isfinite(kth), kth, 0)
        self.worst[who[own]] = np.where(np.isfinite(kth), np.sqrt(np.maximum(0, square) + 1e-12 * self.top * self.top), np.inf)


def usable(vectors: DataFrame) -> DataFrame:
    """id, v (array of doubles) and dim of vectors without null or non-finite components, other than zero."""
    v = F.col("v").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("id").cast("long").alias("id"), v.alias("v"), F.size("v").alias("dim")).where("id is not null and v is not null and dim > 0").where(finite & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, setting: Setting = Setting(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row whose id is divisible by `every`, among all rows but those of its own id.

    Rows without an id, null vectors, zero vectors and those with null or non-finite components take no part;
    vectors meet only those of their own number of components. Equal scores go to the smaller id. Rows of one id
    with different vectors count as one item, scored by its best pair, so no id comes twice in a ranking.
    An empty table gives no rows; other columns are not read.
    """
    s = setting
    n = partitions_for(vectors.sparkSession, 1)
    data = stored(usable(pick(vectors, id=id_col, v=vector_col)).dropDuplicates(["id", "v"]))
    # One row for each number of components; its length says nothing about the number of vectors.
    sizes = data.groupBy("dim").agg(F.count("*").alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("queries"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("top"))
    wanted = lambda count, size: F.greatest(F.lit(1), F.ceil(F.col(count) / size), F.least(F.lit(n), F.ceil(16 * F.col(count) / size))).cast("int")
    sizes = sizes.select("dim", "top", wanted("n", s.shard).alias("shards"), F.greatest(F.lit(1), F.ceil(F.col("queries") / s.block)).cast("int").alias("blocks"))
    sized = data.join(sizes, "dim")
    spread = lambda n, salt: F.pmod(F.xxhash64("id", "v", F.lit(salt)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    matrix = lambda t, c: t[c].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)

    def plant(table: pa.Table) -> pa.Table:
        # Rows in one order whatever task they come from, so that a shard built again has the same tree.
        table = table.take(pa.array(np.lexsort((*matrix(table, "v").T, table["id"].to_numpy()))))
        x, top = matrix(table, "v"), table["top"][0].as_py()
        order, nodes = built(lifted(x, top), s.leaf, s.seed)
        one = {"dim": table["dim"][0].as_py(), "shard": table["shard"][0].as_py(), "top": top, "blocks": table["blocks"][0].as_py()}
        return pa.Table.from_pylist([one | {"ids": table["id"].to_numpy()[order].tobytes(), "x": x[order].tobytes(), "nodes": nodes.tobytes()}], planted)

    planted = pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("top", pa.float64()), ("blocks", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("nodes", pa.binary())])
    shards = sized.select("dim", "top", "id", "v", "blocks", spread("shards", 1).alias("shard")).repartition(n, "dim", "shard").groupBy("dim", "shard")
    trees = stored(shards.applyInArrow(plant, "dim int, shard int, top double, blocks int, ids binary, x binary, nodes binary"))
    base = trees.select("dim", "shard", "top", "ids", "x", "nodes", upto("blocks").alias("block"))
    asked = sized.where(F.col("id") % every == 0).select(F.col("dim").alias("q_dim"), F.col("id").alias("q_id"), F.col("v").alias("q_v"), spread("blocks", 2).alias("q_block"), upto("shards").alias("q_shard"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        q_ids, tree = right["q_id"].to_numpy(), left.to_pylist()[0]
        x = np.frombuffer(tree["x"]).reshape(-1, tree["dim"])
        run = Search(matrix(right, "q_v"), q_ids, x, np.frombuffer(tree["ids"], np.int64), np.frombuffer(tree["nodes"]).reshape(-1, 4), tree["top"], k, s)
        run.run()
        i, j = np.nonzero(run.score > -np.inf)
        return pa.table({"query_id": q_ids[i], "vec_id": run.found[i, j], "score": run.score[i, j]})

    keys, q_keys = ["dim", "shard", "block"], ["q_dim", "q_shard", "q_block"]
    found = base.repartition(n, *keys).groupBy(*keys).cogroup(asked.repartition(n, *q_keys).groupBy(*q_keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
