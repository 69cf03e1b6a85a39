"""Centroid clustering (Lloyd rounds over whole numbers), each vector's centroid found by Orchard search.

Every centroid has the list of the others, nearest first. A search stands at one centroid and goes down its list;
as soon as one is closer to the vector, it jumps to that one's list. Centroids once measured are marked and
passed over. It ends where the next of the list is strictly more than twice as far from the centroid as the
vector is: all that follow are then strictly farther from the vector than the centroid it stands at. Squares of
distances are whole numbers, so nothing is rounded, and ties go to the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stored

#: Greatest amount of a whole-number component for which squared distances of 64 components are sure to fit a long.
LARGEST = 1 << 27
#: Vectors searched at once.
BLOCK = 4096


@dataclass(frozen=True)
class Centroids:
    """The centroids c, for each the others by distance (near), and the greatest squared distance of a vector at which
    the search goes no farther than that place of the list (ends)."""

    c: np.ndarray
    near: np.ndarray
    ends: np.ndarray


def centroids_of(c: np.ndarray) -> Centroids:
    between = np.stack([((c - one) ** 2).sum(axis=1) for one in c])
    number = np.arange(len(c))
    near = np.stack([(order := np.lexsort((number, row)))[order != i] for i, row in enumerate(between)])
    # Strictly beyond twice the distance: between > 4 d, that is d <= (between - 1) // 4.
    return Centroids(c, near, (np.take_along_axis(between, near, axis=1) - 1) // 4)


def search(x: np.ndarray, k: Centroids, start: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of x its nearest centroid and the squared distance to it, and how many distances were worked out.

    All rows go on in step, each in the list of its own centroid."""
    n, others = len(x), k.near.shape[1]
    at = np.full(n, start)
    d = ((x - k.c[start]) ** 2).sum(axis=1)
    place = np.zeros(n, np.int64)
    seen = np.zeros((n, len(k.c)), bool)
    seen[:, start] = True
    open_rows, measured = np.arange(n), n
    while others and len(open_rows):
        # A closed list: at its end, or the next is too far away.
        mine, p = at[open_rows], place[open_rows]
        go = p < others
        go[go] = k.ends[mine[go], p[go]] < d[open_rows[go]]
        open_rows, mine, p = open_rows[go], mine[go], p[go]
        next_one = k.near[mine, p]
        place[open_rows] += 1
        new = ~seen[open_rows, next_one]
        rows, cand = open_rows[new], next_one[new]
        seen[rows, cand] = True
        far = ((x[rows] - k.c[cand]) ** 2).sum(axis=1)
        measured += len(rows)
        better = (far < d[rows]) | ((far == d[rows]) & (cand < at[rows]))
        rows, cand = rows[better], cand[better]
        at[rows], d[rows], place[rows] = cand, far[better], 0
    return at, d, measured


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), width)


def whole_vectors(vectors: DataFrame, width: int) -> DataFrame:
    """vec_id and v, the components as whole numbers, of vectors with `width` components, none null or non-finite."""
    v = F.col("v").cast("array<double>")
    usable = (F.size("v") == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    limit = F.raise_error(F.lit(f"a component is beyond {LARGEST // 256}"))
    whole = F.transform(v, lambda x: F.when(F.abs(256 * x) <= LARGEST, F.floor(256 * x)).otherwise(limit.cast("long")))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))


def cluster_vectors(vectors: DataFrame, clusters: int = 40, rounds: int = 5, width: int = 64, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every vector kept.

    Kept are vectors of `width` components without null or non-finite ones; components are floor(256 x). The first
    centroids are those of least hash of seed and id (a null id counts as ''; rows of one id by their vectors), as
    many as there are vectors if these are fewer. Centroids are replaced by the exact floor of the mean, empty ones
    stay. Repeated rows count repeatedly and give repeated results; an empty table gives no rows; other columns are
    not read. Components beyond 524,288 are refused, as their distances might not fit a long; sums that do not
    fit are null. Only centroids and their sums, whose number is fixed, pass through the driver.
    """
    spark = vectors.sparkSession
    data = stored(whole_vectors(pick(vectors, vec_id=id_col, v=vector_col), width))
    lot = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = data.select(lot.alias("lot"), "v").orderBy("lot", "v").limit(clusters).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    c = np.array([r.v for r in first], np.int64)
    for _ in range(rounds):
        c = moved(data, c)
    found = stored(assigned(data, c))
    # A row a cluster, at most `clusters` of them, whatever the number of vectors.
    totals = {r.cluster: r.total for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    fits = lambda total: int(total) if total < 1 << 63 else None
    digest = lambda one: hashlib.sha256(",".join(map(str, one.tolist())).encode()).hexdigest()
    inertia = fits(sum(totals.values()))
    facts = spark.createDataFrame([(i, fits(total), inertia, digest(c[i])) for i, total in totals.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def assigned(data: DataFrame, c: np.ndarray) -> DataFrame:
    """vec_id, cluster and distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = centroids_of(c)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                at, d, _ = search(matrix(part["v"], c.shape[1]), k)
                yield pa.RecordBatch.from_arrays([part["vec_id"], pa.array(at, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return data.mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(data: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after one round. A task sums up its vectors by cluster; Spark adds these sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = centroids_of(c)
        n, sums = np.zeros(len(c), np.int64), np.zeros_like(c)
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                x = matrix(batch["v"].slice(i, BLOCK), c.shape[1])
                at, _, _ = search(x, k)
                np.add.at(sums, at, x)
                n += np.bincount(at, minlength=len(c))
        held = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(n[held], pa.int64()), pa.array(list(sums[held]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    partial = data.mapInArrow(run, "cluster int, n long, sums array<long>")
    every = partial.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(c.shape[1]))).alias("sums"))
    after = c.copy()
    for r in every.collect():
        after[r.cluster] = [s // r.n for s in r.sums]
    return after
