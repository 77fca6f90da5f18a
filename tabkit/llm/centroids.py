"""Centroid clustering in integers; the nearest centroid is found by the threshold algorithm.

Every dimension holds the centroids sorted by their value there. A vector
walks each of these lists outward from its own value, one centroid a step in
all dimensions at once. A centroid met for the first time gets its exact
distance. After a step, whatever has not been met yet lies at least as far
away as the frontier: the sum, over dimensions, of the squared distance just
reached. Once that sum strictly exceeds the best exact distance the walk ends;
at equality it goes on, as a centroid of a smaller number might tie.

Vectors are turned into integers once and written out. Each round is one pass
that sends on a row of sums per task and centroid, so rounds shuffle in
proportion to tasks, never to vectors, and the driver holds nothing but the
centroids. All sums are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabkit.session import stable

WIDTH, SCALE = 64, 256
CENTROIDS, ROUNDS, SEED = 40, 5, 2
#: Integers beyond this would let a squared distance of 64 components leave a long.
LARGEST = 1 << 27
CHUNK = 1024


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """(vec_id, x): the vectors of exactly `width` finite components, as floor(scale * component).

    Rows with a null vector, another length, a null, infinite or NaN component,
    or an integer beyond 2^27 either way are left out.
    """
    x = F.transform(embedding, lambda v: F.lit(float(scale)) * v.cast("double"))
    sound = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(F.floor(v).cast("double")) <= LARGEST), F.lit(False)))
    slim = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")).where(F.size("embedding") == width)
    x = F.transform("embedding", lambda v: F.lit(float(scale)) * v.cast("double"))
    return slim.where(sound).select("vec_id", F.transform(x, lambda v: F.floor(v).cast("int")).alias("x"))


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, exact distances taken) for rows of integers; ties: the smaller number."""
    who, distance, taken = [], [], 0
    for low in range(0, len(x), CHUNK):
        a, b, n = _walk(x[low : low + CHUNK], centroids)
        who.append(a)
        distance.append(b)
        taken += n
    return np.concatenate([*who, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*distance, np.zeros(0, np.int64)]).astype(np.int64), taken


def _walk(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    n, k = len(x), len(centroids)
    frontier = np.zeros((n, k), np.int64)
    met_at = np.full((n, k), k, np.int16)
    for d in range(x.shape[1]):
        values, which = np.unique(x[:, d], return_inverse=True)
        in_order = np.argsort(centroids[:, d], kind="stable")  # the sorted list of this dimension
        gaps = np.abs(values[:, None] - centroids[in_order, d])
        outward = np.argsort(gaps, axis=1, kind="stable")  # the list as walked outward from each value
        frontier += (np.take_along_axis(gaps, outward, 1) ** 2)[which]
        step = np.empty((len(values), k), np.int16)
        np.put_along_axis(step, in_order[outward], np.arange(k, dtype=np.int16)[None, :], 1)
        np.minimum(met_at, step[which], out=met_at)
    exact = np.full((n, k), np.iinfo(np.int64).max)
    best = np.full(n, np.iinfo(np.int64).max)
    walking, taken = np.arange(n), 0
    for step in range(k):
        row, met = np.nonzero(met_at[walking] == step)
        row = walking[row]
        found = ((x[row] - centroids[met]) ** 2).sum(axis=1)
        exact[row, met] = found
        np.minimum.at(best, row, found)
        taken += len(row)
        walking = walking[frontier[walking, step] <= best[walking]]
        if not len(walking):
            break
    return exact.argmin(axis=1), best, taken


def start(rows: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `seed:vec_id`, in that order; fewer if there are fewer.

    Equal ids are put in order by their components; rows without id come last.
    """
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.select(place.alias("place"), "x").orderBy(F.col("place").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in first], np.int64)


def _sums(rows: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty centroid its vectors' count and componentwise sums: centroids times width numbers reach the driver."""
    k, width = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            who, _, _ = nearest(x, centroids)
            np.add.at(total, who, x)
            count += np.bincount(who, minlength=k)
        held = np.flatnonzero(count)
        if len(held):
            flat = pa.ListArray.from_arrays(np.arange(len(held) + 1, dtype=np.int32) * width, pa.array(total[held].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(count[held]), flat], names=["cluster", "n", "total"])

    # decimals: sums of the tasks' longs can't overflow
    long_form = rows.select("x").mapInArrow(partial, "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("at", "total"))
    summed = long_form.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in summed.collect():
        found.setdefault(r["cluster"], (r["n"], [0] * width))[1][r["at"]] = int(r["total"])
    return found


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def assigned(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`rows` (vec_id, x) as vec_id, cluster and distance; one pass, no shuffle."""
    width = centroids.shape[1]
    schema = rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).schema

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who, distance, _ = nearest(_matrix(batch.column(1), width), centroids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(who.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    return rows.select("vec_id", "x").mapInArrow(mapped, schema)


def fit(rows: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Centroids after so many rounds over `rows` (vec_id, x); a centroid that loses all vectors stays where it is."""
    centroids = start(rows, k, seed)
    for _ in range(rounds if len(centroids) else 0):
        for number, (n, total) in _sums(rows, centroids).items():
            centroids[number] = [t // n for t in total]
    return centroids


def digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """One row per usable vector of `vectors` (vec_id, embedding), and the centroids.

    Columns: vec_id, cluster, distance, cluster_inertia, inertia and
    centroid_sha256; other columns of the input are not carried. Unusable
    vectors (see `integers`) have no row. Repeated rows and null ids stay, each
    with a row. With fewer vectors than k there are as many centroids as
    vectors; an empty table gives an empty result.
    """
    rows = stable(integers(vectors, width=width, scale=scale))
    centroids = fit(rows, k, rounds, seed)
    if not len(centroids):
        none = rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        named = {"cluster_inertia": F.lit(0).cast("long"), "inertia": F.lit(0).cast("long"), "centroid_sha256": F.lit("")}
        return none.withColumns(named), centroids
    placed = stable(assigned(rows, centroids))
    spread = {r["cluster"]: int(r["total"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}

    def by_cluster(values: dict[int, object], kind: str) -> Column:
        known = F.array(*[F.lit(values.get(i)).cast(kind) for i in range(len(centroids))])
        return F.element_at(known, F.col("cluster") + 1)

    return placed.withColumns({
        "cluster_inertia": by_cluster(spread, "long"),
        "inertia": F.lit(sum(spread.values())).cast("long"),
        "centroid_sha256": by_cluster({i: digest(c) for i, c in enumerate(centroids)}, "string"),
    }), centroids
