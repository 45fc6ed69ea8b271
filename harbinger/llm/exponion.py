"""Lloyd's clustering in whole numbers by exponion search: vectors scan only centroids in a ball around their own.

Every vector carries its cluster, an upper bound on the distance to its centroid and a lower bound on the distance to
any other. After centroids move, both bounds move by as much. A vector whose upper bound is below its lower bound, or
below half the way from its centroid to the nearest other one, keeps its cluster unseen. Others take the exact distance
to their centroid and, if that does not decide, scan the centroids within twice that distance plus the distance to the
nearest other centroid, in the order of their distance from the vector's centroid; the radius is inclusive and rounded
outwards, so that centroids at equal distance are seen and the smaller number wins. Distances that decide are whole
numbers; only bounds are floating, and are rounded to the safe side.

A round is one pass without a shuffle over a written table, which gives the next table and, in rows of their own, each
task's sums per cluster; only these are added up, and as many rows as there are clusters come to the driver.

Vectors with another number of components than `width`, null ones and those with null or non-finite components are
left out. floor(scale * x) is held within 2^27. A null id counts as an empty one in the choice of the first centroids;
equal hashes (repeated ids) are ordered by the vector; rows that repeat count as often as they stand. With fewer
vectors than k there are as many clusters as vectors; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.llm import common, intvec

#: Bounds are moved outwards by this share, more than their arithmetic can err.
SLACK = 1e-9
STATE = "vec_id long, embedding {}, cluster int, upper double, lower double, distance long, n long, sums array<long>, inertia decimal(38,0)"


class Centroids:
    """Whole centroids with their sorted distances from each other, and what they moved by since the last round."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points, k = points, points.shape[0]
        gaps = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2, dtype=np.float64))
        gaps[np.arange(k), np.arange(k)] = -1  # itself comes first
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1)
        self.nearest = self.gaps[:, 1] if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((points - before) ** 2).sum(axis=1, dtype=np.float64))
        self.moved = moved * (1 + SLACK)
        top = np.sort(self.moved)[::-1]
        self.others_moved = np.where((self.moved == top[0]) & (np.count_nonzero(self.moved == top[0]) == 1), top[1] if k > 1 else 0.0, top[0])

    def squared(self, x: np.ndarray, k: int) -> np.ndarray:
        return ((x - self.points[k]) ** 2).sum(axis=1)


def first_assigned(x: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster and bounds of vectors without any: all centroids are scanned."""
    d = np.stack([c.squared(x, k) for k in range(c.points.shape[0])], axis=1)
    own = d.argmin(axis=1)
    best = d[np.arange(x.shape[0]), own]
    d[np.arange(x.shape[0]), own] = np.iinfo(np.int64).max
    second = np.sqrt(d.min(axis=1).astype(np.float64)) if c.points.shape[0] > 1 else np.full(x.shape[0], np.inf)
    return own.astype(np.int32), np.sqrt(best.astype(np.float64)) * (1 + SLACK), second * (1 - SLACK)


def assigned(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster and bounds after the centroids have moved, and how many distances it took."""
    upper = (upper + c.moved[cluster]) * (1 + SLACK)
    lower = lower - c.others_moved[cluster]
    lower = lower * np.where(lower > 0, 1 - SLACK, 1 + SLACK)
    cluster, asked = cluster.copy(), 0
    half = c.nearest / 2 * (1 - SLACK)
    open_ = np.flatnonzero(upper >= np.maximum(lower, half[cluster]))
    for a in np.unique(cluster[open_]).tolist():
        rows = open_[cluster[open_] == a]
        own = c.squared(x[rows], a)
        upper[rows] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
        asked += rows.size
        still = upper[rows] >= np.maximum(lower[rows], half[a])
        rows, own = rows[still], own[still]
        if not rows.size or c.points.shape[0] == 1:
            continue
        radius = (2 * upper[rows] + c.nearest[a]) * (1 + SLACK)
        inside = np.searchsorted(c.gaps[a], radius, "right")  # how many of the sorted list each scans
        best, at, second = own, np.full(rows.size, a), np.full(rows.size, np.iinfo(np.int64).max)
        for n in range(1, int(inside.max())):
            k, mine = int(c.order[a, n]), np.flatnonzero(inside > n)
            d = c.squared(x[rows[mine]], k)
            asked += mine.size
            better = (d < best[mine]) | (d == best[mine]) & (k < at[mine])
            second[mine] = np.where(better, best[mine], np.minimum(second[mine], d))
            best[mine], at[mine] = np.where(better, d, best[mine]), np.where(better, k, at[mine])
        cluster[rows] = at
        upper[rows] = np.sqrt(best.astype(np.float64)) * (1 + SLACK)
        lower[rows] = np.sqrt(second.astype(np.float64)) * (1 - SLACK)
    return cluster, upper, lower, asked


def round_of(rows: DataFrame, centroids: Centroids, scale: int, first: bool, last: bool, name: str) -> DataFrame:
    """One pass: the rows with their state by these centroids, and each task's sums of every cluster."""
    k, width = centroids.points.shape
    kind = rows.schema["embedding"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, inertia, vector = np.zeros(k, np.int64), np.zeros((k, width), np.int64), [0] * k, None
        for b in batches:
            vector = b.schema.field("embedding").type
            x = intvec.floored(intvec.matrix(b.column("embedding"), width), scale).astype(np.int64)
            if first:
                cluster, upper, lower = first_assigned(x, centroids)
            else:
                cluster, upper, lower, _ = assigned(x, *(b.column(c).to_numpy() for c in ("cluster", "upper", "lower")), centroids)
            distance = np.zeros(cluster.size, np.int64)
            for a in np.unique(cluster).tolist():
                mine = cluster == a
                n[a] += np.count_nonzero(mine)
                if last:
                    distance[mine] = centroids.squared(x[mine], a)
                    inertia[a] += sum(distance[mine].tolist())
                else:
                    sums[a] += x[mine].sum(axis=0)
            none = lambda kind: pa.nulls(b.num_rows, kind)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("embedding"), pa.array(cluster), pa.array(upper), pa.array(lower), pa.array(distance), none(pa.int64()), none(pa.list_(pa.int64())), none(pa.decimal128(38, 0))],
                ["vec_id", "embedding", "cluster", "upper", "lower", "distance", "n", "sums", "inertia"],
            )
        some = np.flatnonzero(n).tolist()
        if some:
            none = lambda kind: pa.nulls(len(some), kind)
            yield pa.RecordBatch.from_arrays(
                [none(pa.int64()), none(vector), pa.array(some, pa.int32()), none(pa.float64()), none(pa.float64()), none(pa.int64()), pa.array(n[some]), pa.array(sums[some].tolist(), pa.list_(pa.int64())), pa.array(inertia, pa.decimal128(38, 0)).take(pa.array(some))],
                ["vec_id", "embedding", "cluster", "upper", "lower", "distance", "n", "sums", "inertia"],
            )

    return common.table(rows.select("vec_id", "embedding", "cluster", "upper", "lower").transform(common.map_batches, run, STATE.format(kind)), name)


def moved(state: DataFrame, points: np.ndarray) -> np.ndarray:
    """The centroids' next places: floors of their vectors' means; those without vectors stay."""
    parts = state.where("n is not null").select("cluster", "n", F.posexplode("sums").alias("place", "x"))
    out = points.copy()
    for r in parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # clusters times components
        out[r["cluster"], r["place"]] = r["x"] // r["n"]
    return out


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, width: int = 64, scale: int = 1024, rounds: int = 10, seed: str = "3") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector kept."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = rows.where(intvec.sound(F.col("embedding")) & (F.size("embedding") == width))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    heads = rows.select(order.alias("h"), "embedding").orderBy("h", "embedding").limit(k).collect()
    if not heads:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    points = intvec.floored(np.array([r["embedding"] for r in heads], np.float64).reshape(len(heads), width), scale).astype(np.int64)
    state, now, done = rows.selectExpr("*", "0 as cluster", "0d as upper", "0d as lower"), Centroids(points), 0
    for n in range(rounds):
        before, state = state, round_of(state if n == 0 else state.where("n is null"), now, scale, n == 0, False, f"exponion-{n}")
        common.discard(before)
        points = moved(state, now.points)
        done = n + 1
        still = (points == now.points).all()
        now = Centroids(points, now.points)
        if still:  # all further rounds would be this one again
            break
    before, state = state, round_of(state.where("n is null") if done else state, now, scale, not done, True, "exponion-last")
    common.discard(before)
    totals = {r["cluster"]: int(r["inertia"]) for r in state.where("n is not null").groupBy("cluster").agg(F.sum("inertia").alias("inertia")).collect()}
    most = (1 << 63) - 1
    facts = [(c, min(most, x), min(most, sum(totals.values())), hashlib.sha256(",".join(map(str, now.points[c].tolist())).encode()).hexdigest()) for c, x in sorted(totals.items())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # at most k rows
    return state.where("n is null").select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_exponion(spark, sf_dir: str) -> DataFrame:
    """All embeddings of 64 components in 8 clusters, 10 rounds."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(k: int = 8, rounds: int = 10) -> str:
    """Plain Lloyd: every vector against every centroid, in each round."""
    nearest = "SELECT v.r, min(ip(v.w, v.w) - 2 * ip(v.w, c.w) + ip(c.w, c.w)) AS d, arg_min(c.k, (ip(v.w, v.w) - 2 * ip(v.w, c.w) + ip(c.w, c.w)) * 64 + c.k) AS k FROM v CROSS JOIN c{n} c GROUP BY v.r".replace("ip(", "list_inner_product(")
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({nearest.format(n=n)})")
        steps.append(
            f"c{n + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.w, c.w) AS w FROM c{n} c LEFT JOIN (SELECT k, list(x ORDER BY j) AS w FROM (SELECT a.k, i.j, floor(sum(v.w[i.j]) / count(*)) AS x FROM a{n} a JOIN v USING (r) CROSS JOIN (SELECT unnest(range(1, 65)) AS j) i GROUP BY a.k, i.j) GROUP BY k) m ON c.k = m.k)"
        )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT k, w FROM (SELECT w, row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), embedding) - 1 AS k FROM v) WHERE k < {k}
), {", ".join(steps)}, f AS MATERIALIZED ({nearest.format(n=rounds)})
SELECT v.vec_id, CAST(f.k AS INTEGER) AS cluster, CAST(f.d AS BIGINT) AS distance, CAST(sum(f.d) OVER (PARTITION BY f.k) AS BIGINT) AS cluster_inertia, CAST(sum(f.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c.w, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM f JOIN v USING (r) JOIN c{rounds} c ON c.k = f.k
"""


OP12_SQL = _sql()
