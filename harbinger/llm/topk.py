"""Exact search for the largest inner products: tiles of queries times shards of candidates, selection, a merging tree.

Queries are dealt into groups and candidates into shards, both of so many bytes; a task takes one group and one
shard, so a candidate travels once a group and a query once a shard. Within a task queries and candidates meet in
tiles: a matrix product, of which each query keeps its k best (candidates come in ascending id, so the first of
equal scores is the one with the smallest id), merged with what it had. The tasks' lists of a query are merged FAN
at a time, level by level, so no group holds more than FAN lists of k, however many shards there are.

Components become whole numbers, floor(scale * x), held within 2^27, so that a score fits a long. Products are
taken in single precision, in double precision or in whole numbers, whichever the norms of a tile allow without any
rounding. Groups and shards have bounded bytes; the work is that of all queries times all rows.

Null vectors, those with null or non-finite components and rows with a null id take no part; shorter vectors count
as filled with zeros, empty ones as zero. A row is a candidate as often as it stands in the table; rows with a
query's own id are never its candidates. Query rows of one id and one vector are one query; those of one id and
different vectors have ranks of their own. No rows or no queries give no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.llm import common, intvec

#: Bytes, as doubles, of the queries of a group and of the candidates of a shard.
GROUP_BYTES, SHARD_BYTES = 64 << 20, 256 << 20
#: Rows of the tiles that a product is taken of.
QUERY_TILE, SHARD_TILE = 1024, 4096
#: Lists that one step of the tree merges.
FAN = 8
#: Partitions of the products; where there are more pairs of group and shard, a partition takes several in turn.
MOST_TASKS = 16_384
NONE = np.iinfo(np.int64).min


def products(q: np.ndarray, c: np.ndarray, q_norm: float, c_norm: float) -> np.ndarray:
    """All inner products of whole rows without rounding: no partial sum passes the product of the norms."""
    if q_norm * c_norm < 1 << 24:
        return q.astype(np.float32) @ c.astype(np.float32).T
    if q_norm * c_norm < 1 << 53:
        return q @ c.T
    return q.astype(np.int64) @ c.astype(np.int64).T


def select(scores: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and columns of the k largest of every row, the first of equals first, NONE where a row has fewer above
    `least`; scores are written over."""
    rows, at, out = np.arange(scores.shape[0]), np.empty((scores.shape[0], k), np.int64), np.full((scores.shape[0], k), NONE)
    for n in range(k):
        at[:, n] = scores.argmax(axis=1)
        value = scores[rows, at[:, n]]
        have = value > least
        out[have, n] = value[have]
        scores[rows, at[:, n]] = least
    return out, at


class Best:
    """The best candidates so far of the queries of a group."""

    def __init__(self, number: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
        self.number, self.ids, self.x, self.k = number, ids, x, k
        self.norms = np.linalg.norm(x, axis=1)
        self.score = np.full((ids.size, k), NONE, np.int64)
        self.found = np.zeros((ids.size, k), np.int64)

    def offer(self, ids: np.ndarray, x: np.ndarray) -> None:
        """Candidates in ascending id, none smaller than those offered before."""
        for c in range(0, ids.size, SHARD_TILE):
            own, y = ids[c : c + SHARD_TILE], x[c : c + SHARD_TILE]
            norm = float(np.linalg.norm(y, axis=1).max(initial=0))
            for a in range(0, self.ids.size, QUERY_TILE):
                b = min(a + QUERY_TILE, self.ids.size)
                scores = products(self.x[a:b], y, float(self.norms[a:b].max(initial=0)), norm)
                least = -np.inf if scores.dtype.kind == "f" else NONE
                lo, hi = np.searchsorted(own, self.ids[a:b], "left"), np.searchsorted(own, self.ids[a:b], "right")
                for r in np.flatnonzero(hi > lo).tolist():
                    scores[r, lo[r] : hi[r]] = least
                # an equal score later has a larger id, so it does not replace the last one kept
                top = scores.max(axis=1)
                alive = np.flatnonzero((top > least) & ((self.score[a:b, -1] == NONE) | (top > self.score[a:b, -1])))
                if not alive.size:
                    continue
                value, at = select(scores[alive], min(self.k, own.size), least)
                score = np.concatenate([self.score[a + alive], value], axis=1)
                found = np.concatenate([self.found[a + alive], own[at]], axis=1)
                order = np.argsort(-np.where(score == NONE, NONE + 1, score), axis=1, kind="stable")[:, : self.k]
                self.score[a + alive] = np.take_along_axis(score, order, 1)
                self.found[a + alive] = np.take_along_axis(found, order, 1)

    def lists(self, node: int) -> pa.RecordBatch:
        have = self.score != NONE
        ends = np.concatenate([[0], np.cumsum(have.sum(axis=1))]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(-self.score[have]), pa.array(self.found[have])], ["neg", "vec_id"])
        return pa.RecordBatch.from_arrays([pa.array(self.number), pa.array(self.ids), pa.array(np.full(self.ids.size, node)), pa.ListArray.from_arrays(pa.array(ends), pairs)], ["q", "query_id", "node", "top"])


def merge_tree(lists: DataFrame, nodes: int, k: int) -> DataFrame:
    """(q, query_id, node, top) of so many nodes to one list a query, FAN lists at a time."""
    while nodes > 1:
        best = F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k)
        lists = lists.groupBy("q", "query_id", F.floor(F.col("node") / FAN).alias("node")).agg(best.alias("top"))
        nodes = -(-nodes // FAN)
    return lists


def exact_topk(
    vectors: DataFrame, is_query: Column | None = None, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, group_bytes: int = GROUP_BYTES, shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best candidates of every query, equal scores by smaller vec_id.

    is_query: of the columns vec_id and embedding; None takes the ids divisible by 50."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & intvec.sound(F.col("embedding")))
    asks = F.col("vec_id") % 50 == 0 if is_query is None else is_query
    asked = common.table(rows.where(asks).distinct().withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    every, asking = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first(), asked.count()
    width = max(1, every[1] or 0)
    groups = max(1, -(-asking * width * 8 // group_bytes))
    shards = max(2 * spark.sparkContext.defaultParallelism, -(-every[0] * width * 8 // shard_bytes))
    task = lambda group, shard: (group * shards + shard).cast("long").alias("task")
    left = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(task(F.pmod(F.xxhash64("q"), F.lit(groups)), F.col("shard")), F.lit(0).alias("kind"), "vec_id", "q", "embedding")
    right = rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards))).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = right.select(task(F.col("group"), F.col("shard")), F.lit(1).alias("kind"), "vec_id", F.lit(0).cast("long").alias("q"), "embedding")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asking, best = None, [], None
        for batch in batches:
            tasks, kinds, ids, numbers = (batch.column(c).to_numpy() for c in ("task", "kind", "vec_id", "q"))
            cuts = np.flatnonzero(np.diff(2 * tasks + kinds)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), tasks.size], strict=True):
                if lo == hi:
                    continue
                if tasks[lo] != at:
                    if best is not None:
                        yield best.lists(at % shards)
                    at, asking, best = int(tasks[lo]), [], None
                x = intvec.floored(intvec.matrix(batch.column("embedding").slice(lo, hi - lo), width), scale)
                if kinds[lo] == 0:
                    asking.append((numbers[lo:hi], ids[lo:hi], x))
                elif asking or best is not None:
                    best = best or Best(*(np.concatenate(part) for part in zip(*asking, strict=True)), k)
                    asking = []
                    best.offer(ids[lo:hi], x)
        if best is not None:
            yield best.lists(at % shards)

    work = left.unionByName(right).repartitionById(min(MOST_TASKS, groups * shards), F.pmod("task", F.lit(MOST_TASKS)).cast("int")).sortWithinPartitions("task", "kind", "vec_id")
    lists = work.transform(common.map_batches, search, "q long, query_id long, node long, top array<struct<neg:long,vec_id:long>>")
    merged = merge_tree(common.table(lists, "topk-lists"), shards, k)
    out = merged.select("query_id", F.posexplode("top").alias("place", "best"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("best.vec_id").alias("vec_id"), (-F.col("best.neg")).alias("score"))


def op11_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best rows of embeddings for every row whose vec_id is divisible by 50."""
    return exact_topk(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP11_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.w, c.w) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 5
"""
