"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors are one class, compared once. Classes are rotated onto the principal axes of a bounded sample (any
rotation is exact; the sample only decides how soon a comparison can stop), ordered by the leading axis, dealt into
bands of so many bytes and cut into tiles within them. A task takes a pair of bands: it holds the tiles of one and
lets those of the other pass by, so a tile travels once a band and not once a pair of tiles. A tile goes to a band
only if their boxes over the leading axes are near enough for a link, and tiles that are further apart are not
compared. In a pair of tiles, products accumulate axis group by axis group; what the rest can add is bounded by the
product of the suffix norms, rows and columns without a pair that can still reach the threshold are dropped, and a
block stops when none is left. Pairs that remain are decided by the cosine in double precision of the vectors as
given.

Bands are as many as give every core two pairs, more where a band would pass BAND_BYTES. So up to BAND_BYTES a core the
bytes that travel grow with the vectors; beyond that, and where boxes prune nothing, with their square over a band's
rows, as the work itself does with their square.

A pair of tiles gives link counts per class and the edges of a spanning forest of its links, so a tight group
gives rows in proportion to its members, not to its pairs.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; shorter vectors
count as filled with zeros. Rows with a null id link with nothing and have a null component. Rows of one id
and vector are copies of each other. Every row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harbinger.llm import common
from harbinger.llm.components import components

TILE_ROWS = 4096
SAMPLE_ROWS = 16_384
#: Leading axes of a tile's box.
BOX_AXES = 12
GROUP_AXES = 16
BLOCK_ROWS = 512
#: Bytes of the vectors of a band with their rotation, which a task holds at once.
BAND_BYTES = 96 << 20
#: A band is not made smaller than this for the sake of more tasks.
LEAST_BAND_ROWS = 1024
#: Tasks of the comparison; where pairs of bands are more, a task takes several, one after the other.
MOST_TASKS = 16_384


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles, filled with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy())
    if sizes.size and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((sizes.size, width))
    out[np.arange(width)[None, :] < sizes[:, None]] = values
    return out


def axes(sample: np.ndarray) -> np.ndarray:
    """Columns: principal axes of unit vectors, the strongest first."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()


def cut_tiles(x: np.ndarray, rows: int) -> list[np.ndarray]:
    """Row numbers of tiles: halved along the leading axis of largest spread until small enough."""
    out, todo = [], [np.arange(x.shape[0])]
    while todo:
        own = todo.pop()
        if own.size <= rows:
            out.append(own)
            continue
        lead = x[own, :BOX_AXES]
        axis = int(np.argmax(lead.max(axis=0) - lead.min(axis=0)))
        order = own[np.argsort(lead[:, axis], kind="stable")]
        half = rows * -(-own.size // (2 * rows))
        todo += [order[half:], order[:half]]
    return [o for o in out if o.size]


def band_rows(rows: int, width: int, item: int, cores: int) -> int:
    """Rows of a band: as many bands as give each core two pairs of them, and none above BAND_BYTES."""
    bands = int(np.ceil((np.sqrt(1 + 16 * cores) - 1) / 2))
    return max(1, min(max(LEAST_BAND_ROWS, -(-rows // bands)), BAND_BYTES // (width * (item + 4))))


def tiles(classes: DataFrame, width: int, basis: np.ndarray, tile_rows: int, parts: int) -> DataFrame:
    """(tile, n, lo, hi, ids, copies, vectors): blocks of classes near each other, numbered along the leading axis.
    Equal places on the axis are ordered by id, so that no partition grows with them."""
    item = item_type(classes)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("embedding"), width)
            first = x @ basis[:, 0] / np.linalg.norm(x, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(first)], [*b.schema.names, "first"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        ids = np.concatenate([b.column("rep").to_numpy(zero_copy_only=False) for b in got])
        copies = np.concatenate([b.column("copies").to_numpy(zero_copy_only=False) for b in got])
        x = np.concatenate([_matrix(b.column("embedding"), width) for b in got])
        turned = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ basis[:, :BOX_AXES]
        part = TaskContext.get().partitionId()
        for k, own in enumerate(cut_tiles(turned, tile_rows)):
            box = turned[own]
            yield pa.RecordBatch.from_pydict({
                "tile": pa.array([part << 32 | k], pa.int64()), "n": pa.array([own.size], pa.int32()), "lo": [box.min(axis=0).tolist()], "hi": [box.max(axis=0).tolist()],
                "ids": [ids[own].tobytes()], "copies": [copies[own].astype(np.int64).tobytes()], "vectors": [x[own].astype(item).tobytes()],
            })

    kind = classes.schema["embedding"].dataType.simpleString()
    rows = classes.select("rep", "copies", "embedding").transform(common.map_batches, lead, f"rep long, copies long, embedding {kind}, first double")
    rows = rows.repartitionByRange(parts, "first", "rep")
    return rows.transform(common.map_batches, block, "tile long, n int, lo array<double>, hi array<double>, ids binary, copies binary, vectors binary")


def item_type(classes: DataFrame) -> str:
    """How a tile stores components, without loss."""
    return "<f4" if classes.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"


def reach_of(threshold: float) -> float:
    """The largest distance of unit vectors that link, and a little more than rounding can take from a box."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6


def with_bands(boxes: DataFrame, rows: int) -> DataFrame:
    """boxes and their band: consecutive range partitions of about so many rows together. The running sum is over one
    row of two numbers a partition."""
    boxes = boxes.withColumn("part", F.shiftright("tile", 32))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = boxes.groupBy("part").agg(F.sum("n").alias("rows"))
    parts = parts.select("part", F.floor(F.coalesce(F.sum("rows").over(earlier), F.lit(0)) / rows).cast("long").alias("band"))
    return boxes.join(parts, "part").drop("part")


def band_pairs(boxes: DataFrame, width: int, threshold: float) -> DataFrame:
    """(tile, pair, side, same) from tiles with boxes and bands: the pairs of bands that a tile goes to. A pair of bands x <= y is
    y (y + 1) / 2 + x; side 0 is held, side 1 passes by, same is a band with
    itself. Tiles and the boxes of bands are joined on cells of the first axis,
    each as wide as the largest distance of a link, so that only those in reach of each other meet."""
    reach = reach_of(threshold)
    step = max(reach, 1e-3)
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / step).cast("int"), F.floor(hi / step).cast("int"))).alias("cell")
    every = range(min(BOX_AXES, width))
    bands = boxes.groupBy("band").agg(F.array(*[F.min(F.col("lo")[k]) for k in every]).alias("b_lo"), F.array(*[F.max(F.col("hi")[k]) for k in every]).alias("b_hi"))
    bands = common.table(bands.select(F.col("band").alias("other"), "b_lo", "b_hi", cells(F.col("b_lo")[0], F.col("b_hi")[0])), "vector-bands")
    own = boxes.select("tile", "band", "lo", "hi", cells(F.col("lo")[0] - reach, F.col("hi")[0] + reach))
    gap = F.zip_with(
        F.arrays_zip(F.col("lo").alias("l"), F.col("hi").alias("h")), F.arrays_zip(F.col("b_lo").alias("l"), F.col("b_hi").alias("h")), lambda x, y: F.pow(F.greatest(F.lit(0.0), y["l"] - x["h"], x["l"] - y["h"]), F.lit(2.0))
    )
    near = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x) <= reach * reach
    x, y = F.least("band", "other"), F.greatest("band", "other")
    pair = F.shiftright(y * (y + 1), 1) + x
    return common.sized_join(own, bands, ["cell"], bands.count()).where(near).select("tile", pair.alias("pair"), (F.col("band") > F.col("other")).cast("int").alias("side"), (F.col("band") == F.col("other")).alias("same")).distinct()


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the links (i, j) of n nodes make a spanning forest."""
    parent = list(range(n))
    keep = []
    for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x != y:
            parent[x] = y
            keep.append(k)
    return np.array(keep, np.int64)


class Tile(NamedTuple):
    """A tile as a task compares it: all that belongs to one tile alone is computed once a task."""

    tile: int
    lo: np.ndarray
    hi: np.ndarray
    ids: np.ndarray
    copies: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    turned: np.ndarray
    suffix: list[np.ndarray]


def _cuts(width: int) -> list[int]:
    return [*range(0, width, GROUP_AXES), width]


def prepared(x: np.ndarray, basis: np.ndarray, ids: np.ndarray, copies: np.ndarray, tile: int = 0, lo=None, hi=None) -> Tile:
    """With norms, the unit vectors on the axes, and the norms of what lies beyond each axis group."""
    norms = np.linalg.norm(x.astype(np.float64), axis=1)
    turned = ((x / norms[:, None]) @ basis).astype(np.float32)
    squares = turned.astype(np.float64) ** 2
    suffix = [np.sqrt(squares[:, c:].sum(axis=1)).astype(np.float32) for c in _cuts(basis.shape[1])[1:]]
    return Tile(tile, lo, hi, ids, copies, x, norms, turned, suffix)


def links(a: Tile, b: Tile, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked rows of two tiles, a block of rows of the first at a time; of a tile with itself, each pair once."""
    least = np.float32(threshold - 1e-4)  # more than single precision can err
    cuts = _cuts(a.turned.shape[1])
    for lo in range(0, a.ids.size, BLOCK_ROWS):
        rows, cols = np.arange(lo, min(lo + BLOCK_ROWS, a.ids.size)), np.arange(b.ids.size)
        few = rows.size * cols.size // 50
        got = np.zeros((rows.size, cols.size), np.float32)
        ta, tb = a.turned[rows], b.turned
        for g, (c, d) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            got += ta[:, c:d] @ tb[:, c:d].T
            alive = got + np.outer(a.suffix[g][rows], b.suffix[g][cols]) >= least
            if np.count_nonzero(alive) <= few:
                break
            r, k = alive.any(axis=1), alive.any(axis=0)
            if 2 * np.count_nonzero(r) * np.count_nonzero(k) <= alive.size:
                rows, cols, got, alive, ta, tb = rows[r], cols[k], got[np.ix_(r, k)], alive[np.ix_(r, k)], ta[r], tb[k]
        i, j = np.nonzero(alive)
        i, j = rows[i], cols[j]
        if a is b:
            i, j = i[i < j], j[i < j]
        for k in range(0, i.size, 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            cosine = np.einsum("ij,ij->i", a.vectors[x].astype(np.float64), b.vectors[y].astype(np.float64)) / (a.norms[x] * b.norms[y])
            yield x[cosine >= threshold], y[cosine >= threshold]


def linked(a: Tile, b: Tile, threshold: float) -> pa.RecordBatch:
    """(kind, a, b) of two tiles: kind 0, class a has b further links; kind 1, a and b are linked."""
    own = a is b
    ids, copies = (a.ids, a.copies) if own else (np.concatenate([a.ids, b.ids]), np.concatenate([a.copies, b.copies]))
    count = np.zeros(ids.size, np.int64)
    edges = [(np.empty(0, np.int64),) * 2]
    for i, j in links(a, b, threshold):
        if not i.size:
            continue
        j = j if own else j + a.ids.size
        np.add.at(count, i, copies[j])
        np.add.at(count, j, copies[i])
        keep = forest(ids.size, i, j)
        edges.append((i[keep], j[keep]))
    some = np.flatnonzero(count)
    i, j = (np.concatenate(e) for e in zip(*edges, strict=True))
    keep = forest(ids.size, i, j)
    i, j = i[keep], j[keep]
    kind = np.repeat([0, 1], [some.size, i.size])
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(np.concatenate([ids[some], ids[i]])), pa.array(np.concatenate([count[some], ids[j]]))], ["kind", "a", "b"])


def compare(blocks: DataFrame, needs: DataFrame, width: int, item: str, basis: np.ndarray, threshold: float) -> DataFrame:
    """(kind, a, b) of all tiles of each pair of bands; needs as `band_pairs` gives them, written."""
    reach = reach_of(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, held = None, []
        for batch in batches:
            for row in range(batch.num_rows):
                value = lambda c: batch.column(c)[row]  # noqa: B023, E731
                numbers = lambda c, kind: np.frombuffer(value(c).as_buffer(), kind)  # noqa: B023, E731
                if value("pair").as_py() != pair:
                    pair, held = value("pair").as_py(), []
                lo, hi = (np.array(value(c).as_py()) for c in ("lo", "hi"))
                # copies of the buffers, so that the batch they lie in can go
                tile = prepared(numbers("vectors", item).reshape(-1, width).copy(), basis, numbers("ids", np.int64).copy(), numbers("copies", np.int64).copy(), value("tile").as_py(), lo, hi)
                if value("side").as_py() == 0:
                    held.append(tile)
                    if not value("same").as_py():
                        continue
                for other in held:
                    if (np.maximum(0, np.maximum(other.lo - hi, lo - other.hi)) ** 2).sum() <= reach * reach:
                        found = linked(other, tile, threshold)
                        if found.num_rows:
                            yield found

    facts = needs.agg(F.count(F.lit(1)), F.max("pair")).first()
    work = common.sized_join(blocks.drop("n"), needs, ["tile"], facts[0])
    work = work.withColumn("task", F.pmod("pair", F.lit(MOST_TASKS)).cast("int")).repartitionById(min(MOST_TASKS, (facts[1] or 0) + 1), "task").sortWithinPartitions("pair", "side", "tile")
    return work.transform(common.map_batches, run, "kind int, a long, b long")


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, tile_rows: int = TILE_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = F.col("embedding")
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0) & F.col("vec_id").isNotNull(), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    rows = rows.select("vec_id", "embedding", F.when(sound, F.xxhash64(v)).alias("h1"), F.when(sound, F.xxhash64(F.lit(1), v)).alias("h2"))
    classes = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding"))
    classes = common.table(classes, "vector-classes")
    width = classes.agg(F.max(F.size("embedding"))).first()[0] or 0
    if not width:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = classes.select("embedding", F.xxhash64("rep", "h1").alias("o")).orderBy("o").limit(sample_rows).select("embedding").toArrow().column(0).combine_chunks()
    x = _matrix(sample, width)
    basis = axes(x / np.linalg.norm(x, axis=1, keepdims=True))
    count, item = classes.count(), item_type(classes)
    rows_a_band = band_rows(count, width, np.dtype(item).itemsize, spark.sparkContext.defaultParallelism)
    # four range partitions a band, as their bounds are sampled
    blocks = common.table(tiles(classes, width, basis, tile_rows, -(-4 * count // rows_a_band)), "vector-tiles", "lz4")
    boxes = with_bands(blocks.select("tile", "n", "lo", "hi"), rows_a_band)
    needs = common.table(band_pairs(boxes, width, threshold), "vector-band-pairs")
    found = common.table(compare(blocks, needs, width, item, basis, threshold), "vector-links")
    common.discard(blocks, needs)
    counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links")).withColumnRenamed("a", "rep")
    comps = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "rep")
    facts = common.table(classes.select("h1", "h2", "rep", "copies").join(counts, "rep", "left").join(comps, "rep", "left"), "vector-facts")
    out = rows.select("vec_id", "h1", "h2").join(facts, ["h1", "h2"], "left")
    component = F.coalesce("component", "rep", "vec_id")
    return out.select("vec_id", F.coalesce(F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op4_embed_dedup(spark, sf_dir: str) -> DataFrame:
    """All embeddings at cosine 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
