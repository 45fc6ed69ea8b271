"""Short codes of vectors: each part by its nearest entry in a codebook learned from the distinct parts.

Vectors of whole numbers are cut into equal consecutive parts. Equal parts at a position become one row with its
number of copies (added up before the shuffle), so that neither a vector that stands a million times nor a common part
costs more than one row from there on. Weighted Lloyd runs over these distinct rows: a round is one pass that
gives each task's weighted sums by position and entry, of which positions times entries rows come to the driver. The
codes and errors of distinct parts are then joined back to the vectors; parts and labels with more than a thousandth of
all rows are broadcast (there cannot be more than a thousand of them a position), all others meet in a shuffle.

Rows whose vector is null or has null or non-finite components are left out. floor(scale * x) is held within 2^27.
Vectors shorter than the longest, and all where its length is no multiple of `parts`, count as filled with zeros. First
entries are those of the smallest ids (null last, repeated ids by vector), with fewer rows than entries as many as there are
rows; entries may be equal, and the lower index wins. Rows that repeat keep a row each. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.llm import common, intvec


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every row, in whole numbers; the first of equals."""
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ book.T) + (book * book).sum(axis=1)[None, :]
    code = d.argmin(axis=1)
    return code, d[np.arange(x.shape[0]), code]


def parts_of(vectors: DataFrame, parts: int, length: int) -> DataFrame:
    """row, position and part, one row for each part of each vector."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("whole", p * length + 1, F.lit(length)))
    return vectors.select("row", F.posexplode(cut).alias("position", "part"))


def learned(distinct: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (position, entry, component) after so many rounds over weighted distinct parts."""
    parts, entries, length = books.shape

    def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, length), np.int64)
        for b in batches:
            x, position, weight = intvec.matrix(b.column("part"), length, np.int64), b.column("position").to_numpy(), b.column("weight").to_numpy()
            for p in np.unique(position).tolist():
                mine = position == p
                code, _ = nearest(x[mine], books[p])
                np.add.at(n[p], code, weight[mine])
                np.add.at(total[p], code, x[mine] * weight[mine][:, None])
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["position", "entry", "n", "sums"])

    for _ in range(rounds):
        run = lambda batches, books=books: sums(batches, books)
        got = distinct.transform(common.map_batches, run, "position int, entry int, n long, sums array<long>").select("position", "entry", "n", F.posexplode("sums").alias("place", "x"))
        books = books.copy()
        before = books.copy()
        for r in got.groupBy("position", "entry", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():  # positions, entries and components
            books[r["position"], r["entry"], r["place"]] = int(r["x"]) // r["n"]
        if (books == before).all():  # all further rounds would be this one again
            break
    return books


def coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """The distinct parts with code and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, position = intvec.matrix(b.column("part"), books.shape[2], np.int64), b.column("position").to_numpy()
            code, error = np.zeros(x.shape[0], np.int64), np.zeros(x.shape[0], np.int64)
            for p in np.unique(position).tolist():
                mine = position == p
                code[mine], error[mine] = nearest(x[mine], books[p])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(code, pa.int32()), pa.array(error)], [*b.schema.names, "code", "error"])

    return distinct.transform(common.map_batches, run, "position int, part array<int>, weight long, code int, error long")


def compress(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 8, entries: int = 16, scale: int = 4096, rounds: int = 6,
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector kept. At most 256 entries: a code has two hex digits a part."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding")).where(intvec.sound(F.col("embedding")))
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    length = max(1, -(-longest // parts))
    whole = intvec.floors(F.col("embedding"), scale)
    whole = F.concat(whole, F.array_repeat(F.lit(0), F.lit(parts * length) - F.size(whole)))
    # a label is known by whether it is null and its value; written, so that row numbers stay what they are
    kept = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.col("label").isNull().alias("no_label"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("label"), whole.alias("whole"))
    kept = common.table(kept, "codes-vectors")
    total = kept.count()
    heads = kept.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select("whole").limit(entries).collect()
    books = np.array([r["whole"] for r in heads], np.int64).reshape(len(heads), parts, length).transpose(1, 0, 2)
    split = parts_of(kept, parts, length)
    distinct = common.table(split.groupBy("position", "part").agg(F.count(F.lit(1)).alias("weight")), "codes-distinct")
    books = learned(distinct, books, rounds)
    found = common.table(coded(distinct, books), "codes-found")
    joined = intvec.frequent_join(split, found, ["position", "part"], "weight", total, F.col("row"))
    by_row = joined.groupBy("row").agg(*[F.max(F.when(F.col("position") == p, F.col("code"))).alias(f"c{p}") for p in range(parts)], F.sum("error").alias("error"))
    code = F.concat(*[F.lpad(F.lower(F.hex(f"c{p}")), 2, "0") for p in range(parts)])
    out = common.table(kept.select("row", "vec_id", "no_label", "label").join(by_row.select("row", code.alias("code"), "error"), "row"), "codes-rows")
    common.discard(found, distinct)
    labels = out.groupBy("no_label", "label").agg(F.count(F.lit(1)).alias("n"), intvec.long_sum(F.col("error")).alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    out = intvec.frequent_join(out, labels, ["no_label", "label"], "n", total, F.col("row"))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """All embeddings in 8 parts of 16 entries, 6 rounds."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql(rounds: int = 6) -> str:
    """Plain Lloyd over all parts, copies included."""
    d = "list_inner_product(s.w, s.w) - 2 * list_inner_product(s.w, b.w) + list_inner_product(b.w, b.w)"
    near = f"SELECT s.r, s.p, min({d}) AS d, arg_min(b.e, ({d}) * 64 + b.e) AS e FROM s JOIN b{{n}} b ON b.p = s.p GROUP BY s.r, s.p"
    steps = []
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED ({near.format(n=n)})")
        steps.append(
            f"b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM b{n} b LEFT JOIN (SELECT p, e, list(x ORDER BY j) AS w FROM (SELECT p, e, j, floor(sum(x) / count(*)) AS x FROM (SELECT a.p, a.e, unnest(s.w) AS x, unnest(range(len(s.w))) AS j FROM a{n} a JOIN s ON s.r = a.r AND s.p = a.p) GROUP BY p, e, j) GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"
        )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT r, p, w[p * (len(w) // 8) + 1 : (p + 1) * (len(w) // 8)] AS w FROM v CROSS JOIN (SELECT unnest(range(8)) AS p)
), b0 AS MATERIALIZED (
  SELECT s.p, h.e, s.w FROM s JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, w) - 1 AS e FROM v) h ON h.r = s.r WHERE h.e < 16
), {", ".join(steps)}, f AS MATERIALIZED ({near.format(n=rounds)}), c AS (
  SELECT r, string_agg(lpad(lower(to_hex(CAST(e AS BIGINT))), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM f GROUP BY r
)
SELECT v.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY v.label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(list_transform(w, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256
FROM c JOIN v USING (r)
"""


OP13_SQL = _sql()
