"""Mixes sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents, in id order, are one stream of words cut into blocks. A source's target gives its block
quota: whole passes over all its blocks, then a part of one more pass. The tree starts with all sources'
quotas and one shard; each split draws, by a multivariate hypergeometric law, how many blocks of each source
the left half of the shards gets, until every shard has its own exact quotas. A keyed permutation ranks the
blocks of every pass; shard after shard takes the next ranks, so the shards' draws are disjoint and a source's
quotas are met exactly. Inside a shard, a key per draw gives a local order.

Everything but the quotas is computed where the documents are. They are one number per source and shard, at most
MOST_QUOTAS in all with more than one shard, so many sources get fewer shards; sources themselves, one row each,
must fit the driver.

A document's size is its number of words; null texts have none. Null is a source of its own, last. Rows of
equal id are documents of their own. Documents without words are never taken. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.llm import bytescan, common

CYCLE = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 256
#: Blocks over all sources; larger corpora get larger blocks, as the drawing of counts is limited to 10**9.
MOST_BLOCKS = 4 * 10**8
SHARD_WORDS = 1 << 22
#: Shards of a small corpus, where it has that many blocks, and of a very large one.
LEAST_SHARDS, MOST_SHARDS = 32, 1024
MOST_QUOTAS = 1 << 22
#: Words that one task orders when a mix is written; a larger shard is ordered in parts.
PART_WORDS = 1 << 20


def targets(sizes: Mapping[str, int], weights: Mapping[str, float], most: int = MOST_REPEATS) -> dict[str, float]:
    """Shares the sum of all sizes by weight; no source gets more than `most` times its size, the rest is shared again."""
    out = dict.fromkeys(sizes, 0.0)
    left, active = float(sum(sizes.values())), [s for s in sizes if sizes[s] > 0 and weights[s] > 0]
    while active:
        whole = sum(weights[s] for s in active)
        over = [s for s in active if left * weights[s] / whole > most * sizes[s]]
        if not over:
            return out | {s: left * weights[s] / whole for s in active}
        for s in over:
            out[s] = float(most * sizes[s])
            active.remove(s)
        left -= sum(out[s] for s in over)
    return out


def block_words(size: int, total: int) -> int:
    """At least 64 blocks a source where it has as many words."""
    return max(1, min(max(BLOCK_WORDS, -(-total // MOST_BLOCKS)), size // 64))


def split_quotas(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas by shard and source: the tree's leaves. Each node draws with a key of its own."""
    out = np.zeros((shards, quotas.size), np.int64)

    def descend(lo: int, hi: int, have: np.ndarray) -> None:
        if hi - lo == 1:
            out[lo] = have
            return
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(key=[seed, (lo << 32) | hi]))
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, take, method="marginals")
        descend(lo, mid, left)
        descend(mid, hi, have - left)

    descend(0, shards, quotas)
    return out


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..n-1 (Feistel rounds over the next even number of bits, walked until inside)."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = x.astype(np.uint64)
    walk = np.ones(x.size, bool)
    with np.errstate(over="ignore"):
        while walk.any():
            left, right = out[walk] >> np.uint64(half), out[walk] & mask
            for r in range(4):
                left, right = right, left ^ (bytescan.mix(right + np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & mask)
            out[walk] = left << np.uint64(half) | right
            walk = out >= n
    return out.astype(np.int64)


def word_count(text: Column) -> Column:
    """Runs of characters other than space and tab to carriage return; null has none."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def sizes_of(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(doc_id, source, part, queue, before, n) in ascending id order; n is the number of words."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("n")
    )
    rows = common.table(rows, "mixing-sizes")
    rows = rows.withColumn("queue", F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for b, before in common.running(batches, "queue", "n"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array([part] * b.num_rows, pa.int32()), b.column("queue"), pa.array(before), b.column("n")], ["doc_id", "source", "part", "queue", "before", "n"])

    ordered = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "source", "n")
    return ordered.transform(common.map_batches, number, "doc_id long, source string, part int, queue string, before long, n long")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Mapping[str | None, float] | None = None, most_repeats: int = MOST_REPEATS, shards: int | None = None, seed: int = 7
) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken, and `draws`: the word ranges that the mix takes,
    each with its pass, shard, key of the order inside the shard, and block of the source. What the tree's leaves give no shard is
    not taken.

    weights: by source; None gives the sources, in code-point order with null last, the weights 5, 2, 1, repeating.
    """
    rows, sizes = common.with_offsets(common.table(sizes_of(docs, id_col, text_col, source_col), "mixing-rows"))
    names = sorted((q for q in sizes if q != "n"), key=lambda q: q[1:]) + [q for q in sizes if q == "n"]
    if weights is None:
        weight = {q: float(CYCLE[k % len(CYCLE)]) for k, q in enumerate(names)}
    else:
        weight = {q: float(weights.get(None if q == "n" else q[1:], 0)) for q in names}
    target = targets({q: sizes[q] for q in names}, weight, most_repeats)
    total = sum(sizes.values())
    step = {q: block_words(sizes[q], total) for q in names}
    blocks = {q: -(-sizes[q] // step[q]) for q in names}
    quota = {}
    for q in names:
        whole = int(target[q] / sizes[q] + 1e-9) if sizes[q] else 0
        rest = round(max(0.0, target[q] - whole * sizes[q]) / step[q])
        quota[q] = min(whole * blocks[q] + rest, most_repeats * blocks[q])
    if shards is None:
        shards = max(1, min(MOST_SHARDS, max(LEAST_SHARDS, total // SHARD_WORDS), sum(quota.values()), MOST_QUOTAS // max(1, len(names))))
    leaves = split_quotas(np.array([quota[q] for q in names], np.int64), shards, seed) if names else np.zeros((1, 0), np.int64)
    ends = {q: np.cumsum(leaves[:, k]) for k, q in enumerate(names)}
    number = {q: k for k, q in enumerate(names)}
    span = pa.struct([("pass", pa.int32()), ("shard", pa.int32()), ("rank", pa.int64()), ("first", pa.int64()), ("words", pa.int64()), ("block", pa.int64())])

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                n, base = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "base"))
                queues = b.column("queue").to_pylist()
                size = np.array([step[q] for q in queues], np.int64)
                first, count = base // size, np.where(n > 0, (base + n - 1) // size - base // size + 1, 0)
                doc = np.repeat(np.arange(n.size), count)
                block = np.arange(doc.size) - np.repeat(np.cumsum(count) - count, count) + first[doc]
                begin = np.maximum(block * size[doc], base[doc]) - base[doc]
                words = np.minimum((block + 1) * size[doc], (base + n)[doc]) - base[doc] - begin
                which = np.array([number[q] for q in queues], np.int64)[doc]
                got = []
                for k in np.unique(which).tolist():
                    mine, q = np.flatnonzero(which == k), names[k]
                    for p in range(-(-quota[q] // blocks[q])):
                        rank = p * blocks[q] + permuted(block[mine], blocks[q], (seed * 1000003 + k) * 8 + p)
                        shard = np.searchsorted(ends[q], rank, "right")
                        chosen = shard < shards
                        at = mine[chosen]
                        got.append((doc[at], np.full(at.size, p), shard[chosen], rank[chosen] * len(names) + k, begin[at], words[at], block[at]))
                d, p, shard, rank, begin, words, number_of = (np.concatenate(c) for c in zip(*got, strict=True)) if got else [np.empty(0, np.int64)] * 7
                order = np.lexsort((begin, p, d))
                d, p, shard, rank, begin, words, number_of = (c[order] for c in (d, p, shard, rank, begin, words, number_of))
                with np.errstate(over="ignore"):
                    key = (bytescan.mix(rank.astype(np.uint64) + np.uint64(seed)) >> np.uint64(1)).astype(np.int64)
                taken = np.bincount(d, words, minlength=n.size).astype(np.int64)
                cuts = np.zeros(n.size + 1, np.int32)
                np.cumsum(np.bincount(d, minlength=n.size), out=cuts[1:])
                values = pa.StructArray.from_arrays([pa.array(p, pa.int32()), pa.array(shard, pa.int32()), pa.array(key), pa.array(begin, pa.int64()), pa.array(words, pa.int64()), pa.array(number_of, pa.int64())], fields=list(span))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("source"), pa.array(n), pa.array([sizes[q] for q in queues], pa.int64()), pa.array([target[q] for q in queues], pa.float64()), pa.array(taken), pa.ListArray.from_arrays(pa.array(cuts), values)],
                    ["doc_id", "source", "size", "source_size", "target", "taken", "draws"],
                )

    schema = "doc_id long, source string, size long, source_size long, target double, taken long, draws array<struct<pass:int,shard:int,rank:long,first:long,words:long,block:long>>"
    return rows.select("doc_id", "source", "queue", "n", "base").transform(common.map_batches, draw, schema)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row per document and pass that takes of it, with the text from the words taken.

    A document taken whole keeps its text as it is. doc_id and all other columns stay; n_chars, if there is one,
    is that of the new text. Rows stand in shards and in each shard's local order; a shard of more than PART_WORDS
    is dealt to tasks by ranges of that order, which are even as its keys are hashes. Columns of any names stay.
    """
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    source_col = options.get("source_col", "source")
    plan = mix(docs, **options).where("taken > 0").groupBy(F.col("doc_id").alias("_mix_id"), F.col("source").alias("_mix_source"), F.col("size").alias("_mix_n")).agg(F.min("draws").alias("draws"))
    plan = common.table(plan, "mixing-draws")
    facts = plan.select(F.explode("draws").alias("d")).agg(F.sum("d.words").alias("words"), F.max("d.shard").alias("shard")).first()
    parts = -(-(facts["words"] or 0) // (PART_WORDS * ((facts["shard"] or 0) + 1))) or 1
    columns = docs.columns
    draws_col, shard_col, rank_col, part_col = (common.unused(c, columns) for c in ("_draws", "_shard", "_rank", "_part"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            draws, text = b.column(draws_col), b.column(text_col)
            count = np.diff(draws.offsets.to_numpy())
            p, shard, rank, first, words = (draws.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
            row = np.repeat(np.arange(b.num_rows), count)
            if not row.size:
                continue
            data, offsets = bytescan.raw(text)
            start, end, doc = bytescan.words(data, offsets)
            size = np.bincount(doc, minlength=b.num_rows)
            own = np.cumsum(size) - size
            head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (p[1:] != p[:-1])))  # draws stand by pass
            new: list[str] = []
            for k, (i, j) in enumerate(zip(head.tolist(), [*head[1:].tolist(), row.size], strict=True)):
                r = row[i]
                if words[i:j].sum() == size[r]:
                    new.append(text[int(r)].as_py() or "")
                    continue
                run = np.flatnonzero(np.append(True, first[i + 1 : j] != first[i : j - 1] + words[i : j - 1])) + i  # runs of words that follow each other
                last = np.append(run[1:], j) - 1
                new.append("\n".join(bytes(data[start[own[r] + first[x]] : end[own[r] + first[y] + words[y] - 1]]).decode() for x, y in zip(run.tolist(), last.tolist(), strict=True)))
            take = pa.array(row[head])
            columns = {c: b.column(c).take(take) for c in b.schema.names if c != draws_col}
            columns[text_col] = pa.array(new, b.schema.field(text_col).type)
            if "n_chars" in columns:
                columns["n_chars"] = pc.utf8_length(columns[text_col]).cast(b.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(shard[head], pa.int32()), pa.array(rank[head])], [*columns, shard_col, rank_col])

    from pyspark.sql.types import IntegerType, LongType, StructField, StructType

    # Rows of one id, source and size take the same draws, the least of theirs.
    same = F.col(f"doc.{id_col}").cast("long").eqNullSafe(F.col("mix._mix_id")) & F.col(f"doc.{source_col}").cast("string").eqNullSafe(F.col("mix._mix_source")) & (word_count(F.col(f"doc.{text_col}")) == F.col("mix._mix_n"))
    joined = docs.alias("doc").join(plan.alias("mix"), same).select("doc.*", F.col("mix.draws").alias(draws_col))
    schema = StructType([*docs.schema.fields, StructField(shard_col, IntegerType()), StructField(rank_col, LongType())])
    rows = joined.transform(common.map_batches, cut, schema)
    part = F.shiftright(F.shiftright(rank_col, 40) * F.lit(parts).cast("long"), 23)  # of the 63-bit key, the top 23 bits
    return rows.withColumn(part_col, part).repartition(shard_col, part_col).sortWithinPartitions(shard_col, rank_col).select(*columns)


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    """Mixes all documents with weights 5, 2, 1 by source. Further columns: source, the shards that draw from the document,
    and its draws as pass:shard:block:first:words."""
    rows = mix(common.documents(spark, sf_dir))
    draws = F.transform("draws", lambda d: F.concat_ws(":", *[d[c].cast("string") for c in ("pass", "shard", "block", "first", "words")]))
    shards = F.array_join(F.transform(F.array_sort(F.array_distinct(F.transform("draws", lambda d: d["shard"]))), lambda x: x.cast("string")), ",")
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", shards.alias("shards"), F.array_join(draws, ",").alias("draws"))
