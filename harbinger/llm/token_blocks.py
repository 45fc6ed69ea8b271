"""Token ids in patched frame-of-reference blocks.

A segment holds whole documents. Its ids form one stream cut into blocks of 128; a block stores its minimum,
the differences packed at the width that a percentile of them fits, and the others ("exceptions") in a list
of positions and full differences. An index gives where each block's packed words start, so that one block
can be read alone. Segments are rows of a Parquet table (`part`, `seq`, `base`, `payload`), written with
Spark's commit protocol, in ascending document order.

Null or empty texts hold the end id only. Null ids come first; rows of equal id stand in text order, each a
document of its own. An empty table gives no segments.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.llm import common, tokens

MAGIC = b"PFB1"
BLOCK = 128
_HEAD = struct.Struct("<4sHHIIQI")


def _bit_lengths(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float64))[1].astype(np.uint8)


def pack(ids: np.ndarray, percentile: float = 0.9) -> bytes:
    """Blocks of a stream of unsigned 32-bit ids: header, block index, exceptions, packed words."""
    n = ids.size
    blocks = -(-n // BLOCK)
    x = np.zeros((blocks, BLOCK), np.uint32)
    x.reshape(-1)[:n] = ids
    if n % BLOCK:
        x[-1, n % BLOCK :] = ids[-1]
    low = x.min(axis=1) if blocks else np.empty(0, np.uint32)
    x -= low[:, None]
    bits = _bit_lengths(x)
    k = max(0, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.partition(bits, k, axis=1)[:, k] if blocks else np.empty(0, np.uint8)
    block, place = np.nonzero(bits > width[:, None])
    count = np.bincount(block, minlength=blocks).astype(np.uint8)
    start = np.zeros(blocks + 1, np.uint32)
    np.cumsum(2 * width.astype(np.uint32), out=start[1:])
    out = np.zeros(int(start[-1]), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        part = np.zeros((2 * w, rows.size), np.uint64)
        column = np.ascontiguousarray((x[rows] & np.uint32((1 << w) - 1 if w < 32 else 0xFFFFFFFF)).T).astype(np.uint64)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            part[word] |= column[j] << np.uint64(shift)
            if shift + w > 64:
                part[word + 1] |= column[j] >> np.uint64(64 - shift)
        out[start[rows].astype(np.int64)[:, None] + np.arange(2 * w)] = part.T
    head = struct.pack("<IIQ", blocks, block.size, n)
    return b"".join([head, low.tobytes(), width.tobytes(), count.tobytes(), start.tobytes(), place.astype(np.uint8).tobytes(), x[block, place].tobytes(), out.tobytes()])


def unpack(data: bytes | memoryview) -> np.ndarray:
    """The ids that pack() was given."""
    blocks, patched, n = struct.unpack_from("<IIQ", data)
    at = 16

    def take(count: int, kind: type) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    low, width, count = take(blocks, np.uint32), take(blocks, np.uint8), take(blocks, np.uint8)
    start, place, value = take(blocks + 1, np.uint32), take(patched, np.uint8), take(patched, np.uint32)
    packed = take(int(start[-1]), np.uint64)
    x = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        part = np.ascontiguousarray(packed[start[rows].astype(np.int64)[:, None] + np.arange(2 * w)].T)
        mask, column = np.uint64((1 << w) - 1), np.empty((BLOCK, rows.size), np.uint32)
        for j in range(BLOCK):
            word, shift = divmod(j * w, 64)
            got = part[word] >> np.uint64(shift)
            if shift + w > 64:
                got = got | part[word + 1] << np.uint64(64 - shift)
            column[j] = got & mask
        x[rows] = column.T
    x[np.repeat(np.arange(blocks), count), place] = value
    x += low[:, None]
    return x.reshape(-1)[:n]


def write_segment(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray, percentile: float) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    head = _HEAD.pack(MAGIC, 1, BLOCK, len(doc_ids), 0, ids.size, 0)
    return b"".join([head, np.array([d or 0 for d in doc_ids], np.int64).tobytes(), known.tobytes(), counts.astype(np.uint32).tobytes(), pack(ids, percentile)])


def read_segment(data: bytes | memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, which of them are known, tokens of each, and all ids."""
    magic, version, block, docs, _, n, _ = _HEAD.unpack_from(data)
    if magic != MAGIC or version != 1 or block != BLOCK:
        raise ValueError("not a segment of token blocks")
    at = _HEAD.size
    doc_ids, known = np.frombuffer(data, np.int64, docs, at), np.frombuffer(data, np.uint8, docs, at + 8 * docs)
    counts = np.frombuffer(data, np.uint32, docs, at + 9 * docs).astype(np.int64)
    ids = unpack(memoryview(data)[at + 13 * docs :])
    if ids.size != n or counts.sum() != n:
        raise ValueError("a segment's ids do not match its header")
    return doc_ids, known.astype(bool), counts, ids


def write_blocks(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", tokenizer_path: str | None = None, end_id: int | None = 2, percentile: float = 0.9, segment_tokens: int = 1 << 18
) -> DataFrame:
    """Encodes every whole text, appends end_id, and gives segments in ascending id order (to be written as a table)."""

    run = uuid.uuid4().hex

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, tokenizer_path, run)
        part, seq, base = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, base, size, held
            doc_ids = [d for h in held for d in h[0]]
            counts, ids = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            row = pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "base": [base], "docs": [len(doc_ids)], "tokens": [int(ids.size)], "payload": [write_segment(doc_ids, counts, ids, percentile)]},
                schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("base", pa.int64()), ("docs", pa.int32()), ("tokens", pa.int64()), ("payload", pa.binary())]),
            )
            seq, base, size, held = seq + 1, base + int(ids.size), 0, []
            return row

        for b in batches:
            texts, doc_ids = b.column("text"), b.column("doc_id").to_pylist()
            _, offsets = tokens.bytescan.raw(texts)
            for lo, hi in tokens.bytescan.passes(offsets):
                ids, counts = encoder.encode(texts.slice(lo, hi - lo))
                if end_id is not None:
                    ids, counts = np.insert(ids.astype(np.uint32), np.cumsum(counts), end_id), counts + 1
                held.append((doc_ids[lo:hi], counts, ids.astype(np.uint32)))
                size += ids.size
                if size >= segment_tokens:
                    yield flush()
        if held:
            yield flush()

    rows = common.texts_of(docs, id_col, text_col).repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    return rows.transform(common.map_batches, encode, "part int, seq int, base long, docs int, tokens long, payload binary")


def read_blocks(segments: DataFrame) -> DataFrame:
    """Per document, from written segments: doc_id, start, n_tokens, ids_crc32, and its ids' place (part, seq)."""
    totals = sorted((r["part"], int(r["n"])) for r in segments.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    heads, done = [], 0
    for part, n in totals:  # one row a partition of the write
        heads.append((part, done))
        done += n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, base, payload in zip(*(b.column(c) for c in ("part", "seq", "base", "payload")), strict=True):
                doc_ids, known, counts, ids = read_segment(payload.as_buffer())
                ends = np.cumsum(counts)
                data, cuts = memoryview(ids.astype("<u4").tobytes()), (4 * ends).tolist()
                crcs = [zlib.crc32(data[i:j]) for i, j in zip([0, *cuts[:-1]], cuts, strict=True)]
                n = len(crcs)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(doc_ids, pa.int64(), mask=~known), "within": ends - counts + base.as_py(), "n_tokens": counts, "ids_crc32": pa.array(crcs, pa.int64()), "part": pa.array([part.as_py()] * n, pa.int32()), "seq": pa.array([seq.as_py()] * n, pa.int32())}
                )

    rows = segments.select("part", "seq", "base", "payload").transform(common.map_batches, decode, "doc_id long, within long, n_tokens long, ids_crc32 long, part int, seq int")
    starts = segments.sparkSession.createDataFrame(heads, "part int, head long")
    return common.sized_join(rows, starts, ["part"], len(heads)).select("doc_id", (F.col("within") + F.col("head")).alias("start"), "n_tokens", "ids_crc32", "part", "seq")


def op1_token_blocks(spark, sf_dir: str) -> DataFrame:
    """Writes all documents' ids in block segments and reads them back."""
    segments = common.table(write_blocks(common.documents(spark, sf_dir)), "token-blocks", "uncompressed")
    return read_blocks(segments)
