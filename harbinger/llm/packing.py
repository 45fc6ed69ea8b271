"""Mixture-controlled packing of documents into sequences.

Each source is a queue of tokens in document order. Deficit round-robin serves the queues in quanta: a source
earns credit in proportion to its target and is served as soon as it has earned half a quantum more than it
was given; what it lacks is carried into the next window, whatever partition that lies in. So as long as no queue
has ended, each of n sources with share p stands within (1 + n p) / 2 quanta of its target at every place of the
stream: half a quantum by its own rounding, and its share of the others' halves. The schedule has a closed form:
quantum i of source s falls due at time (2i+1)/w_s, ties in source order, and its place in the stream is the sum
over all sources of the quanta due before it. So every partition places its own documents knowing only each
queue's total and where its rows start in their queues. A queue that ends early leaves its share to the others.
Queues with a target of 0 are a class of their own, scheduled by their sizes behind the end of all others.

Full windows need no padding; the rest of the stream is cut into sequences whose lengths are powers of two.
Null texts are empty and hold the end id only; null is a source of its own; rows of equal id are documents of
their own. Empty tables give no pieces.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harbinger.llm import common, tokens

#: Weights are rounded to this many parts, so that the schedule's products stay within 63 bits.
PARTS = 1 << 20
CYCLE = (5.0, 2.0, 1.0)
#: Quanta times queues that are placed at once.
PLACED = 1 << 18


def weights(totals: dict[str, int], targets: dict[str, float] | None = None) -> dict[str, int]:
    """A whole weight of each queue: its share of `targets`, or of all tokens."""
    want = {q: max(0.0, float((targets or {}).get(q, 0))) for q in totals} if targets else {q: float(n) for q, n in totals.items()}
    whole = sum(want.values()) or 1.0
    return {q: max(1, round(PARTS * x / whole)) for q, x in want.items()}


def classes(totals: dict[str, int], targets: dict[str, float] | None) -> list[tuple[list[str], np.ndarray, np.ndarray, int]]:
    """Queues that are scheduled together, each class with its queues' weights and totals and its place in the stream:
    those with a target, then those without, by size."""
    out, at = [], 0
    for aimed in (True, False):
        own = {q: n for q, n in sorted(totals.items()) if (not targets or targets.get(q, 0) > 0) == aimed}
        share = weights(own, targets if aimed else None)
        out.append((list(own), np.array([share[q] for q in own], np.int64), np.array(list(own.values()), np.int64), at))
        at += sum(own.values())
    return out


def places(queue: int, quanta: np.ndarray, weight: np.ndarray, total: np.ndarray, quantum: int) -> np.ndarray:
    """Where in the stream each of a queue's quanta starts."""
    out = np.minimum(total[queue], quanta * quantum)
    after = (np.arange(weight.size) > queue).astype(np.int64)
    step = max(1, PLACED // weight.size)
    for lo in range(0, quanta.size, step):
        due = 2 * quanta[lo : lo + step, None] + 1
        served = np.minimum(total, ((due * weight - after) // weight[queue] + 1) // 2 * quantum)
        out[lo : lo + step] += served.sum(axis=1) - served[:, queue]
    return out


def sequences(total: int, window: int) -> np.ndarray:
    """Starts of the sequences after the full windows: powers of two, longest first; the last entry is the end."""
    at, left = [total - total % window], total % window
    while left:
        step = 1 << (left.bit_length() - 1)
        at.append(at[-1] + step)
        left -= step
    return np.array(at, np.int64)


def pieces(doc: np.ndarray, start: np.ndarray, stop: np.ndarray, at: np.ndarray, window: int, tail: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cuts spans placed at `at` where sequences end and joins neighbours: doc, start, length, sequence, offset."""
    parts = []
    full = int(tail[0])
    while doc.size:
        whole = at < full
        k = np.searchsorted(tail, at, "right") - 1
        first = np.where(whole, at - at % window, tail[np.minimum(k, tail.size - 1)])
        last = np.where(whole, first + window, tail[np.minimum(k + 1, tail.size - 1)])
        seq = np.where(whole, at // window, full // window + k)
        length = np.minimum(stop - start, last - at)
        parts.append((doc, start, length, seq, at - first))
        rest = start + length < stop
        doc, start, stop, at = doc[rest], (start + length)[rest], stop[rest], (at + length)[rest]
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    doc, start, length, seq, offset = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((start, doc))
    doc, start, length, seq, offset = doc[order], start[order], length[order], seq[order], offset[order]
    new = np.ones(doc.size, bool)
    new[1:] = (doc[1:] != doc[:-1]) | (seq[1:] != seq[:-1]) | (offset[1:] != offset[:-1] + length[:-1])
    head = np.flatnonzero(new)
    return doc[head], start[head], np.add.reduceat(length, head), seq[head], offset[head]


def tokenized(docs: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str, tokenizer_path: str | None, end_id: int | None, own: Iterable[str] = ()) -> DataFrame:
    """(doc_id, source, part, queue, before, n, ids) in ascending id order; ids are little-endian 16-bit numbers."""

    run = uuid.uuid4().hex

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer, tokenizer_path, run)
        part, done = TaskContext.get().partitionId(), {}
        for whole in batches:
            _, offsets = tokens.bytescan.raw(whole.column("text"))
            for lo, hi in tokens.bytescan.passes(offsets):
                b = whole.slice(lo, hi - lo)
                ids, n = encoder.encode(b.column("text"))
                if end_id is not None:
                    ids, n = np.insert(ids, np.cumsum(n), end_id), n + 1
                before = np.empty(n.size, np.int64)
                for k, (q, size) in enumerate(zip(b.column("queue").to_pylist(), n.tolist(), strict=True)):
                    before[k] = have = done.get(q, 0)
                    done[q] = have + size
                cuts = np.zeros(n.size + 1, np.int32)
                np.cumsum(2 * n, out=cuts[1:])
                data = pa.BinaryArray.from_buffers(pa.binary(), n.size, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(ids.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), pa.array([part] * n.size, pa.int32()), b.column("queue"), pa.array(before), pa.array(n), data], ["doc_id", "source", "part", "queue", "before", "n", "ids"])

    rows = common.texts_of(docs, id_col, text_col, source_col).withColumnRenamed(source_col, "source")
    rows = rows.withColumn("queue", common.queue_column(rows, "source", own))
    rows = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "source", "text")
    return rows.transform(common.map_batches, encode, "doc_id long, source string, part int, queue string, before long, n long, ids binary")


def pack_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", targets: dict[str | None, float] | None = None, window: int = 1024, quantum: int = 64,
    tokenizer: str = "byte_bpe_50k.json", tokenizer_path: str | None = None, end_id: int | None = 0,
) -> DataFrame:
    """A row per piece: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    targets: weight by source; None takes the documents' own proportions, with which all queues end together.
    A source without a target, or with one of 0, is served when the others have ended: nothing is dropped.
    Past common.MOST_QUEUES sources those without a target share queues, so windows follow the shares of these groups.
    """
    named = {("n" if s is None else f"s{s}"): w for s, w in targets.items()} if targets else None
    rows, totals = common.with_offsets(common.table(tokenized(docs, id_col, text_col, source_col, tokenizer, tokenizer_path, end_id, named or ()), "packing-ids"))
    groups = classes(totals, named)
    tail, number = sequences(sum(totals.values()), window), {q: (g, k) for g, (names, *_) in enumerate(groups) for k, q in enumerate(names)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                b = whole.slice(lo, 500)
                n, base = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n", "base"))
                queue = np.array([number[q] for q in b.column("queue").to_pylist()], np.int64).reshape(-1, 2)
                first, last = base // quantum, (base + n - 1) // quantum
                count = np.where(n > 0, last - first + 1, 0)
                doc = np.repeat(np.arange(n.size), count)
                c = np.arange(doc.size) - np.repeat(np.cumsum(count) - count, count) + first[doc]
                at = np.empty(doc.size, np.int64)
                for g, q in np.unique(queue, axis=0).tolist():
                    mine = (queue[doc] == (g, q)).all(axis=1)
                    _, weight, total, start = groups[g]
                    at[mine] = start + places(q, c[mine], weight, total, quantum)
                begin, end = np.maximum(c * quantum, base[doc]), np.minimum((c + 1) * quantum, (base + n)[doc])
                doc, start, length, seq, offset = pieces(doc, begin - base[doc], end - base[doc], at + begin - c * quantum, window, tail)
                ids = b.column("ids")
                data = np.frombuffer(b"".join(x.as_py() for x in ids), "<u2").astype("<u4").tobytes()
                view, own = memoryview(data), (np.cumsum(n) - n)[doc]
                i = 4 * (own + start)
                crcs = [zlib.crc32(view[x:y]) for x, y in zip(i.tolist(), (i + 4 * length).tolist(), strict=True)]
                take = pa.array(doc)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(take), b.column("source").take(take), *(pa.array(x, pa.int64()) for x in (start, length, crcs, n[doc], seq, offset))],
                    ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
                )

    return rows.select("doc_id", "source", "queue", "n", "base", "ids").transform(
        common.map_batches, place, "doc_id long, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )


def cycle_targets(docs: DataFrame, source_col: str = "source") -> dict[str | None, float] | None:
    """Weights 5, 2, 1, repeating, by source; None, the corpus's own proportions, past common.MOST_QUEUES sources, as those share queues."""
    names = [r[0] for r in docs.select(F.col(source_col).cast("string")).distinct().limit(common.MOST_QUEUES + 1).collect()]
    if len(names) > common.MOST_QUEUES:
        return None
    return {s: CYCLE[k % len(CYCLE)] for k, s in enumerate(sorted(names, key=lambda s: (s is None, s or "")))}


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """Packs all documents into windows of 1024 tokens, sources in code-point order, null last, weighing 5, 2, 1, repeating."""
    docs = common.documents(spark, sf_dir)
    return pack_documents(docs, targets=cycle_targets(docs))
