"""N-gram Jaccard join by parity sketches.

A document's set is its distinct shingles (64-bit hashes of runs of words). Documents link when the Jaccard
similarity of their sets is at least num/den. Sizes are cut into bands; a pair belongs to the band of its
larger set, which bounds its symmetric difference by some d. In a band each shingle flips one bit of a parity
sketch, so that the Hamming distance of two sketches is at most the symmetric difference of their sets. The
sketch has d+1+e segments; at most d of them can differ, so linked documents agree on at least e+1 whole segments
(pigeonhole). A segment's key is the XOR of the codes of its odd bits, over a bit space too wide for two
shingles to meet by chance. Segments without odd bits give no key, as all documents would share it: agreeing
segments that are empty are empty in both sets, so a set with at most e of them agrees on a key with every set
linked to it. Sets with more than e empty segments also give the keys of a further sketch with another hash, and so
on; those that have too many in all LEVELS sketches (next to none, see `spares`) give the empty segments of the
last one too. Documents that share a key are candidates; a second, short sketch of one bit a shingle drops those
whose Hamming distance is above d; the rest are verified on the words of their texts, not on hashes.

No group is ever expanded into all its pairs:
1. documents of equal sets are one class, represented by the smallest id;
2. in each key, every member is compared with the first member only (a star), and what is verified is joined
   into components;
3. only keys that still hold several components go on, one of those with the same members: members of different
   components are compared by their short sketches, in blocks of bounded size, and those within d of any other are
   compared again, there, by their whole sets. What comes out is members, then a forest of links, never pairs. So
   every link between different components is found, whatever the group's size, and links inside a component need
   not be found.

Keys travel as binary blocks, not as rows, and are grouped by a streaming merge whose memory follows the
distinct keys of a partition, not the members of a key.

Null and empty texts have no shingles and link with nothing. A text with fewer words than a shingle is one
shingle. Rows with a null id count with their text's shingles but link with nothing (component null). Rows of
one id are one document that links with whatever one of its texts links with; each row counts its own shingles.
Every row gives one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harbinger.llm import bytescan, common
from harbinger.llm.components import components

BAND = 1.5
#: Sketches, each with a hash of its own, before a set with too many empty segments gives keys of empty ones.
LEVELS = 4
#: Entries that a partition holds back before it merges them, and members and shingles of a block that is compared at once.
MERGE_ENTRIES = 1 << 20
BLOCK_MEMBERS = 2048
BLOCK_SHINGLES = 1 << 21
_C1, _C2 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted by text, then hash: hashes and text numbers."""
    with np.errstate(over="ignore"):
        start, end, doc = bytescan.words(data, offsets)
        word = bytescan.block_hashes(bytescan.blocks(bytescan.lowered(data), start, end))
        if not word.size:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        count = np.bincount(doc, minlength=offsets.size - 1)
        out, own = [], []
        full = np.flatnonzero(doc[: word.size - k + 1] == doc[k - 1 :]) if word.size >= k else np.empty(0, np.int64)
        h = word[full]
        for j in range(1, k):
            h = bytescan.mix(h * _C1 + word[full + j])
        out.append(h)
        own.append(doc[full])
        first = np.cumsum(count) - count
        for m in range(1, k):
            short = np.flatnonzero(count == m)
            h = word[first[short]]
            for j in range(1, m):
                h = bytescan.mix(h * _C1 + word[first[short] + j])
            out.append(bytescan.mix(h ^ np.uint64(m)))
            own.append(short)
        h, own = np.concatenate(out), np.concatenate(own)
        order = np.lexsort((h, own))
        h, own = h[order], own[order]
        new = np.ones(h.size, bool)
        new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        return h[new], own[new]


def exact_shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as numbers, equal exactly where the words are, and text numbers, sorted by both."""
    start, end, doc = bytescan.words(data, offsets)
    if not start.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = bytescan.numbered(bytescan.lowered(data), start, end) + 1
    count = np.bincount(doc, minlength=offsets.size - 1)
    first = np.cumsum(count) - count
    # a shorter text is one shingle of all its words, filled with zeros
    at = np.concatenate([np.flatnonzero(doc[: word.size - k + 1] == doc[k - 1 :]) if word.size >= k else np.empty(0, np.int64), first[(count > 0) & (count < k)]])
    own = doc[at]
    ends = first[own] + count[own]
    step = int(word.max()) + 1
    x = word[at]
    for j in range(1, k):
        x = x * step + np.where(at + j < ends, word[np.minimum(at + j, word.size - 1)], 0)
        x = np.unique(x, return_inverse=True)[1]
    once = np.unique(own * (int(x.max()) + 1) + x)
    return once % (int(x.max()) + 1), once // (int(x.max()) + 1)


def bands(most: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * BAND))))
    return np.array(out, np.int64)


_BANDS = bands()


def difference(band: np.ndarray, num: int, den: int) -> np.ndarray:
    """The largest symmetric difference of a linked pair whose larger set is in the band."""
    return 2 * (_BANDS[band + 1] - 1) * (den - num) // (den + num)


def spaces(size: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, band) for every band in which a set of that size can be part of a linked pair: its own and that of larger partners."""
    own = np.searchsorted(_BANDS, size, "right") - 1
    most = np.searchsorted(_BANDS, size * den // num, "right") - 1
    out = []
    for step in range(int((most - own).max(initial=0)) + 1):
        rows = np.flatnonzero((own + step <= most) & (size > 0))
        out.append((rows, own[rows] + step))
    return out


@cache
def spares(num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """By band, how many segments a sketch has beyond d+1, and whether it needs keys of empty ones from the start.

    As few spare segments as make the number of empty ones of the band's smallest set, one deviation above its mean,
    no larger; where the similarity is too low for that, none."""
    spare, plain = np.zeros(_BANDS.size - 1, np.int64), np.zeros(_BANDS.size - 1, bool)
    for b in range(_BANDS.size - 1):
        d, n = int(difference(np.array([b]), num, den)[0]), -(-int(_BANDS[b]) * num // den)

        def enough(e: int) -> bool:
            parts = d + 1 + e  # noqa: B023
            if parts == 1:
                return True
            one, two = np.exp(n * np.log1p(-1 / parts)), np.exp(n * np.log1p(-2 / parts)) if parts > 2 else 0.0  # noqa: B023
            mean = parts * one
            return mean + np.sqrt(max(0.0, mean + parts * (parts - 1) * two - mean * mean)) <= e + 0.5

        if not enough(d + 2):
            plain[b] = True
            continue
        low, high = 0, d + 2
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if enough(mid) else (mid + 1, high)
        spare[b] = low
    return spare, plain


def segment_keys(h: np.ndarray, own: np.ndarray, size: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the segments of all texts and their text numbers; a key's low six bits are its band."""
    keys, owners = [], []
    spare, plain = spares(num, den)
    with np.errstate(over="ignore"):
        for rows, band in spaces(size, num, den):
            for level in range(LEVELS):
                if not rows.size:
                    break
                parts = np.zeros(size.size, np.int64)
                parts[rows] = difference(band, num, den) + 1 + spare[band]
                of = np.zeros(size.size, np.uint64)
                of[rows] = band
                mine = np.flatnonzero(parts[own] > 0)
                d = own[mine]
                code = bytescan.mix(h[mine] ^ ((of[d] + np.uint64(64 * level)) * _C2))
                first = np.cumsum(parts) - parts
                at = first[d] + ((code >> np.uint64(32)) * parts[d].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
                word = np.zeros(int(parts.sum()), np.uint64)
                np.bitwise_xor.at(word, at, bytescan.mix(code + _C1))
                owner = np.repeat(np.arange(size.size), parts)
                number = (np.arange(word.size) - first[owner]).astype(np.uint64)
                key = bytescan.mix(word ^ bytescan.mix(number * _C1 + of[owner] + np.uint64(64 * level + 1)))
                give = word != 0
                many = np.bincount(owner[~give], minlength=size.size)[rows] > spare[band]
                every = np.zeros(size.size, bool)
                every[rows[plain[band] | many & (level == LEVELS - 1)]] = True
                give |= every[owner]
                keys.append(key[give] & ~np.uint64(63) | of[owner[give]] & np.uint64(63))
                owners.append(owner[give])
                again = many & ~plain[band]
                rows, band = rows[again], band[again]
    return np.concatenate(keys), np.concatenate(owners)


def short_sketches(h: np.ndarray, own: np.ndarray, size: np.ndarray, num: int, den: int) -> list[dict[int, bytes]]:
    """By text, for each of its bands, a parity sketch of about one bit a shingle."""
    out: list[dict[int, bytes]] = [{} for _ in range(size.size)]
    with np.errstate(over="ignore"):
        for rows, band in spaces(size, num, den):
            words = np.zeros(size.size, np.int64)
            words[rows] = -(-(_BANDS[band + 1] - 1) // 64)
            mine = np.flatnonzero(words[own] > 0)
            d = own[mine]
            first = np.cumsum(words) - words
            bit = (bytescan.mix(h[mine] + _C2) >> np.uint64(32)) * (64 * words[d]).astype(np.uint64) >> np.uint64(32)
            sketch = np.zeros(int(words.sum()), np.uint64)
            np.bitwise_xor.at(sketch, first[d] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
            data = sketch.tobytes()
            for r, b in zip(rows.tolist(), band.tolist(), strict=True):
                out[r][b] = data[8 * first[r] : 8 * (first[r] + words[r])]
    return out


def _each_pass(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for b in batches:
        data, offsets = bytescan.raw(b.column("text"))
        for lo, hi in bytescan.passes(offsets):
            h, own = shingles(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], k)
            yield b.slice(lo, hi - lo), h, own, np.bincount(own, minlength=hi - lo).astype(np.int64)


def set_facts(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, n, h1, h2, sketches) per row; h1 and h2 are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, own, size in _each_pass(batches, k):
            some = np.flatnonzero(size)
            first = (np.cumsum(size) - size)[some]
            h1, h2 = np.zeros(size.size, np.int64), np.zeros(size.size, np.int64)
            if some.size:
                with np.errstate(over="ignore"):
                    h1[some] = np.bitwise_xor.reduceat(bytescan.mix(h), first).view(np.int64)
                    h2[some] = np.add.reduceat(bytescan.mix(h ^ _C2), first).view(np.int64)
            none = size == 0
            maps = [list(s.items()) for s in short_sketches(h, own, size, num, den)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(h1, mask=none), pa.array(h2, mask=none), pa.array(maps, pa.map_(pa.int32(), pa.binary()))], ["doc_id", "n", "h1", "h2", "sketches"])

    return docs.transform(common.map_batches, run, "doc_id long, n long, h1 long, h2 long, sketches map<int,binary>")


def shared_keys(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(key, lead, member): for every key that several documents have, its first member with each of the others."""
    spark = docs.sparkSession
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            key, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            bucket = (key >> np.uint64(40)) % np.uint64(buckets)
            order = np.lexsort((ids, bucket))  # by id, so that the ids of a block pack well
            key, ids, bucket = key[order], ids[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = [*cuts[1:].tolist(), key.size]
            blocks = []
            for i, j in zip(cuts.tolist(), ends, strict=True):
                once, n = np.unique(ids[i:j], return_counts=True)
                blocks.append((int(bucket[i]), key[i:j].tobytes(), np.array([once.size]).tobytes() + once.tobytes() + n.astype(np.uint32).tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), schema.types, strict=True)], schema=schema)

        for b, h, own, size_of in _each_pass(batches, k):
            ids = b.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            key, owner = segment_keys(h, own, np.where(known, size_of, 0), num, den) if h.size else (np.empty(0, np.uint64), np.empty(0, np.int64))
            if key.size:
                held.append((key, np.array(ids.fill_null(0))[owner]))
                size += key.size
            if size >= MERGE_ENTRIES:
                yield flush()
                size = 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, lead = np.empty(0, np.uint64), np.empty(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def merge() -> pa.RecordBatch:
            nonlocal known, lead, size
            key, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((ids, key))
            key, ids = key[order], ids[order]
            at = np.searchsorted(known, key)
            old = np.zeros(key.size, bool)
            inside = at < known.size
            old[inside] = known[at[inside]] == key[inside]
            new = ~old
            new[1:] &= key[1:] != key[:-1]
            head = np.maximum.accumulate(np.where(new | np.append(True, key[1:] != key[:-1]), np.arange(key.size), 0))
            first = ids[head]
            first[old] = lead[at[old]]
            other = first != ids
            other[1:] &= (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])
            row = [pa.array(x[other]) for x in (key.view(np.int64), first, ids)]
            all_known, all_lead = np.concatenate([known, key[new]]), np.concatenate([lead, ids[new]])
            order = np.argsort(all_known, kind="stable")
            known, lead = all_known[order], all_lead[order]
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays(row, ["key", "lead", "member"])

        for b in batches:
            for keys, ids in zip(b.column("keys"), b.column("ids"), strict=True):
                data = ids.as_buffer()
                m = int(np.frombuffer(data, np.int64, 1)[0])
                own = np.repeat(np.frombuffer(data, np.int64, m, 8), np.frombuffer(data, np.uint32, m, 8 + 8 * m))
                held.append((np.frombuffer(keys.as_buffer(), np.uint64), own))
                size += own.size
                if size >= MERGE_ENTRIES:
                    yield merge()
        if held:
            yield merge()

    dealt = docs.transform(common.map_batches, deal, "bucket int, keys binary, ids binary")
    return dealt.repartition(buckets // 2, "bucket").transform(common.map_batches, gather, "key long, lead long, member long")


def _bits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def within_reach(pairs: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) from (a, b, band): those whose sizes and short sketches allow a link."""
    side = lambda s: facts.select(F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("sketches").alias(f"s{s}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where((F.greatest("na", "nb") * num) <= F.least("na", "nb") * den)
    near = near.select("a", "b", "band", (F.col("na") + F.col("nb")).alias("whole"), F.element_at("sa", F.col("band")).alias("x"), F.element_at("sb", F.col("band")).alias("y")).where("x is not null and y is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            band = b.column("band").to_numpy(zero_copy_only=False)
            most = b.column("whole").to_numpy(zero_copy_only=False) * (den - num) // (den + num)
            x, y = b.column("x"), b.column("y")
            keep = np.zeros(b.num_rows, bool)
            for g in np.unique(band).tolist():
                rows = np.flatnonzero(band == g)
                words = -(-int(_BANDS[g + 1] - 1) // 64)
                take = pa.array(rows)
                u, v = (np.frombuffer(b"".join(c.take(take).to_pylist()), np.uint64).reshape(-1, words) for c in (x, y))
                keep[rows] = _bits(u, v) <= most[rows]
            yield b.filter(pa.array(keep)).select(["a", "b"])

    return near.transform(common.map_batches, run, "a long, b long").distinct()


def verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): the pairs whose sets, made anew from the whole texts, are similar enough."""
    pairs = common.table(pairs, "jaccard-candidates")
    needed = common.table(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "jaccard-needed")
    texts = common.table(common.sized_join(docs, needed, ["doc_id"], needed.count()).dropDuplicates(["doc_id"]), "jaccard-texts")
    left = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, o1 = bytescan.raw(whole.column("ta"))
            _, o2 = bytescan.raw(whole.column("tb"))
            for lo, hi in bytescan.passes(o1 + o2):
                b = whole.slice(lo, hi - lo)
                d1, x1 = bytescan.raw(b.column("ta"))
                d2, x2 = bytescan.raw(b.column("tb"))
                h, own = exact_shingles(np.concatenate([d1, d2]), np.concatenate([x1, x2[1:] + x1[-1]]), k)
                own %= b.num_rows
                order = np.lexsort((h, own))
                h, own = h[order], own[order]
                same = np.flatnonzero((h[1:] == h[:-1]) & (own[1:] == own[:-1]))
                shared = np.bincount(own[same], minlength=b.num_rows)
                union = np.bincount(own, minlength=b.num_rows) - shared
                yield b.filter(pa.array((den * shared >= num * union) & (shared > 0))).select(["a", "b"])

    return both.transform(common.map_batches, run, "a long, b long")


def blocks(members: DataFrame) -> DataFrame:
    """(key, i, j, mine, doc_id, component) of (key, doc_id, component, parts): a key of several blocks is compared block
    with block, so a member goes to each pair of blocks with its own in it; most keys are one block."""
    mine = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    pairs = members.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return pairs.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "doc_id", "component")


def in_groups(rows: DataFrame, columns: tuple[str, ...], compare: Callable[[list[tuple]], Iterator[tuple[np.ndarray, np.ndarray]]], schema: str) -> DataFrame:
    """The two columns that `compare` gives for the rows of each (key, i, j)."""
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        out: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> pa.RecordBatch:
            once = np.unique(np.stack([np.concatenate(c) for c in zip(*out, strict=True)]), axis=1)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(once[0]), pa.array(once[1])], names)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "i", "j", *columns)), strict=True):
                if group and row[:3] != group[0][:3]:
                    if len(group) > 1:
                        out += compare(group)
                    group = []
                    if len(out) >= 512:
                        yield emit()
                group.append(row)
        if len(group) > 1:
            out += compare(group)
        if out:
            yield emit()

    return rows.transform(common.map_batches, run, schema)


def near_members(live: DataFrame, comps: DataFrame, facts: DataFrame, num: int, den: int) -> DataFrame:
    """(key, doc_id): members of a key whose short sketches are within d of a member of another component.

    live: (key, lead, member). A key of one component is done; so is one without two members besides its first,
    as that one was compared with all others."""
    of = comps.select(F.col("node").alias("member"), "component")
    rows = common.sized_join(live, of, ["member"], of.count(), "left").select("key", F.col("member").alias("doc_id"), F.coalesce("component", "member").alias("component"))
    rows = common.table(rows, "jaccard-members")
    open_keys = rows.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("m"), *_same_members()).where("m >= 2 and c0 <> c1")
    open_keys = common.table(_one_of_each(open_keys, "m").select("key", "m"), "jaccard-open")
    members = common.sized_join(rows, open_keys, ["key"], open_keys.count()).select("key", "doc_id", "component", F.ceil(F.col("m") / BLOCK_MEMBERS).cast("int").alias("parts"))
    pairs = blocks(members).join(facts.select("doc_id", "n", "sketches"), "doc_id").withColumn("sketch", F.element_at("sketches", _band("key"))).drop("sketches").where("sketch is not null")

    def compare(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        key, i, j = rows[0][:3]
        mine, ids, comp, n = (np.array([r[c] for r in rows], np.int64) for c in (3, 4, 5, 6))
        x = np.frombuffer(b"".join(r[7] for r in rows), np.uint64).reshape(len(rows), -1)
        near = np.zeros(ids.size, bool)
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        for lo in range(0, left.size, 64):
            a = left[lo : lo + 64]
            ok = (comp[a][:, None] != comp[right][None, :]) & (np.maximum(n[a][:, None], n[right][None, :]) * num <= np.minimum(n[a][:, None], n[right][None, :]) * den)
            if i == j:
                ok &= a[:, None] < right[None, :]
            p, q = np.nonzero(ok)
            for s in range(0, p.size, 1 << 16):
                u, v = a[p[s : s + (1 << 16)]], right[q[s : s + (1 << 16)]]
                hit = _bits(x[u], x[v]) <= (n[u] + n[v]) * (den - num) // (den + num)
                near[u[hit]] = near[v[hit]] = True
        yield np.full(int(near.sum()), key, np.int64), ids[near]

    return in_groups(pairs, ("mine", "doc_id", "component", "n", "sketch"), compare, "key long, doc_id long").distinct()


def _band(key: str) -> Column:
    return F.col(key).bitwiseAND(F.lit(63)).cast("int")


def _same_members() -> list[Column]:
    return [F.bit_xor(F.xxhash64(F.lit(seed), "doc_id")).alias(f"x{seed}") for seed in (0, 1)]


def _one_of_each(keys: DataFrame, *more: str) -> DataFrame:
    """Of the keys of one band with the same members one: it says all that the others do."""
    return keys.groupBy(_band("key").alias("band"), "x0", "x1", *more).agg(F.min("key").alias("key"))


def linked_members(near: DataFrame, comps: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links, found on the whole sets, that join the components of the members of each key; a link between
    what others have joined already is left out, so a key gives fewer links than it has members.

    A block holds at most BLOCK_MEMBERS members and about BLOCK_SHINGLES shingles."""
    needed = common.table(near.select("doc_id").distinct(), "jaccard-near")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, h, _, size in _each_pass(batches, k):
            cuts = np.zeros(size.size + 1, np.int32)
            np.cumsum(8 * size, out=cuts[1:])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.BinaryArray.from_buffers(pa.binary(), size.size, [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(h.tobytes())])], ["doc_id", "n", "hashes"])

    sets = common.sized_join(docs, needed, ["doc_id"], needed.count()).transform(common.map_batches, whole, "doc_id long, n long, hashes binary").dropDuplicates(["doc_id"])
    sets = common.table(sets, "jaccard-whole-sets", "lz4")
    of = comps.select(F.col("node").alias("doc_id"), "component")
    rows = common.sized_join(near, of, ["doc_id"], of.count(), "left").withColumn("component", F.coalesce("component", "doc_id"))
    rows = common.table(rows.join(sets.select("doc_id", "n"), "doc_id"), "jaccard-near-members")
    keys = _one_of_each(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("words"), *_same_members()), "m", "words")
    keys = common.table(keys.select("key", F.ceil(F.greatest(F.col("m") / BLOCK_MEMBERS, F.col("words") / BLOCK_SHINGLES)).cast("int").alias("parts")), "jaccard-near-keys")
    pairs = blocks(common.sized_join(rows, keys, ["key"], keys.count()).select("key", "doc_id", "component", "parts")).join(sets.select("doc_id", "hashes"), "doc_id")

    def compare(rows: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, i, j = rows[0][:3]
        mine, ids, comp = (np.array([r[c] for r in rows], np.int64) for c in (3, 4, 5))
        n = np.array([len(r[6]) // 8 for r in rows], np.int64)
        first = np.cumsum(n) - n
        once, code = np.unique(np.frombuffer(b"".join(r[6] for r in rows), np.uint64), return_inverse=True)
        mark = np.zeros(once.size, np.int32)
        a, b = [], []
        for u in np.flatnonzero(mine == i).tolist():
            if i == j:
                other = np.arange(u + 1, ids.size)
            else:
                other = np.flatnonzero(mine == j)
            other = other[comp[other] != comp[u]]
            other = other[np.maximum(n[other], n[u]) * num <= np.minimum(n[other], n[u]) * den]
            if not other.size:
                continue
            own = code[first[u] : first[u] + n[u]]
            mark[own] = 1
            at = np.repeat(first[other] - (np.cumsum(n[other]) - n[other]), n[other]) + np.arange(n[other].sum())
            shared = np.add.reduceat(mark[code[at]], np.cumsum(n[other]) - n[other]).astype(np.int64)
            mark[own] = 0
            for v in other[den * shared >= num * (n[u] + n[other] - shared)].tolist():
                if comp[u] != comp[v]:
                    comp[comp == comp[v]] = comp[u]
                    a.append(ids[u])
                    b.append(ids[v])
        if a:
            yield np.minimum(a, b), np.maximum(a, b)

    return in_groups(pairs, ("mine", "doc_id", "component", "hashes"), compare, "a long, b long").distinct()


def _one_text_an_id(texts: DataFrame, facts: DataFrame) -> DataFrame | None:
    """(node, doc_id, text) where an id has several sets: each of its texts becomes a node of its own; else None."""
    one = F.struct(F.coalesce("h1", F.lit(0)), F.coalesce("h2", F.lit(0)), "n")
    sets = facts.where("doc_id is not null").groupBy("doc_id").agg(F.min(one).alias("x"), F.max(one).alias("y"))
    several = common.table(sets.where("x <> y").select("doc_id", F.lit(True).alias("several")), "jaccard-several")
    count = several.count()
    if not count:
        return None
    own = F.bitwise_not(F.abs(F.shiftright(F.xxhash64("doc_id", "text"), 1)))  # below zero, where ids are not
    return common.sized_join(texts, several, ["doc_id"], count, "left").select(F.when(F.col("several"), own).otherwise(F.col("doc_id")).alias("node"), "doc_id", "text")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id of its component). Similarity num/den or more links;
    num/den must be over 1/2."""
    if not 2 * num > den or num > den:
        raise ValueError("the similarity must be over 1/2 and at most 1")
    texts = common.texts_of(docs, id_col, text_col)
    facts = common.table(set_facts(texts, words, num, den), "jaccard-sets")
    split = _one_text_an_id(texts, facts)
    ids = None
    if split is not None:
        split = common.table(split, "jaccard-split")
        ids = common.table(split.select("node", "doc_id").where("node <> doc_id").distinct(), "jaccard-nodes")
        texts = split.select(F.col("node").alias("doc_id"), "text")
        facts = common.table(set_facts(texts, words, num, den), "jaccard-sets")
    # Only sets that several rows have need a class; so a set with very many rows is joined with one row of a small side.
    classes = facts.where("h1 is not null and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    classes = common.table(classes, "jaccard-classes")
    member = common.sized_join(facts, classes, ["h1", "h2", "n"], classes.count(), "left").select("doc_id", "n", "sketches", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    member = common.table(member, "jaccard-rows")
    copies = common.table(member.where("doc_id <> rep").select("doc_id").distinct(), "jaccard-copies")
    reps = common.sized_join(texts, copies, ["doc_id"], copies.count(), "left_anti")
    facts = common.table(member.where("doc_id = rep and n > 0").select("doc_id", "n", "sketches").dropDuplicates(["doc_id"]), "jaccard-sketches")
    live = common.table(shared_keys(reps, words, num, den), "jaccard-keys")
    stars = live.select(F.least("lead", "member").alias("a"), F.greatest("lead", "member").alias("b"), _band("key").alias("band")).distinct()
    edges = verified(within_reach(stars, facts, num, den), reps, words, num, den)
    if ids is not None:  # the texts of one id are one document
        own = ids.join(member.select(F.col("doc_id").alias("node"), "rep").distinct(), "node").select("doc_id", "rep")
        edges = edges.unionByName(own.groupBy("doc_id").agg(F.min("rep").alias("b")).join(own, "doc_id").select(F.col("rep").alias("a"), "b"))
    comps = components(edges)
    near = common.table(near_members(live, comps, facts, num, den), "jaccard-open-members")
    if not near.isEmpty():
        more = common.table(linked_members(near, comps, reps, words, num, den), "jaccard-more-links")
        if not more.isEmpty():
            comps = components(more.unionByName(comps.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))))
    found = common.sized_join(member.drop("sketches"), comps.withColumnRenamed("node", "rep"), ["rep"], comps.count(), "left")
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
    if ids is None:
        return found
    # Nodes back to ids, and a component's name to the smallest of them.
    found = found.withColumnRenamed("doc_id", "node").join(ids, "node", "left").select(F.coalesce("doc_id", "node").alias("doc_id"), "n_shingles", F.col("component_id").alias("c"))
    least = found.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "c", "left").select("doc_id", "n_shingles", "component_id")


def without_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents of which none has a near duplicate of smaller id: one of each group stays, with all columns."""
    found = near_duplicates(docs, id_col=id_col, **options)
    gone = common.table(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct(), "near-duplicates")
    n, same = gone.count(), F.col(f"doc.{id_col}").cast("long") == F.col("gone._gone")
    gone = F.broadcast(gone) if n <= common.BROADCAST_ROWS else gone
    return docs.alias("doc").join(gone.alias("gone"), same, "left_anti")


def op7_ngram_join(spark, sf_dir: str) -> DataFrame:
    """All documents, shingles of three words, similarity 0.9."""
    return near_duplicates(common.documents(spark, sf_dir), words=3, num=90, den=100)
