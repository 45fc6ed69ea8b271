"""Exact search, exponion clustering and vector codes against plain loops over the same rows."""

import hashlib
import itertools
import math
import os

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harbinger.llm import codes, exponion, intvec, queries, topk

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, label int, task string, kind string, n int, row int, position string, embedding2 string"


def table(spark, rows):
    """Rows (vec_id, embedding, label) with columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", 7, 8, "z", None) for r in rows], SCHEMA)


def whole(v, scale):
    return [min(intvec.LIMIT, max(-intvec.LIMIT, math.floor(x * scale))) if abs(x) < 1e6 else int(math.copysign(intvec.LIMIT, x)) for x in v]


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def odd_rows(width, n, seed=1, repeat=True):
    """Vectors with few values, so that many are equal or tie; null ids, vectors, components and labels; a hot vector."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.integers(-2, 3, width) / 4).tolist(), int(i) % 3 if i % 4 else None) for i in rng.permutation(n)]
    rows += [(1000 + i, [0.25] * width, 1) for i in range(n // 2)]
    rows += [(None, [0.5] * width, 1), (2000, None, 1), (2001, [NAN] * width, 1), (2002, [INF] + [0.0] * (width - 1), 2), (2003, [None] + [0.0] * (width - 1), None), (2004, [0.0] * width, None)]
    return rows + ([rows[0]] * 2 if repeat else [])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_exact_topk", "op12_exponion", "op13_vector_codes"])
def test_queries_match_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"create view embeddings as from '{SF}/embeddings.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.sql(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    rows = lambda x: sorted(map(tuple, x[sorted(x.columns)].astype(str).values))
    assert rows(got) == rows(want)


def best(rows, k, scale):
    """(query id, rank, id, score) of all pairs."""
    kept = [(i, whole(v, scale)) for i, v, _ in rows if i is not None and sound(v)]
    out = []
    for q, x in {(i, tuple(x)) for i, x in kept if i % 50 == 0}:
        scores = sorted((-sum(a * b for a, b in itertools.zip_longest(x, y, fillvalue=0)), i) for i, y in kept if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("k", "group", "shard"), [(5, 64 << 20, 64 << 20), (3, 256, 512), (400, 512, 256)])
def test_search_equals_all_pairs(spark, k, group, shard):
    """Over one group and over many groups and shards, whose lists the tree merges."""
    rows = [r for r in odd_rows(6, 230)] + [(3000, [], 1), (3001, [1.0, 2.0], 1), (3050, [0.5], 1)]
    got = topk.exact_topk(table(spark, rows), k=k, group_bytes=group, shard_bytes=shard)
    assert sorted(map(tuple, got.collect())) == best(rows, k, 256)


@pytest.mark.parametrize("size", [1.0, 300.0, 40_000.0, 4e5, 1e30, 1e300])
def test_scores_are_exact_at_every_size(spark, size):
    """Single, double and whole products, and components beyond the limit."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(5) * size).tolist(), 0) for i in range(101)]
    assert sorted(map(tuple, topk.exact_topk(table(spark, rows)).collect())) == best(rows, 5, 256)


def test_search_without_rows_queries_or_candidates(spark):
    assert topk.exact_topk(table(spark, [])).collect() == []
    assert topk.exact_topk(table(spark, [(1, [1.0], 0), (2, [1.0], 0)])).collect() == []
    assert topk.exact_topk(table(spark, [(50, [1.0], 0)])).collect() == []
    assert [tuple(r) for r in topk.exact_topk(table(spark, [(50, [1.0], 0), (1, [0.5], 0)])).collect()] == [(50, 1, 1, 128 * 256)]


def lloyd(rows, k, width, scale, rounds):
    kept = [(i, v, whole(v, scale)) for i, v, _ in rows if sound(v) and len(v) == width]
    mark = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    centres = [x for _, _, x in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    for n in range(rounds + 1):
        own = [min(range(len(centres)), key=lambda c: (far(x, centres[c]), c)) for _, _, x in kept]  # noqa: B023
        if n < rounds:
            for c in range(len(centres)):
                mine = [x for (_, _, x), o in zip(kept, own, strict=True) if o == c]
                if mine:
                    centres[c] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    d = [far(x, centres[o]) for (_, _, x), o in zip(kept, own, strict=True)]
    by = {c: sum(y for y, o in zip(d, own, strict=True) if o == c) for c in own}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted([(i, o, y, by[o], sum(d), digest[o]) for (i, _, _), o, y in zip(kept, own, d, strict=True)], key=str)


@pytest.mark.parametrize(("k", "rounds", "n"), [(8, 10, 150), (3, 1, 40), (5, 0, 20), (8, 4, 3)])
def test_clusters_equal_lloyd(spark, k, rounds, n):
    rows = [*odd_rows(4, n), (4000, [1.0], 0), (4001, [], 0), (4002, [1.0] * 5, 0), (4003, [1e30, 0.0, -1e30, 1e5], 0)]
    got = exponion.cluster(table(spark, rows), k=k, width=4, scale=1024, rounds=rounds)
    assert sorted(map(tuple, got.collect()), key=str) == lloyd(rows, k, 4, 1024, rounds)


def test_clusters_of_few_or_no_vectors(spark):
    assert exponion.cluster(table(spark, []), width=4).collect() == []
    assert exponion.cluster(table(spark, [(1, [1.0], 0)]), width=4).collect() == []
    assert [(r["vec_id"], r["cluster"], r["distance"]) for r in exponion.cluster(table(spark, [(1, [1.0], 0)]), width=1).collect()] == [(1, 0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 1 << 30), st.integers(1, 9), st.integers(1, 3), st.integers(2, 40))
def test_bounds_never_change_a_cluster(seed, k, width, spread):
    """Rounds of moving centroids, with many ties and equal centroids: clusters and bounds against all distances."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-spread, spread, (80, width))
    points = rng.integers(-spread, spread, (k, width))
    now = exponion.Centroids(points)
    cluster, upper, lower = exponion.first_assigned(x, now)
    for n in range(5):
        d = ((x[:, None, :] - points[None]) ** 2).sum(axis=2)
        assert (cluster == d.argmin(axis=1)).all()
        own = d[np.arange(80), cluster]
        d[np.arange(80), cluster] = 1 << 60
        assert (upper >= np.sqrt(own)).all() and (k == 1 or (lower <= np.sqrt(d.min(axis=1))).all())
        moved = points + rng.integers(-1 - n % 2, 2, points.shape)
        now, points = exponion.Centroids(moved, points), moved
        cluster, upper, lower, _ = exponion.assigned(x, cluster, upper, lower, now)


def test_few_distances_are_taken():
    """Tight clusters far apart: after the first round hardly any distance is needed."""
    rng = np.random.default_rng(3)
    points = rng.integers(-10_000, 10_000, (8, 16))
    x = points[rng.integers(0, 8, 5000)] + rng.integers(-20, 20, (5000, 16))
    cluster, upper, lower = exponion.first_assigned(x, exponion.Centroids(points))
    moved = points + rng.integers(-5, 5, points.shape)
    _, _, _, asked = exponion.assigned(x, cluster, upper, lower, exponion.Centroids(moved, points))
    assert asked < 5000 // 10


def quantized(rows, parts, entries, scale, rounds):
    kept = [(i, whole(v, scale), label) for i, v, label in rows if sound(v)]
    length = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // parts))
    kept = [(i, v + [0] * (parts * length - len(v)), label) for i, v, label in kept]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    cut = lambda v, p: v[p * length : (p + 1) * length]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    near = lambda x, p: min((far(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = [near(cut(v, p), p)[1] for _, v, _ in kept]
            groups = [[cut(v, p) for (_, v, _), o in zip(kept, own, strict=True) if o == e] for e in range(len(first))]
            new.append([[sum(c) // len(g) for c in zip(*g, strict=True)] if g else books[p][e] for e, g in enumerate(groups)])
        books = new
    found = [[near(cut(v, p), p) for p in range(parts)] for _, v, _ in kept]
    errors = [sum(d for d, _ in f) for f in found]
    by = {}
    for (_, _, label), e in zip(kept, errors, strict=True):
        by[label] = by.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted([(i, "".join(f"{e:02x}" for _, e in f), x, by[label], digest) for (i, _, label), f, x in zip(kept, found, errors, strict=True)], key=str)


@pytest.mark.parametrize(("width", "n", "entries", "rounds", "frequent"), [(8, 120, 16, 6, 1000), (8, 120, 16, 6, 3), (6, 40, 4, 2, 1000), (4, 9, 16, 3, 2), (8, 30, 5, 0, 1000)])
def test_codes_equal_plain_quantization(spark, monkeypatch, width, n, entries, rounds, frequent):
    """Also with a bound that makes some keys frequent and others not, so that both ways of the join have rows."""
    monkeypatch.setattr(intvec, "FREQUENT", frequent)
    rows = [*odd_rows(width, n), (5000, [1.0], None), (5001, [], 4), (5002, [1e30] * width, 4)]
    got = codes.compress(table(spark, rows), parts=4, entries=entries, scale=64, rounds=rounds)
    assert sorted(map(tuple, got.collect()), key=str) == quantized(rows, 4, entries, 64, rounds)


def test_codes_of_no_or_empty_vectors(spark):
    assert codes.compress(table(spark, [])).collect() == [] and codes.compress(table(spark, [(1, None, 0), (2, [NAN], 0)])).collect() == []
    assert [tuple(r)[:4] for r in codes.compress(table(spark, [(1, [], None)])).collect()] == [(1, "00" * 8, 0, 0)]


def test_equal_parts_are_one_weighted_row(spark):
    rows = [(i, [0.5, 0.25, float(i % 3), 1.0], 0) for i in range(60)]
    vectors = table(spark, rows).selectExpr("vec_id as row", "transform(embedding, x -> cast(x * 4 as int)) as whole")
    got = codes.parts_of(vectors, 2, 2).groupBy("position", "part").count().collect()
    assert sorted((r["position"], r["part"], r["count"]) for r in got) == [(0, [2, 1], 60), (1, [0, 4], 20), (1, [4, 4], 20), (1, [8, 4], 20)]
