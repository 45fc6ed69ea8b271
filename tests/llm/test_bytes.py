"""Words that a linear hash cannot tell apart: pieces and shingles are compared by their bytes."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from harbinger.llm import bytescan, ngram_join, tokens

MORSE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
MIRROR = MORSE.translate(str.maketrans("ab", "ba"))
NAMES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def spans(texts):
    data, offsets = bytescan.raw(pa.array(texts))
    return data, *bytescan.words(data, offsets)[:2]


def test_words_of_one_linear_hash_differ():
    data, start, end = spans([MORSE, MIRROR])
    assert len(set(bytescan.hashes(data, start, end).tolist())) == 1  # the weak case
    assert len(set(bytescan.block_hashes(bytescan.blocks(data, start, end)).tolist())) == 2
    assert bytescan.numbered(data, start, end).tolist() in ([0, 1], [1, 0])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="abé中", min_size=1, max_size=30), min_size=1, max_size=40))
def test_numbers_are_those_of_the_words(words):
    data, start, end = spans(words)
    got = bytescan.numbered(data, start, end).tolist()
    assert [[x == y for y in got] for x in got] == [[x == y for y in words] for x in words]


def test_numbers_do_not_need_the_hash(monkeypatch):
    monkeypatch.setattr(bytescan, "block_hashes", lambda b, seed=0: b.size.astype(np.uint64))
    words = ["aa", "bb", "a", "aa", "cc", "bb", "c"]
    got = bytescan.numbered(*spans(words)).tolist()
    assert [[x == y for y in got] for x in got] == [[x == y for y in words] for x in words]


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize("weak", [False, True])
def test_ids_are_the_librarys(monkeypatch, name, weak):
    """Also with a hash that many pieces share, within a text, between texts and between calls."""
    if weak:
        monkeypatch.setattr(bytescan, "block_hashes", lambda b, seed=0: b.size.astype(np.uint64) % np.uint64(7))
    e = tokens.PieceEncoder(name)
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abAB'.é"), rng.integers(1, 25)))
    texts = [MORSE + " x", MIRROR + " x", MIRROR, MORSE, "", *(" ".join(word() for _ in range(12)) for _ in range(20)), "a\nb", "a b\nc", "b\na a", " a", "a  b"]
    for some in (texts, texts[::-1]):
        ids, counts = e.encode(pa.array(some))
        got = np.split(ids, np.cumsum(counts)[:-1])
        want = e.tokenizer.encode_batch_fast(some, add_special_tokens=False)
        assert [g.tolist() for g in got] == [w.ids for w in want]


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_exact_shingles(k):
    texts = ["a b c d", "A b", "", "a b", "a", "a b a b a b a b", "b c d a b c d", MORSE, MIRROR]
    data, offsets = bytescan.raw(pa.array(texts))
    x, own = ngram_join.exact_shingles(data, offsets, k)
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    got = [set(x[own == i].tolist()) for i in range(len(texts))]
    assert [[len(p & q) for q in got] for p in got] == [[len(p & q) for q in sets] for p in sets]
    assert np.unique(np.stack([x, own]), axis=1).shape[1] == x.size


def test_such_words_stay_unlinked(spark):
    rows = [(1, MORSE), (2, MIRROR), (3, MORSE), (4, "one two three four " + MORSE), (5, "one two three four " + MIRROR)]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, num=90, den=100)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == {1: 1, 2: 2, 3: 1, 4: 4, 5: 5}
