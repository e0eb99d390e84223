"""Vector codes against plain integer Lloyd rounds, bounds against exact distances, odd tables."""

import numpy as np
import pytest

from splicespark.llm import vector_codes as V
from splicespark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, id long, key string, v int, codes int, error int"


def brute(rows, parts=8, entries=16, rounds=6):
    """code and error of (vec_id, integer vector) rows in order, and the final codebooks, in Python integers."""
    first = sorted(rows)[:entries]
    d = len(first[0][1]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    book = [[list(cut(v, p)) for _, v in first] for p in range(parts)]
    gap = lambda x, e: sum((a - b) ** 2 for a, b in zip(x, e))

    def nearest():
        return [[min(range(len(book[p])), key=lambda e: (gap(cut(v, p), book[p][e]), e)) for p in range(parts)] for _, v in rows]

    for _ in range(rounds):
        own = nearest()
        for p in range(parts):
            for e in range(len(book[p])):
                mine = [cut(v, p) for (_, v), o in zip(rows, own) if o[p] == e]
                if mine:
                    book[p][e] = [sum(c) // len(mine) for c in zip(*mine)]
    own = nearest()
    return own, [sum(gap(cut(v, p), book[p][o[p]]) for p in range(parts)) for (_, v), o in zip(rows, own)], book


@pytest.mark.parametrize("kept", [2, 4, 8])
@pytest.mark.parametrize("spread", [3, 1000])
def test_bounds_decide_as_exact_distances_do(kept, spread):
    rng = np.random.default_rng(kept)
    x = rng.integers(-spread, spread + 1, (3000, 4))  # small spreads: ties everywhere
    x[:1000] //= 4
    book = rng.integers(-spread, spread + 1, (16, 4))
    b = V.Bounds.fresh(V.squared(x, book), kept, 8)
    spared = 0
    for step in range(8):
        new = book + rng.integers(-spread // 3, spread // 3 + 1, book.shape) // (step + 1)
        b.moved(V.moves([book], [new])[0])
        book = new
        used = V.reassign(x, book, b, kept)
        V.narrowed_to(b, kept)
        exact = V.squared(x, book)
        assert (b.own == np.argmin(exact, 1)).all()
        roots = np.sqrt(exact)
        assert (b.upper >= roots[np.arange(len(x)), b.own]).all()
        for j in range(8):
            has = b.near[:, j] != V.NONE
            assert (b.lower[has, j] <= roots[has, b.near[has, j]]).all() and not has[: len(x) if j >= kept else 0].any()
        held = np.concatenate((b.own[:, None], b.near), 1)
        rest = np.array([min((r[e] for e in range(16) if e not in h), default=np.inf) for r, h in zip(roots, held)])
        assert (b.outer <= rest).all()
        spared += (used == 0).sum()
    assert spared > 1000  # the bounds do decide


@pytest.mark.parametrize("parts", [1, 5])
def test_codes(spark, parts):
    rng = np.random.default_rng(1)
    vectors = np.concatenate((rng.normal(0, 0.02, (150, 16)), np.round(rng.normal(0, 1, (60, 16))) / 4096, np.repeat(rng.normal(0, 0.02, (1, 16)), 90, 0))).astype(np.float32)
    ids = rng.permutation(len(vectors)) // 2  # every id twice
    rows = [(int(i), v.tolist(), None if k % 5 == 0 else k % 3, k, "k", 1, 2, 3) for k, (i, v) in enumerate(zip(ids, vectors))]
    odd = [(0, None, 1), (0, [], 1), (1, [0.5] * 15 + [None], 1), (2, [float("nan")] * 16, 1), (-5, [0.5] * 15 + [float("-inf")], 1), (3, [1.0] * 8, 1)]
    table = spark.createDataFrame(rows + [(*o, 1, "k", 1, 2, 3) for o in odd], SCHEMA).repartition(parts)
    coded, book, did = V.compress(table)
    found = V.label_errors(coded).collect()
    whole = [(int(i), np.floor(v.astype(float) * 4096).astype(int).tolist(), r[2]) for i, v, r in zip(ids, vectors, rows)]
    codes, errors, right = brute([w[:2] for w in whole])
    assert [b.tolist() for b in book] == right and len(did["kept"]) == 6
    sums = {}
    for w, e in zip(whole, errors):
        sums[w[2]] = sums.get(w[2], 0) + e
    want = sorted((w[0], str(w[2]), c, e, sums[w[2]]) for w, c, e in zip(whole, codes, errors))
    assert sorted((r.vec_id, str(r.label), list(r.codes), r.error, r.label_error) for r in found) == want


def test_few_empty_and_uneven(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert V.label_errors(V.compress(make([]))[0]).count() == 0
    assert V.compress(make([(1, None, 2)]))[0].count() == 0
    coded, book, _ = V.compress(make([(None, [1.0] * 8, 1), (4, [0.0] * 8, None), (4, [2.0] * 8, None)]))  # fewer than 16: no errors
    assert {(r.vec_id, tuple(r.codes), r.error) for r in coded.collect()} == {(4, (0,) * 8, 0), (4, (1,) * 8, 0), (None, (2,) * 8, 0)}
    assert all(len(b) == 3 for b in book)
    coded, book, _ = V.compress(make([(1, [0.25] * 11, 1), (2, [0.5] * 11, 1), (0, [3.0e38] * 11, 1)]))  # 11 components in 8 parts
    assert [b.shape[1] for b in book] == [1, 1, 2, 1, 1, 2, 1, 2] and sorted(r.error for r in coded.collect()) == [0, 0, 0]
    assert V.compress(make([(1, [], 1), (2, [], 1)]))[0].count() == 2


def test_query_digest(spark):
    rows = QUERIES["op11_vector_codes"](spark, "/root/testdata/sf0.001").collect()
    assert all(len(r.code) == 16 for r in rows) and len({r.codebooks_sha256 for r in rows}) == 1
