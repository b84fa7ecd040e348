"""Whitening against exact rational arithmetic on all rows."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from spanlens.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, whitened string"


def plain(vectors):
    """x rows, n, sums, covariances (exact, then rounded) of some vectors."""
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, width = len(x), len(x[0])
    sums = [sum(r[a] for r in x) for a in range(width)]
    d = [[n * r[a] - sums[a] for a in range(width)] for r in x]
    cov = [[float(Fraction(sum(r[a] * r[b] for r in d), n**3)) for b in range(width)] for a in range(width)]
    return d, n, np.array(cov)


def some_vectors(n=300, width=6, seed=3, size=1.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) * size).astype(np.float32).tolist()


@pytest.mark.parametrize("size", [1.0, 1e9])
def test_whitened_rows(spark, size):
    """Small values take the long path, large ones the one of Python integers; both are exact."""
    vectors = some_vectors(size=size)
    bad = [(900, None), (901, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, []), (905, [1.0, 2.0])]
    rows = [(i, v, "own") for i, v in [*enumerate(vectors), (5, vectors[5]), (None, vectors[6]), *bad]]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(4), components=4)
    assert got.columns == ["vec_id", "embedding", "whitened", "whitened_1"]
    got = got.select("vec_id", "embedding", "whitened_1").collect()
    kept = [v for v in vectors] + [vectors[5], vectors[6]]
    d, n, cov = plain(kept)
    assert len(got) == n == 302 and {r.whitened_1.n for r in got} == {n}
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:4], axes[:, ::-1][:, :4]
    z = np.array(d, float) / n @ axes / np.sqrt(values)
    by_text = {str(v): (sum(a * a for a in row), z[i]) for i, (v, row) in enumerate(zip(kept, d))}
    signs = None
    for r in got:
        square, want = by_text[str(r.embedding)]
        assert int(r.whitened_1.deviation) == square
        have = np.array(r.whitened_1["values"])
        signs = np.sign(have * want) if signs is None else signs
        assert np.allclose(have, want * signs, rtol=1e-7, atol=1e-9)
    first = got[0].whitened_1
    assert np.allclose(first.explained, values / np.trace(cov), rtol=1e-12) and first.identity_error < 1e-9


def test_square_sums_are_exact():
    rng = random.Random(1)
    for bound in (3, 2**31, whitening.LIMB_BOUND - 1):
        rows = [[rng.randint(-bound, bound) for _ in range(4)] for _ in range(whitening.BLOCK)] + []
        rows[0] = [bound, -bound, bound, -bound]
        want = [sum(r[a] ** 2 for r in rows) for a in range(4)]
        assert whitening.square_sums(np.array(rows, np.int64)) == want == whitening.square_sums(np.array(rows, object))
    for total in (0, 1, 2**60, 2**130 + 12345):
        assert sum(v << 60 * i for i, v in enumerate(whitening._limbs(total))) == total


def test_rows_without_components(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None, "a"), (2, [], "b")], SCHEMA)).count() == 0
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], "a")] * 3, SCHEMA)).select("whitened_1.*").collect()
    assert [(r.n, int(r.deviation), r["values"], r.explained, r.identity_error) for r in same] == [(3, 0, [], [], None)] * 3
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i], "a") for i in range(9)], SCHEMA)).select("whitened_1.*").collect()
    assert all(len(r["values"]) == 1 and r.explained == pytest.approx([1.0]) for r in line)  # one direction only


def test_registered_query_covers_every_row(spark, sf_dir):
    from spanlens.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    d, n, cov = plain([r.embedding for r in rows])
    got = QUERIES["op13_embedding_whitening"](spark, sf_dir).collect()
    assert len(got) == 32 * n and len({(r.vec_id, r.component) for r in got}) == len(got)
    squares = {r.vec_id: sum(a * a for a in row) for r, row in zip(rows, d)}
    shares = np.sort(np.linalg.eigvalsh(cov))[::-1] / np.trace(cov)
    assert all(r.deviation == squares[r.vec_id] and abs(r.explained - shares[r.component - 1]) < 1e-9 and r.identity_error < 1e-9 and r.n == n for r in got)
