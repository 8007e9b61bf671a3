from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from airstrata.llm import whitening
from airstrata.session import table
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<double>, n string"
ODD = [
    (1, [0.5, -0.25, 3.0], "a"), (1, [0.5, -0.25, 3.0], "a"), (2, [0.5, -0.25, 3.001], "b"), (None, [1.0, 2.0, -7.0], None), (3, None, "c"), (4, [1.0, None, 2.0], "d"),
    (5, [1.0, float("nan"), 2.0], "e"), (6, [1.0, float("-inf"), 2.0], "f"), (7, [1.0, 2.0], "g"), (8, [], "h"), (9, [-4.0, 0.003, 1.0], "i"), (10, [-0.0, 0.0, 0.001], "j"),
]
HUGE = [(i, [1e15 * (i % 5), 3.0 * i, -1e16 + i], None) for i in range(12)] + [(99, [1e300, -1e300, 0.0], None)]


def exact(rows):
    """Kept rows, the fit list, n, sums, and n*X'X - S*S' in Python's integers."""
    whole = lambda c: min(max(int(np.floor(c * 256)), -(1 << 63)), (1 << 63) - 1) if np.isfinite(c * 256) else ((1 << 63) - 1) * (1 if c > 0 else -1) - (c < 0)
    kept = [(k, tuple(map(whole, v))) for k, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    sizes = Counter(len(x) for x in {x for _, x in kept})
    size = min(sizes, key=lambda s: (-sizes[s], s), default=0)
    kept = [(k, x) for k, x in kept if len(x) == size]
    fit = sorted({x for _, x in kept})
    sums = [sum(c) for c in zip(*fit)]
    scatter = [[len(fit) * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j] for j in range(size)] for i in range(size)]
    return kept, fit, len(fit), sums, scatter


def held(spark, df, components=4):
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    kept, fit, n, sums, scatter = exact(rows)
    got = whitening.whitened(df, components).collect()
    v = np.array([[float(Fraction(a, n * n)) for a in row] for row in scatter])
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    k = int((values > len(v) * 2.3e-16 * values.max()).sum())
    assert Counter(r.vec_id for r in got) == Counter(key for key, _ in kept for _ in range(k))
    want = Counter((key, c + 1, sum((n * a - s) ** 2 for a, s in zip(x, sums))) for key, x in kept for c in range(k))
    assert Counter((r.vec_id, r.component, int(r.deviation)) for r in got) == want
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-6
    places = {}
    for key, x in kept:
        w = np.array([float(Fraction(n * a - s, n)) for a, s in zip(x, sums)]) @ vectors / np.sqrt(values)
        for c in range(k):
            places.setdefault((key, c + 1), []).append(abs(w[c]))
    mine = {}
    for r in got:
        mine.setdefault((r.vec_id, r.component), []).append(abs(r.whitened))
        assert abs(r.explained - values[r.component - 1] / np.trace(v)) < 1e-9
    assert all(np.allclose(sorted(a), sorted(mine[key]), atol=1e-6) for key, a in places.items())
    return got


def test_embeddings_are_white(spark):
    got = held(spark, table(spark, SF, "embeddings"))
    one = [r for r in got if r.component == 1]
    # one sign for all rows: the distinct whitened places have a mean of 0
    assert abs(np.mean(list({r.deviation: r.whitened for r in one}.values()))) < 1e-3


def test_odd_rows(spark):
    held(spark, spark.createDataFrame(ODD, SCHEMA), components=2)


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame(HUGE, SCHEMA)
    n, sums, scatter = whitening.scatter(whitening.fit_list(whitening.whole_vectors(df)), 3)
    want = exact([(r.vec_id, r.embedding) for r in df.collect()])
    assert (n, sums, scatter.tolist()) == want[2:]


@pytest.mark.parametrize("rows", [[], ODD[4:7], [(1, [], "x")], [(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "x")]])
def test_nothing_to_fit(spark, rows):
    out = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and not out.collect()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-(1 << 200), 1 << 200), max_size=5))
def test_limbs_add_up(cells):
    out = [0] * len(cells)
    for cell, limb, value in whitening.limbs(cells):
        out[cell] += value << whitening.LIMB * limb
    assert out == cells
