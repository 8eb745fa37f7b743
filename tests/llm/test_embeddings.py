import math

import numpy as np
import pytest

from tabsift.llm.embeddings import blocks, cells, near_vectors, per_axis, rotation, unit

COLUMNS = "vec_id long, embedding array<float>, label int, vec string, row int"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def plain(rows, cosine=0.95):
    """``(vec_id, n_links, component_id, kept)`` per row, by comparing all pairs."""
    vecs = [np.array(v, np.float32).astype(float) if usable(v) else None for _, v in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i, a in enumerate(vecs):
        for j in range(i):
            b = vecs[j]
            if a is None or b is None or len(a) != len(b):
                continue
            if a @ b >= cosine * math.sqrt((a @ a) * (b @ b)):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    out = []
    for i, (d, _) in enumerate(rows):
        c = d if vecs[i] is None else least.get(find(i))
        out.append((d, links[i], c, d == c))
    return sorted(out, key=str)


def near(rng, base, cosine):
    """A vector at about this cosine."""
    other = rng.standard_normal(len(base))
    other -= base * (other @ base) / (base @ base)
    other /= np.linalg.norm(other)
    base = base / np.linalg.norm(base)
    return cosine * base + math.sqrt(1 - cosine * cosine) * other


def corpus(seed, dim, n=150):
    rng = np.random.default_rng(seed)
    rows = [rng.standard_normal(dim) for _ in range(n)]
    for _ in range(n):
        base = rows[rng.integers(len(rows))]
        rows.append(near(rng, base, rng.choice([0.9, 0.94, 0.96, 0.99, 1.0])) * rng.choice([0.01, 1, 50]))
    hub = rng.standard_normal(dim)
    rows += [hub.copy() for _ in range(60)] + [near(rng, hub, 0.98) for _ in range(60)]
    return [(7000 - 3 * i, [float(x) for x in np.float32(v)]) for i, v in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame([(d, v, 1, "x", 2) for d, v in rows], COLUMNS)


def result(df, **options):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(df, **options).collect()), key=str)


@pytest.mark.parametrize("dim, cell_rows, tile", [
    (64, 200, 8192), (64, 1, 8192), (20, 1, 16), (8, 1, 7), (3, 2, 5), (1, 200, 8192)])
def test_against_all_pairs(spark, dim, cell_rows, tile):
    rows = corpus(dim, dim)
    assert result(frame(spark, rows), cell_rows=cell_rows, tile=tile) == plain(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [1.0, inf]), (6, [1.0, None]),
            (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [2.0, 4.0]), (8, [-1.0, -2.0]), (9, [1.0, 2.0, 0.0]),
            (10, [1e-30, 2e-30]), (11, [1e30, 2e30]), (12, [0.0, -0.0, 1.0]), (13, [-0.0, 0.0, 1.0]), (None, [5.0])]
    assert result(frame(spark, rows)) == plain(rows)


def test_empty_tables(spark):
    assert near_vectors(frame(spark, [])).count() == 0
    assert result(frame(spark, [(1, None)])) == [(1, 0, 1, True)]
    with pytest.raises(ValueError):
        near_vectors(frame(spark, []), cosine=0.0)


def test_rotation_keeps_distances():
    for dim in (1, 3, 64):
        q = rotation(dim)
        assert np.allclose(q @ q.T, np.eye(dim))
        assert sorted(np.concatenate(blocks(dim)).tolist()) == list(range(dim))


@pytest.mark.parametrize("per", [2, 3, 5])
def test_cells_in_reach_are_visited(per):
    rng = np.random.default_rng(per)
    x = rng.standard_normal((300, 4))
    edges = np.sort(rng.standard_normal((4, per - 1)), axis=1)
    home, point, code = cells(x, edges, 0.5)
    visits = set(zip(point.tolist(), code.tolist()))
    for i in range(300):
        for j in range(300):
            if home[i] < home[j] and ((x[i] - x[j]) ** 2).sum() <= 0.5:
                assert (i, int(home[j])) in visits


def test_cells_grow_with_the_table():
    assert [per_axis(n, 8) for n in (0, 500, 50_000, 5_000_000, 10**10)] == [2, 2, 2, 3, 9]
    assert np.allclose(np.linalg.norm(unit(np.array([[3e200, 4e200], [1e-200, 0]])), axis=1), 1)
