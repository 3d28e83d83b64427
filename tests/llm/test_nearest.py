import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ordina.llm import nearest as N
from ordina.llm.nearest import hilbert, nearest, products


def brute(rows, k=20, every=20):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and None not in v and len(v) == 4 and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, float))]
    out = {}
    for i, q in ok:
        if i % every == 0:
            best = {}
            for j, v in ok:
                if j != i:
                    best[j] = max(best.get(j, -np.inf), float(products(q[None], v[None])[0]))
            for j, s in best.items():
                out.setdefault(i, {})[j] = max(out.get(i, {}).get(j, -np.inf), s)
    return {i: sorted(((-s, j) for j, s in best.items()))[:k] for i, best in out.items()}


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    got = {}
    for r in nearest(df, **more).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
        assert r["rank"] == len(got[r.query_id])
    return got


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for i in range(n)]


def test_equals_brute_force(spark):
    rows = vectors(700)
    odd = [(2000, None), (2020, [0.0] * 4), (2040, [1.0, None, 0.0, 0.0]), (2060, [float("nan")] * 4), (2080, [float("inf"), 0.0, 0.0, 0.0]), (2100, [1.0, 2.0]), (None, [1.0] * 4), (-20, [0.5] * 4), (rows[40][0], rows[40][1])]
    assert run(spark, rows + odd) == brute(rows + odd)


def test_hot_vector_and_ties(spark):
    rows = [(i, [1.0, 0.5, 0.25, 0.125]) for i in range(300)] + [(1000 + i, v) for i, v in vectors(200, 3)]
    assert run(spark, rows) == brute(rows)


def test_repeated_ids_take_one_place_each(spark):
    rows = vectors(500) * 3
    near = np.array(rows[40][1])
    rows += [(2001, [float(x) for x in (near * (1 + i / 1000)).astype(np.float32)]) for i in range(700)]
    got = run(spark, rows)
    assert got == brute(rows) and {len(x) for x in got.values()} == {20}


def test_few_candidates_and_none(spark):
    assert run(spark, vectors(5)) == brute(vectors(5))
    assert run(spark, [(20, [1.0] * 4)]) == {} and run(spark, []) == {}


def test_windows_alone_find_clustered_neighbours(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 4)) * 5
    rows = [(i, [float(x) for x in (centres[i % 40] + rng.normal(size=4) * 0.05).astype(np.float32)]) for i in range(2000)]
    unit = [(i, [float(x) for x in np.array(v) / np.linalg.norm(v)]) for i, v in rows]
    got, want = run(spark, unit, exact=False), brute(unit)
    assert np.mean([len({j for _, j in got[q]} & {j for _, j in w}) / len(w) for q, w in want.items()]) >= 0.6


@pytest.mark.parametrize("bits, dims", [(3, 2), (2, 3), (2, 4)])
def test_hilbert_steps_by_one(bits, dims):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_small_blocks_and_chunks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 60)
    monkeypatch.setattr(N, "QUERIES", 6)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 4)) * 6
    rows = [(i, [float(x) for x in (centres[i % 12] + rng.normal(size=4) * 0.05).astype(np.float32)]) for i in range(900)]
    assert run(spark, rows) == brute(rows)


def test_chunks_visit_only_blocks_that_may_hold_more():
    centres, radii = np.array([[1.0, 0.0], [-1.0, 0.0], [0.0, 1.0]]), np.array([0.1, 0.1, 0.1])
    batch = pa.record_batch([pa.array([1, 2]), pa.array([[1.0, 0.0], [0.0, 1.0]]), pa.array([7, 8]), pa.array([0.8, -np.inf])], names=["id", "v", "chunk", "floor"])
    got = {(r["chunk"], r["block"]) for b in N._visits((np.arange(3, dtype=np.int32), centres, radii))(iter([batch])) for r in b.to_pylist()}
    assert got == {(7, 0), (8, 0), (8, 1), (8, 2)}
