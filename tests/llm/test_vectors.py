import numpy as np
import pyarrow.parquet as pq

from tidemark.llm import vectors
from tidemark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, class string"


def brute(rows, least=0.9):
    """(id, links) sets by comparing everything."""
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and len(v) and None not in v]
    ok = [(i, v) for i, v in ok if np.isfinite(v).all() and v.any()]
    ids, x = [i for i, _ in ok], np.array([v / np.linalg.norm(v) for _, v in ok])
    near = x @ x.T >= least
    return {(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b}


def reach(ids, pairs):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check(rows, out, recall=0.9):
    pairs = brute(rows)
    degree = {}
    for a, b in pairs:
        degree[a] = degree.get(a, 0) + 1
        degree[b] = degree.get(b, 0) + 1
    assert len(out) == len(rows)
    got = {r["vec_id"]: r for r in out}
    assert all(got[i]["n_links"] <= degree.get(i, 0) for i in got)  # none below the threshold, none twice
    assert sum(r["n_links"] for r in out) >= recall * 2 * len(pairs)
    whole = reach(list(got), pairs)
    assert np.mean([got[i]["component_id"] == whole[i] for i in got]) >= 0.98
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


def test_query(spark):
    for d in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{d}/embeddings.parquet").to_pylist()]
        check(rows, QUERIES["op10_sorted_projection_passes"](spark, d).collect())


def test_clusters_larger_than_a_window(spark):
    rng = np.random.default_rng(0)
    centre = rng.standard_normal((4, 32))
    rows = []
    for c, size, noise in ((0, 900, 0.12), (1, 200, 0.05), (2, 30, 0.2), (3, 2, 0.01)):
        rows += [centre[c] + noise * rng.standard_normal(32) for _ in range(size)]
    rows += list(rng.standard_normal((1500, 32)))
    rows += [rows[0]] * 50
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(rows)]
    df = spark.createDataFrame([(i, v, 0, "x", "x") for i, v in rows], SCHEMA).repartition(3)
    check(rows, vectors.near_vectors(df).collect())


def test_large_groups_have_all_their_links(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.standard_normal(32) + 0.05 * rng.standard_normal((3000, 32)), rng.standard_normal((4000, 32))])
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    df = spark.createDataFrame([(i, v, 0, "x", "x") for i, v in rows], SCHEMA).repartition(3)
    check(rows, vectors.near_vectors(df).collect(), recall=0.9999)


def leaning(rng, n, mean_cosine, dimensions=64):
    """Unit vectors that share a direction, the first 1,000 with partners at a cosine of 0.905 at the end."""
    x = rng.standard_normal((n - 1000, dimensions)) / np.sqrt(dimensions) * np.sqrt(1 - mean_cosine)
    x[:, 0] += np.sqrt(mean_cosine)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    toward = rng.standard_normal((1000, dimensions))
    toward -= (toward * x[:1000]).sum(1, keepdims=True) * x[:1000]
    return np.concatenate([x, 0.905 * x[:1000] + np.sqrt(1 - 0.905**2) * toward / np.linalg.norm(toward, axis=1, keepdims=True)])


def test_passes_follow_a_shared_direction():
    x = leaning(np.random.default_rng(5), 40_000, 0.6)
    found, centre = np.zeros(1000, bool), x.mean(0)
    for p in range(vectors.passes_by_trial(x[1000:9000], centre, len(x), 0.9, 7)):
        rank = np.argsort(np.argsort(vectors.sort_keys(x - centre, p, 7))) // vectors.BLOCK
        found |= np.abs(rank[:1000] - rank[-1000:]) <= 1
    assert found.mean() >= 0.95


def test_vectors_that_share_a_direction(spark):
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(leaning(np.random.default_rng(6), 7000, 0.8))]
    check(rows, vectors.near_vectors(spark.createDataFrame([(i, v, 0, "x", "x") for i, v in rows], SCHEMA).repartition(3)).collect(), recall=0.97)


def test_edges(spark):
    data = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [float("nan"), 1.0], 0), (6, [None, 1.0], 0), (7, [], 0), (8, [1.0, 0.0, 0.0], 0), (9, [-0.0, 1.0], None), (10, [0.0, 1.0], 0), (11, [float("inf"), 1.0], 0), (12, [3e38, 3e38], 0), (13, [1e-38, 1e-38], 0), (1, [1.0, 0.0], 0), (None, [0.0, 1.0], 0)]
    out = vectors.near_vectors(spark.createDataFrame([(*r, "x", "x") for r in data], SCHEMA)).collect()
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in out)
    want = [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 2, 9), (10, 2, 9), (11, 0, 11), (12, 1, 12), (13, 1, 12), (None, 2, 9)]
    assert got == sorted((str(a), b, str(c)) for a, b, c in want)
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passes():
    assert vectors.passes_for(100, 0.9) == vectors.LEAST_PASSES and vectors.passes_for(10**6, 0.9) > vectors.passes_for(10**4, 0.9)


def test_passes_run_at_every_size(spark):
    rng = np.random.default_rng(8)
    for n in (1, 40, 3000):
        df = spark.createDataFrame([(k, [float(c) for c in v], 0, "x", "x") for k, v in enumerate(rng.standard_normal((n, 16)))], SCHEMA)
        found, kind = vectors.classify(df, "vec_id", "embedding")
        classes = found.select("class", "dimensions", "vector")
        assert vectors.plan(classes, kind, vectors.centres(classes, kind), 0.9, 7)[1] == []
