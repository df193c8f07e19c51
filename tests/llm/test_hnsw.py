import numpy as np
import pytest

from foliant.llm import hnsw


def unit(n, dim, seed):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graph_recall_against_brute_force():
    r = np.random.default_rng(1)
    base = unit(600, 32, 2)
    x = np.concatenate([base, base[:150] + 0.02 * r.normal(size=(150, 32)), base[0] + 0.01 * r.normal(size=(400, 32))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x = x[r.permutation(len(x))]
    levels = np.sort(np.minimum(r.geometric(15 / 16, len(x)) - 1, 3))[::-1]
    graph = hnsw.Hnsw.build(x, levels)
    truth = x @ x.T >= 0.93
    q, node, recall = graph.search(x, 0.93)
    got = np.zeros_like(truth)
    got[q, node] = True
    assert not (got & ~truth).any() and (got & truth).sum() / truth.sum() >= 0.99 and recall >= hnsw.TARGET_RECALL


@pytest.mark.parametrize("shard_rows", [50, 8192])
def test_links_match_brute_force(spark, shard_rows):
    r = np.random.default_rng(4)
    rows = []
    for i, x in enumerate(unit(150, 16, 5)):
        rows.append((len(rows), x, i % 3))
        for _ in range(int(r.integers(0, 3))):
            rows.append((len(rows), x + 0.05 * r.normal(size=16) / 4, i % 3))
    rows += [(len(rows) + k, rows[0][1], 0) for k in range(3)] + [(900, rows[0][1], None), (901, rows[0][1], 1)]
    rows = [(int(i), [float(np.float32(v)) for v in x], label) for i, x, label in rows]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [], 0), (1003, [float("nan")] + [1.0] * 15, 0), (1004, [1.0, 2.0], 0), (1005, [2.0, 4.0], 0), (None, rows[0][1], 0), (1006, [None] + [1.0] * 15, 0)]
    table = [(i, x, label, 0) for i, x, label in rows + odd]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, node int")
    got = sorted(((x.vec_id, x.n_links, x.component_id, x.kept) for x in hnsw.near_duplicate_vectors(df, shard_rows=shard_rows).collect()), key=str)

    vec = [np.array(x, float) if x and None not in x and np.isfinite(x).all() and np.any(x) else None for _, x, _, _ in table]
    links = {i: set() for i in range(len(table))}
    for i in range(len(table)):
        for j in range(i):
            a, b = vec[i], vec[j]
            if a is not None and b is not None and len(a) == len(b) and table[i][2] is not None and table[i][2] == table[j][2] and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links[i].add(j)
                links[j].add(i)
    want = []
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            todo += (new := links[todo.pop()] - seen)
            seen |= new
        ids = [table[k][0] for k in seen if table[k][0] is not None]
        least = min(ids) if ids else None
        want.append((table[i][0], len(links[i]), least, table[i][0] == least))
    assert got == sorted(want, key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hnsw.near_duplicate_vectors(df).count() == 0


def test_links_of_large_shards(spark):
    """Over 5,000 vectors of one label in three shards, a third of them in one hot group, against all pairs."""
    r = np.random.default_rng(7)
    base = unit(2400, 24, 8)
    x = np.concatenate([base, base[:900] + 0.03 * r.normal(size=(900, 24)), base[0] + 0.02 * r.normal(size=(1900, 24))])
    x = x[r.permutation(len(x))].astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<float>, label string").repartition(8)
    rows = hnsw.near_duplicate_vectors(df, shard_rows=2000).collect()
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = u @ u.T >= 0.93
    np.fill_diagonal(links, False)
    want, got = links.sum(1), np.zeros(len(x), int)
    for row in rows:
        got[row.vec_id] = row.n_links
    assert (got <= want).all() and got.sum() / want.sum() >= 0.99
    recalls = [row.recall for row in rows if row.recall is not None]
    assert recalls and min(recalls) >= 0.9
