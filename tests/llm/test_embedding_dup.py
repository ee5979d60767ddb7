import numpy as np
import pyarrow.parquet as pq

from gleanery.llm.embedding_dup import near_vectors


def brute(ids, vectors, least=0.95):
    n = len(ids)
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for v in vectors]
    u = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if k else None for v, k in zip(vectors, ok)]
    links = [[j for j in range(n) if j != i and ok[i] and ok[j] and len(u[i]) == len(u[j]) and u[i] @ u[j] >= least] for i in range(n)]
    label = list(ids)
    for _ in range(n):
        new = [min([label[i], *(label[j] for j in links[i])]) for i in range(n)]
        if new == label:
            break
        label = new
    return sorted((ids[i], len(links[i]), label[i], ids[i] == label[i]) for i in range(n))


def test_whole_small_table_by_brute_force(spark):
    t = pq.read_table("/root/testdata/sf0.01/embeddings.parquet")
    got = sorted(tuple(r) for r in near_vectors(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"), block=64).collect())
    assert got == brute(t["vec_id"].to_pylist(), t["embedding"].to_pylist())


def test_chains_and_edge_rows(spark):
    r = np.random.default_rng(3)
    walk = np.cumsum(r.normal(size=(200, 8)) * 0.25, axis=0) + 1
    rows = [(i, v.tolist(), 1) for i, v in enumerate(walk)] + [(500 + i, walk[5].tolist(), 1) for i in range(40)]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 8, 1), (903, [float("nan")] * 8, 1), (904, [1.0, None] * 4, 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [1e300] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    got = sorted(tuple(x) for x in near_vectors(df, block=16, leading=3).collect())
    want = brute([x[0] for x in rows], [[1.0] * 8 if x[0] == 907 else x[1] for x in rows])
    assert got == want
    assert {g[0]: g for g in got}[905][2] == 905 and {g[0]: g for g in got}[906][2] == 905
    assert near_vectors(df.limit(0)).count() == 0
