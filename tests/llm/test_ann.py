import numpy as np
import pyarrow.parquet as pq

from faircart.llm import ann


def brute(ids, x, k=20, step=20):
    out = {}
    for i in range(len(ids)):
        if ids[i] % step == 0:
            s = x @ x[i]
            order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
            out.setdefault(int(ids[i]), []).extend((int(ids[j]), float(s[j])) for j in order)
    return out


def test_recall_on_a_table(spark, monkeypatch):
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, x = t["vec_id"].to_numpy(), np.array(t["embedding"].to_pylist(), np.float64)
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest(df, lambda v: v % 20 == 0, block_rows=1000, query_rows=30).collect()
    want = brute(ids, x)
    assert len(got) == sum(map(len, want.values()))
    hit = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got)
    assert hit / len(got) >= 0.98
    at = {int(v): i for i, v in enumerate(ids)}
    for r in got:
        assert abs(r.score - x[at[r.query_id]] @ x[at[r.vec_id]]) < 1e-12
    for q in want:
        own = [(r.rank, -r.score, r.vec_id) for r in got if r.query_id == q]
        assert [n for n, *_ in sorted(own)] == list(range(1, 21)) and sorted(own) == sorted(own, key=lambda o: o[1:])


def test_recall_at_the_query_s_own_settings(spark):
    """One full block of vectors without any clusters: the hardest case for the depth of the reranking."""
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    given = np.array(t["embedding"].to_pylist(), np.float64)
    loose = np.random.default_rng(3).normal(size=(ann.BLOCK_ROWS, given.shape[1]))
    for x in (given, loose / np.linalg.norm(loose, axis=1, keepdims=True)):
        ids = np.arange(len(x))
        df = spark.createDataFrame(list(zip(ids.tolist(), x.tolist())), "vec_id long, embedding array<double>")
        got, want = ann.nearest(df, lambda v: v % 20 == 0).collect(), brute(ids, x)
        recall = sum(r.vec_id in {v for v, _ in want[r.query_id]} for r in got) / len(got)
        print("recall", recall)
        assert len(got) == sum(map(len, want.values())) and recall >= 0.95


def test_quantiser_prefers_parallel_accuracy():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    along = []
    for threshold in (0.0, 0.5):
        q = ann.Quantiser.fit(x, threshold=threshold)
        codes = q.encode(x)
        full = np.stack([codes >> 4, codes & 15], 2).reshape(len(x), -1)
        back = q.codebooks[np.arange(full.shape[1]), full].reshape(len(x), -1)
        assert np.allclose(q.scan(x[:5], codes), (back @ x[:5].T), atol=1e-4)
        along.append(np.mean(np.einsum("nd,nd->n", x - back, ann.Quantiser._unit(x)) ** 2))
    assert along[1] < along[0]


def test_edge_rows_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(200)]
    same = [1.0, 2.0, 3.0]
    rows += [(i, same) for i in range(1000, 1100)] + [(1020, same)]
    rows += [(2000, None), (2020, [0.0, 0.0, 0.0]), (2040, [1.0, None, 2.0]), (2060, [1.0, float("nan"), 2.0])]
    rows += [(2080, [float("inf"), 1.0, 1.0]), (2100, [1.0]), (2120, []), (None, same)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as rep")
    got = ann.nearest(df, lambda v: v % 20 == 0, rerank=500)
    kept = [(i, v) for i, v in rows if i is not None and (i < 2000 or i == 2100)]
    want = brute(np.array([i for i, _ in kept]), np.array([(v + [0.0, 0.0])[:3] for _, v in kept]))
    have = {}
    for r in got.collect():
        have.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: sorted(c) for q, c in have.items()} == {q: sorted(v for v, _ in c) for q, c in want.items()}
    assert len(have[1020]) == 40


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 1.0]), (1, [2.0, 0.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in ann.nearest(df, lambda v: v % 20 == 0).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 20, 2.0), (20, 1, 0, 2.0), (20, 2, 1, 2.0)]
    assert ann.nearest(df.where("vec_id = 1"), lambda v: v % 20 == 0).count() == 0
    assert ann.nearest(df.limit(0), lambda v: v % 20 == 0).count() == 0
