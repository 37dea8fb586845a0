import numpy as np
import pytest

from ipquarry.llm import exact_topk as T
from tests.compare import check


def oracle(rows, ask, k):
    def scaled(v):
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            return None
        return [int(np.floor(1024 * float(np.float64(x)))) for x in v]

    use = [(i, s) for i, v in rows if i is not None and (s := scaled(v)) is not None]
    out = []
    for q in sorted({i for i, _ in use if ask(i)}):
        own = next(s for i, s in use if i == q)
        scores = sorted(((-sum(a * b for a, b in zip(own, s)), i) for i, s in use if i != q and len(s) == len(own)))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, k=10, parts=5, kind="double", **more):
    vectors = spark.createDataFrame([(i, v, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, rank int").repartition(parts)
    return sorted(tuple(r) for r in T.top_k(vectors, vectors.where("vec_id % 100 = 0"), k, **more).collect())


@pytest.mark.parametrize(("tile", "parts", "block"), [(2048, 5, 1 << 24), (7, 40, 1 << 24), (16, 3, 64)])
def test_against_brute_force(spark, monkeypatch, tile, parts, block):
    rng = np.random.default_rng(0)
    monkeypatch.setattr(T, "TILE", tile)
    monkeypatch.setattr(T, "FAN_IN", 4)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(500)]
    rows += [(500 + i, [1.0] * 6) for i in range(60)]  # ties
    assert run(spark, rows, parts=parts, query_bytes=block) == oracle(rows, lambda i: i % 100 == 0, 10)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 2.0]), (100, [0.5, -1.0]), (200, None), (300, [nan, 1.0]), (400, [None, 1.0]), (500, [inf, 0.0]), (None, [1.0, 1.0]), (7, [3.0, 1.0]), (7, [3.0, 1.0]), (8, [-1e-9, 0.0]),
        (600, [1.0, 2.0, 3.0]), (9, [1.0]), (700, []), (10, []),
    ]
    assert run(spark, rows, 3) == oracle(rows, lambda i: i % 100 == 0, 3)
    assert run(spark, []) == [] and run(spark, [(1, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (1, [1.0])]) == [(0, 1, 1, 1024 * 1024)]


def test_long_products(spark):
    rows = [(0, [1e9, 3.0]), (1, [1e3, 7.0]), (2, [1e3, 8.0]), (3, [-1e3, 1.0])]
    assert run(spark, rows) == oracle(rows, lambda i: i % 100 == 0, 10)
    rows = [(0, [1e300]), (1, [1.0]), (2, [-1.0]), (3, [1e300])]
    got = run(spark, rows)
    assert [r[2:] for r in got] == [(1, T._LONG), (3, T._LONG), (2, -T._LONG - 1)]


def test_same_query_in_many_rows(spark):
    rows = [(0, [1.0, 0.0])] * 4 + [(i, [float(i), 1.0]) for i in range(1, 30)]
    got = run(spark, rows, 5)
    assert got == oracle(rows, lambda i: i % 100 == 0, 5)


def test_corpus_against_sql(spark):
    assert check(spark, "/root/testdata/sf0.001", T.QUERIES["op7_exact_topk"], T.ORACLE_SQL["op7_exact_topk"]) == 50


def test_blocks_are_given_back(spark, monkeypatch):
    """However many blocks there are, one broadcast is held at a time, and a query is asked once."""
    sent, most = [], []
    real = type(spark.sparkContext).broadcast

    def broadcast(self, value):
        out = real(self, value)
        sent.append(out)
        destroy = out.destroy
        out.destroy = lambda *a: (sent.remove(out), destroy(*a))
        most.append(len(sent))
        return out

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", broadcast)
    rows = [(100 * (i % 20), [float(i % 20), 1.0]) for i in range(40)] + [(i, [1.0, float(i)]) for i in range(1, 9)]
    got = run(spark, rows, 3, query_bytes=64)
    assert got == oracle(rows, lambda i: i % 100 == 0, 3)
    assert len(most) >= 5 and set(most) == {1} and not sent
