"""Exact and approximate search against brute force, with ties and rows that take no part."""

import math

import duckdb
import numpy as np
import pytest

from gridframe.llm import vectors
from gridframe.llm.queries import ORACLE_SQL

SCHEMA = "vec_id bigint, embedding array<float>, score string"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s") for i, v in rows], SCHEMA).repartition(parts)


def rows(n=900, width=8, seed=1):
    rng = np.random.default_rng(seed)
    out = [(k, rng.integers(-3, 4, width) / 4) for k in range(n)]  # many ties
    out += [(2000, None), (2100, [1.0, None] + [0.0] * 6), (2200, [math.nan] * 8), (2300, [math.inf] + [0.0] * 7), (2400, []), (2500, [1.0]), (None, [1.0] * 8)]
    return out + [(20 * k, out[20 * k][1]) for k in range(10) if 20 * k < n]  # repeated rows, also of queries


def whole(data):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in data if i is not None and v is not None and len(v) == 8 and None not in list(v) and np.isfinite(np.array(v, float)).all()]
    return np.array([i for i, _ in ok]), np.stack([v for _, v in ok])


def best(ids, x, every, k, scale):
    out = set()
    y = np.floor(1024 * x) if scale else x
    for q in sorted({i for i in ids if i % every == 0}):
        s = y @ y[list(ids).index(q)]
        other = ids != q
        for rank, j in enumerate(np.lexsort((ids[other], -s[other]))[:k], 1):
            out.add((int(q), rank, int(ids[other][j]), int(s[other][j]) if scale else round(float(s[other][j]), 9)))
    return out


def test_exact(spark):
    data = rows()
    ids, x = whole(data)
    got = [tuple(r) for r in vectors.exact_top_k(table(spark, data), 10, 100).collect()]
    assert set(got) == best(ids, x, 100, 10, True) and len(got) == len(set(got))


def test_exact_blocks_and_large_numbers(spark, monkeypatch):
    few = [(100, [3e7, 1.0]), (1, [3e7, 2.0]), (2, [-3e7, 5.0]), (200, [0.0, 0.0])]
    got = {tuple(r) for r in vectors.exact_top_k(table(spark, few), 2, 100).collect()}
    f = lambda v: [math.floor(1024 * float(np.float32(x))) for x in v]
    dot = lambda a, b: sum(p * q for p, q in zip(f(a), f(b), strict=True))
    clip = lambda v: max(-(2**63), min(2**63 - 1, v))
    want = set()
    for q, v in few:
        if q % 100 == 0:
            ranked = sorted(((-clip(dot(v, w)), i) for i, w in few if i != q))[:2]
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(ranked, 1)}
    assert got == want
    assert vectors.exact_top_k(table(spark, []), 2).count() == 0


def searched(queries, query_ids, rows, k, bar=None):
    best = vectors._Best(k, exact=True)
    best.ask(query_ids, np.column_stack([queries, np.full(len(queries), -np.inf) if bar is None else bar]))
    for ids, x in rows:
        best.look(ids, x)
    return set(zip(*(c.tolist() for c in best.found()), strict=True)), best


def test_ties_are_kept():
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (4096, 4)).astype(float)
    ids = rng.permutation(4096).astype(np.int64)
    q = x[:5]
    found, _ = searched(q, ids[:5], [(ids[a : a + 1000], x[a : a + 1000]) for a in range(0, 4096, 1000)], 10)
    for k in range(5):
        s = x @ q[k]
        other = ids != ids[k]
        want = {(int(ids[k]), int(ids[other][j]), int(s[other][j])) for j in np.lexsort((ids[other], -s[other]))[:10]}
        assert {f for f in found if f[0] == ids[k]} == want


def test_clustered_blocks_are_skipped():
    """Blocks of one cluster each: bounds fall below the bar, and what is found before raises it for the rows that follow."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    x = np.floor(1024 * (np.repeat(centres, 256, 0) + 0.05 * rng.normal(size=(40 * 256, 32))))
    ids = np.arange(len(x))
    queries = x[::512]
    found, best = searched(queries, ids[::512], [(ids[a : a + 2560], x[a : a + 2560]) for a in range(0, len(x), 2560)], 10)
    s = queries @ x.T
    s[np.arange(len(queries)), ids[::512]] = -(2.0**60)
    assert {(q, i) for q, i, _ in found} == {(int(ids[::512][a]), int(i)) for a in range(len(queries)) for i in np.lexsort((ids, -s[a]))[:10]}
    assert best.pairs == 40 * len(queries) and best.scored < 0.5 * best.pairs


def test_sql_says_the_same(spark):
    duck = duckdb.connect()
    duck.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = {(r[0], r[1], r[2], r[3]) for r in duck.sql(ORACLE_SQL["op4_exact_top_k"]).project("query_id, rank, vec_id, score").fetchall()}
    got = {tuple(r) for r in vectors.exact_top_k(spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")).collect()}
    assert got == want


@pytest.mark.parametrize("n", [12, 900])
def test_nearest(spark, n):
    data = [r for r in rows(n) if r[0] is None or r[0] < n or r[0] >= 2000] + [(3000, [0.0] * 8)]
    ids, x = whole(data)
    keep = (x != 0).any(1)
    ids, x = ids[keep], x[keep]
    got = [tuple(r) for r in vectors.nearest(table(spark, data), 20, 20).collect()]
    want = best(ids, x, 20, 20, False)
    assert len(got) == len(want)
    exact = {(q, i): s for q, i, s in ((int(q), int(i), float(a @ b)) for q, a in zip(ids, x, strict=True) if q % 20 == 0 for i, b in zip(ids, x, strict=True))}
    assert all(abs(exact[q, i] - s) < 1e-12 and q != i for q, _, i, s in got)
    hit = len({(q, r, i) for q, r, i, _ in got} & {(q, r, i) for q, r, i, _ in want})
    assert hit >= 0.9 * len(want)
    assert vectors.nearest(table(spark, []), 20).count() == 0


def test_recall_on_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    data = frame.toPandas()
    ids, x = data.vec_id.to_numpy(), np.stack(data.embedding).astype(float)
    want = {(q, i) for q, _, i, _ in best(ids, x, 20, 20, False)}
    got = {(r["query_id"], r["vec_id"]) for r in vectors.nearest(frame).collect()}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("copies", [3, 20])
def test_a_repeated_query_takes_no_candidate_away(spark, copies):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(100, 8)).astype(np.float32)
    x[0] *= 9  # the copies score above all others
    data = list(enumerate(x)) + [(0, x[0])] * (copies - 1)
    got = [tuple(r) for r in vectors.exact_top_k(table(spark, data, 1), 10, 100).collect()]
    ids, y = whole(list(enumerate(x)))
    assert len(got) == 10 and set(got) == best(ids, y, 100, 10, True)


def test_repeated_queries_among_many_ties():
    ids = np.array([5] * 30 + list(range(100, 200)), np.int64)
    x = np.ones((len(ids), 2))
    found, _ = searched(x[:1], ids[:1], [(ids, x)], 10)
    assert found == {(5, k, 2) for k in range(100, 110)}


def test_units_cut_queries_and_candidates(spark, monkeypatch):
    monkeypatch.setattr(vectors, "UNIT_CANDIDATES", 100)
    monkeypatch.setattr(vectors, "UNIT_QUERIES", 3)
    monkeypatch.setattr(vectors, "CHUNK_QUERIES", 2)
    monkeypatch.setattr(vectors, "ROW_BLOCKS", 1)
    monkeypatch.setattr(vectors, "BLOCK_VECTORS", 40)
    data = rows()
    ids, x = whole(data)
    got = [tuple(r) for r in vectors.exact_top_k(table(spark, data), 10, 100).collect()]
    assert set(got) == best(ids, x, 100, 10, True) and len(got) == len(set(got))


@pytest.mark.parametrize("clustered", [True, False])
def test_a_tree_of_many_leaves(spark, monkeypatch, clustered):
    """50 leaves or more, of which a query visits a part; a third of all vectors are equal and fill one leaf."""
    monkeypatch.setattr(vectors, "LEAF_VECTORS", 20)
    monkeypatch.setattr(vectors, "UNIT_CANDIDATES", 300)
    rng = np.random.default_rng(3)
    n, width = 3000, 8
    x = rng.normal(size=(n, width)) if not clustered else np.repeat(rng.normal(size=(100, width)), n // 100, 0) + 0.1 * rng.normal(size=(n, width))
    x[rng.permutation(n)[: n // 3]] = x[0]
    data = list(enumerate(x.astype(np.float32)))
    seen = []
    calibrate = vectors.MeansTree.calibrate

    def spy(tree, *args):
        seen.append((tree.leaves, calibrate(tree, *args)))
        return seen[-1][1]

    monkeypatch.setattr(vectors.MeansTree, "calibrate", spy)
    got = {(r["query_id"], r["vec_id"]) for r in vectors.nearest(table(spark, data)).collect()}
    ids, y = whole(data)
    want = {(q, i) for q, _, i, _ in best(ids, y, 20, 20, False)}
    (leaves, visits), = seen
    assert leaves >= 50 and visits < leaves * (0.5 if clustered else 0.95)
    assert len(got & want) >= 0.9 * len(want)


def test_a_sample_of_useless_rows_is_no_sample(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SAMPLE_VECTORS", 4)
    data = [(k, [math.nan] * 8) for k in range(200)] + [(20 * k, [1.0, k] + [0.0] * 6) for k in range(30)]
    assert vectors.nearest(table(spark, data), 5).count() == 150 and vectors.exact_top_k(table(spark, data), 5).count() == 30
