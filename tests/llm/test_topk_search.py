import numpy as np
import pytest

from tidepool.llm import topk_search as T


def brute(rows, k, every):
    usable = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        usable.append((i, [int(np.floor(64 * x)) for x in v]))
    out = []
    for at, (i, q) in enumerate(usable):
        if i % every:
            continue
        found = sorted((-sum(a * b for a, b in zip(q, c)), j) for n, (j, c) in enumerate(usable) if n != at and len(c) == len(q))
        out += [(i, n + 1, j, max(-T.SPAN, min(T.SPAN, -s))) for n, (s, j) in enumerate(found[:k])]
    return sorted(out)


def rows_for(n, dim, seed):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(40)]  # copies: ties go to the smaller id
    return rows


@pytest.mark.parametrize("leaf,shard,block", [(4, 50, 7), (256, 16384, 1024)])
def test_same_as_brute_force(spark, monkeypatch, leaf, shard, block):
    monkeypatch.setattr(T, "SHARD_ROWS", shard)
    monkeypatch.setattr(T, "BLOCK_ROWS", block)
    monkeypatch.setattr(T.KdTree.__init__, "__defaults__", (leaf,))
    rows = rows_for(300, 6, 1)
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] + [0.0] * 5), (903, [float("inf")] + [0.0] * 5)]
    rows += [(None, [0.5] * 6), (920, [1.0, 2.0]), (921, [3.0, -1.0]), (40, rows[40][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string")
    got = T.top_k(df, lambda c: c % 20 == 0, k=5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 20)


def test_values_beyond_exact_doubles(spark):
    rows = [(i, [float(2**20 + i), -3.5 * i]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in T.top_k(df, lambda c: c % 20 == 0, k=3).collect()) == brute(rows, 3, 20)


def test_empty_and_few(spark):
    assert T.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), lambda c: c % 20 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert T.top_k(one, lambda c: c % 20 == 0).count() == 0


@pytest.mark.parametrize("shard, block", [(16384, 65536), (4, 3)])
def test_repeated_ids_are_rows_of_their_own(spark, monkeypatch, shard, block):
    monkeypatch.setattr(T, "SHARD_ROWS", shard)
    monkeypatch.setattr(T, "BLOCK_ROWS", block)
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (20, [-1.0, 3.0]), (0, [1.0, 0.0])]
    rows += [(i, [(i % 7) / 50, (-i % 5) / 50]) for i in range(2, 20)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, rank string, kth string")
    got = sorted(tuple(r) for r in T.top_k(df, lambda c: c % 20 == 0, k=5).collect())
    assert got == brute(rows, 5, 20) and (0, 1, 1, 8192) in got


def test_scores_beyond_doubles_and_beyond_longs(spark, monkeypatch):
    monkeypatch.setattr(T, "SHARD_ROWS", 10)
    rows = [(i, [float(2**26 + i), -1.5 * i, float(2**25)]) for i in range(40)]  # beyond 2**52, within 64 bits
    rows += [(100 + i, [x]) for i, x in enumerate([1e20, 2e20, -1e20, 1e15, 3.0])]
    rows += [(i, [x]) for i, x in ((60, 1e20), (80, -2e20))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in T.top_k(df, lambda c: c % 20 == 0, k=4).collect()) == brute(rows, 4, 20)


def test_sql_agrees_on_repeated_ids(spark):
    import duckdb
    import pandas as pd

    from tidepool.llm.queries import OP10_SQL

    rows = rows_for(90, 4, 3) + [(20, [0.5, 1.0, 2.0, 0.0]), (20, [0.5, 1.0, 2.0, 0.0]), (31, [9.0, 9.0, 9.0, 9.0])]
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding"])  # noqa: F841
    want = sorted(duckdb.sql(OP10_SQL).fetchall())
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in T.top_k(df, lambda c: c % 20 == 0).collect()) == want == brute(rows, 20, 20)
