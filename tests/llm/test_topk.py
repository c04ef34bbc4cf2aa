import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillpress.llm import queries, topk
from quillpress.llm.queries import ORACLE_SQL
from quillpress.llm.topk import Best, approximate, exact_top_k


def slow(rows, is_query, k):
    """rows: (vec_id, vector); rank lists by brute force."""
    good = [(u, i, [math.floor(256 * x) for x in v]) for u, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for u, i, q in good:
        if is_query(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, w) for w, j, v in good if w != u and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j, _) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(map(tuple, queries.op9_exact_top_k(spark, sf).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == sorted(map(tuple, con.sql(f"SELECT query_id, rank, vec_id, score FROM ({ORACLE_SQL['op9_exact_top_k']})").fetchall()))


@pytest.mark.parametrize("seed", range(6))
def test_blocks(seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(1, 3000)), int(rng.integers(1, 20))
    vectors = rng.integers(-100, 100, (n, d)) if seed % 2 else rng.integers(-2, 2, (n, d))
    queries_, ids, rows = rng.integers(-100, 100, (7, d)), rng.integers(0, 50, n), np.arange(n)
    own = np.array([0, 1, 2, -1, -2, -3, -4])
    found = Best(queries_, own, 5)
    for at in range(0, n, 700):  # several batches
        found.add(vectors[at : at + 700], ids[at : at + 700], rows[at : at + 700])
    for i in range(7):
        best = sorted((-int(vectors[j] @ queries_[i]), int(ids[j]), j) for j in range(n) if rows[j] != own[i])[:5]
        assert [(-int(a), int(b), int(c)) for a, b, c in zip(*found.found[i], strict=True)] == best


def test_the_scan_reads_few_exact_vectors_and_beats_plain_products():
    """768 dimensions: bounds leave few vectors to read, and take no longer than twice a plain float64 product with its partition."""
    import time

    rng = np.random.default_rng(3)
    vectors, asked = rng.integers(-256, 256, (8192, 768)), rng.integers(-256, 256, (256, 768))
    read = []
    best = Best(asked, np.full(256, -1), 5)
    keep = Best._keep
    best._keep = lambda i, score, *x: (read.append(len(score)), keep(best, i, score, *x))
    began = time.perf_counter()
    best.add(vectors, np.arange(8192), np.arange(8192))
    took = time.perf_counter() - began
    began = time.perf_counter()
    score = asked.astype(np.float64) @ vectors.T.astype(np.float64)
    top = np.sort(-np.partition(-score, 5, axis=1)[:, :5], axis=1)[:, ::-1]
    plain = time.perf_counter() - began
    assert all((x[0] == top[i]).all() for i, x in enumerate(best.found))
    assert sum(read) < 0.02 * 256 * 8192 and took < 2 * plain + 1


def test_cells_hold_their_vectors():
    vectors = np.random.default_rng(0).integers(-1000, 1000, (500, 6))
    vectors[:, 2] = 7
    codes, low, step = approximate(vectors)
    assert (low + step * codes <= vectors + 1e-6).all() and (vectors <= low + step * (codes + 1.0) + 1e-6).all()


def test_cases(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 150)  # several blocks
    rnd = random.Random(8)
    vec = lambda: [rnd.choice([-0.5, 0.0, 0.25, 0.26]) for _ in range(3)]
    rows = [(i, vec()) for i in range(60)] + [(0, vec()), (0, [0.0, 0.0, 0.0]), (None, vec()), (70, None), (75, [1.0, None, 2.0]), (80, [float("nan"), 0.0, 0.0]), (85, [float("inf"), 0.0, 0.0]), (90, [1.0]), (95, [2.0]), (100, [])]
    df = spark.createDataFrame([(i, v, 1.0, 5) for i, v in rows], "vec_id long, embedding array<float>, score double, uid long")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted(tuple(r) for r in exact_top_k(df, F.col("id") % 5 == 0, 4).select("query_id", "rank", "vec_id", "score").collect())
    assert got == slow(rows, lambda i: i % 5 == 0, 4)
    assert exact_top_k(df.where("vec_id < 0"), F.col("id") % 5 == 0, 4).count() == 0


def test_large_components(spark):
    df = spark.createDataFrame([(0, [1e6, -1e6]), (1, [1e6, 1.0]), (2, [-1e6, 3.0]), (3, [2e6, -5.0])], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in exact_top_k(df, F.col("id") == 0, 5).select("query_id", "rank", "vec_id", "score").collect())
    assert got == slow([(r["vec_id"], r["embedding"]) for r in df.collect()], lambda i: i == 0, 5)
