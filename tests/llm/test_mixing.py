import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quillpress.llm import queries
from quillpress.llm.mixing import ORACLE, mix, rake


def slow_rake(cells, targets, rounds):
    total = sum(cells.values())
    weight = {k: n / total for k, n in cells.items() if n > 0}
    aims = []
    for d, wanted in enumerate(targets):
        share = defaultdict(float)
        for k, w in weight.items():
            share[k[d]] += w
        aim = {x: wanted.get(x, s) for x, s in share.items()}
        aims.append({x: v / sum(aim.values()) for x, v in aim.items()})
    for _ in range(rounds):
        for d, aim in enumerate(aims):
            share = defaultdict(float)
            for k, w in weight.items():
                share[k[d]] += w
            weight = {k: w * aim[k[d]] / share[k[d]] for k, w in weight.items()}
    return weight


def test_rake(spark):
    cells = {("a", "x", "p"): 100, ("a", "y", "p"): 10, ("b", "x", "q"): 5, ("b", "y", "p"): 50, ("c", "x", "p"): 7, ("b", "y", "q"): 0}
    targets = ({"a": 0.3, "b": 0.6, "zz": 0.4}, {"x": 0.5, "y": 0.5}, {"p": 0.8, "q": 0.2})
    df = spark.createDataFrame([(*k, n) for k, n in cells.items()], "s string, l string, t string, tokens long")
    got = {(r["s"], r["l"], r["t"]): r["weight"] for r in rake(df, dict(zip("slt", targets, strict=True)), 24).collect()}
    expected = slow_rake(cells, targets, 24)
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    for d, wanted in ((1, targets[1]), (2, targets[2])):
        for x, v in wanted.items():
            assert sum(w for k, w in got.items() if k[d] == x) == pytest.approx(v, abs=1e-3)


def test_query_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    order = ["doc_id"]
    got = queries.op8_mixing(spark, sf).toPandas().sort_values(order).reset_index(drop=True)
    expected = con.sql(ORACLE).df().sort_values(order).reset_index(drop=True)[list(got.columns)]
    assert got.astype(str).equals(expected.astype(str))


def test_sample_meets_the_targets(docs):
    rows = [{"text": "x" * 400, "source": f"src{i % 3 if i % 10 else 0}", "lang": "en" if i % 7 else "de"} for i in range(6000)]
    out = mix(docs(rows), {"src0": 0.4, "src1": 0.3, "src2": 0.3}, {"en": 0.7, "de": 0.3}, {"prose": 1.0}, budget=0.2).where("__sampled")
    shares = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum("__tokens").alias("n")).collect()}
    total = sum(shares.values())
    assert total == pytest.approx(0.2 * 6000 * 100, rel=0.1)
    assert shares["src0"] / total == pytest.approx(0.4, abs=0.05)
    langs = {r["lang"]: r["n"] for r in out.groupBy("lang").agg(F.sum("__tokens").alias("n")).collect()}
    assert langs["de"] / total == pytest.approx(0.3, abs=0.05)


def test_draw_is_a_hash_of_the_id(docs):
    rows = mix(docs([{"text": "abcd" * 9} for _ in range(300)]), budget=0.5).collect()
    for r in rows:
        u = int(hashlib.md5(f"11:{r['doc_id']}".encode()).hexdigest()[:12], 16) / 2**48
        assert r["__sampled"] == (u < r["__probability"])


def test_cases(docs):
    rows = [{"text": None}, {"text": ""}, {"text": "x | y", "lang": None, "source": None}, {"text": "word " * 50_000, "source": "unheard"}, {"doc_id": 2, "text": "x | y"}, {"doc_id": None, "text": "$$$ !! "}]
    df = docs(rows)
    out = mix(df).collect()
    assert len(out) == len(rows) and all(0 <= r["__probability"] <= 1 and r["__sampled"] is not None for r in out)
    assert {r["__source"] for r in out} == {"src0", "~"} and {r["__topic"] for r in out} == {"prose", "table", "shouting"}
    assert set(df.columns) <= set(mix(df).columns)
    assert mix(df.where("doc_id < 0")).count() == 0
    plan = mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_zero_targets(spark):
    df = spark.createDataFrame([("a", "x", 10), ("b", "x", 30), ("b", "y", 60)], "s string, l string, tokens long")
    got = {(r["s"], r["l"]): r["weight"] for r in rake(df, {"s": {"a": 0.0, "b": 1.0}, "l": {"z": 1.0, "y": 0.0}}, 6).collect()}
    assert got[("a", "x")] == 0 and sum(got.values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        rake(df, {"s": {"a": 0.0}})
