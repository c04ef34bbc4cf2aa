import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from quillpress.llm import quality_rules, queries
from quillpress.llm.quality_rules import RULES, apply_rules, binomial_tail, certified_cutoffs, counts

CASES = [None, "", "one", " \t\n ", "a b c d e " * 5, "x\nx\n\n \nx\ny", "#*$ | <a> 100%", "é É ü " * 4, "a b c d e f a b c d e", "p q r s t p q r s t p q", "w " * 30_000, "A\x1cB c\x0bd", "the same line\nthe same line\r\nthe same line"]


def slow_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if seen[g] > 1:
            covered.update(range(i, i + 5))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts(docs):
    got = {r["id"]: tuple(r)[2:7] for r in counts(docs([{"text": x} for x in CASES])).collect()}
    assert got == {i: slow_counts(x) for i, x in enumerate(CASES)}


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op6_quality_rules(spark, sf).collect():
        expected = slow_counts(texts[r["doc_id"]])
        assert tuple(r)[1:6] == expected
        assert r["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize(("n", "k", "p"), [(10, 0, 0.3), (50, 3, 0.1), (1000, 4, 0.0125), (1000, 12, 0.0125), (5, 2, 0.3), (100_000, 1000, 0.0125), (3, 3, 0.2), (1, 0, 0.5)])
def test_exact_tail(spark, n, k, p):
    got = spark.range(1).select(binomial_tail(F.lit(n), F.lit(k), p)).first()[0]
    if k >= n * p:
        assert got == 1.0
    elif n <= 1000:
        assert got == pytest.approx(sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1)), rel=1e-8)
    else:
        import math

        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert got == pytest.approx(exact, rel=1e-6)


def labelled(n):
    """Good texts of both languages, and bad ones full of symbols; the words of a text are all different."""
    rows = [{"text": " ".join(f"word{i}x{j}" for j in range(12)), "lang": "en" if i % 2 else "de"} for i in range(n)]
    rows += [{"text": " ".join(f"w{i}{j}###" for j in range(12)), "lang": "en" if i % 2 else "de"} for i in range(n // 5)]
    return rows, [(i, int(i < n)) for i in range(len(rows))]


def test_certifies_and_rejects(docs, spark):
    rows, labels = labelled(1600)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["id"]: r for r in apply_rules(docs(rows), known, risk=0.05).collect()}
    assert all(got[i]["kept"] for i in range(1600))
    assert not any(got[i]["kept"] for i in range(1600, len(rows))) and got[1600]["failed_rules"] == ["symbols"]
    found = certified_cutoffs(counts(docs(rows)), known, risk=0.05).collect()
    alpha = 0.05 / len(RULES)
    assert found and all(r["rejected"] < alpha * r["holdout"] and r["p_value"] <= 0.05 / len(RULES) / 2 for r in found)


def test_a_small_holdout_certifies_nothing(docs, spark):
    rows, labels = labelled(60)
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    assert certified_cutoffs(counts(docs(rows)), known).count() == 0
    assert all(r["kept"] for r in apply_rules(docs(rows), known).collect())


def test_risk_holds_on_new_documents(docs, spark):
    """Good texts with more symbols the higher their number: the cutoffs lose a limited share of others like them."""
    import random

    rnd = random.Random(7)
    make = lambda n: [{"text": " ".join(f"w{rnd.randrange(10**6)}{'#' * rnd.randint(0, 4) if rnd.random() < q else ''}" for _ in range(30))} for q in (rnd.random() for _ in range(n))]
    train, new = make(2500), make(1500)
    known = spark.createDataFrame([(i, 1) for i in range(2500)], "doc_id long, quality int")
    got = apply_rules(docs(train + new), known, risk=0.05).collect()
    lost = sum(not r["kept"] and not r["base_failed"] for r in got if r["id"] >= 2500)
    assert lost / 1500 <= 0.05


def test_cases(docs, spark):
    rows = [{"text": x, "lang": None if i % 2 else "en"} for i, x in enumerate(CASES)] + [{"doc_id": 4, "text": CASES[4]}, {"doc_id": None, "text": "x"}]
    known = spark.createDataFrame([(0, None), (2, 1), (2, 0), (99, 1)], "doc_id long, quality int")
    got = apply_rules(docs(rows), known).collect()
    assert len(got) == len(rows) and all(r["kept"] is not None for r in got)
    assert apply_rules(docs(rows).where("doc_id < 0"), known).count() == 0
    plan = apply_rules(docs(rows), known)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_null_stratum_is_its_own_and_both_joins_agree(docs, spark, monkeypatch):
    rows, labels = labelled(1200)
    rows = [x | {"lang": (None, "", "=", "en")[i % 4] if i % 3 else None} for i, x in enumerate(rows)]
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    counted = counts(docs(rows))
    assert {r[0] for r in counted.select("stratum").distinct().collect()} == {"", "=", "==", "=en"}
    one = sorted(map(str, apply_rules(docs(rows), known).collect()))
    monkeypatch.setattr(quality_rules, "STRATA", 0)
    assert one == sorted(map(str, apply_rules(docs(rows), known).collect()))


@pytest.mark.parametrize("terms", (1, 2, 5, 50))
def test_a_tail_of_few_terms_is_bounded_from_above(spark, terms):
    n, k, p = 4000, 60, 0.02
    exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    got = spark.range(1).select(binomial_tail(F.lit(n), F.lit(k), p, terms)).first()[0]
    assert exact * (1 - 1e-9) <= got <= 6 * exact and (terms < 50 or got == pytest.approx(exact, rel=1e-3))
