import pytest
from pyspark.sql import functions as F

from quillpress.llm import mixing

TARGETS = ({"a": 0.5, "b": 0.5}, {"en": 0.5, "de": 0.5}, {"prose": 0.65, "table": 0.35})


def rows():
    """Tables of source a have fewer tokens than their raked share of a budget of 0.4; the targets can be met."""
    sizes = {("a", "en", 0): 500, ("a", "de", 0): 300, ("a", "en", 1): 100, ("a", "de", 1): 100, ("b", "en", 0): 1000, ("b", "de", 0): 800, ("b", "en", 1): 200, ("b", "de", 1): 160}
    return [{"text": ("x | " if table else "xxxx") * 100, "source": s, "lang": lang} for (s, lang, table), n in sizes.items() for _ in range(n)]


def test_full_cells_pass_their_excess_on(docs):
    df = docs(rows())
    out = mixing.mix(df, *TARGETS, budget=0.4).cache()
    assert max(abs(r["expected"] - r["target"]) for r in mixing.marginals(out, *TARGETS).collect()) < 0.001
    assert out.agg(F.sum(F.col("__tokens") * F.col("__probability")) / F.sum("__tokens")).first()[0] == pytest.approx(0.4, abs=1e-5)
    assert out.where("__probability > 0.999999").count() > 0 and out.where("__probability > 1").count() == 0
    assert out.where("__sampled").agg(F.sum("__tokens")).first()[0] == pytest.approx(0.4 * 316_000, rel=0.05)


def test_targets_of_the_query_are_met(spark):
    """Expected shares at sf0.1: half of all tokens holds fewer tables than the target asks for, so all are taken; every other target is met."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source", "lang")
    out = mixing.mix(docs).cache()
    got = {(r["dimension"], r["category"]): (r["target"], r["expected"]) for r in mixing.marginals(out).collect()}
    assert out.where("__topic = 'table' and __tokens > 0").agg(F.min("__probability")).first()[0] > 0.999999
    table = got["topic", "table"][1]
    assert 0.05 < table < 0.06
    for (dim, category), (target, expected) in got.items():
        if category != "table":
            assert abs(expected - target * ((1 - table) / 0.94 if dim == "topic" else 1)) < 1e-5, (dim, category)


def test_targets_that_contradict_each_other_leave_a_residual(spark):
    df = spark.createDataFrame([("a", "x", 50), ("b", "y", 50)], "s string, l string, tokens long")
    assert mixing.rake(df, {"s": {"a": 0.9, "b": 0.1}, "l": {"x": 0.5, "y": 0.5}}, 12).agg(F.max("residual")).first()[0] > 0.1
    assert mixing.rake(df, {"s": {"a": 0.9, "b": 0.1}, "l": {}}, 12).agg(F.max("residual")).first()[0] > 0.1
    assert mixing.rake(df, {"s": {"a": 0.9, "b": 0.1}}, 12).agg(F.max("residual")).first()[0] <= 1e-6
    with pytest.raises(ValueError):
        mixing.rake(df, {"s": {"a": 1.0}}, budget=0.0)


def test_a_category_without_enough_tokens_is_taken_whole(docs):
    df = docs([{"text": "xxxx" * 100, "source": "a" if i % 20 else "b"} for i in range(2000)])
    out = mixing.mix(df, {"a": 0.5, "b": 0.5}, {}, {}, budget=0.5)
    got = {r["__source"]: (r["p"], r["w"]) for r in out.groupBy("__source").agg(F.max("__probability").alias("p"), F.max("__weight").alias("w")).collect()}
    assert got["b"] == (pytest.approx(1), pytest.approx(0.1)) and got["a"] == (pytest.approx(0.9 / 1.9), pytest.approx(0.9))


def test_rounds_that_do_not_settle_cost_no_jobs(spark):
    """Targets that contradict each other take every round; on the driver that is one plan, whatever their number."""
    df = spark.createDataFrame([("a", "x", 50), ("b", "y", 50), ("b", "x", 0)], "s string, l string, tokens long")
    jobs = {}
    for rounds in (1, 200):
        spark.sparkContext.setJobGroup(f"raking-{rounds}", "")
        got = mixing.rake(df, {"s": {"a": 0.9, "b": 0.1}, "l": {"x": 0.5, "y": 0.5}}, rounds).collect()
        jobs[rounds] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"raking-{rounds}"))
        assert {(r["s"], r["l"]): r["weight"] for r in got} == {("a", "x"): pytest.approx(0.5), ("b", "y"): pytest.approx(0.5)} and got[0]["residual"] == pytest.approx(0.4)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] == jobs[200] < 20


def test_rounds_equal_plain_ones(spark):
    """Caps, a category without a target and weights of 0, against sorted pieces in plain Python."""
    cells = {(s, t): (7 * i * i + 13 * j) % 50 + (i == j) for i, s in enumerate("abcde") for j, t in enumerate("pqrs")}
    targets, budget = ({"a": 0.4, "b": 0.3, "c": 0.1, "d": 0.1}, {"p": 0.4, "q": 0.3, "r": 0.3, "s": 0.0}), 0.5
    got = mixing.rake(spark.createDataFrame([(*k, n) for k, n in cells.items()], "s string, t string, tokens long"), dict(zip("st", targets, strict=True)), 30, budget).collect()
    total = sum(cells.values())
    cap = {k: n / total / budget for k, n in cells.items() if n > 0}
    weight = {k: c * budget for k, c in cap.items()}

    def root(aim, pairs):  # f for which the sum of min(c, f w) is aim, the largest if several; None if no w is left
        found, full = [], 0.0
        order = sorted(pairs, key=lambda x: x[0] / x[1] if x[1] > 0 else float("inf"))
        for n, (c, _) in enumerate(order):
            if (left := sum(w for _, w in order[n:])) > 0:
                found.append(max(0.0, (aim - full) / left))
            full += c
        return max(found, default=None)

    aims = []
    for d, wanted in enumerate(targets):
        share = {x: sum(w for k, w in weight.items() if k[d] == x) for x in {k[d] for k in weight}}
        aim = {x: wanted.get(x, s) for x, s in share.items()}
        aim = {x: v / sum(aim.values()) for x, v in aim.items()}
        room = {x: sum(c for k, c in cap.items() if k[d] == x) for x in aim}
        f = root(1.0, [(room[x], aim[x]) for x in aim])
        aims.append({x: min(room[x], f * aim[x]) for x in aim})
    for _ in range(30):
        for d, aim in enumerate(aims):
            f = {x: root(aim[x], [(cap[k], w) for k, w in weight.items() if k[d] == x]) or 0.0 for x in aim}
            weight = {k: w * f[k[d]] for k, w in weight.items()}
        residual = max(abs(sum(min(w, cap[k]) for k, w in weight.items() if k[d] == x) - aim[x]) for d, aim in enumerate(aims) for x in aim)
        if residual <= mixing.TOLERANCE:
            break
    assert {(r["s"], r["t"]): r["weight"] for r in got} == {k: pytest.approx(min(w, cap[k]), abs=1e-9) for k, w in weight.items()}
    assert got[0]["residual"] == pytest.approx(residual, abs=1e-9)
