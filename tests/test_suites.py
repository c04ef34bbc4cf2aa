"""Suites over a corpus: each text goes through the settings once, and a row per document gives what a row per run gives."""

import pytest

from quillpress.config import grid
from quillpress.plans import expected as X
from quillpress.plans import suites
from quillpress.plans.queries import QUERIES


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture(scope="module")
def notes(spark):
    filled = [t.replace("{k}", str(k)).replace("{s}", "QUAY") for k in range(3) for t in (X.NOTE, X.DOTTED)]
    texts = [*filled, "", None, "The the THE a quay, the quay.\n" + "".join(f"word{i} is listx{i}\n" for i in range(30))]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.mark.parametrize("name", ["grammar_coverage", "removed_words"])
def test_words_are_compared_in_one_pass(spark, sf, name):
    plan = optimized(QUERIES[name](spark, sf))
    assert plan.count("Relation [") == 1 and plan.count("Join") == 0
    assert plan.count("ArrowEvalPython [") == 2  # the settings, and the comparison of their words


def rows(df):
    return sorted(map(str, df.collect()))


def pair(notes, *names):
    return suites.run_beside(notes, {k: grid()[k] for k in names})


def test_removed_words_by_hand(spark, notes):
    runs = spark.createDataFrame([(1, "L2", "b b a c ee ee"), (1, "L2_g", "a c ff"), (2, "L2", "ee the the"), (2, "L2_g", "ee"), (3, "L2", None), (3, "L2_g", None)], "doc_id long, config string, output string")
    want = [("ee", 2, False), ("the", 2, True)]  # words of one byte do not count
    assert sorted(map(tuple, suites.removed_words(runs).collect())) == want
    assert sorted(map(tuple, suites.removed_words(suites.beside(runs, "L2", "L2_g")).collect())) == want
    assert rows(suites.removed_words(pair(notes, "L2", "L2_g"))) == rows(suites.removed_words(suites.run_grid(notes)))


def test_grammar_coverage_shows_the_first_of_all(notes, spark):
    got = suites.grammar_coverage(pair(notes, "L2", "L2_g")).first()
    other = [r for r in suites.removed_words(pair(notes, "L2", "L2_g")).collect() if not r["approved"]]
    assert len(other) > suites.SHOWN and got["unexpected_words"] == sorted(r["word"] for r in other)[: suites.SHOWN]
    assert got["unexpected"] + got["protected_removed"] == sum(r["n"] for r in other)
    none = suites.grammar_coverage(pair(notes.limit(0), "L2", "L2_g")).first()
    assert (none["total_removed"], none["unexpected"], none["unexpected_words"]) == (0, 0, [])


def test_structures_are_not_broadcast(spark, sf, notes):
    plan = optimized(QUERIES["structure_preservation"](spark, sf))
    assert plan.count("Relation [") == 1 and plan.count("Join") == 0 and plan.count("ArrowEvalPython [") == 1
    runs = suites.run_grid(notes)
    assert "Broadcast" not in suites.structure_preservation(runs, notes)._jdf.queryExecution().executedPlan().toString()
    assert rows(suites.structure_preservation(pair(notes, "L1", "L2", "L3", "L4"))) == rows(suites.structure_preservation(runs, notes))


def test_expansions_are_not_broadcast(spark, sf, notes):
    plan = optimized(QUERIES["dictionary_reversibility"](spark, sf))
    assert plan.count("Relation [") == 1 and plan.count("Join") == 0
    assert rows(suites.dictionary_reversibility(pair(notes, "L2", "L2_d"))) == rows(suites.dictionary_reversibility(suites.run_grid(notes)))


def test_ids_that_do_not_expand(spark):
    coded = lambda k, end: (k, "L2_d", f"@dict:\n  @m1: foo\n@m1{end}\n")
    bad = [coded(k, "!") for k in range(60, 0, -1)]
    rest = [coded(61, ""), (62, "L2_d", "no dictionary"), (63, "L2_d", None), coded(64, "")]
    plain = [(k, "L2", "foo" if k < 63 else None) for k in range(1, 64)]  # the last has no plain run
    got = suites.dictionary_reversibility(spark.createDataFrame([*bad, *rest, *plain], "doc_id long, config string, output string")).first()
    assert tuple(got) == (61, 1, list(range(1, suites.SHOWN + 1)))


def test_offsets_of_characters():
    from quillpress.operators.dictionary import _offsets

    text = "aé—§\U0001f600\ud800z"
    assert _offsets(text) == [len(text[:i].encode("utf-8", "surrogatepass")) for i in range(len(text) + 1)]


def test_gate_checks_each_document_once(spark, sf):
    plan = optimized(QUERIES["threshold_gate"](spark, sf))
    assert plan.count("ArrowEvalPython [") == 2  # the setting, and the checks
