"""The fit's gradient and the running-sum scorer against slow versions."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillpress.llm import toxicity
from quillpress.llm.toxicity import Bag, Model, Scorer, Settings, subwords, windows_of

TINY = Settings(buckets=1 << 8, window=6)


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 101, rng.integers(1, 7), dtype=np.uint8)) for _ in range(60)]
    bag = Bag((words[i : i + 20] for i in (0, 20, 40)), TINY)
    model = Model(TINY)
    model.table, model.out, model.bias = model.table.astype(np.float64), rng.normal(size=(TINY.dims, 2)), rng.normal(size=2)
    mine = np.arange(len(bag.doc))
    y = mine % 2
    _, used, to_row, to_out, to_bias = model.gradients(bag, mine, y)
    full = np.zeros_like(model.table)
    full[used] = to_row
    for value, grad in ((model.table, full), (model.out, to_out), (model.bias, to_bias)):
        for _ in range(40):
            at = tuple(rng.integers(n) for n in value.shape)
            if value is model.table:
                at = (rng.choice(used), at[1])
            kept, step = value[at], 1e-5
            value[at] = kept + step
            more = model.gradients(bag, mine, y)[0]
            value[at] = kept - step
            less = model.gradients(bag, mine, y)[0]
            value[at] = kept
            assert abs((more - less) / (2 * step) - grad[at]) < 1e-5 * (1 + abs(grad[at]))


def slow_logit(words, scorer):
    """The worst window, each distinct word of it counted once, by its n-grams."""
    w = scorer.s.window
    windows = [set(words[i : i + w]) for i in range(max(1, len(words) - w + 1))]
    value = lambda x: float(np.mean([float(scorer.weight[r]) for r in subwords(x, scorer.s)]))
    return max(sum(map(value, sorted(x))) for x in windows) + scorer.bias if words else scorer.bias


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bb", b"abc", b"abd", b"nitwit", b"river", b"zz"]), max_size=40), st.integers(0, 9))
def test_scorer_equals_a_slow_one(words, seed):
    scorer = Scorer(np.random.default_rng(seed).normal(size=TINY.buckets).astype(np.float32), 0.3, 1.0, 0.0, TINY).start()
    assert abs(scorer.logit(words) - slow_logit(words, scorer)) < 1e-9


def test_the_cache_changes_no_score():
    scorer = Scorer(np.random.default_rng(1).normal(size=TINY.buckets).astype(np.float32), 0.3, 1.0, 0.0, TINY).start()
    first = [b"%d" % i for i in range(310_000)]
    a = scorer.logit(first)
    assert len(scorer.known) > 300_000
    b = scorer.logit([b"new", b"words"])
    assert len(scorer.known) == 2 and b == Scorer(scorer.weight, 0.3, 1.0, 0.0, TINY).start().logit([b"new", b"words"]) and a == scorer.logit(first)


def test_every_window_of_a_sampled_text_is_read():
    words = [b"w%d" % i for i in range(5000)]
    assert {w for x in windows_of(words, Settings()) for w in x} == set(words)


def test_the_sample_is_bounded_in_bytes(docs, spark):
    """A row that does not fit in what is left of its class's bytes is passed over, others are read whole."""
    texts = ["long " * 500] + [f"text number {i} " * 5 for i in range(20)]
    known = spark.createDataFrame([(i, i % 2) for i in range(21)], "doc_id long, toxic int")
    take = lambda s: [(bytes(r["words"]), r["label"]) for r in toxicity.sampled(docs([{"text": x} for x in texts]), known, F.col("id") >= 0, "doc_id", "text", "toxic", s).collect()]
    some = take(Settings(max_bytes=400))
    assert 0 < len(some) < 20 and all(sum(len(w) for w, y in some if y == c) <= 400 for c in (0, 1))
    assert all(len(w.split()) == 15 for w, _ in some)
    assert sorted(len(w.split()) for w, _ in take(Settings())) == [15] * 20 + [500]
