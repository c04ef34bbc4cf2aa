import random

import numpy as np

import corpus_pipeline
from quillpress.llm import stages
from quillpress.llm.near_copies import FAR, WIDE, near_copy_components, sketch


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def slow_groups(texts):
    sets = [slow_set(x) for x in texts]
    label = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if label[i] != label[j] and 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((label[i], label[j]))
                label = [a if k == b else k for k in label]
    return label


def edited(rnd, words, n):
    words = list(words)
    for i in rnd.sample(range(len(words)), n):
        words[i] = f"new{rnd.randrange(10**9)}"
    return " ".join(words)


def planted(seed=1):
    """Copies with 0 to 5 words changed (some above, some below the threshold), a line that all share, one large group."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(3000)}"
    line = " ".join(word() for _ in range(12))
    texts = [None, "", " \n", "a b", "A  b", "a b c d e", "a b c d e f"]
    for _ in range(40):
        base = [word() for _ in range(rnd.randrange(30, 120))]
        texts += [" ".join(base) + " " + line] + [edited(rnd, base, rnd.randrange(6)) + " " + line for _ in range(3)]
    base = [word() for _ in range(80)]
    texts += [edited(rnd, base, rnd.randrange(4)) for _ in range(60)]
    rnd.shuffle(texts)
    return texts


def test_groups_equal_all_pairs(spark, docs):
    texts = planted()
    got = near_copy_components(docs([{"text": x} for x in texts])).collect()
    least = {}
    for r in sorted(got, key=lambda r: r["id"]):
        least.setdefault(r["root"], r["id"])
    expected = slow_groups(texts)
    assert {r["id"]: least[r["root"]] for r in got} == dict(enumerate(expected)) and len(set(expected)) < len(texts) - 60


def test_links_are_within_the_bits_that_are_compared():
    """Pairs at the threshold differ in fewer bits than FAR, unrelated ones in more."""
    rnd = np.random.default_rng(4)
    for n in (WIDE, 50, 200, 1000):
        far = []
        for _ in range(200):
            x = np.unique(rnd.integers(0, 1 << 63, n).astype(np.uint64))
            lost = n // 9  # (n - lost) / (n + lost) is 0.8
            y = np.concatenate((x[lost:], rnd.integers(0, 1 << 63, lost).astype(np.uint64)))
            z = rnd.integers(0, 1 << 63, n).astype(np.uint64)
            bits = lambda a, b: sum(((i ^ j) & (1 << 64) - 1).bit_count() for i, j in zip(sketch(a), sketch(b), strict=True))
            assert bits(x, y) <= FAR
            far.append(bits(x, z))
        assert np.mean(np.array(far) > FAR) > 0.99


def test_one_id_with_two_texts_and_rows_without_an_id(spark, docs, sf):
    base = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(base)), (1, "something else that stands alone here"), (2, " ".join(base[:59] + ["x"])), (None, " ".join(base)), (None, "words of a row without id"), (None, "words of a row without id"), (3, "one row"), (3, "one row"), (4, None), (5, "")]
    for stage in (stages.drop_near_copies, stages.drop_near_duplicates):
        got = stage(spark, docs([{"doc_id": i, "text": x} for i, x in rows]), sf).collect()
        own = sorted((r["doc_id"] or 0, r["text"] or "") for r in got)
        assert own == sorted([(0, "words of a row without id"), (1, " ".join(base)), (1, "something else that stands alone here"), (3, "one row"), (4, "")] + ([] if stage is stages.drop_near_copies else [x for x in [(2, " ".join(base[:59] + ["x"]))] if x in own]))


def test_stage_leaves_no_near_copy(spark, sf):
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:50] + [f"x{i}"] + base[51:]), "en", "src0", 0) for i in range(3)]
    rows.append((9, " ".join(f"other{i}" for i in range(200)), "en", "src0", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in stage(spark, df, sf).collect()) == [0, 9]
