import random

import numpy as np
import xxhash

from quillpress.llm import queries
from quillpress.llm.simhash import Anchors, anchor_forest, components, connected, fingerprint, near_duplicate_components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """prints: list of (id, fingerprint); the smallest id that each can reach, by all pairs."""
    n = len(prints)
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                a, b = label[i], label[j]
                if a != b:
                    label = [min(a, b) if x in (a, b) else x for x in label]
    return [min((prints[j][0] for j in range(n) if label[j] == label[i] and prints[j][0] is not None), default=None) for i in range(n)]


def test_query(spark, sf):
    texts = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash_near_dedup(spark, sf).collect()}
    prints = [(i, slow_fingerprint(t)) for i, t in texts]
    expected = {i: (f"{fp:016x}", c) for (i, fp), c in zip(prints, slow_components(prints), strict=True)}
    assert got == expected


def test_fingerprint_cases():
    for text in ("", " \n\t", "a", "a b", "A B c", "a b c d", "é É x y", "a\x0bb\x0cc\rd", "a\x1cb c d", "x " * 5000):
        assert fingerprint(text.encode()) == slow_fingerprint(text), text


def test_cover_reaches_every_neighbour():
    """For any fingerprint and any of its neighbours within two bits there is an anchor, home of one, that both have."""
    anchors, rnd = Anchors(), random.Random(1)
    for _ in range(30):
        x = rnd.getrandbits(64)
        near = [x ^ (1 << a) ^ (1 << b) for a, b in (rnd.sample(range(64), 2) for _ in range(40))] + [x ^ (1 << b) for b in range(64)]
        row, at, home = anchors.cover(np.array([x, *near], np.uint64))
        homes = [set(at[(row == i) & home].tolist()) for i in range(len(near) + 1)]
        cover = [set(at[row == i].tolist()) for i in range(len(near) + 1)]
        assert all(len(h) == 1 for h in homes)
        assert all(homes[0] <= cover[i] and homes[i] <= cover[0] for i in range(1, len(near) + 1))


def test_forest_by_masks_equals_all_pairs(monkeypatch):
    from quillpress.llm import simhash

    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(40)]
    fp = np.unique(np.array([b ^ sum(1 << x for x in rnd.sample(range(64), rnd.choice([0, 1, 2, 3]))) for b in base for _ in range(6)], np.uint64))
    one, home = np.zeros(len(fp), np.int32), np.ones(len(fp), bool)

    def groups():
        a, b = anchor_forest(one, fp, home)
        return components(len(fp), np.searchsorted(fp, a), np.searchsorted(fp, b)).tolist()

    plain = groups()
    monkeypatch.setattr(simhash, "MASK_LOOKUP", 1)
    assert groups() == plain and len(set(plain)) < len(fp)


def test_connected(spark):
    rnd = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)] + [(500, i) for i in range(501, 560)] + [(7, 7), (-5, 300)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    for u, v in edges:
        assert u == v or got.get(u, u) == got.get(v, v)
    assert all(got.get(i, i) == 0 for i in range(41)) and all(got[i] == 500 for i in range(501, 560)) and got[300] == -5


def test_cases(docs):
    rows = [{"text": None}, {"text": ""}, {"text": " "}, {"text": "a b c d"}, {"text": "A  b\nC d"}, {"doc_id": 3, "text": "a b c d"}, {"doc_id": None, "text": "a b c d"}, {"doc_id": None, "text": "other words here"}]
    got = [(r["id"], r["component_id"]) for r in near_duplicate_components(docs(rows)).collect()]
    assert sorted((i, c) for i, c in got if i is not None) == [(0, 0), (1, 0), (2, 0), (3, 3), (3, 3), (4, 3)]
    assert sorted(c is None for i, c in got if i is None) == [False, True]
    assert near_duplicate_components(docs(rows).where("doc_id < 0")).count() == 0
