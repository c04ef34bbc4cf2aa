import hashlib
import random

import numpy as np
import pytest

from quillpress.llm import queries
from quillpress.llm.suffix_dedup import anchors, remove_earlier_copies, remove_ranges, suffix_runs


def slow(rows, length=100):
    """rows: (doc_id, bytes) with different ids; (n_bytes, n_removed, n_spans, sha256 of what is left) by id."""
    seen, out = set(), {}
    for i, data in sorted(rows):
        n, mark = len(data), bytearray(len(data) + 1)
        for s in range(n - length + 1):
            part = data[s : s + length]
            if part in seen:
                mark[s : s + length] = b"\1" * length
            seen.add(part)
        left = bytes(b for b, m in zip(data, mark, strict=False) if not m)
        runs = sum(m and not (mark[j - 1] if j else 0) for j, m in enumerate(mark))
        out[i] = (n, sum(mark), runs, hashlib.sha256(left).hexdigest())
    return out


def got(df):
    return {r["id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()}


def texts(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abé ") for _ in range(rnd.randint(2, 9)))
    fresh = lambda k: " ".join(word() for _ in range(k))
    passages = [fresh(rnd.randint(10, 60)) for _ in range(6)]
    out = []
    for _ in range(n):
        kind = rnd.random()
        parts = [fresh(rnd.randint(0, 20)), *(rnd.choice(passages) for _ in range(rnd.randint(0, 3))), fresh(rnd.randint(0, 20))]
        if kind < 0.2 and out:
            parts = [rnd.choice(out)]
        elif kind < 0.4 and out:  # a near copy
            old = rnd.choice(out)
            at = rnd.randrange(len(old) + 1)
            parts = [old[:at], "X", old[at:]]
        elif kind < 0.5:
            parts = ["ab" * rnd.randint(1, 300)]
        out.append("".join(parts))
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 100_000), (2, 100_000), (3, 3), (4, 1)])
def test_against_brute_force(docs, seed, hot):
    rows = texts(seed)
    ids = random.Random(seed).sample(range(1000), len(rows))
    df = docs([{"doc_id": i, "text": t} for i, t in zip(ids, rows, strict=True)])
    assert got(remove_earlier_copies(df, hot=hot)) == slow([(i, t.encode()) for i, t in zip(ids, rows, strict=True)])


@pytest.mark.parametrize(("sample", "common", "hot"), [(10_000, 2, 100_000), (10_000, 2, 2), (7, 1, 100_000), (1, 1, 0), (10_000, 10**9, 100_000)])
def test_common_anchors_change_nothing(docs, monkeypatch, sample, common, hot):
    """Whichever hashes the sample calls common, and with few or many copies that meet by a broadcast."""
    from quillpress.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "COPIES", 10 if hot else 10**9)
    rows = texts(9)
    df = docs([{"doc_id": i, "text": t} for i, t in enumerate(rows)])
    assert got(remove_earlier_copies(df, hot=hot, sample=sample, common=common)) == slow([(i, t.encode()) for i, t in enumerate(rows)])


def test_query(spark, sf):
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = queries.op10_suffix_dedup(spark, sf).withColumnRenamed("doc_id", "id")
    assert got(found) == slow(rows)


def test_long_texts_are_cut_without_loss(docs, monkeypatch):
    from quillpress.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    rnd = random.Random(9)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(4000))
    rows = [base, base[1500:3300] + "tail", "z" * 2000, "q" + base[:700] + base[100:900]]
    assert got(remove_earlier_copies(docs([{"text": x} for x in rows]))) == slow(list(enumerate(x.encode() for x in rows)))


def test_cases(docs):
    long = "".join(chr(97 + i % 23) + str(i) for i in range(60))
    rows = [{"text": None}, {"text": ""}, {"text": long[:99]}, {"text": long[:99]}, {"text": long}, {"text": long}, {"doc_id": 5, "text": long}, {"doc_id": None, "text": long}, {"doc_id": 4, "text": long + "!"}]
    out = remove_earlier_copies(docs(rows), with_text=True).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["id"], []).append((r["n_bytes"], r["n_removed"], bytes(r["kept"]).decode()))
    assert by[0] == by[1] == [(0, 0, "")] and by[2] == by[3] == [(99, 0, long[:99])]
    n = len(long)
    assert by[5] == [(n, n, "")] * 2 and by[None] == [(n, n, "")]
    assert sorted(by[4]) == [(n, 0, long), (n + 1, 0, long + "!")]  # two texts of one id
    assert remove_earlier_copies(docs(rows).where("doc_id < 0")).count() == 0


def test_anchors_follow_content():
    """Equal strings have equal anchors in equal places."""
    rnd = random.Random(10)
    core = bytes(rnd.choice(b"abc") for _ in range(150))
    a, b = b"x" * 37 + core + b"yy", b"zw" * 60 + core
    at = {}
    for name, data in (("a", a), ("b", b)):
        _, anchor, first, last, _ = anchors([data], 100, 32)
        where = data.index(core)
        at[name] = {int(s) - where: int(x) - where for x, lo, hi in zip(anchor, first, last, strict=True) for s in range(lo, hi + 1)}
    assert all(at["a"][i] == at["b"][i] for i in range(51))


def test_suffix_order():
    data = np.frombuffer(b"banana bandana banana band" * 4, np.uint8)
    start = np.arange(len(data) - 12)
    rank = suffix_runs(data, start, 12)
    strings = [bytes(data[i : i + 12]) for i in start]
    assert [strings[i] for i in np.argsort(rank, kind="stable")] == sorted(strings)
    assert len(set(rank.tolist())) == len(set(strings))


def test_ranges():
    assert remove_ranges(b"abcdef", []) == (0, 0, b"abcdef")
    assert remove_ranges(b"abcdef", [(0, 2), (2, 3), (5, 6), (4, 5)]) == (5, 2, b"d")
    assert remove_ranges(b"abcdef", [(1, 3), (2, 5), (1, 2)]) == (4, 1, b"af")
