import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillpress.llm import queries
from quillpress.llm.packing import SPECIAL, pack, plan_packing, public_encoder


@settings(max_examples=150, deadline=None)
@given(st.sampled_from([4, 8, 16, 64, 2048]).flatmap(lambda cap: st.tuples(st.just(cap), st.dictionaries(st.integers(1, cap - 1), st.integers(1, 9), max_size=40))))
def test_plan(case):
    """Every document of every length is placed once, packs have no gaps inside, and less than one sequence is padding."""
    capacity, histogram = case
    plan, n = plan_packing(histogram, capacity)
    placed, packs = set(), {}
    for length, rank, count, parts in plan:
        for i in range(count):
            assert (length, rank + i) not in placed
            placed.add((length, rank + i))
            at = 0
            for start, size, first, offset in parts:
                assert start == at and size > 0
                packs.setdefault(first + i, []).append((offset, size))
                at += size
            assert at == length
    assert placed == {(x, i) for x, m in histogram.items() for i in range(m)}
    padding = 0
    for parts in packs.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        padding += capacity - at
        assert at <= capacity
    assert set(packs) == set(range(n)) and padding < capacity


def test_plan_rejects():
    with pytest.raises(ValueError):
        plan_packing({8: 1}, 8)


def plain_ids():
    import public_tokenizers as p
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(), st.sampled_from([SPECIAL, f"a {SPECIAL} b", "  \n\t x", "it's don't", "é日本語 ß", "a" * 3000])))
def test_ids_equal_the_tokenizers(text):
    encode = test_ids_equal_the_tokenizers.__dict__.setdefault("encode", public_encoder())
    plain = test_ids_equal_the_tokenizers.__dict__.setdefault("plain", plain_ids())
    assert encode(text).tolist() + [1] == plain(text)


def test_long_runs_of_white_space(docs):
    """Texts on which the quick way's patterns run out of stack."""
    texts = [" " * 1_100_000, "\n" * 1_100_000, "a" + " \n\t" * 400_000 + "b", "\u3000" * 1_100_000 + "x"]
    rows = pack(docs([{"text": x} for x in texts])).withColumnRenamed("id", "doc_id").collect()
    check(rows, dict(enumerate(texts)))


def check(pieces, texts):
    """pieces: rows with doc_id; texts: doc_id to text."""
    ids = plain_ids()
    by_doc, by_seq = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, rows in by_doc.items():
        own, at = ids(texts[i]), 0
        for r in sorted(rows, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : at], "<u4").tobytes())
        assert at == len(own)
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 2048 - at
    assert padding < 2048


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    check(queries.op2_packing(spark, sf).collect(), texts)


def test_cases(docs):
    texts = [None, "", "x", SPECIAL, "word " * 9000, "é" * 5000, "same text", "same text", " \n "]
    df = docs([{"text": x} for x in texts])
    rows = pack(df).withColumnRenamed("id", "doc_id").collect()
    check(rows, dict(enumerate(texts)))
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] for r in rows)


def test_repeated_and_null_ids(docs):
    rows = pack(docs([{"doc_id": 7, "text": "a b"}, {"doc_id": 7, "text": "a b"}, {"doc_id": None, "text": "c"}])).collect()
    assert sorted((r["id"] or 0) for r in rows) == [0, 7, 7] and len({(r["sequence_id"], r["offset"]) for r in rows}) == 3


def test_empty(docs):
    assert pack(docs([{"text": "x"}]).where("doc_id < 0")).count() == 0
