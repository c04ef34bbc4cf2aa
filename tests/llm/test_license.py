import re

import regex

from quillpress.llm import queries
from quillpress.llm.license_scan import BASE, FUZZY, Scanner, scan_licenses


def slow_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def slow_base(words):
    places = []
    for notice in BASE:
        phrase = notice.phrase.split()
        places += [(i, notice.label) for i in range(len(words) - len(phrase) + 1) if words[i : i + len(phrase)] == phrase]
    return sorted(places)


def slow_labels(words):
    """Labels of places within the bound of edits, by fuzzy search over the whole text."""
    joined = (" " + " ".join(words) + " ").encode()
    found = {label for _, label in slow_base(words)}
    for x in FUZZY:
        for m in regex.finditer(rb"(?be)(?<= )(?:" + regex.escape(x.phrase.encode()) + rb"){e<=%d}(?= )" % x.edits, joined):
            if all(f" {g} ".encode() in joined[m.start() - 1 : m.end() + 1] for g in x.guard):
                found.add(x.label)
    return found


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_license_scan(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        words = slow_words(texts[r["doc_id"]])
        base = slow_base(words)
        assert (r["n_words"], r["n_base"]) == (len(words), len(base))
        assert (r["first_word"], r["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert r["labels"] == ",".join(sorted(slow_labels(words)))
        assert (r["score"] > 0) == bool(r["labels"]) and r["score"] <= 1


CASES = {
    "Released UNDER the MIT-License.": "mit",
    "under the mit lisence": "mit",
    "under the mlt license": "",  # the guard word must stand
    "Apache Licence, Version 2.0": "apache-2",
    "Apache License, Version 1.1": "",
    "cc by nc cc by nc": "cc-by-nc",
    "licenced under cc by nc": "cc-by-nc",
    "licensed under cc by nd": "",
    "GNU Generel Public Licence version 3": "gpl-3",
    "nothing here": "",
}


def test_fuzzy_notices(docs):
    got = {r["id"]: r for r in scan_licenses(docs([{"text": x} for x in CASES])).collect()}
    for i, (text, labels) in enumerate(CASES.items()):
        assert ",".join(sorted({x["label"] for x in got[i]["spans"]})) == labels, text
    assert got[5]["base_first"] == [0, 3]
    near = got[1]["spans"][0]
    assert (near["first"], near["last"], near["edits"], near["notice"]) == (0, 3, 2, "under the mit lisence")


def test_pigeonhole_misses_nothing():
    scanner = Scanner()
    import random

    rnd = random.Random(4)
    for _ in range(300):
        x = rnd.choice(FUZZY)
        text = list(x.phrase)
        for _ in range(rnd.randint(0, x.edits + 1)):
            at = rnd.randrange(len(text))
            text[at : at + 1] = rnd.choice([[], [rnd.choice("abcde ")], [text[at], rnd.choice("abcde")]])
        words = slow_words("some words " + "".join(text) + " and more")
        got = {s["label"] for s in scanner.scan(" ".join(words).encode())["spans"]}
        assert got == slow_labels(words), text


def test_cases(docs):
    rows = [{"text": None}, {"text": ""}, {"text": "x " * 50_000 + "under the mit license"}, {"doc_id": 2, "text": "é under the mit license"}, {"doc_id": None, "text": "\x00\x7f"}]
    got = scan_licenses(docs(rows)).collect()
    assert [(r["n_words"], r["base_first"], r["score"]) for r in got] == [(0, [], 0.0), (0, [], 0.0), (50_004, [50_000], 1.0), (5, [1], 1.0), (0, [], 0.0)]
    assert scan_licenses(docs(rows).where("doc_id < 0")).count() == 0


def test_time_follows_the_length_of_dense_texts():
    import time

    scanner = Scanner()
    for unit in ("cc by nc ", "apache licence version 2 ", "under the mlt license ", "gnu general "):
        began = time.process_time()
        found = scanner.scan((unit * (1_000_000 // len(unit))).encode())
        assert time.process_time() - began < 8, unit  # some 1 to 2 s here; counting from the start took minutes
        places = 1_000_000 // len(unit)
        assert len(found["spans"]) == (places if unit in ("cc by nc ", "apache licence version 2 ") else 0)


def test_dense_texts_equal_a_slow_search():
    scanner = Scanner()
    for unit in ("cc by nc ", "apache licence version 2 ", "under the mit lisence x ", "gnu general public licence version 3 or 2 "):
        words = slow_words(unit * 9)
        found = scanner.scan((unit * 9).encode())
        assert found["base"] == slow_base(words)
        assert {x["label"] for x in found["spans"]} == slow_labels(words)
        for x in found["spans"]:
            assert " ".join(words[x["first"] : x["last"] + 1]) == x["notice"]


def test_own_notices_are_scored_by_their_own_length():
    from quillpress.llm.license_scan import Notice

    scanner = Scanner((), (Notice("own", "free as in free beer", 2),))
    assert scanner.scan(b"it is free as in fre beer")["score"] == 1 - 1 / 20
