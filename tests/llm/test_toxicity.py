import zlib

import numpy as np
from pyspark.sql import functions as F

from quillpress.llm import queries, toxicity
from quillpress.llm.toxicity import Settings, train

WORDS = "alpha bravo river stone cloud maple ember violet copper lantern meadow harbor".split()
SMALL = Settings(buckets=1 << 14, epochs=5)


def corpus(n, seed=0):
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(WORDS, rng.integers(20, 200)))
        if i % 4 == 0:
            for _ in range(3):
                words[rng.integers(len(words))] = str(rng.choice(["blockhead", "nitwit"]))
        texts.append(" ".join(words).encode())
        labels.append(int(i % 4 == 0))
    return texts, labels


def test_learns_and_generalises_to_misspellings():
    texts, labels = corpus(400)
    scorer = train(texts, labels, SMALL).start()
    held, truth = corpus(100, seed=1)
    got = np.array([scorer.score(x) for x in held])
    assert ((got >= 0.7) == np.array(truth)).mean() >= 0.95
    assert scorer.score(b"alpha blokhead river blockheads stone") > 0.7 > scorer.score(b"alpha river stone")
    long = (" ".join(WORDS) + " ") * 500
    assert scorer.score((long + "blockhead nitwit " + long).encode()) > 0.7 > scorer.score(long.encode())
    assert scorer.score(b"") < 0.5 and 0 <= scorer.score(b"\xff\xfe") <= 1


def test_repeats_of_a_harmless_word_do_not_add_up():
    texts, labels = corpus(400)
    scorer = train(texts, labels, SMALL).start()
    assert all(scorer.score(((w + " ") * 60).encode()) < 0.7 for w in WORDS)


def test_one_class_or_none():
    assert train([], [], SMALL).start().score(b"x") < 0.01
    assert train([b"x"], [1], SMALL).start().score(b"y") > 0.99


def test_query_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in queries.op1_toxicity(spark, sf).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for i, r in got.items())
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(got[i]["score"], y) for i, y in labels.items() if got[i]["held_out"]]
    toxic, clean = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9
    assert np.mean([s >= 0.7 for s in clean]) < 0.1


def test_cases(docs, spark):
    texts, labels = corpus(120)
    rows = [{"text": t.decode()} for t in texts] + [{"text": None}, {"text": ""}, {"doc_id": None, "text": "nitwit blockhead"}, {"doc_id": 0, "text": texts[0].decode()}]
    df = docs(rows)
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(1, None), (0, 0), (999, 1)], "doc_id long, toxic int")
    scorer = toxicity.fit(df, known, F.col("id") >= 0, s=SMALL)
    got = toxicity.score(df, scorer, carry=("text", "id", "score")).collect()
    assert len(got) == len(rows) and all(0 <= r["__score"] <= 1 and r["id"] == -1 for r in got)
    assert [r["__score"] for r in got if r["text"] is None] == [r["__score"] for r in got if r["text"] == ""]
    twins = [r["__score"] for r in got if r["__id"] == 0]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert toxicity.score(df.where("doc_id < -1"), scorer).count() == 0
    none = toxicity.fit(df, known.where("doc_id < -1"), F.col("id") >= 0, s=SMALL)
    assert toxicity.score(df, none).agg(F.max("__score")).first()[0] < 0.01
