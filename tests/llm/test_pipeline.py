import corpus_pipeline
from corpus_pipeline import STAGES, run
from quillpress.llm import packing, stages
from quillpress.llm.simhash import fingerprint

from .test_secrets import slow_base


def test_stages_one_by_one(spark):
    """Each stage against a brute-force version of what it decides, on its own input."""
    sf = "/root/testdata/sf0.01"
    assert [name for name, _ in STAGES] == ["toxicity", "simhash_near_dedup", "secret_scan", "mixing", "packing"]
    before = spark.read.parquet(f"{sf}/documents.parquet").cache()
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}

    clean = stages.drop_toxic(spark, before, sf).cache()
    assert clean.columns == list(stages.COLUMNS)
    all_ids, left = {r["doc_id"] for r in before.collect()}, {r["doc_id"] for r in clean.collect()}
    labelled = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert left < all_ids and len((labelled - toxic) & left) >= 0.95 * len(labelled - toxic)

    single = stages.drop_near_duplicates(spark, clean, sf).cache()
    prints = {r["doc_id"]: fingerprint((r["text"] or "").encode()) for r in clean.collect()}
    ids = sorted(prints)
    label = {i: i for i in ids}
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (prints[i] ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                a, b = sorted((label[i], label[j]))
                label = {k: a if v == b else v for k, v in label.items()}
    assert sorted(r["doc_id"] for r in single.collect()) == sorted(set(label.values()))

    masked = stages.mask_secrets(spark, single, sf).cache()
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in masked.collect():
        assert not slow_base(r["text"]) and r["n_chars"] == len(r["text"])
        assert (r["text"] == texts[r["doc_id"]]) == (not slow_base(texts[r["doc_id"]]))
    assert masked.count() == single.count()

    mixed = stages.sample_mixture(spark, masked, sf).cache()
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in masked.collect()} and mixed.count() > 0.2 * masked.count()

    encode = packing.public_encoder()
    pieces = stages.pack_sequences(spark, mixed, sf).collect()
    found = {}
    for r in sorted(pieces, key=lambda r: r["start"]):
        found[r["doc_id"]] = found.get(r["doc_id"], b"") + bytes(r["ids"])
    import numpy as np

    assert {i: np.frombuffer(x, "<u4").tolist() for i, x in found.items()} == {r["doc_id"]: encode(r["text"]).tolist() + [1] for r in mixed.collect()}


def test_run(spark, sf):
    got = run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None


def test_cases(docs, spark, sf):
    rows = [{"text": None}, {"text": ""}, {"text": "a b c d e f"}, {"text": "a b c d e f"}, {"doc_id": 2, "text": "a b c d e f"}, {"doc_id": None, "text": "token=abcdefghijklmnop", "lang": None, "source": None}, {"text": " " * 1_100_000 + "x"}]
    for name, f in STAGES:
        out = f(spark, docs(rows), sf)
        assert out.count() >= 0
        if name != "packing":
            assert out.columns == list(stages.COLUMNS)
        assert f(spark, docs(rows).where("doc_id > 100"), sf).count() == 0
    assert sorted(r["doc_id"] for r in stages.drop_near_duplicates(spark, docs(rows), sf).collect() if r["doc_id"] is not None) == [0, 2, 6]
    long = [r for r in stages.pack_sequences(spark, docs(rows), sf).collect() if r["doc_id"] == 6]
    assert sum(r["length"] for r in long) == long[0]["doc_tokens"] > 1_000_000
    assert [r["text"] for r in stages.mask_secrets(spark, docs(rows), sf).collect() if r["doc_id"] is None] == ["[secret]"]


def test_the_library_does_not_need_this_folder():
    import pathlib

    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in (root / "quillpress").rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in [w for line in path.read_text().splitlines() if line.startswith(("import", "from")) for w in line.replace(".", " ").split()]
