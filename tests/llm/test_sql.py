"""Every query that has SQL against that SQL, over the driver's tables and over planted cases."""

import os
import random

import duckdb
import pytest

from quillpress.llm import quality_rules, queries, secret_scan, url_filter
from quillpress.llm.queries import ORACLE_SQL, QUERIES

from .test_quality import CASES as TEXTS
from .test_quality import labelled
from .test_secrets import CASES as SECRETS
from .test_secrets import keys_and_names
from .test_suffix import texts
from .test_url import URLS


def compare(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        if os.path.exists(f"{sf_dir}/{table}.parquet"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet{'/*.parquet' if os.path.isdir(f'{sf_dir}/{table}.parquet') else ''}')")
    got, expected = QUERIES[name](spark, str(sf_dir)).toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).values.tolist()))
    assert rows(got) == rows(expected)
    return got


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_tables(spark, sf, name):
    assert len(compare(spark, sf, name))


def write(spark, folder, table, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")


def test_planted_keys(spark, tmp_path):
    keys, names = keys_and_names(200)
    rnd = random.Random(11)
    rows = [f"x {v} y {w}" for v, w in zip(keys, names, strict=False)] + names[200:] + SECRETS
    rows += ["".join(rnd.choice("0123456789ABCDEF") for _ in range(40)) for _ in range(50)] + ["".join(rnd.choice(secret_scan.ALPHABETS["random32"]) for _ in range(52)) for _ in range(50)]
    rows += ["".join(rnd.choice(secret_scan.ALPHABETS["random64"]) for _ in range(44)) for _ in range(100)]
    write(spark, tmp_path, "documents", list(enumerate(rows)), "doc_id long, text string")
    got = compare(spark, tmp_path, "op5_secret_scan").sort_values("doc_id")["spans"].tolist()
    planted = {"random62": got[:200], "random16": got[-200:-150], "random32": got[-150:-100], "random64": got[-100:]}
    for kind, spans in planted.items():
        assert sum(bool(x) for x in spans) >= 0.9 * len(spans) and any(kind in x for x in spans), kind
    false = sum("random" in x for x in got[200:-200]) + sum(x.count("random") > 1 for x in got[:200])
    assert false <= 0.1 * sum(map(bool, got))


def test_certified_cutoffs(spark, tmp_path):
    rows, labels = labelled(3000)
    rows += [{"text": x, "lang": None} for x in TEXTS]
    write(spark, tmp_path, "documents", [(i, x["text"], x["lang"]) for i, x in enumerate(rows)], "doc_id long, text string, lang string")
    write(spark, tmp_path, "labels", labels, "doc_id long, quality int")
    got = compare(spark, tmp_path, "op6_quality_rules")
    assert (~got["kept"] & ~got["base_failed"]).sum() >= 600 and quality_rules.sql() == ORACLE_SQL["op6_quality_rules"]


def test_urls(spark, tmp_path):
    rnd = random.Random(12)
    more = [f"http://{rnd.choice(['a.net', 'b.org', 'www.example.com', 'example.com'])}/{rnd.choice(['en', 'es', 'fr', 'x1', 'deadbeef01234567890abcdef'])}/{rnd.randint(1, 99)}{rnd.choice(['', '/', '.html', '/p/q/r/s'])}" for _ in range(600)]
    more.append("http://hex.org/deadbeef01234567890abcdef/x")  # one branch, which stays apart
    # only the tree can tell: rules block /es/ and /fr/ of a host, and its other languages have the same pages
    planted = [f"http://spam.net/{lang}/{i}/offer{i % 7}.html" for lang in ("es", "fr", "it", "pt") for i in range(30)]
    more += planted + [f"http://fine.net/{lang}/{i}" for lang in ("it", "pt") for i in range(30)] + [f"http://deep.org/a/{x}/{i}/{j}/tail/{'abcd'[i % 4]}" for x in "pqrs" for i in range(3) for j in "uvwx"]
    write(spark, tmp_path, "pages", list(enumerate([x for x in URLS if x is None or "\x00" not in x] + more)), "page_id long, url string")
    got = compare(spark, tmp_path, "op7_url_filter")
    own = got[got["rule"].isna()]
    spam, fine = (own[own["host"] == x] for x in ("spam.net", "fine.net"))
    assert set(spam["path"].str[:4]) == {"/it/", "/pt/"} and len(spam) == 60 and set(spam["verdict"]) == {"block"} and set(spam["template"]) == {"/*/#/offer#.html"}
    assert len(fine) == 60 and set(fine["verdict"]) == {"allow"}
    assert got["template"].str.startswith("/a/*/#/*/tail/*").any()
    assert got["template"].str.contains("*", regex=False).any() and "{hex}" in "".join(got["template"]) and url_filter.sql() == ORACLE_SQL["op7_url_filter"]


def test_repeated_strings(spark, tmp_path):
    write(spark, tmp_path, "documents", list(enumerate([*texts(21, 80), None, ""])), "doc_id long, text string")
    assert compare(spark, tmp_path, "op10_suffix_dedup")["n_removed"].sum() > 0


def test_queries_are_complete():
    assert [x.split("_")[0] for x in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
