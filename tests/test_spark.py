"""Operators on DataFrames: built-in forms against the per-text ones, queries against SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quillpress.config import Config, GrammarLevel, Level
from quillpress.functions import extract as E
from quillpress.functions import text as T
from quillpress.functions.lexicon import replacement_table, word_table, NEGATION
from quillpress.operators import code, dictionary, lines, lists, minify, recall, restructure, scan
from quillpress.plans import suites
from quillpress.plans.oracles import ORACLE_SQL
from quillpress.plans.queries import QUERIES
from quillpress.sources import corpus

TEXTS = [
    "",
    "\n\n",
    "plain",
    "---\na: 1\n---\n# T\n\n\n\nbody <!-- x\ny --> z\n",
    "- a\n- b\n\n  * c, d\nx: y\nt:\n+ done\n! todo\n",
    "// short\n# a long comment that stays because of its length\n x = ( 1 , 2 )\r\n",
    "| a | b |\n|---|---|\n| 1 | |\n> quote\n`code` [l](http://x/y) **b** __c__ ~~d~~\n```py\na\n```\n",
    "@dict:\n  @m1: foo\n  @m10: bar\n@m1 and @m10\n",
    "äöü — é\n",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, x) for i, x in enumerate([*TEXTS, None])], "doc_id long, text string")


@pytest.mark.parametrize(
    ("column", "function"),
    [
        (T.strip_schemes, minify.strip_schemes),
        (T.strip_frontmatter, minify.strip_frontmatter),
        (T.squeeze_lines, code.squeeze_lines),
        (T.strip_edges, code.strip_edges),
        (T.strip_short_comments, code.strip_short_comments),
        (T.minify_spaces, code.minify_spaces),
        (T.level_3, restructure.level_3),
        (E.strip_markdown, recall.strip_markdown),
    ],
)
def test_built_in_equals_python(texts, column, function):
    rows = texts.select("text", column(F.col("text")).alias("out")).collect()
    assert [r["out"] for r in rows] == [None if r["text"] is None else function(r["text"]) for r in rows]


def test_lines_relation(texts):
    rows = lines.explode_lines(texts)
    back = {r["doc_id"]: r["text"] for r in lines.assemble(rows).collect()}
    assert back[4] == TEXTS[4] and 0 not in back
    merged = {r["doc_id"]: r["text"] for r in lines.assemble(lines.merge_items(rows)).collect()}
    assert merged[4] == lists.merge_short_items(TEXTS[4])


def test_dictionary_columns(texts):
    row = texts.where("doc_id = 7").select(T.dict_entries(F.col("text")).alias("m"), T.dict_expand(F.col("text")).alias("x")).first()
    assert row["m"] == {"@m1": "foo", "@m10": "bar"} and row["x"] == "foo and bar" == dictionary.expand(TEXTS[7])


def test_minify(texts, spark):
    config = Config(Level.ULTRA, grammar=GrammarLevel.MEDIUM, dictionary=True)
    rows = minify.minify(texts, config=config).collect()
    assert {r["doc_id"]: r["output"] for r in rows} == {i: minify.minify_text(x, config) for i, x in enumerate(TEXTS)} | {len(TEXTS): None}
    last = next(r for r in rows if r["text"] is None)
    assert last["input_tokens"] is None and last["savings_pct"] is None
    kept = minify.minify(texts, config=config, on_error="keep").collect()
    assert all(r["error"] is None for r in kept) and {r["output"] for r in kept} == {r["output"] for r in rows}
    col = texts.select(minify.minify_col(F.col("text"), Config(Level.LIGHT)).alias("m")).collect()
    assert col[-1]["m"] is None and col[0]["m"]["savings_pct"] == 0.0
    minify.register(spark)
    texts.createOrReplaceTempView("texts")
    assert spark.sql("SELECT minify(text, '2') AS o FROM texts WHERE doc_id = 3").first()["o"] == minify.minify_text(TEXTS[3], Config())


def test_no_python_in_plain_plans(texts):
    plan = texts.select(T.level_3(T.strip_schemes(F.col("text"))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_recall(spark):
    df = spark.createDataFrame([(1, "# Config file\n\n- red apple\n\n[x](https://a.com/b)\n```py\nx = 1\n```\n", "config file: red apple a.com ```py\nx = 1\n```"), (2, "# Gone entirely\n- zz qq\n", "other"), (3, "", "")], "doc_id long, text string, output string")
    rows = {r["doc_id"]: r for r in recall.evaluate(df).collect()}
    assert rows[1]["pass"] and rows[1]["headings"]["recall"] == 1.0 and rows[1]["tables"] is None
    assert not rows[2]["pass"] and rows[2]["lists"]["found"] == 0
    assert rows[3]["pass"] and rows[3]["savings_pct"] is None
    total = recall.summary(recall.evaluate(df)).first()
    assert (total["n_docs"], total["n_pass"], total["all_pass"]) == (3, 2, 0)
    with pytest.raises(AssertionError):
        recall.gate(recall.evaluate(df))


def test_suites(spark, sf):
    from quillpress.plans.queries import corpus as docs

    runs = suites.run_grid(docs(spark, sf)).cache()
    found = suites.report(runs, docs(spark, sf))
    runs.unpersist()
    assert set(found["token_savings"]) == set(suites.grid()) and found["token_savings"]["L0"]["savings_pct"] == 0
    assert found["token_savings"]["L4_gd"]["bytes"] < found["token_savings"]["L0"]["bytes"]
    assert found["structure_preservation"]["L1"]["headings_match"] == found["structure_preservation"]["L1"]["headings_total"]
    d = found["dictionary_reversibility"]
    assert d["fully_reversible"] == d["files_with_dict"] and suites.as_text(found) and suites.as_json(found)


def test_sources(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("# A\n\n**text** that is long enough to be kept in the report\n")
    (tmp_path / "in" / "sub" / "b.md").write_text("short")
    (tmp_path / "in" / "c.txt").write_text("no")
    docs = corpus.read_markdown(spark, str(tmp_path / "in"), str(tmp_path / "missing"))
    assert docs.count() == 2 and corpus.long_enough(docs).count() == 1 and corpus.sample(docs, 1).count() == 1
    assert corpus.read_markdown(spark, str(tmp_path / "missing")).count() == 0
    out = minify.minify(docs)
    corpus.write(out, str(tmp_path / "out"))
    assert corpus.read_table(spark, str(tmp_path / "out"), "output").count() == 2
    corpus.write(out, str(tmp_path / "txt"), "text", "output")
    corpus.write_json_report(out, str(tmp_path / "json"))
    assert corpus.read_text(spark, str(tmp_path / "in" / "a.md")).first()["text"].startswith("# A")
    with pytest.raises(ValueError):
        corpus.read_table(spark, str(tmp_path / "out"), "nothing")
    assert replacement_table(spark).count() == 212 and word_table(spark, NEGATION).count() == 14


def test_stream(spark, tmp_path):
    from quillpress.streaming.stream import minify_stream, read_markdown_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\n**text**\n")
    query = minify_stream(read_markdown_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(60)
    assert [r["output"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [minify.minify_text("# A\n\n**text**\n", Config())]


def test_cli(tmp_path, capsys):
    from quillpress.cli import main

    (tmp_path / "a.md").write_text("# Title\n\nSome **bold** text.\n")
    assert main([str(tmp_path / "a.md"), "-l", "1", "-s"]) == 0
    got = capsys.readouterr()
    assert got.out == "# Title\n\nSome bold text.\n" and got.err.startswith("tokens: 7 →")
    assert main([str(tmp_path / "a.md"), "-o", str(tmp_path / "b.md"), "-g", "-d", "-l", "ultra", "-q", "-s"]) == 0
    assert (tmp_path / "b.md").read_text() and capsys.readouterr().err == ""
    assert main([str(tmp_path / "none.md")]) == 1 and "reading" in capsys.readouterr().err
    assert main([str(tmp_path / "a.md"), "-l", "9"]) == 1


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(str)
    return sorted(map(tuple, frame.values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    expected = duck.sql(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows_of(got) == rows_of(expected)


def test_every_query_has_sql_and_rows(spark, sf):
    assert set(QUERIES) == set(ORACLE_SQL)
    assert all(QUERIES[x](spark, sf).count() for x in ("monotonicity", "dict_seed_counts", "removed_words", "threshold_gate", "flatten_nested_lists"))


def test_results_that_are_written_down():
    """Templates of documents and results against the operators, for numbers and words that the tables do not hold too."""
    from quillpress.config import CodeMode, grid
    from quillpress.operators import dedup, grammar
    from quillpress.plans import expected as X

    for k, s in (("1", "BUILDING"), ("86420", "X"), ("7", "STONEMASONRY")):
        fill = lambda t: t.replace("{k}", k).replace("{s}", s)  # noqa: E731, B023
        for f, a, b in ((grammar.strip_grammar, X.PROSE, X.PROSE_STRIPPED), (dedup.deduplicate, X.REPEATS, X.REPEATS_REPLACED), (dictionary.compress, X.PATHS, X.PATHS_CODED)):
            assert f(fill(a)) == fill(b)
        for i in (0, 1):
            assert minify.minify_many(fill(X.GRID["L0"][i]), list(grid().values())) == [fill(X.GRID[name][i]) for name in grid()]
        assert minify.minify_text(fill(X.NOTE), Config(Level.LIGHT, CodeMode.COMPRESS_WHITESPACE)) == fill(X.NOTE_L1_CODE)
        for language, (a, b) in X.COMMENTED.items():
            assert code.strip_comments(fill(a), language) == fill(b)


def test_reports(tmp_path, capsys):
    """The commands that report on folders."""
    import json

    from quillpress.cli import main
    from quillpress.plans import expected as X

    for i in range(3):
        (tmp_path / f"{i}.md").write_text(X.NOTE.replace("{k}", str(i)).replace("{s}", "QUAY"))
    assert main(["eval", str(tmp_path), "--all", "--level", "4", "--output", str(tmp_path / "r.json"), "--rows", str(tmp_path / "rows"), "--check"]) == 0
    report = json.loads((tmp_path / "r.json").read_text())
    assert report["overall_pass"] and report["summary"]["n_docs"] == 3 and report["thresholds"]["headings"] == 0.85
    assert "n_pass: 3" in capsys.readouterr().out
    assert main(["eval", str(tmp_path), "--sample", "2", "--noise-floor"]) == 0 and "n_docs: 2" in capsys.readouterr().out
    assert main(["bench", str(tmp_path)]) == 0 and "Corpus: 3 files" in capsys.readouterr().out
    assert main(["bench", str(tmp_path), "--json"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["corpus"]["files"] == 3 and found["dictionary_reversibility"]["fully_reversible"] == 3


def test_python_queries_equal_their_functions(spark, sf):
    from quillpress.plans.views import md_orders

    source = {r["doc_id"]: r["text"] for r in md_orders(spark, sf).limit(50).collect()}
    for name, f in (("apply_structure_l3", lambda x: scan.apply_structure(x, Level.STRUCTURED)), ("compress_code_blocks", code.compress_blocks), ("level4", restructure.level_4)):
        got = {r["doc_id"]: r["output"] for r in QUERIES[name](spark, sf).collect()}
        assert all(got[k] == f(v) for k, v in source.items())
