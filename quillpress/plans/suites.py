"""The corpus report: a grid of settings over a corpus, and five suites over its runs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..config import Config, grid
from ..functions import extract
from ..functions import text as T
from ..functions.lexicon import APPROVED
from ..operators import dictionary
from ..operators.lines import words_of
from ..operators.minify import minify_many, text_udf
from ..workers import ship

#: Examples in a report, and parts of a table in which they are looked for.
SHOWN, PARTS = 20, 64


def _outputs(text: Column, configs: list[Config]) -> Column:
    """What each setting makes of a text, as an array; never made twice, as a filter on it is not moved below it."""
    ship()

    @F.arrow_udf("array<string>")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array([None if x is None else minify_many(x, configs) for x in batch.to_pylist()], pa.list_(pa.string()))

    return run.asNondeterministic()(text)


def run_grid(corpus: DataFrame, configs: dict[str, Config] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, config, level, output, bytes, tokens): one pass over the corpus for all settings; store it before several suites read it."""
    named = configs or grid()
    settings = F.array(*(F.struct(F.lit(k).alias("config"), F.lit(int(c.level)).alias("level")) for k, c in named.items()))
    each = corpus.select(F.col(id_col).alias("doc_id"), _outputs(F.col(text_col), list(named.values())).alias("outputs"))
    made = F.coalesce("outputs", F.array_repeat(F.lit(None).cast("string"), len(named)))
    runs = each.select("doc_id", F.inline(F.arrays_zip(settings.alias("x"), made.alias("output")))).select("doc_id", "x.config", "x.level", "output")
    size = F.octet_length("output").cast("long")
    return runs.withColumns({"bytes": size, "tokens": F.floor(size / 4).cast("long")})


def run_beside(corpus: DataFrame, configs: dict[str, Config] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, a column for each setting): the same pass, a row per document, so that a suite compares settings without a join."""
    named = configs or grid()
    each = corpus.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), _outputs(F.col(text_col), list(named.values())).alias("outputs"))
    return each.select("doc_id", "text", *(F.col("outputs")[i].alias(k) for i, k in enumerate(named)))


def beside(runs: DataFrame, *names: str) -> DataFrame:
    """(doc_id, a column for each of the names): runs of run_grid as a row per document; those of run_beside pass through."""
    if "config" not in runs.columns:
        return runs
    return runs.where(F.col("config").isin(*names)).groupBy("doc_id").agg(*(F.max(F.when(F.col("config") == k, F.col("output"))).alias(k) for k in names))


def token_savings(runs: DataFrame) -> DataFrame:
    """(config, tokens, bytes, savings_pct): totals, and percent of L0's bytes saved."""
    total = runs.groupBy("config").agg(F.sum("tokens").alias("tokens"), F.sum("bytes").alias("bytes"))
    whole = F.max(F.when(F.col("config") == "L0", F.col("bytes"))).over(Window.partitionBy(F.lit(1)))  # a row per config
    return total.withColumn("savings_pct", F.when(whole > 0, (1 - F.col("bytes") / whole) * 100).otherwise(0.0))


def monotonicity(runs: DataFrame) -> DataFrame:
    """(doc_id, level, bytes, previous): bare levels with more bytes than the level below."""
    bare = runs.where(F.col("config").rlike("^L[0-4]$"))
    bare = bare.withColumn("previous", F.lag("bytes").over(Window.partitionBy("doc_id").orderBy("level")))
    return bare.where("bytes > previous").select("doc_id", "level", "bytes", "previous")


def structure_preservation(runs: DataFrame, corpus: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per level from 1: headings, list items and table rows of the originals, and how many the outputs hold.

    Runs of run_beside have their texts beside them; those of run_grid meet the corpus by document, never by broadcast, as
    estimates know nothing of the texts' length.
    """
    if "config" in runs.columns:
        before = corpus.select(F.col(id_col).alias("doc_id"), extract.structure(F.col(text_col)).alias("before"))
        after = runs.where(F.col("config").rlike("^L[1-4]$")).select("doc_id", "config", extract.structure(F.col("output")).alias("after"))
        both = after.hint("merge").join(before, "doc_id")
    else:
        levels = [x for x in runs.columns if re.fullmatch("L[1-4]", x)]
        each = runs.withColumn("before", extract.structure(F.col("text"))).select("before", F.inline(F.array(*(F.struct(F.lit(x).alias("config"), F.col(x).alias("output")) for x in levels))))
        both = each.select("config", "before", extract.structure(F.col("output")).alias("after"))
    cols = []
    for field, name in (("headings", "headings"), ("list_items", "lists"), ("table_rows", "tables")):
        a, b = F.col(f"before.{field}"), F.col(f"after.{field}")
        cols += [F.sum(F.size(a)).alias(f"{name}_total"), F.sum(F.size(_held(a, b))).alias(f"{name}_match")]
    return both.groupBy("config").agg(*cols)


def _held(a, b):
    return F.filter(a, lambda x: F.exists(b, lambda y: x == y))


def removed_words(runs: DataFrame, plain: str = "L2", stripped: str = "L2_g") -> DataFrame:
    """(word, n, approved): words that grammar stripping removed from all places of a document, and from how many places."""
    bare = F.filter(words_of(F.col(plain)), lambda w: F.octet_length(w) > 1)
    gone = beside(runs, plain, stripped).select(_missing(bare, words_of(F.col(stripped))).alias("words")).select(F.explode("words").alias("word"))
    return gone.groupBy("word").agg(F.count("*").alias("n")).withColumn("approved", F.lower("word").isin(*sorted(APPROVED)))


def _missing(words: Column, left: Column) -> Column:
    """The words, repeats included, that are not left; null is empty.  Nor is this made twice, for the filter that explode brings."""

    @F.arrow_udf("array<string>")
    def run(words: pa.Array, left: pa.Array) -> pa.Array:
        found = []
        for a, b in zip(words.to_pylist(), left.to_pylist(), strict=True):
            held = set(b or ())
            found.append([w for w in a or () if w not in held])
        return pa.array(found, pa.list_(pa.string()))

    return run.asNondeterministic()(words, left)


def grammar_coverage(runs: DataFrame, plain: str = "L2", stripped: str = "L2_g") -> DataFrame:
    """One row: how many words were removed, by whether that is expected, and the SHOWN unexpected ones that come first by name."""
    gone = _with_shown(removed_words(runs, plain, stripped), "word", ~F.col("approved"))
    capital = F.col("word").rlike(r"^\p{Lu}+$")
    share = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    approved = F.col("approved")
    return gone.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_removed"), share(approved)("in_frequency_table"), share(~approved & capital)("protected_removed"), share(~approved & ~capital)("unexpected"), _first("unexpected_words"))


def _with_shown(df: DataFrame, x: str, wanted: Column) -> DataFrame:
    """df with shown: x of the SHOWN first wanted rows of each of PARTS parts, which hold the SHOWN first of all; one pass serves them and totals."""
    part = Window.partitionBy(wanted, F.pmod(F.xxhash64(x), F.lit(PARTS))).orderBy(x)
    return df.withColumn("shown", F.when(wanted & (F.row_number().over(part) <= SHOWN), F.col(x)))


def _first(name: str) -> Column:
    """The SHOWN least values of shown as an array."""
    return F.slice(F.array_sort(F.collect_list("shown")), 1, SHOWN).alias(name)


def dictionary_reversibility(runs: DataFrame, plain: str = "L2", coded: str = "L2_d") -> DataFrame:
    """One row: documents with a dictionary, those whose expansion gives the plain output, and the SHOWN first ids of others."""
    expanded = text_udf(lambda x: dictionary.expand(x))(F.col(coded))
    has = (F.size(T.dict_entries(F.col(coded))) > 0) & F.col(plain).isNotNull()
    both = beside(runs, plain, coded).select("doc_id", F.coalesce(has, F.lit(False)).alias("has"), (T.trim(expanded) == T.trim(F.col(plain))).alias("same"))
    total = _with_shown(both, "doc_id", F.col("has") & ~F.coalesce("same", F.lit(True)))
    return total.agg(F.count_if("has").alias("files_with_dict"), F.count_if(F.col("has") & F.col("same")).alias("fully_reversible"), _first("issues"))


def report(runs: DataFrame, corpus: DataFrame) -> dict:
    """All suites as plain data, of stored runs: a row per setting, level or suite, the count of violations and the SHOWN first."""
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    return {
        "token_savings": {r.pop("config"): r for r in rows(token_savings(runs).orderBy("config"))},
        "monotonicity_violations": monotonicity(runs).count(),
        "first_violations": rows(monotonicity(runs).orderBy("doc_id", "level").limit(SHOWN)),
        "structure_preservation": {r.pop("config"): r for r in rows(structure_preservation(runs, corpus).orderBy("config"))},
        "grammar_coverage": rows(grammar_coverage(runs))[0],
        "dictionary_reversibility": rows(dictionary_reversibility(runs))[0],
    }


def as_text(found: dict) -> str:
    """The report for people."""
    out = ["Token savings"]
    out += [f"  {k:<6} {v['tokens']:>12} tokens {v['bytes']:>14} bytes {v['savings_pct']:6.1f} %" for k, v in sorted(found["token_savings"].items())]
    out.append(f"Monotonicity: {found['monotonicity_violations']} violations")
    out += [f"  {v['doc_id']}: level {v['level']} ({v['bytes']}) > {v['previous']}" for v in found["first_violations"]]
    out.append("Structure")
    for k, v in sorted(found["structure_preservation"].items()):
        share = lambda x, v=v: 100.0 if not v[f"{x}_total"] else 100.0 * v[f"{x}_match"] / v[f"{x}_total"]
        out.append(f"  {k}: headings {share('headings'):.1f} %, lists {share('lists'):.1f} %, tables {share('tables'):.1f} %")
    g, d = found["grammar_coverage"], found["dictionary_reversibility"]
    out.append(f"Grammar: {g['total_removed']} removed, {g['in_frequency_table']} expected, {g['protected_removed']} capitals, {g['unexpected']} unexpected")
    out += [f"  {w}" for w in g["unexpected_words"]]
    out.append(f"Dictionary: {d['fully_reversible']} of {d['files_with_dict']} reversible")
    return "\n".join(out) + "\n"


def as_json(found: dict) -> str:
    return json.dumps(found, indent=2, default=str)
