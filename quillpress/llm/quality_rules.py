"""Quality rules whose cutoffs are certified on labelled documents, by DataFrame functions only.

Counts are taken from whole texts.  Every rule is a rate that is high for poor text.  On labelled
good documents (the holdout) a cutoff rejects k of the n in a stratum; the exact binomial test
of "it rejects a share of alpha or more" has the p-value P(Binomial(n, alpha) <= k).  For each
rule and stratum cutoffs are tested from the loosest to the tightest, stopping at the first that
fails (fixed-sequence testing, which needs no correction within the sequence), and the level is
divided by the number of rules and strata (Bonferroni).  So with probability 1 - level, no
stratum loses more than a share of `risk` of its good documents, summed over the rules.

A stratum without enough labels certifies nothing and loses only what the base rules reject.

Defined results: a null text counts as empty, a null stratum is a stratum of its own, labels
other than 1 and null labels are not in the holdout, and if an id has several labels the lowest
counts; repeated rows give a row each; extra columns are ignored; an empty table gives an empty
result.  Counts of a text are made within its row, so time and memory follow its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Up to so many strata the cutoffs are broadcast.
STRATA = 10_000


@dataclass(frozen=True)
class Rule:
    """Rejects where value (SQL over the counts) is at or above a cutoff; cutoffs run from loose to tight."""

    name: str
    value: str
    cutoffs: tuple[float, ...]


_GRID = tuple(round(1 - 0.02 * i, 2) for i in range(1, 50))
RULES = (
    Rule("symbols", "n_symbols / greatest(word_chars, 1)", _GRID),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", _GRID),
    Rule("capitals", "n_capitals / greatest(word_chars, 1)", _GRID),
    Rule("few_different_words", "1 - n_different_words / greatest(n_words, 1)", _GRID),
)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, stratum ("=" and its name, empty for null) and the counts that rules are made of, for every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum"), text.alias("text"))
    words = words.withColumn("words", F.filter(F.split("text", SPACE + "+"), lambda w: w != ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    grams = F.when(F.size("words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("words") - WINDOW), lambda i: F.xxhash64(*(F.get("words", i + j) for j in range(WINDOW))))).otherwise(F.array().cast("array<bigint>"))
    made = words.select("id", "stratum", "text", "words", lines.alias("lines"), grams.alias("grams"))
    # windows found twice, in the order of their hashes; only in the texts that have any
    ordered = F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.array_sort(F.transform("grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    made = made.select("*", ordered.alias("ordered"))
    same = lambda x, j: x["h"] == F.get("ordered", j)["h"]
    places = F.transform(F.filter("ordered", lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False))), lambda x: x["i"])
    covered = F.aggregate(
        F.array_sort(places), F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("bigint").alias("n")), lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n")), lambda a: a["n"]
    )
    return made.select(
        "id",
        "stratum",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS + "+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.size(F.array_distinct("words")).cast("long").alias("n_different_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _log_gamma(z: Column) -> Column:
    """Stirling's series at z + 10, brought back by the recurrence; exact to about 1e-12."""
    x = z + 10
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    product = z
    for i in range(1, 10):
        product = product * (z + i)
    return series - F.log(product)


def binomial_tail(n: Column, k: Column, p: float, terms: int = 4096) -> Column:
    """P(Binomial(n, p) <= k) for k below n * p, else 1: the top `terms` terms, and a bound on those below them."""
    n, k = n.cast("double"), k.cast("double")
    top = F.exp(_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p)))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    ratio = lambda j: (k - j) * (1 - p) / ((n - k + j + 1) * p)  # noqa: E731  of the term of k - j - 1 to that of k - j
    summed = F.aggregate(
        F.when(k >= 1, F.sequence(F.lit(0), F.least(k - 1, F.lit(float(terms))).cast("int"))).otherwise(F.array().cast("array<int>")),
        start,
        lambda a, j: F.struct((a["term"] * ratio(j.cast("double"))).alias("term"), (a["total"] + a["term"] * ratio(j.cast("double"))).alias("total")),
        lambda a: a["total"] + F.when(k > terms + 1, a["term"] * ratio(F.lit(float(terms))) / (1 - ratio(F.lit(float(terms))))).otherwise(0.0),
    )
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.least(F.lit(1.0), top * summed))


def certified_cutoffs(counted: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = 0.02, level: float = 0.05, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(stratum, rule, cutoff, rejected, holdout, p_value): the tightest certified cutoff of each rule and stratum."""
    good = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(label_col).alias("label")).where("label = 1").select("id")
    held = counted.where(~base_failed()).join(good, "id")
    value = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.expr(r.value).cast("double").alias("value"), F.array(*(F.lit(c) for c in r.cutoffs)).alias("cutoffs")) for r in rules)))
    held = held.select("stratum", value.alias("x")).select("stratum", "x.rule", "x.cutoffs", F.size(F.filter("x.cutoffs", lambda c: F.col("x.value") < c)).alias("passed"))
    # passed cutoffs are the loose ones: a document that passes j of them is rejected by the rest
    tally = held.groupBy("stratum", "rule", "cutoffs", "passed").agg(F.count("*").alias("n"))
    per = tally.groupBy("stratum", "rule", "cutoffs").agg(F.sum("n").alias("holdout"), F.map_from_entries(F.collect_list(F.struct("passed", "n"))).alias("by"))  # a cutoff's row each at most
    step = per.select("stratum", "rule", "holdout", F.posexplode("cutoffs").alias("j", "cutoff"), "by")
    below = F.aggregate(F.sequence(F.lit(0), F.col("j")), F.lit(0).cast("bigint"), lambda a, i: a + F.coalesce(F.element_at("by", i), F.lit(0)))
    step = step.select("stratum", "rule", "holdout", "j", "cutoff", below.alias("rejected"))
    tests = materialize(step, "quality-tests")
    strata = max(1, tests.agg(F.countDistinct("stratum")).first()[0])
    alpha = risk / len(rules)
    p = binomial_tail(F.col("holdout"), F.col("rejected"), alpha)
    tested = tests.withColumn("p_value", p).withColumn("failed", F.max((F.col("p_value") > level / len(rules) / strata).cast("int")).over(Window.partitionBy("stratum", "rule").orderBy("j")))
    passed = tested.where("failed = 0").groupBy("stratum", "rule").agg(F.max_by(F.struct("cutoff", "rejected", "holdout", "p_value"), "j").alias("best"))
    return passed.select("stratum", "rule", "best.*")


def apply_rules(docs: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, risk: float = 0.02, level: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """id, the counts, base_failed, failed_rules and kept for every row."""
    counted = materialize(counts(docs, id_col, text_col, stratum_col), "quality-counts")
    cutoffs = certified_cutoffs(counted, labels, rules, risk, level, id_col).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    cutoffs = materialize(cutoffs, "quality-cutoffs")
    # a stratum with a cutoff has some 10^3 labels; so many strata that they are no small table have no large share of the rows each
    judged = counted.join(F.broadcast(cutoffs) if cutoffs.count() <= STRATA else cutoffs, "stratum", "left")
    failed = F.filter(F.array(*(F.when(F.expr(r.value) >= F.element_at("cutoffs", F.lit(r.name)), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    return judged.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).drop("cutoffs")


def sql(rules: tuple[Rule, ...] = RULES, risk: float = 0.02, level: float = 0.05) -> str:
    """apply_rules() over documents and labels as SQL for DuckDB."""
    alpha = risk / len(rules)
    values = " UNION ALL ".join(f"SELECT doc_id, stratum, '{r.name}' AS rule, {r.value} AS value, [{', '.join(map(str, r.cutoffs))}] AS cutoffs FROM held" for r in rules)
    failed = " OR ".join(f"coalesce({r.value} >= max(cutoff) FILTER (rule = '{r.name}'), false)" for r in rules)
    columns = "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, n_different_words, stratum"
    return f"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
t AS (SELECT *, list_filter(string_split_regex(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM (SELECT doc_id, i, words[i:i + 4] AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM t))),
c AS (SELECT doc_id, sum(least(5, coalesce(after - i, 5))) AS n FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS after FROM g WHERE n > 1) GROUP BY doc_id),
counted AS (SELECT t.doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
  len(lines) AS n_lines, length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_capitals, len(list_distinct(words)) AS n_different_words FROM t LEFT JOIN c USING (doc_id)),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted),
good AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT * FROM based JOIN good USING (doc_id) WHERE NOT base_failed),
v AS ({values}),
j AS (SELECT stratum, rule, unnest(range(len(cutoffs))) AS j, unnest(cutoffs) AS cutoff, value FROM v),
k AS (SELECT stratum, rule, j, any_value(cutoff) AS cutoff, count(*) AS holdout, count(*) FILTER (value >= cutoff) AS rejected FROM j GROUP BY stratum, rule, j),
p AS (SELECT *, CASE WHEN rejected >= holdout * {alpha} THEN 1.0 ELSE list_sum(list_transform(range(0, rejected + 1), lambda i: exp(lgamma(holdout + 1) - lgamma(i + 1) - lgamma(holdout - i + 1) + i * ln({alpha}) + (holdout - i) * ln(1 - {alpha})))) END AS p_value FROM k),
f AS (SELECT *, max(CAST(p_value > {level} / {len(rules)} / (SELECT greatest(count(DISTINCT stratum), 1) FROM k) AS INT)) OVER (PARTITION BY stratum, rule ORDER BY j) AS failed FROM p),
cut AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM f WHERE failed = 0 GROUP BY stratum, rule),
judged AS (SELECT {columns}, any_value(base_failed) AS base_failed, {failed} AS rejected FROM based LEFT JOIN cut USING (stratum) GROUP BY {columns})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept FROM judged
"""
