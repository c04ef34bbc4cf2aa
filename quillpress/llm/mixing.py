"""Sampling a mixture whose source, language and topic shares meet targets, by DataFrame functions only.

Tokens are summed over (source, language, topic) cells.  Iterative proportional fitting rakes the
cells' weights: each round scales them so that the sources' sums meet their targets, then the
languages', then the topics', and the rounds approach the weights that meet all three and
differ least from the data.  No cell can give more than its tokens: where its weight would ask for
more it is held at them, and scaling solves for the factor by which the others of its category
make up for it.  A category whose target is above its tokens is taken whole, and the rest of its
target goes to the others of its dimension.  Rounds end when no sum is off its target by more than
TOLERANCE, or after ROUNDS; `residual` is the largest error that is left.

A cell's documents are then sampled with one probability, the cell's share of the token budget
over its tokens; a document's draw is a hash of its id, so a sample is the same at every run and
grows with the budget.  marginals() shows what is reached.

A value without a target, or null, belongs to one rest category; so the cells are at most
(sources + 1) x (languages + 1) x (topics + 1) and their table is small enough to broadcast at
any size of the corpus.  The rest's target is its share in the data.

Defined results: null texts have no tokens; targets of categories without tokens are dropped
and the others scaled to 1 (if none is left above 0, the data's shares hold); where the targets
contradict each other the last raked, the topics, hold and the residual is not small; cells without tokens, of empty texts only, are sampled at the budget's share; repeated
rows share an id and a draw; extra columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, once

REST = "~"
ROUNDS, TOLERANCE = 200, 1e-6
#: Targets of the registered query.
SOURCES = {f"src{i}": 0.05 for i in range(20)}
LANGS = {"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15}
TOPICS = {"prose": 0.9, "table": 0.06, "symbols": 0.02, "shouting": 0.02}
BUDGET = 0.5
SEED = 11


def form_topic(text_col: str = "text") -> Column:
    """A topic by a text's form, where no topic column exists."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.when(text.contains(" | "), "table").when(text.contains("!! "), "shouting").when(text.rlike(r"[#*$%&]{3}"), "symbols").otherwise("prose")


def tokens(text_col: str = "text") -> Column:
    """Whole quarters of the UTF-8 length."""
    return F.floor(F.coalesce(F.octet_length(F.col(text_col).cast("string")), F.lit(0)) / 4).cast("long")


def draw(id_col: str, seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _category(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin(*targets), value).otherwise(REST) if targets else F.lit(REST)


def rake(cells: DataFrame, targets: dict[str, dict[str, float]], rounds: int = ROUNDS, budget: float | None = None, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (one column per dimension, tokens) with weight: shares that sum to 1 and meet the targets; and residual.

    With a budget (a share of all tokens) no cell's weight is above its tokens' share of the budget.
    """
    for dim, wanted in targets.items():
        if wanted and (min(wanted.values()) < 0 or not sum(wanted.values())):
            raise ValueError(f"targets of {dim} must not be negative, nor all 0")
    if budget is not None and not 0 < budget <= 1:
        raise ValueError("the budget must lie above 0 and not above 1")
    keys = list(targets)
    everything = Window.partitionBy(F.lit(1))  # of the few cells, which are one partition, so that no window shuffles
    now = cells.where("tokens > 0").coalesce(1).withColumn("weight", F.col("tokens") / F.sum("tokens").over(everything))
    for dim, wanted in targets.items():
        share = F.sum("weight").over(Window.partitionBy(dim))
        aim = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv)), F.col(dim)), share) if wanted else share
        now = now.withColumn(f"{dim}_aim", aim)
        # each category once: its aim over its count of cells
        whole = F.sum(F.col(f"{dim}_aim") / F.col("n")).over(everything)
        now = now.withColumn("n", F.count("*").over(Window.partitionBy(dim))).withColumn(f"{dim}_aim", F.when(whole > 0, F.col(f"{dim}_aim") / whole).otherwise(share)).drop("n")
    now = now.withColumn("cap", F.lit(float("inf")) if budget is None else F.col("weight") / F.lit(float(budget)))
    aimed = now = materialize(now, "mixing-cells")  # read once for each dimension; unstored, its plan would double with each
    for dim in targets:  # an aim above the category's tokens goes to the others of its dimension
        room = aimed.groupBy(dim).agg(F.first(f"{dim}_aim").alias("aim"), F.sum("cap").alias("room"))
        room = room.withColumn("f", _factor(room, [F.lit(1)], "aim", "room", F.lit(1.0), [dim])).withColumn("f", F.max("f").over(everything))
        now = now.drop(f"{dim}_aim").join(room.select(dim, F.least("room", F.col("aim") * F.coalesce("f", F.lit(1.0))).alias(f"{dim}_aim")), dim)
    now = now.withColumn("residual", F.lit(float("inf")))
    if not keys:
        return now.withColumn("residual", F.lit(0.0)).withColumn("weight", F.least("weight", "cap")).drop("cap")
    # the few cells stand in one row, in which all rounds are one expression: no plan grows with them, nor does the count of jobs
    rows = now.coalesce(1).agg(F.array_sort(F.collect_list(F.struct(*keys, *(c for c in now.columns if c not in keys)))).alias("cells"))
    done = rows.select("cells", _rounds(F.col("cells"), keys, rounds, tolerance).alias("done"))
    done = done.select(F.explode(F.zip_with("cells", F.col("done.weights"), lambda c, w: F.struct(c.alias("c"), w.alias("w")))).alias("x"), F.col("done.residual").alias("r"))
    out = materialize(done.select(*({"weight": F.col("x.w"), "residual": F.col("r")}.get(c, F.col(f"x.c.{c}")).alias(c) for c in now.columns)), "mixing-cells")
    return out.withColumn("weight", F.least("weight", "cap")).drop("cap", *(f"{dim}_aim" for dim in targets))


def _factor(now: DataFrame, by: list, value: str, cap: str, aim: Column, keys: list[str]) -> Column:
    """The factor f by which sum(least(cap, f * value)) over by is aim: the largest root of its linear pieces."""
    ordered = Window.partitionBy(*by).orderBy(F.when(F.col(value) > 0, F.col(cap) / F.col(value)).asc_nulls_last(), *keys)
    full = F.coalesce(F.sum(cap).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum(value).over(ordered.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return F.when(left > 0, F.greatest(F.lit(0.0), (aim - full) / left))


def _factor_of(members: Column, aim: Column, weights: Column, caps: Column) -> Column:
    """As _factor, of the cells of one category: members are their places in weights and caps."""
    ratio = lambda i: F.when(F.get(weights, i) > 0, F.get(caps, i) / F.get(weights, i))
    ordered = F.array_sort(F.transform(members, lambda i: F.struct(ratio(i).isNull().alias("last"), ratio(i).alias("ratio"), i.alias("i"))))

    def largest(pieces: Column) -> Column:
        left = F.aggregate(F.reverse(pieces), F.expr("cast(array() as array<double>)"), lambda a, p: F.concat(F.array(F.coalesce(F.get(a, 0), F.lit(0.0)) + F.get(weights, p["i"])), a))
        both = F.zip_with(pieces, left, lambda p, x: F.struct(F.get(caps, p["i"]).alias("cap"), x.alias("left")))
        start = F.struct(F.lit(0.0).alias("full"), F.lit(None).cast("double").alias("f"))
        root = lambda a, x: F.when(x["left"] > 0, F.greatest(F.lit(0.0), (aim - a["full"]) / x["left"]))
        return F.aggregate(both, start, lambda a, x: F.struct((a["full"] + x["cap"]).alias("full"), F.greatest(a["f"], root(a, x)).alias("f")), lambda a: F.coalesce(a["f"], F.lit(0.0)))

    return once(ordered, largest)


def _rounds(cells: Column, dims: list[str], rounds: int, tolerance: float) -> Column:
    """(weights, residual) of an array of cells after the rounds; weights that are good enough stay.

    A round is one pass over the dimensions; the residual is the largest error after it.
    """

    def dimension(dim: str) -> Column:
        values = F.array_distinct(F.transform(cells, lambda c: c[dim]))
        members = lambda v: F.filter(F.transform(cells, lambda c, i: i), lambda i: F.get(cells, i)[dim] == v)
        category = lambda v: once(members(v), lambda m: F.struct(F.get(cells, F.get(m, 0))[f"{dim}_aim"].alias("aim"), m.alias("members")))
        return once(values, lambda x: F.struct(F.transform(x, category).alias("categories"), F.transform(cells, lambda c: F.array_position(x, c[dim]).cast("int") - 1).alias("of")))

    def run(fixed: Column) -> Column:
        parts, caps = fixed["dims"], fixed["caps"]

        def scaled(weights: Column, d: Column) -> Column:
            factors = F.transform(d["categories"], lambda c: _factor_of(c["members"], c["aim"], weights, caps))
            return once(factors, lambda f: F.transform(weights, lambda w, i: w * F.get(f, F.get(d["of"], i))))

        def off(weights: Column) -> Column:
            reached = lambda c: F.aggregate(c["members"], F.lit(0.0), lambda a, i: a + F.least(F.get(weights, i), F.get(caps, i)))
            return F.array_max(F.flatten(F.transform(parts, lambda d: F.transform(d["categories"], lambda c: F.abs(reached(c) - c["aim"])))))

        def one(state: Column, _: Column) -> Column:
            more = once(F.aggregate(parts, state["weights"], scaled), lambda w: F.struct(w.alias("weights"), off(w).alias("residual")))
            return F.when(state["residual"] > tolerance, more).otherwise(state)

        start = F.struct(F.transform(cells, lambda c: c["weight"]).alias("weights"), F.lit(float("inf")).alias("residual"))
        return F.aggregate(F.array_repeat(F.lit(0), rounds), start, one)

    return once(F.struct(F.array(*map(dimension, dims)).alias("dims"), F.transform(cells, lambda c: c["cap"]).alias("caps")), run)


def mix(docs: DataFrame, sources: dict[str, float] = SOURCES, langs: dict[str, float] = LANGS, topics: dict[str, float] = TOPICS, budget: float = BUDGET, topic: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = SEED, rounds: int = ROUNDS) -> DataFrame:
    """All rows and columns of docs with __source, __lang, __topic, __tokens, __weight (of the cell), __probability and __sampled."""
    named = docs.withColumns(
        {
            "__source": _category(F.col(source_col), sources),
            "__lang": _category(F.col(lang_col), langs),
            "__topic": _category(form_topic(text_col) if topic is None else topic, topics),
            "__tokens": tokens(text_col),
        }
    )
    cells = materialize(named.groupBy("__source", "__lang", "__topic").agg(F.sum("__tokens").alias("tokens")), "mixing-cells")
    raked = rake(cells, {"__source": sources, "__lang": langs, "__topic": topics}, rounds, budget)
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))
    odds = raked.withColumn("__probability", F.least(F.lit(1.0), F.lit(budget) * total * F.col("weight") / F.col("tokens"))).select("__source", "__lang", "__topic", F.col("weight").alias("__weight"), "__probability")
    out = named.join(F.broadcast(odds), ["__source", "__lang", "__topic"], "left")
    out = out.withColumns({"__weight": F.coalesce("__weight", F.lit(0.0)), "__probability": F.coalesce("__probability", F.lit(float(budget)))})
    return out.withColumn("__sampled", draw(id_col, seed) < F.col("__probability"))


def marginals(mixed: DataFrame, sources: dict[str, float] = SOURCES, langs: dict[str, float] = LANGS, topics: dict[str, float] = TOPICS) -> DataFrame:
    """dimension, category, target (null for the rest) and expected and sampled share of the tokens of a mix()."""
    out = None
    cells = mixed.groupBy("__source", "__lang", "__topic").agg(F.sum(F.col("__tokens") * F.col("__probability")).alias("e"), F.sum(F.when(F.col("__sampled"), F.col("__tokens")).otherwise(0)).alias("s"))
    for dim, wanted in (("source", sources), ("lang", langs), ("topic", topics)):
        target = F.element_at(F.create_map(*(F.lit(x) for kv in wanted.items() for x in kv)), F.col("category")) if wanted else F.lit(None).cast("double")
        sums = cells.groupBy(F.col(f"__{dim}").alias("category")).agg(F.sum("e").alias("e"), F.sum("s").alias("s"))
        every = Window.partitionBy(F.lit(1))
        one = sums.select(F.lit(dim).alias("dimension"), "category", target.alias("target"), (F.col("e") / F.sum("e").over(every)).alias("expected"), (F.col("s") / F.sum("s").over(every)).alias("sampled"))
        out = one if out is None else out.unionByName(one)
    return out


def _raked_sql(dim: str, aim: str, rows: str) -> str:
    """Rows with weights scaled so that the sums by dim of what cells can give are the aims."""
    order = f"PARTITION BY {dim} ORDER BY CASE WHEN weight > 0 THEN cap / weight END NULLS LAST, source, lang, topic"
    ends = f"SELECT *, coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM ({rows})"
    factors = f"SELECT *, CASE WHEN free > 0 THEN greatest(0, ({aim} - filled) / free) END AS f FROM ({ends})"
    return f"SELECT i, source, lang, topic, tokens, weight * coalesce(max(f) OVER (PARTITION BY {dim}), 0) AS weight, cap, sa, la, ta FROM ({factors})"


def _room_sql(dim: str, aim: str) -> str:
    """A table of dim with the aims that its categories' tokens allow."""
    order = f"ORDER BY CASE WHEN aim > 0 THEN room / aim END NULLS LAST, {dim}"
    ends = f"SELECT *, coalesce(sum(room) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled, sum(aim) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM (SELECT {dim}, any_value({aim}) AS aim, sum(cap) AS room FROM scaled GROUP BY {dim})"
    return f"{dim}_room AS (SELECT {dim}, least(room, aim * coalesce(max(CASE WHEN free > 0 THEN greatest(0, (1 - filled) / free) END) OVER (), 1)) AS aim FROM ({ends}))"


_ROOM_SQL = ", ".join(_room_sql(*x) for x in (("source", "sa"), ("lang", "la"), ("topic", "ta")))
_RAKED_SQL = _raked_sql("topic", "ta", _raked_sql("lang", "la", _raked_sql("source", "sa", f"SELECT * FROM rounds WHERE i < {ROUNDS} AND off > {TOLERANCE}")))
ORACLE = f"""
WITH RECURSIVE named AS (
  SELECT doc_id,
    CASE WHEN source IN ({", ".join(f"'{x}'" for x in SOURCES)}) THEN source ELSE '{REST}' END AS source,
    CASE WHEN lang IN ({", ".join(f"'{x}'" for x in LANGS)}) THEN lang ELSE '{REST}' END AS lang,
    CASE WHEN contains(coalesce(text, ''), ' | ') THEN 'table' WHEN contains(coalesce(text, ''), '!! ') THEN 'shouting'
         WHEN regexp_matches(coalesce(text, ''), '[#*$%&]{{3}}') THEN 'symbols' ELSE 'prose' END AS topic,
    CAST(coalesce(strlen(text), 0) // 4 AS BIGINT) AS n_tokens
  FROM documents
), cells AS (
  SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS tokens FROM named GROUP BY ALL HAVING sum(n_tokens) > 0
), start AS (
  SELECT *, tokens / sum(tokens) OVER () AS weight FROM cells
), aimed AS (
  SELECT *, weight / {BUDGET} AS cap,
    CASE {" ".join(f"WHEN source = '{k}' THEN {v}" for k, v in SOURCES.items())} ELSE sum(weight) OVER (PARTITION BY source) END AS sa,
    CASE {" ".join(f"WHEN lang = '{k}' THEN {v}" for k, v in LANGS.items())} ELSE sum(weight) OVER (PARTITION BY lang) END AS la,
    CASE {" ".join(f"WHEN topic = '{k}' THEN {v}" for k, v in TOPICS.items())} ELSE sum(weight) OVER (PARTITION BY topic) END AS ta,
    count(*) OVER (PARTITION BY source) AS sn, count(*) OVER (PARTITION BY lang) AS ln, count(*) OVER (PARTITION BY topic) AS tn
  FROM start
), scaled AS (
  SELECT source, lang, topic, tokens, weight, cap, sa / sum(sa / sn) OVER () AS sa, la / sum(la / ln) OVER () AS la, ta / sum(ta / tn) OVER () AS ta FROM aimed
), {_ROOM_SQL}, ready AS (
  SELECT c.* EXCLUDE (sa, la, ta), source_room.aim AS sa, lang_room.aim AS la, topic_room.aim AS ta FROM scaled c JOIN source_room USING (source) JOIN lang_room USING (lang) JOIN topic_room USING (topic)
), rounds AS (
  SELECT 0 AS i, *, CAST('inf' AS DOUBLE) AS off FROM ready
  UNION ALL
  SELECT i + 1, source, lang, topic, tokens, weight, cap, sa, la, ta, max(greatest(abs(ms - sa), abs(ml - la), abs(mt - ta))) OVER () AS off FROM (
    SELECT *, sum(least(weight, cap)) OVER (PARTITION BY source) AS ms, sum(least(weight, cap)) OVER (PARTITION BY lang) AS ml, sum(least(weight, cap)) OVER (PARTITION BY topic) AS mt FROM ({_RAKED_SQL}))
), odds AS (
  SELECT source, lang, topic, least(weight, cap) AS weight, least(1.0, {BUDGET} * sum(tokens) OVER () * least(weight, cap) / tokens) AS probability FROM rounds WHERE i = (SELECT max(i) FROM rounds)
), placed AS (
  SELECT n.*, coalesce(o.weight, 0) AS weight, coalesce(o.probability, {BUDGET}) AS probability,
    CAST('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) / 281474976710656.0 AS u
  FROM named n LEFT JOIN odds o USING (source, lang, topic)
)
SELECT doc_id, source, lang, topic, n_tokens, round(weight, 6) AS weight, round(probability, 6) AS probability, u < probability AS sampled FROM placed
"""
