"""Secrets by fixed patterns and by a battery of randomness tests, by DataFrame functions only.

Base patterns find keys by their form.  The battery finds others: runs of 20 and more key
characters with letters and digits are candidates; each one's encoding is inferred (16, 32, 62 or
64 symbols) and its symbols' numbers are tested against "independent and uniform":

* chi-squared uniformity over the alphabet, standardised by its exact mean and variance for the
  candidate's length, so that short strings over a large alphabet are not misjudged,
* runs above and below the middle of the alphabet (Wald and Wolfowitz),
* serial correlation of neighbours.

The sum of the three squared scores has about a chi-squared distribution with 3 degrees of
freedom for a random key, which gives one p-value.  Words, paths and numbers fail at least one.
How many such strings pass by chance depends on length, so the cutoff is set for each encoding
and class of lengths over all candidates of the corpus: random keys have uniform p-values, so
twice the count above 1/2 estimates them (Storey), what lies above a cutoff in excess of their
share is falsely discovered, and the least cutoff is taken whose share of these, less one standard
error of that estimate, is at most `rate`.  A class where no cutoff holds adds nothing.

Spans are in code points, end exclusive.  Positions are running sums over the pieces between
matches, made by doubling steps, and spans meet by binary search, so a text of n characters and m
matches takes n + m log m steps.  Defined results: a null text counts as empty and has
no span; repeated rows give a row each; extra columns are ignored; an empty table gives an empty
result; a candidate that touches a base span is not added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, once

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "random16", "random32", "random62", "random64")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {
    "random16": "0123456789abcdef",
    "random32": _LETTERS + "234567",
    "random62": _LETTERS + _LETTERS.lower() + "0123456789",
    "random64": _LETTERS + _LETTERS.lower() + "0123456789+/",
}
#: Classes of lengths start here.
LENGTHS = (20, 28, 36, 48, 64, 96)
BINS = 50

_SPAN = "array<struct<start:int,kind:int,end:int>>"


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _running(values: Column, join) -> Column:
    """join of the values up to each place: in each round every place joins the one 1, 2, 4, ... before it."""
    rounds = lambda v: F.when(F.size(v) > 1, F.sequence(F.lit(0), F.ceil(F.log2(F.size(v))).cast("int"))).otherwise(_empty("array<int>"))
    step = lambda acc, r: F.transform(acc, lambda x, i: F.coalesce(join(x, F.get(acc, i - F.call_function("shiftleft", F.lit(1), r))), x))
    return once(values, lambda v: F.aggregate(rounds(v), v, step))


def _below(ordered: Column, bound: Column) -> Column:
    """How many of the ordered values are below the bound, by binary search."""
    step = lambda at, r: F.when(F.get(ordered, at + F.call_function("shiftleft", F.lit(1), r) - 1) < bound, at + F.call_function("shiftleft", F.lit(1), r)).otherwise(at)
    return F.aggregate(F.sequence(F.lit(29), F.lit(0)), F.lit(0), step)


def places(text: Column, pattern: str, group: int = 0) -> Column:
    """array of (start, end, length of the group, match) of the leftmost non-overlapping matches, in code points."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    pairs = F.zip_with(F.zip_with(F.slice(gaps, 1, F.size(gaps) - 1), found, lambda g, m: F.struct((F.length(g) + F.length(m)).alias("both"), m.alias("value"))), inner, lambda a, b: F.struct(a["both"].alias("both"), a["value"].alias("value"), F.length(b).alias("inner")))
    placed = lambda x: F.zip_with(x, _running(F.transform(x, lambda y: y["both"]), lambda p, q: p + q), lambda y, end: F.struct((end - F.length(y["value"])).alias("start"), end.alias("end"), y["inner"].alias("inner"), y["value"].alias("value")))
    return F.when(text.rlike(pattern), once(pairs, placed)).otherwise(_empty("array<struct<start:int,end:int,inner:int,value:string>>"))


def _as_spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))


def _erfc(x: Column) -> Column:
    """For x >= 0; a published rational approximation, off by less than 1.5e-7."""
    poly = lambda t: t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return once(1 / (1 + 0.3275911 * x), poly) * F.exp(-x * x)


def randomness(value: Column, alphabet: str) -> Column:
    """p-value of "independent and uniform over the alphabet" for a string of its characters.

    What is used more than once is bound once, else the tree grows with the product of the uses, and the driver's memory with it.
    """
    size = len(alphabet)
    mean, variance = (size - 1) / 2, (size * size - 1) / 12

    def tests(chars: Column) -> Column:
        codes = F.transform(chars, lambda c: (F.instr(F.lit(alphabet), c) - 1).cast("double"))
        return once(F.struct(F.size(chars).cast("double").alias("n"), codes.alias("v")), counted)

    def counted(x: Column) -> Column:
        n, v = x["n"], x["v"]
        squares = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter(v, lambda x: x == c)).cast("double"), F.lit(2.0)))
        chi = (size / n * squares - n - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n)
        high = F.size(F.filter(v, lambda x: x > mean)).cast("double")
        runs = 1.0 + F.size(F.filter(F.sequence(F.lit(1), F.size(v) - 1), lambda i: (F.get(v, i) > mean) != (F.get(v, i - 1) > mean)))
        lag = F.aggregate(F.sequence(F.lit(1), F.size(v) - 1), F.lit(0.0), lambda a, i: a + (F.get(v, i) - mean) * (F.get(v, i - 1) - mean))
        serial = lag / (variance * F.sqrt(n - 1))
        return once(F.struct(n.alias("n"), chi.alias("chi"), high.alias("high"), runs.alias("runs"), serial.alias("serial")), lambda y: once(scores(y), lambda z: once(F.least(z["chi"] * z["chi"] + z["run"] * z["run"] + z["serial"] * z["serial"], F.lit(1000.0)), tail)))

    def scores(y: Column) -> Column:
        n, high = y["n"], y["high"]
        low = n - high
        spread = 2 * high * low * (2 * high * low - n) / (n * n * (n - 1))
        run_score = once(spread, lambda s: F.when((high > 0) & (low > 0) & (s > 0), (y["runs"] - 1 - 2 * high * low / n) / F.sqrt(s)).otherwise(F.lit(99.0)))
        return F.struct(y["chi"].alias("chi"), run_score.alias("run"), y["serial"].alias("serial"))

    def tail(q: Column) -> Column:
        return _erfc(F.sqrt(q / 2)) + F.sqrt(2 * q / math.pi) * F.exp(-q / 2)

    return once(F.filter(F.split(value, ""), lambda c: c != ""), tests)


def _judged(found: Column, base: Column) -> Column:
    """Candidates with kind, class of lengths and p-value; those that touch a base span or lack letters or digits are left out."""
    ordered = lambda name: F.array_sort(F.transform(base, lambda b: b[name]))
    # spans that start before a candidate's end, but for those that end by its start, overlap it
    free = once(F.struct(ordered("start").alias("starts"), ordered("end").alias("ends")), lambda b: F.filter(found, lambda x: _below(b["starts"], x["end"]) == _below(b["ends"], x["start"] + 1)))
    named = F.filter(free, lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))

    def one(x: Column) -> Column:
        v, n = x["value"], x["end"] - x["start"]
        hexadecimal, base32, base62 = v.rlike("^([0-9a-f]+|[0-9A-F]+)$"), v.rlike("^[A-Z2-7]+$"), v.rlike("^[A-Za-z0-9]+$")
        kind = F.when(hexadecimal, KINDS.index("random16")).when(base32, KINDS.index("random32")).when(base62, KINDS.index("random62")).otherwise(KINDS.index("random64"))
        p = (
            F.when(hexadecimal, randomness(F.lower(v), ALPHABETS["random16"]))
            .when(base32, randomness(v, ALPHABETS["random32"]))
            .when(base62, randomness(v, ALPHABETS["random62"]))
            .otherwise(randomness(F.translate(v, "-_", "+/"), ALPHABETS["random64"]))
        )
        size = F.lit(0)
        for i, least in enumerate(LENGTHS[1:], 1):
            size = F.when(n >= least, F.lit(i)).otherwise(size)
        return F.struct(x["start"].alias("start"), kind.alias("kind"), x["end"].alias("end"), size.alias("size"), F.coalesce(p, F.lit(0.0)).alias("p"))

    return F.transform(named, one)


def spans_and_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, base (spans of the fixed patterns) and candidates (with p-values) for every row; nothing of the text."""
    return _scanned(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), "text").select("id", F.col("__base").alias("base"), F.col("__candidates").alias("candidates"))


def _scanned(rows: DataFrame, text_col: str) -> DataFrame:
    """rows with __base and __candidates."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = rows.withColumns(
        {
            "__assign": F.filter(places(text, ASSIGN, 2), lambda x: x["inner"] >= 12),
            "__access": F.filter(places(text, ACCESS), lambda x: x["inner"] >= 18),
            "__hex": places(text, HEX),
            "__found": places(text, CANDIDATE),
        }
    )
    out = out.withColumn("__base", F.concat(*(_as_spans(F.col(f"__{k}"), k) for k in KINDS[:3])))
    none = _empty("array<struct<start:int,kind:int,end:int,size:int,p:double>>")
    return out.withColumn("__candidates", F.when(F.size("__found") > 0, _judged(F.col("__found"), F.col("__base"))).otherwise(none)).drop("__assign", "__access", "__hex", "__found")


def cutoffs(scanned: DataFrame, rate: float = 0.1) -> DataFrame:
    """(kind, size, cutoff): the least p-value at which at most `rate` of what is added is falsely discovered, within a standard error."""
    each = scanned.select(F.explode("candidates").alias("c")).select("c.kind", "c.size", F.least(F.floor(F.col("c.p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"))
    tally = each.groupBy("kind", "size", "bin").agg(F.count("*").alias("n"))
    per = tally.groupBy("kind", "size").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by"))  # BINS entries at most
    above = lambda b: F.aggregate(F.sequence(b, F.lit(BINS - 1)), F.lit(0).cast("bigint"), lambda a, i: a + F.coalesce(F.element_at("by", i), F.lit(0)))
    half = above(F.lit(BINS // 2))
    # of random keys as many as `half` times 2 (1 - b / BINS) are above b
    error = lambda b: F.sqrt(half * (1 - 2 * b / BINS) * 2 * (1 - b / BINS))
    holds = F.filter(F.sequence(F.lit(1), F.lit(BINS // 2)), lambda b: (above(b) > 0) & (above(b) - 2 * half * (1 - b / BINS) <= rate * above(b) + error(b)))
    return per.select("kind", "size", (F.get(holds, 0) / BINS).alias("cutoff")).where("cutoff is not null")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.1) -> DataFrame:
    """id, base and spans (base and added) for every row; spans sorted by start, then kind."""
    scanned = materialize(spans_and_candidates(docs, id_col, text_col), "secret-spans")
    limits = cutoffs(scanned, rate).collect()  # kinds x classes of lengths: 18 rows at most
    return scanned.select("id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", accepted(F.col("candidates"), limits))).alias("spans"))


def accepted(candidates: Column, limits: list) -> Column:
    ok = lambda c: sum((((c["kind"] == r["kind"]) & (c["size"] == r["size"]) & (c["p"] >= r["cutoff"])).cast("int") for r in limits), F.lit(0)) > 0
    return F.transform(F.filter(candidates, ok), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def masked(docs: DataFrame, rate: float = 0.1, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with every span in the text replaced by a mark; spans that overlap are one.  Every row and column stays, a null text too.

    The texts are scanned once and stored with their spans, as cutoffs come from all of them.
    """
    scanned = materialize(_scanned(docs, text_col), "secret-texts")
    limits = cutoffs(scanned.select(F.col("__candidates").alias("candidates")), rate).collect()  # kinds x classes of lengths: 24 rows at most
    spans = F.array_sort(F.concat("__base", F.when(F.size("__candidates") > 0, accepted(F.col("__candidates"), limits)).otherwise(_empty(_SPAN))))
    text, block = F.coalesce(F.col(text_col).cast("string"), F.lit("")), 2048

    def clean(x: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:  # the text from a to b, of the blocks that hold it
            first = (a / block).cast("int")
            held = F.slice(x["blocks"], first + 1, ((b - 1) / block).cast("int") - first + 1)
            return F.substring(F.array_join(held, ""), a % block + 1, b - a)

        before = lambda i: F.coalesce(F.get(x["reach"], i - 1), F.lit(0))
        heads = F.filter(F.transform(x["spans"], lambda y, i: F.struct(y["start"].alias("start"), before(i).alias("before"))), lambda y: y["start"] >= y["before"])
        pieces = F.transform(heads, lambda y: F.concat(cut(y["before"], y["start"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), cut(before(F.size(x["spans"])), x["length"]))

    parts = F.struct(
        F.col("__spans").alias("spans"),
        _running(F.transform("__spans", lambda y: y["end"]), F.greatest).alias("reach"),
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{block}}}"), F.lit(0)).alias("blocks"),
        F.length(text).alias("length"),
    )
    out = scanned.withColumn("__spans", spans)
    return out.withColumn(text_col, F.when(F.size("__spans") > 0, once(parts, clean)).otherwise(F.col(text_col))).select(*docs.columns)


def sql(rate: float = 0.1) -> str:
    """The registered query over documents as SQL for DuckDB."""
    quoted = lambda x: x.replace("'", "''")

    def found(pattern: str, group: int = 0) -> str:
        return f"""SELECT doc_id, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - size AS s, sum(gap + size) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS e, inside, found
  FROM (SELECT doc_id, unnest(range(len(m))) AS k, length(unnest(gaps[1:len(m)])) AS gap, unnest(m) AS found, length(unnest(m)) AS size, length(unnest(g)) AS inside
    FROM (SELECT doc_id, string_split_regex(text, '{quoted(pattern)}') AS gaps, regexp_extract_all(text, '{quoted(pattern)}') AS m, regexp_extract_all(text, '{quoted(pattern)}', {group}) AS g FROM d WHERE regexp_matches(text, '{quoted(pattern)}')))"""

    size = " + ".join(f"CAST(e - s >= {x} AS INT)" for x in LENGTHS[1:])
    kinds = [KINDS.index(f"random{x}") for x in (16, 32, 62, 64)]
    count = lambda k: f"count(*) FILTER (kind = {k})"
    listing = "string_agg(names[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind, e)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS (
  SELECT doc_id, s, e, 0 AS kind FROM ({found(ASSIGN, 2)}) WHERE inside >= 12
  UNION ALL SELECT doc_id, s, e, 1 FROM ({found(ACCESS)}) WHERE inside >= 18
  UNION ALL SELECT doc_id, s, e, 2 FROM ({found(HEX)})
),
runs AS (SELECT doc_id, s, e, found AS value FROM ({found(CANDIDATE)}) WHERE regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Za-z]')),
free AS (SELECT * FROM runs r WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = r.doc_id AND b.s < r.e AND r.s < b.e)),
named AS (SELECT *, CASE WHEN regexp_full_match(value, '[0-9a-f]+|[0-9A-F]+') THEN {kinds[0]} WHEN regexp_full_match(value, '[A-Z2-7]+') THEN {kinds[1]} WHEN regexp_full_match(value, '[A-Za-z0-9]+') THEN {kinds[2]} ELSE {kinds[3]} END AS kind, {size} AS size, CAST(e - s AS DOUBLE) AS n FROM free),
coded AS (SELECT *, CASE kind WHEN {kinds[0]} THEN 16.0 WHEN {kinds[1]} THEN 32.0 WHEN {kinds[2]} THEN 62.0 ELSE 64.0 END AS w, list_transform(string_split(CASE kind WHEN {kinds[0]} THEN lower(value) WHEN {kinds[1]} THEN value ELSE translate(value, '-_', '+/') END, ''),
  lambda c: instr(CASE kind WHEN {kinds[0]} THEN '{ALPHABETS["random16"]}' WHEN {kinds[1]} THEN '{ALPHABETS["random32"]}' ELSE '{ALPHABETS["random64"]}' END, c) - 1) AS v FROM named),
counted AS (SELECT *, list_sum(list_transform(range(64), lambda a: pow(len(list_filter(v, lambda x: x = a)), 2))) AS squares, CAST(len(list_filter(v, lambda x: x > (w - 1) / 2)) AS DOUBLE) AS high,
  1.0 + len(list_filter(range(2, len(v) + 1), lambda i: (v[i] > (w - 1) / 2) <> (v[i - 1] > (w - 1) / 2))) AS runs,
  list_sum(list_transform(range(2, len(v) + 1), lambda i: (v[i] - (w - 1) / 2) * (v[i - 1] - (w - 1) / 2))) AS lag1 FROM coded),
spread AS (SELECT *, n - high AS low, 2 * high * (n - high) * (2 * high * (n - high) - n) / (n * n * (n - 1)) AS spread FROM counted),
scored AS (SELECT *, (w / n * squares - n - (w - 1)) / sqrt(2.0 * (w - 1) * (n - 1) / n) AS chi, CASE WHEN high > 0 AND low > 0 AND spread > 0 THEN (runs - 1 - 2 * high * low / n) / sqrt(spread) ELSE 99.0 END AS run,
  lag1 / ((w * w - 1) / 12 * sqrt(n - 1)) AS serial FROM spread),
summed AS (SELECT *, least(chi * chi + run * run + serial * serial, 1000.0) AS q FROM scored),
tailed AS (SELECT *, 1 / (1 + 0.3275911 * sqrt(q / 2)) AS t FROM summed),
judged AS (SELECT doc_id, s, e, kind, size, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-sqrt(q / 2) * sqrt(q / 2)) + sqrt(2 * q / pi()) * exp(-q / 2) AS p FROM tailed),
tally AS (SELECT kind, size, CAST(least(floor(p * {BINS}), {BINS - 1}) AS INT) AS bin, count(*) AS n FROM judged GROUP BY ALL),
above AS (SELECT kind, size, b, CAST(coalesce(sum(n) FILTER (bin >= b), 0) AS DOUBLE) AS n, CAST(coalesce(sum(n) FILTER (bin >= {BINS // 2}), 0) AS DOUBLE) AS half FROM tally, (SELECT unnest(range(1, {BINS // 2 + 1})) AS b) GROUP BY kind, size, b),
limits AS (SELECT kind, size, min(b) / {BINS} AS cutoff FROM above WHERE n > 0 AND n - 2 * half * (1 - b / {BINS}) <= {rate} * n + sqrt(half * (1 - 2 * b / {BINS}) * 2 * (1 - b / {BINS})) GROUP BY kind, size),
spans AS (SELECT doc_id, s, e, kind FROM base UNION ALL SELECT doc_id, s, e, kind FROM judged JOIN limits USING (kind, size) WHERE p >= cutoff),
listed AS (SELECT doc_id, {listing} AS spans, {listing} FILTER (kind < 3) AS base, {count(0)} AS n_assign, {count(1)} AS n_access, {count(2)} AS n_hex
  FROM spans, (SELECT [{", ".join(f"'{k}'" for k in KINDS)}] AS names) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (doc_id)
"""
