"""URL filter: host and path rules, then a tree of path templates, by DataFrame functions only.

A rule (host, path) fits its host and all subdomains where the path starts with the rule's; the
longest rule wins.  What no rule decides is decided by its host's template tree:

1. In each path segment variable parts become marks: digits `#`, long hex strings `{hex}`.
   Urls are then one row for each host and path shape, with counts; all that follows works on these.
2. From the root down, the branches under a node are compared.  A branch is a segment; what
   follows it is its distribution over remainders.  A branch whose distribution is similar to that
   of all branches of the node together (a chi-squared test, by its normal approximation) is
   merged into the wildcard `*`, and so is a rare branch among many; the others stay apart.  The
   tree grows until no path that shares its node with another has a further segment.
3. A template is rejected by its smoothed labelled purity:
   (blocked + a) / (labelled + a + b) >= threshold.
   Labels are the rules' own verdicts, or a label column's.  With the prior's a of a + b a template
   without labels, or with fewer than five, is never rejected.

A host's pages, a host and path shape that a large share of all rows has: such keys, at most HOT
of them by their count, are joined by a broadcast, all others by their key.  Defined results: a
null url or one without "://" has an empty host and path, fits no rule and is allowed unless its
(empty) template is rejected; repeated rows give a row each; a null id stays; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Keys that more than one row in so many has are hot; there are fewer than so many of them.
HOT = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the registered query.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(at_host: Column, at_path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule = verdict = None
    for what, where, prefix in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((at_host == where) | at_host.endswith("." + where)) & at_path.startswith(prefix)
        rule = F.when(fits, where + prefix) if rule is None else rule.when(fits, where + prefix)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule.otherwise(none), verdict.otherwise(none))


#: A segment's name that is a long hex string, up to its first dot.
_HEX = r"^[0-9a-f-]*(?:[0-9][a-f-]|[a-f-][0-9])[0-9a-f-]{10,}(\.|$)"


def shape(at_path: Column) -> Column:
    """The path with its variable parts marked."""
    return F.array_join(F.transform(F.split(at_path, "/", -1), lambda x: F.regexp_replace(F.regexp_replace(x, _HEX, "{hex}$1"), "[0-9]+", "#")), "/")


def grow(shapes: DataFrame, z: float = 3.0, rare: int = 2, many: int = 20) -> DataFrame:
    """shapes (host, shape, n, labelled, blocked) with template: the place of each shape in its host's merged tree."""
    columns = [*shapes.columns, "template"]
    now, done, depth = shapes.withColumns({"segments": F.split("shape", "/"), "template": F.lit("")}), [], 0
    while True:
        depth += 1
        shared = now.groupBy("host", "template").agg(F.count("*").alias("shapes")).where("shapes > 1").select("host", "template")
        more = now.where(F.size("segments") > depth)
        # what has no further segment, or stands alone at its node, keeps the rest of its path
        tail = F.when(F.size("segments") > depth, F.concat(F.lit("/"), F.array_join(F.slice("segments", depth + 1, 1_000_000), "/"))).otherwise("")
        rest = now.where(F.size("segments") <= depth).unionByName(more.join(shared, ["host", "template"], "left_anti"))
        done.append(materialize(rest.withColumn("template", F.concat("template", tail)).select(*columns), "url-done"))
        now = materialize(_level(more.join(shared, ["host", "template"], "left_semi"), depth, z, rare, many), "url-tree")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, done)


def _level(now: DataFrame, depth: int, z: float, rare: int, many: int) -> DataFrame:
    """now with the next segment, or the wildcard that its branch is merged into, at the end of each template."""
    now = now.withColumn("branch", F.get("segments", F.lit(depth))).withColumn("rest", F.array_join(F.slice("segments", depth + 2, 1_000_000), "/"))
    here = now.groupBy("host", "template", "branch", "rest").agg(F.sum("n").alias("c"))
    node = here.groupBy("host", "template").agg(F.sum("c").alias("total"), F.countDistinct("branch").alias("branches"), F.countDistinct("rest").alias("kinds"))
    kind = here.groupBy("host", "template", "rest").agg(F.sum("c").alias("of_kind"))
    size = here.groupBy("host", "template", "branch").agg(F.sum("c").alias("size"))
    full = here.join(kind, ["host", "template", "rest"]).join(size, ["host", "template", "branch"]).join(node, ["host", "template"])
    expected = F.col("size") * F.col("of_kind") / F.col("total")
    seen = full.groupBy("host", "template", "branch").agg(
        F.sum((F.col("c") - expected) * (F.col("c") - expected) / expected).alias("chi"),
        F.sum(F.col("of_kind") / F.col("total")).alias("share"),
        *(F.first(x).alias(x) for x in ("size", "branches", "kinds")),
    )
    chi = F.col("chi") + F.col("size") * (1 - F.col("share"))  # kinds the branch lacks
    free = F.col("kinds") - 1
    similar = chi <= free + z * F.sqrt(2.0 * free)
    merged = (F.col("branches") > 1) & (similar | ((F.col("size") <= rare) & (F.col("branches") > many)))
    now = now.join(seen.select("host", "template", "branch", merged.alias("merged")), ["host", "template", "branch"])
    return now.withColumn("template", F.concat("template", F.lit("/"), F.when(F.col("merged"), "*").otherwise(F.col("branch")))).drop("merged", "branch", "rest")


def judge(pages: DataFrame, rules=RULES, label: Column | None = None, id_col: str = "page_id", url_col: str = "url", a: float = 1.0, b: float = 4.0, threshold: float = 0.6) -> DataFrame:
    """id, host, path, rule, template, purity and verdict for every row; label: 1 bad, 0 good, else the rules' verdicts."""
    url = F.col(url_col).cast("string")
    marked = F.coalesce(F.lit(None).cast("int") if label is None else label.cast("int"), F.lit(None).cast("int"))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), host(url).alias("host"), path(url).alias("path"), marked.alias("label"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "shape": shape(F.col("path"))})
    bad = F.coalesce("label", F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0))
    shapes = materialize(rows.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count(bad).alias("labelled"), F.coalesce(F.sum(bad), F.lit(0)).alias("blocked")), "url-shapes")
    tree = grow(shapes)
    purity = (F.sum("blocked") + a) / (F.sum("labelled") + a + b)
    judged = tree.groupBy("host", "template").agg(purity.alias("purity"))
    place = materialize(tree.join(judged, ["host", "template"]).select("host", "shape", "n", "template", "purity"), "url-places")
    total = place.agg(F.sum("n")).first()[0] or 0
    hot = place.where(F.col("n") * HOT > total).select("host", "shape", F.col("template").alias("hot_template"), F.col("purity").alias("hot_purity"))
    out = rows.join(F.broadcast(hot), ["host", "shape"], "left")
    # a path starts with "/", so what starts otherwise meets nothing, and hot rows are dealt by their paths
    key = F.when(F.col("hot_template").isNull(), F.col("shape")).otherwise(F.concat(F.lit("?"), F.xxhash64("id", "path").cast("string")))
    cold = place.where(F.col("n") * HOT <= total).select("host", F.col("shape").alias("key"), "template", "purity")
    out = out.withColumn("key", key).join(cold, ["host", "key"], "left")
    out = out.withColumns({"template": F.coalesce("template", "hot_template"), "purity": F.coalesce("purity", "hot_purity")})
    own = F.when(F.col("purity") >= threshold, "block").otherwise("allow")
    return out.select("id", "host", "path", "rule", "template", "purity", F.coalesce("ruled", own).alias("verdict"))


def sql(rules=RULES, a: float = 1.0, b: float = 4.0, threshold: float = 0.6, z: float = 3.0, rare: int = 2, many: int = 20) -> str:
    """judge() over pages as SQL for DuckDB, with the rules' verdicts as labels."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: f"(host = '{r[1]}' OR ends_with(host, '.{r[1]}')) AND starts_with(path, '{r[2]}')"
    rule = " ".join(f"WHEN {fits(r)} THEN '{r[1]}{r[2]}'" for r in longest)
    ruled = " ".join(f"WHEN {fits(r)} THEN '{r[0]}'" for r in longest)
    node, branch, kind = "PARTITION BY host, template, going", "PARTITION BY host, template, going, branch", "PARTITION BY host, template, going, rest"
    return f"""
WITH RECURSIVE urls AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\\A.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '(?s)\\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT *, CASE {rule} END AS rule, CASE {ruled} END AS ruled,
  array_to_string(list_transform(string_split(path, '/'), lambda x: regexp_replace(regexp_replace(x, '{_HEX}', '{{hex}}\\1'), '[0-9]+', '#', 'g')), '/') AS shape FROM urls),
grown AS (
  SELECT 0 AS d, host, shape, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked, string_split(shape, '/') AS segs, '' AS template FROM r GROUP BY host, shape
  UNION ALL
  SELECT d, host, shape, n, labelled, blocked, segs, template || CASE WHEN NOT going THEN '' WHEN branches > 1 AND (chi <= kinds - 1 + {z} * sqrt(2.0 * (kinds - 1)) OR (size <= {rare} AND branches > {many})) THEN '/*' ELSE '/' || branch END
  FROM (SELECT *, sum((c - expected) * (c - expected) / expected) FILTER (first = 1) OVER ({branch}) + size * (1 - sum(of_kind / total) FILTER (first = 1) OVER ({branch})) AS chi
    FROM (SELECT *, size * of_kind / total AS expected, row_number() OVER ({branch}, rest) AS first
      FROM (SELECT *, sum(n) OVER ({node}) AS total, sum(n) OVER ({branch}) AS size, sum(n) OVER ({kind}) AS of_kind, sum(n) OVER ({branch}, rest) AS c, count(DISTINCT branch) OVER ({node}) AS branches, count(DISTINCT rest) OVER ({node}) AS kinds
        FROM (SELECT d + 1 AS d, * EXCLUDE (d), segs[d + 2] AS branch, array_to_string(segs[d + 3:], '/') AS rest, segs[d + 2] IS NOT NULL AS going, max(len(segs)) OVER () AS longest FROM grown) WHERE d < longest)))
),
tree AS (SELECT * FROM grown WHERE d = (SELECT max(d) FROM grown)),
p AS (SELECT host, template, (sum(blocked) + {a}) / (sum(labelled) + {a} + {b}) AS purity FROM tree GROUP BY ALL)
SELECT page_id, r.host, path, rule, coalesce(ruled, CASE WHEN purity >= {threshold} THEN 'block' ELSE 'allow' END) AS verdict, tree.template, round(purity, 6) AS purity
FROM r JOIN tree USING (host, shape) JOIN p ON p.host = r.host AND p.template = tree.template
"""
