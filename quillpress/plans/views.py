"""Markdown documents made from the driver's tables, and the same documents in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import expected


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order: frontmatter, heading, bold, table, nested list, tasks, rule, code, address."""
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.struct(F.col("l_linenumber").cast("long").alias("a"), F.col("l_partkey").alias("b"), F.col("l_quantity").cast("long").alias("c")).alias("x")
    )
    rows = items.groupBy("k").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    rows = rows.select("k", F.array_join(F.transform("xs", lambda x: F.concat(F.lit("| "), x["a"].cast("string"), F.lit(" | "), x["b"].cast("string"), F.lit(" | "), x["c"].cast("string"), F.lit(" |"))), "\n").alias("rows"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    k = F.col("k").cast("string")
    parts = (
        "---\norder: ", k, "\n---\n# Order ", k, "\n\n**Status:** ", F.col("s"), "\n\n| line | part | qty |\n|---|---|---|\n", F.col("rows"),
        "\n\n- Priority\n  - ", F.col("p"), "\n- [x] received\n- [ ] shipped\n\n***\n\n```python\n# total\nx = ( 1 + ", k,
        " )\n\n\ny = [ 1, 2 ]\n```\n\nNote:\nSee https://example.com/orders/", k, "\n- red\n- green\n- blue\n",
    )
    return orders.join(rows, "k").select(F.col("k").alias("doc_id"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("text"))


def md_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per nation and market segment: a nested list of their customers."""
    names = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.array_sort(F.collect_list("c_name")).alias("names"))
    both = table(spark, sf_dir, "nation").join(names, F.col("n_nationkey") == F.col("c_nationkey"))
    doc_id = F.col("n_nationkey") * 10 + F.instr(F.lit("ABFHM"), F.substring("c_mktsegment", 1, 1))
    text = F.concat(F.lit("## Region\n- "), F.col("n_name"), F.lit(" "), F.col("c_mktsegment"), F.lit("\n  - "), F.array_join("names", "\n  - "), F.lit("\n"))
    return both.select(doc_id.cast("long").alias("doc_id"), text.alias("text"))


def md_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per conversation: a heading for each turn's role."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("xs"))
    body = F.transform("xs", lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    return turns.select(F.col("conv_id").alias("doc_id"), F.array_join(body, "").alias("text"))


def md_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per event: its properties as a block of code."""
    text = F.concat(F.lit("### "), F.col("event_type"), F.lit("\n```json\n// event\n"), F.col("props"), F.lit("\n```\n"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), text.alias("text"))


def templated(spark: SparkSession, sf_dir: str, template: str) -> DataFrame:
    """A document per customer: a template with the customer's number and market segment."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), _filled(template).alias("text"))


def _filled(template: str) -> Column:
    return F.replace(F.replace(F.lit(template), F.lit("{k}"), F.col("c_custkey").cast("string")), F.lit("{s}"), F.col("c_mktsegment"))


def md_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note per customer; every tenth is only a heading whose letters have longer lower cases."""
    text = F.when(F.col("c_custkey") % 10 == 0, _filled(expected.DOTTED)).otherwise(_filled(expected.NOTE))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


#: The templates' columns.
CUSTOMERS = "cust AS (SELECT c_custkey AS doc_id, CAST(c_custkey AS VARCHAR) AS k, c_mktsegment AS s FROM customer)"
NL = "chr(10)"
#: The same documents as common table expressions of DuckDB.
MD_ORDERS = """
md AS (
  SELECT o.o_orderkey AS doc_id,
    '---' || chr(10) || 'order: ' || k || chr(10) || '---' || chr(10) || '# Order ' || k || chr(10) || chr(10) || '**Status:** ' || o.o_orderstatus || chr(10) || chr(10)
    || '| line | part | qty |' || chr(10) || '|---|---|---|' || chr(10) || r.rows || chr(10) || chr(10) || '- Priority' || chr(10) || '  - ' || o.o_orderpriority || chr(10)
    || '- [x] received' || chr(10) || '- [ ] shipped' || chr(10) || chr(10) || '***' || chr(10) || chr(10) || '```python' || chr(10) || '# total' || chr(10) || 'x = ( 1 + ' || k
    || ' )' || chr(10) || chr(10) || chr(10) || 'y = [ 1, 2 ]' || chr(10) || '```' || chr(10) || chr(10) || 'Note:' || chr(10) || 'See https://example.com/orders/' || k
    || chr(10) || '- red' || chr(10) || '- green' || chr(10) || '- blue' || chr(10) AS text
  FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS k FROM orders) o JOIN (
    SELECT l_orderkey, string_agg('| ' || l_linenumber || ' | ' || l_partkey || ' | ' || CAST(floor(l_quantity) AS BIGINT) || ' |', chr(10) ORDER BY l_linenumber, l_partkey, CAST(floor(l_quantity) AS BIGINT)) AS rows
    FROM lineitem GROUP BY l_orderkey
  ) r ON r.l_orderkey = o.o_orderkey
)"""
MD_GEO = """
md AS (
  SELECT CAST(n_nationkey * 10 + instr('ABFHM', c_mktsegment[1]) AS BIGINT) AS doc_id, '## Region' || chr(10) || '- ' || n_name || ' ' || c_mktsegment || chr(10) || '  - ' || names || chr(10) AS text
  FROM nation JOIN (SELECT c_nationkey, c_mktsegment, string_agg(c_name, chr(10) || '  - ' ORDER BY c_name) AS names FROM customer GROUP BY ALL) ON c_nationkey = n_nationkey
)"""
MD_CONVERSATIONS = """
md AS (
  SELECT conv_id AS doc_id, string_agg('## ' || role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS text FROM conversations GROUP BY conv_id
)"""
MD_EVENTS = """
md AS (SELECT event_id AS doc_id, '### ' || event_type || chr(10) || '```json' || chr(10) || '// event' || chr(10) || props || chr(10) || '```' || chr(10) AS text FROM events)"""
DOCUMENTS = "md AS (SELECT doc_id, text FROM documents)"
PAGES = "md AS (SELECT page_id AS doc_id, html AS text FROM pages)"
