"""Queries of the page readers over pages with tables, captions and sections, and of the texts that answers come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableweave.functions import scalars as S
from tableweave.operators import cells, codecs, spans
from tableweave.plans import inputs
from tableweave.plans.catalog import query
from tableweave.sources import html_tables

# A page for each customer: as the archive wraps it for even keys, else with a caption and a footnote around a plain table
# that has two header lines, a cell over two columns, an empty line and a repeated header.
_PAGE = """
SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN
  '<hgroup><h1> Study of ' || c_name || '</h1></hgroup><section><h2>Abstract</h2><p>On <b>' || c_name || '</b></p><p>and more</p></section><div class="table-wrap anchored whole_rhythm"><div class="caption">Doses of ' || c_name
  || '</div><div class="xtable"><table><tr><th>Name</th><th>Key</th></tr><tr><td>' || c_name || '<sup>a</sup></td><td>' || CAST(c_custkey AS STRING) || '</td></tr></table></div><div class="tblwrap-foot">a: segment ' || c_mktsegment || '</div></div>'
ELSE
  '<div id="page-title"><h1>Report on ' || c_name || '</h1></div><h2>Abstract</h2><p>Short &amp; plain ' || c_name || '</p><h2>Results</h2><p>' || c_mktsegment || '</p><p>' || c_mktsegment || '</p><div class="box"><p class="caption">Table of ' || c_name
  || '</p><table><tr><th>Name</th><th colspan="2">Amounts</th></tr><tr><th>Name</th><th>Low</th><th>Low</th></tr><tr><td></td><td></td><td></td></tr><tr><td>' || c_name || '</td><td>' || CAST(c_custkey AS STRING) || '</td><td>' || c_mktsegment
  || '</td></tr></table><div class="footnote">See ' || c_mktsegment || '</div></div><h2>References</h2><p>none</p>' END AS html
FROM customer
"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.from_sql(spark, sf_dir, _PAGE, "customer", dealt=["c_custkey"])


@query(
    """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN 'Study of ' ELSE 'Report on ' END || c_name AS title,
  CASE WHEN c_custkey % 2 = 0 THEN 'On ' || c_name || chr(10) || 'and more' ELSE 'Short & plain ' || c_name END AS abstract FROM customer"""
)
def full_text_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tables.parse_pages(_pages(spark, sf_dir), ["doc_id"], parts=("title", "abstract"))


@query(
    """SELECT c_custkey AS doc_id, 0 AS table_id, CASE WHEN c_custkey % 2 = 0 THEN 'Doses of ' ELSE 'Table of ' END || c_name AS caption, CASE WHEN c_custkey % 2 = 0 THEN 'a: segment ' ELSE 'See ' END || c_mktsegment AS footnote,
  CASE WHEN c_custkey % 2 = 0 THEN 'Name|Key' ELSE 'Name|Amounts.Low|Amounts.Low' END AS headers,
  CASE WHEN c_custkey % 2 = 0 THEN c_name || '|' || CAST(c_custkey AS STRING) ELSE '||;' || c_name || '|' || CAST(c_custkey AS STRING) || '|' || c_mktsegment END AS rows FROM customer"""
)
def full_text_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_tables.page_tables(html_tables.parse_pages(_pages(spark, sf_dir), ["doc_id"], parts=("tables",)), ["doc_id"])
    return found.select("doc_id", "table_id", "caption", "footnote", F.array_join("headers", "|").alias("headers"), F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), ";").alias("rows"))


@query(
    """SELECT c_custkey AS doc_id, 0 AS section_id, 'Abstract' AS section, CASE WHEN c_custkey % 2 = 0 THEN 'On ' || c_name || chr(10) || 'and more' ||
  chr(10) || '| Name | Key |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | ' || CAST(c_custkey AS STRING) || ' |' ELSE 'Short & plain ' || c_name END AS content FROM customer
UNION ALL SELECT c_custkey, 1, 'Results', c_mktsegment || chr(10) || 'Table of ' || c_name || chr(10) || '| Name | Amounts.Low | Amounts.Low |' || chr(10) || '| --- | --- | --- |' || chr(10) || '|  |  |  |' || chr(10) || '| ' || c_name || ' | ' || CAST(c_custkey AS STRING) || ' | ' || c_mktsegment || ' |'
FROM customer WHERE c_custkey % 2 = 1"""
)
def full_text_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = html_tables.parse_pages(_pages(spark, sf_dir), ["doc_id"], parts=("sections",))
    return parsed.select("doc_id", F.posexplode("sections").alias("section_id", "s")).select("doc_id", "section_id", "s.section", "s.content")


@query(
    """SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 2 = 0 THEN '| Name | Key |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || c_name || ' | ' || CAST(c_custkey AS STRING) || ' |'
  ELSE '| Name | Amounts.Low_0 | Amounts.Low_1 |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| ' || c_name || ' | ' || CAST(c_custkey AS STRING) || ' | ' || c_mktsegment || ' |' END AS markdown FROM customer"""
)
def single_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tables.single_tables(_pages(spark, sf_dir), ["doc_id"])


@query(
    """SELECT c_custkey AS doc_id, CASE c_custkey % 3 WHEN 0 THEN '[{"a": "' || c_name || '"}, {"a": "2"}]' WHEN 1 THEN '[{"a": "' || c_name || '"}]' ELSE '[{"a": "1"},{"a": "' || c_name || '"}]' END AS answer FROM customer"""
)
def joined_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    parts = (
        F.when(F.col("c_custkey") % 3 == 0, F.array(F.concat(F.lit('```json\n[{"a": "'), name, F.lit('"}, {"a": "cut')), F.lit('[{"a": "2"}]\n```')))
        .when(F.col("c_custkey") % 3 == 1, F.array(F.concat(F.lit('[{"a": "'), name, F.lit('"}, {"a": "'))))
        .otherwise(F.array(F.lit('[{"a": "1"},'), F.lit(None), F.concat(F.lit('{"a": "'), name, F.lit('"}]'))))
    )
    return inputs.load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.trim(F.regexp_replace(S.joined_answers(parts), r"\n", "")).alias("answer"))


@query(
    """SELECT o_orderkey, true AS valid, CASE WHEN o_orderkey % 3 <> 2 THEN 'name|note' END AS headers, CASE WHEN o_orderkey % 3 <> 2 THEN o_orderpriority || '|a, b' END AS first FROM orders"""
)
def csv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = F.when(F.col("o_orderkey") % 3 == 1, ",").when(F.col("o_orderkey") % 3 == 2, ",x,y").otherwise("")
    text = F.concat(F.lit("name,note\n"), "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 1, F.lit(',"a, b"')).otherwise(F.lit(',"a, b"')), F.when(F.col("o_orderkey") % 3 == 2, extra).otherwise(""))
    told = codecs.from_csv_texts(inputs.load(spark, sf_dir, "orders").select("o_orderkey", text.alias("csv")), ["o_orderkey"])
    return told.select("o_orderkey", "valid", F.array_join("headers", "|").alias("headers"), F.array_join(F.get("rows", F.lit(0)), "|").alias("first"))


# A table for each customer, a line for each order: in each three lines one cell is two columns wide and three lines high, in
# the middle of the line. The last of these may reach below the table.
_SPANNED = """
SELECT o_custkey AS doc_id, '<table><tr><th>a</th><th colspan="2">b</th><th>c</th></tr>' || {joined} || '</table>' AS html FROM (
  SELECT o_custkey, o_orderkey, '<tr><td>a' || CAST(o_orderkey AS STRING) || '</td>' || CASE WHEN (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3 = 0
    THEN '<td colspan=2 rowspan=3>b' || CAST(o_orderkey AS STRING) || '</td>' ELSE '' END || '<td>c' || CAST(o_orderkey AS STRING) || '</td></tr>' AS line FROM orders) l
GROUP BY o_custkey
"""
_SPANNED_ROWS = """
WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS r, CAST(count(*) OVER (PARTITION BY o_custkey) AS INT) AS n FROM orders),
b AS (SELECT o.doc_id, o.r, o.n, o.k, f.k AS first FROM o JOIN o f ON f.doc_id = o.doc_id AND f.r = o.r - o.r % 3),
g AS (SELECT doc_id, r, c, CASE c WHEN 0 THEN 'a' || k WHEN 3 THEN 'c' || k ELSE 'b' || first END AS value FROM b CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS c)
  UNION ALL SELECT doc_id, n + x, c, 'b' || first FROM (SELECT * FROM b WHERE r = n - 1) CROSS JOIN (SELECT unnest([0, 1]) AS c) CROSS JOIN (SELECT unnest([0, 1]) AS x) WHERE x < (3 - n % 3) % 3)
"""


def _spanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.from_sql(spark, sf_dir, _SPANNED.format(joined="array_join(transform(sort_array(collect_list(struct(o_orderkey, line))), x -> x.line), '')"), "orders")


@query(
    _SPANNED_ROWS + """SELECT doc_id, 0 AS table_id, r + 1 AS row_idx, c AS col_idx, value FROM g
UNION ALL SELECT DISTINCT doc_id, 0, 0, c, CASE c WHEN 0 THEN 'a' WHEN 3 THEN 'c' ELSE 'b' END FROM o CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS c)"""
)
def expanded_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.expanded_spans(html_tables.span_cells(_spanned(spark, sf_dir), ["doc_id"]), ["doc_id", "table_id"])


# The same with headers apart and told from each other, and short lines padded.
@query(
    _SPANNED_ROWS + """, p AS (SELECT doc_id, m, CAST(unnest(range(0, m)) AS INT) AS row_idx FROM (SELECT doc_id, max(r) + 1 AS m FROM g GROUP BY doc_id))
SELECT p.doc_id, 0 AS table_id, row_idx, h.c AS col_idx, CASE h.c WHEN 0 THEN 'a' WHEN 3 THEN 'c' ELSE 'b_' || CAST(h.c - 1 AS STRING) END AS header, coalesce(value, '') AS value
FROM p CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS c) h LEFT JOIN g ON g.doc_id = p.doc_id AND g.r = row_idx AND g.c = h.c"""
)
def spanned_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["doc_id", "table_id"]
    return cells.repair_headers(spans.table_cells(html_tables.span_cells(_spanned(spark, sf_dir), ["doc_id"]), keys), keys)
