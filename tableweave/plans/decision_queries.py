"""Queries of the operators that apply a reader's decisions, and of the text functions around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableweave.functions import scalars as S
from tableweave.functions import similarity as M
from tableweave.operators import cells as T
from tableweave.operators import cleanup, positional, reshape
from tableweave.plans import inputs
from tableweave.plans.catalog import query

# Answers of one customer, in the order of the orders.
ANSWERS = """
SELECT o_custkey AS doc_id, o_orderkey,
  CASE WHEN o_custkey % 3 > 0 AND o_orderkey % 4 = 0 THEN 'min' ELSE 'h' END AS unit,
  CAST(o_orderkey % 24 AS STRING) AS time, CAST(o_orderkey % 5 AS INT) AS place,
  CASE WHEN o_orderkey % 8 = 1 THEN 'Parameter type' ELSE 'Parameter value' END AS category
FROM orders
"""


@query(
    f"""WITH v AS (SELECT doc_id, list(unit ORDER BY o_orderkey) AS units, list(time ORDER BY o_orderkey) AS times, list(CAST(place AS STRING) ORDER BY o_orderkey) AS places,
  count(*) AS n, count(*) FILTER (WHERE category = 'Parameter type') AS needed, count(DISTINCT unit) AS kinds FROM ({ANSWERS}) a GROUP BY 1)
SELECT doc_id, array_to_string(CASE WHEN kinds = 1 THEN list_transform(range(7), lambda i: units[1]) ELSE units END, ',') AS spread,
  CASE WHEN kinds = 1 THEN array_to_string(times, ', ') END AS time_value, CASE WHEN kinds = 1 THEN units[1] END AS time_unit,
  coalesce(array_to_string(CASE WHEN n > 4 THEN list_filter(places, lambda x: x <> '4') ELSE places END, ','), '') AS known,
  CASE WHEN doc_id % 4 = 0 THEN 'column count' WHEN needed <> 1 THEN 'Parameter type count' END AS fault,
  CASE WHEN doc_id % 4 = 0 THEN 'column count' WHEN needed = 0 THEN 'Parameter type count' END AS loose_fault FROM v"""
)
def decision_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = inputs.from_sql(spark, sf_dir, ANSWERS, "orders")
    packed = answers.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "unit", "time", "place", "category"))).alias("a"))
    of = lambda name: F.transform("a", lambda x: x[name])
    categories = F.map_from_entries(F.transform("a", lambda x: F.struct(x["o_orderkey"].cast("string"), x["category"])))
    n_columns = F.size("a") + (F.col("doc_id") % 4 == 0).cast("int")
    time, unit = positional.collapsed_times(of("time"), of("unit"))
    return packed.select(
        "doc_id",
        F.array_join(positional.spread(of("unit"), F.lit(7)), ",").alias("spread"),
        time.alias("time_value"),
        unit.alias("time_unit"),
        F.array_join(positional.known_matches(of("place"), F.lit(4)).cast("array<string>"), ",").alias("known"),
        positional.header_categories_fault(categories, n_columns, "Parameter type").alias("fault"),
        positional.header_categories_fault(categories, n_columns, "Parameter type", exactly_one=False).alias("loose_fault"),
    )


_TABLES = "base AS (SELECT o_custkey AS doc_id, CAST(o_orderkey AS STRING) AS a, o_orderpriority AS b, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS r FROM orders)"
_PLAIN = "SELECT doc_id, r AS row_idx, 0 AS col_idx, 'order' AS header, a AS value FROM base UNION ALL SELECT doc_id, r, 1, '{}', b FROM base"
_TURNED = "SELECT DISTINCT doc_id, 0 AS row_idx, 0 AS col_idx, '{}' AS header, 'priority' AS value FROM base UNION ALL SELECT doc_id, 0, r + 1, a, b FROM base"


def _orders_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.col("o_orderkey").cast("string").alias("order"), F.col("o_orderpriority").alias("priority"))
    return T.to_cells(orders, ["doc_id"], ["o_orderkey"], ["order", "priority"])


def _parameter_columns(cells: DataFrame) -> DataFrame:
    return cells.select("doc_id").distinct().withColumn("column", F.when(F.col("doc_id") % 3 > 0, "priority"))


@query(f"WITH {_TABLES} SELECT * FROM ({_PLAIN.format('Parameter type')}) p WHERE doc_id % 3 > 0 UNION ALL SELECT * FROM ({_TURNED.format('Parameter type')}) t WHERE doc_id % 3 = 0")
def aligned_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _orders_cells(spark, sf_dir)
    return reshape.aligned_parameters(cells, ["doc_id"], _parameter_columns(cells))


@query(f"WITH {_TABLES} SELECT * FROM ({_PLAIN.format('priority')}) p WHERE doc_id % 3 = 0 UNION ALL SELECT * FROM ({_TURNED.format('order')}) t WHERE doc_id % 3 > 0")
def aligned_individual(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _orders_cells(spark, sf_dir)
    return reshape.aligned_individual(cells, ["doc_id"], _parameter_columns(cells))


_SUB_TABLES = "SELECT o_custkey AS doc_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS table_id, o_orderstatus AS type_column, o_orderkey AS answer FROM orders"


@query(f"SELECT doc_id, table_id, type_column, first_value(answer) OVER (PARTITION BY doc_id, type_column ORDER BY table_id) AS answer FROM ({_SUB_TABLES}) t")
def reused_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = positional.numbered(inputs.load(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "doc_id"), ["doc_id"], ["o_orderkey"], "table_id")
    tables = tables.select("doc_id", "table_id", F.col("o_orderstatus").alias("type_column"), "o_orderkey")
    asked = positional.unanswered(tables, ["doc_id"], "type_column")
    answers = asked.select("doc_id", "type_column", F.col("o_orderkey").alias("answer"))
    return positional.reused(tables.drop("o_orderkey"), answers, ["doc_id"], "type_column")


# Answers around which there is what models put there; braces are doubled, as Spark fills in the table's name by braces.
PAYLOADS = """
SELECT o_orderkey, o_custkey, o_orderkey % 2 = 0 AS even,
  '```json' || chr(10) || CASE WHEN o_orderkey % 2 = 0 THEN '[{{"", name: "' ELSE '[{{name: "' END || o_orderstatus
    || CASE WHEN o_orderkey % 2 = 0 THEN '", key: ' ELSE '", "", key: ' END || CAST(o_orderkey AS STRING) || '}}]' || chr(10) || '```' AS payload,
  CAST(o_orderkey AS STRING) || ' of 1.5, ' || CAST(o_custkey AS STRING) || ' % or 0 and ' || CAST(o_orderkey AS STRING) || ' ' || CAST(o_custkey AS STRING) AS numbers,
  '<think>about [1]</think> ' || CASE WHEN o_orderkey % 2 = 0 THEN 'So: [1, 2, 3] ' ELSE 'the answer, at last [1]' END AS thought
FROM orders
"""


@query(
    """WITH p AS (SELECT o_orderkey, o_custkey, o_orderkey % 2 = 0 AS even, o_orderstatus AS s, CAST(o_orderkey AS STRING) AS k FROM orders)
SELECT o_orderkey, CASE WHEN even THEN '[{"", name: "' || s || '", key: ' || k || '}]' ELSE '[{name: "' || s || '", "", key: ' || k || '}]' END AS bare,
  CASE WHEN even THEN '[{ "name": "' || s || '", "key": ' || k || '}]' ELSE '[{"name": "' || s || '", "key": ' || k || '}]' END AS json,
  CASE WHEN even THEN '[{{"", name: "' || s || '", key: ' || k || '}}]' ELSE '[{{name: "' || s || '", "", key: ' || k || '}}]' END AS template,
  CASE WHEN o_orderkey = o_custkey OR o_custkey = 0 THEN k WHEN o_orderkey = 0 THEN CAST(o_custkey AS STRING) ELSE CAST(least(o_orderkey, o_custkey) AS STRING) || ',' || CAST(greatest(o_orderkey, o_custkey) AS STRING) END AS integers,
  CASE WHEN even THEN '[1, 2, 3]' ELSE 'the answer, at last [1]' END AS answer FROM p"""
)
def text_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = inputs.from_sql(spark, sf_dir, PAYLOADS, "orders").withColumn("bare", S.without_fences(F.col("payload")))
    return told.select(
        "o_orderkey",
        "bare",
        S.without_empty_fields(S.quoted_property_names(F.col("bare"))).alias("json"),
        S.escaped_braces(F.col("bare")).alias("template"),
        F.array_join(S.pure_integers(F.col("numbers")).cast("array<string>"), ",").alias("integers"),
        S.after_thinking(F.col("thought")).alias("answer"),
    )


# Pairs of cells: equal texts, numbers, quoted numbers with a unit, nothing, abbreviations.
CELL_PAIRS = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey % 5 AS i, l_suppkey % 5 AS j,
  CASE l_partkey % 5 WHEN 0 THEN 'Mean' WHEN 1 THEN '2' WHEN 2 THEN '"2.5 mg"' WHEN 3 THEN 'AUC' END AS a,
  CASE l_suppkey % 5 WHEN 0 THEN 'MEAN' WHEN 1 THEN '2.5' WHEN 2 THEN '' WHEN 3 THEN 'area under curve' END AS b
FROM lineitem
"""


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN (i = 0 AND j = 0) OR (i = 3 AND j = 3) THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity,
  (i = 0 AND j = 0) OR (i = 3 AND j = 3) OR (i = 4 AND j IN (2, 4)) AS same_text,
  (i IN (0, 3, 4) AND j <> 1) OR (i = 2 AND j = 1) AS same_number,
  (i = 0 AND j = 0) OR (i = 3 AND j = 3) OR (i = 2 AND j = 1) OR (i = 4 AND j <> 1) OR (j = 4 AND i <> 1) AS stands_for FROM ({CELL_PAIRS}) p"""
)
def rated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, a, b = inputs.from_sql(spark, sf_dir, CELL_PAIRS, "lineitem"), F.col("a"), F.col("b")
    return pairs.select(
        *("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        M.text_similarity(a, b).alias("similarity"),
        M.equal_text(a, b).alias("same_text"),
        M.equal_number(a, b).alias("same_number"),
        M.loosely_equal(a, b).alias("stands_for"),
    )


@query(
    """WITH o AS (SELECT o_orderkey, o_orderstatus AS s, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END AS caption, CASE WHEN o_orderkey % 2 = 0 THEN 'a note' ELSE '' END AS note FROM orders)
SELECT o_orderkey, 'Table ' || CAST(o_orderkey % 4 AS STRING) || coalesce(chr(10) || 'caption: ' || caption, '') || chr(10) || 'table: | ' || s || ' |' || CASE WHEN note <> '' THEN chr(10) || 'footnote: a note' ELSE '' END AS prompt,
  'Methods' || chr(10) || s || chr(10) || 'Results' || chr(10) || 'none' AS article, 'status: ' || s || chr(10) || 'note: ' || note AS definitions,
  CASE WHEN s = 'O' THEN 'Content from Table: -O- x' ELSE s END AS cell FROM o"""
)
def table_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    note = F.when(key % 2 == 0, "a note").otherwise("")
    sections = F.array(F.struct(F.lit("Methods").alias("section"), status.alias("content")), F.struct(F.lit("Results").alias("section"), F.lit("none").alias("content")))
    return inputs.load(spark, sf_dir, "orders").select(
        key,
        S.table_prompt((key % 4).cast("int"), F.when(key % 3 > 0, F.col("o_orderpriority")), F.concat(F.lit("| "), status, F.lit(" |")), note).alias("prompt"),
        S.joined_sections(sections).alias("article"),
        S.column_definitions(F.array(F.lit("status"), F.lit("note")), F.array(status, note)).alias("definitions"),
        S.without_pipes(F.when(status == "O", "|O| x").otherwise(status)).alias("cell"),
    )


@query("""SELECT CAST(l_quantity AS BIGINT) AS "Parameter value", l_orderkey, l_returnflag AS "Parameter statistic", l_linestatus AS "Parameter unit" FROM lineitem""")
def final_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = inputs.load(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("Statistic type"), F.col("l_quantity").cast("long").alias("Main values"), F.col("l_linestatus").alias("Parametr unit"))
    told = cleanup.fuzzily_renamed(df, ["Main value", "Statistics type", "Parameter unit"])
    return cleanup.renamed(told, {"Main value": "Parameter value", "Statistics type": "Parameter statistic"}, ["Parameter value", "l_orderkey", "Parameter statistic", "Parameter unit"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 3 THEN 'Main value' WHEN o_orderkey % 5 = 3 THEN 'Statistics type' END AS name FROM orders")
def resolved_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.element_at(F.array(*[F.lit(x) for x in ("Main value", "Main valeu", "main_value", "Statistic types", "zzz")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return cleanup.resolved_names(inputs.load(spark, sf_dir, "orders").select("o_orderkey", written.alias("name")), "name", ["Main value", "Statistics type"])


@query(
    """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey, o_orderpriority AS raw, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS row_idx, CAST(o_orderkey AS STRING) AS k FROM orders)
SELECT doc_id, row_idx, o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN k END AS value, CASE WHEN o_orderkey % 3 > 0 THEN raw END AS unit FROM o"""
)
def parsed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", F.col("o_orderpriority").alias("raw"))
    rows = positional.numbered(orders, ["doc_id"], ["o_orderkey"]).select("doc_id", "row_idx", "o_orderkey", "raw")
    # an answer of the wrong length for every third row
    own = F.array(F.col("o_orderkey").cast("string"), F.col("raw"))
    answer = F.when(F.col("o_orderkey") % 3 > 0, own).otherwise(F.slice(own, 1, 1))
    lists = orders.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", answer.alias("x")))), lambda s: s["x"]).alias("values"))
    return reshape.replaced_column(rows, ["doc_id"], "raw", positional.exploded(lists, ["doc_id"], ["value", "unit"]), ["value", "unit"])


# Answers in one to three parts, by the orders' remainder: whole, begun anew, cut off, with words before the rest, fenced, with a missing part.
_FORMS = {
    0: (["[{\"a\": \"x\", \"b\": K}, {\"a\": \"y\", \"b\": ", "K}]"], "[{\"a\": \"x\", \"b\": K}, {\"a\": \"y\", \"b\":K}]", False),
    1: (["[{\"a\": \"x\", \"b\": K}, {\"a\": \"y\", \"b\": ", "[{\"a\": \"z\", \"b\": K}]"], "[{\"a\": \"x\", \"b\": K}, {\"a\": \"z\", \"b\": K}]", True),
    2: (["[{\"a\": \"x\", \"b\": K}, {\"a\": \"y\","], "[{\"a\": \"x\", \"b\": K}]", True),
    3: (["[{\"a\": K}, {\"a\": \"y", "Sure: {\"a\": \"z\"}]"], "[{\"a\": K}, {\"a\": \"z\"}]", True),
    4: (["```json [{\"a\": \"x{,\", \"b\": K}]```"], "[{\"a\": \"x{,\", \"b\": K}]", False),
    5: (["[{\"a\": [K, {\"c\": null}]}, ", None, "{\"a\": 1.5e3}]"], "[{\"a\": [K, {\"c\": null}]},{\"a\": 1.5e3}]", False),
}


@query(
    "SELECT o_orderkey, replace(CASE o_orderkey % 6 " + " ".join(f"WHEN {k} THEN '{text}'" for k, (_, text, _) in _FORMS.items())
    + " END, 'K', CAST(o_orderkey AS STRING)) AS text, o_orderkey % 6 IN (" + ", ".join(str(k) for k, f in _FORMS.items() if f[2]) + ") AS truncated FROM orders"
)
def repaired_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tableweave.functions.json_repair import repaired_answers as repaired

    key = F.col("o_orderkey")
    form = None
    for k, (parts, _, _) in _FORMS.items():
        made = F.array(*[F.replace(F.lit(p), F.lit("K"), key.cast("string")) if p is not None else F.lit(None).cast("string") for p in parts])
        form = F.when(key % 6 == k, made) if form is None else form.when(key % 6 == k, made)
    # a few bytes of an order are a lot of work
    orders = inputs.dealt_out(inputs.load(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])
    return orders.select("o_orderkey", repaired(form).alias("r")).select("o_orderkey", "r.text", "r.truncated")
