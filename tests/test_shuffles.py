"""How often steps shuffle and write what they work on, and into how many tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tableweave.operators import cleanup as C
from tableweave.operators import reshape
from tableweave.plans import cleanup_queries, graph_queries, inputs, materialize, pipeline_queries, pipelines

SF = "/root/testdata/sf0.001"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


def test_summary_rows_are_shuffled_once_and_not_written(spark):
    rows = spark.createDataFrame([(1, 0, *["x"] * len(cleanup_queries.COLUMNS))], ["doc_id", "row_idx", *cleanup_queries.COLUMNS])
    with materialize.recorded() as paths:
        clean = C.clean_summary(rows, ["doc_id"], C.Names(identity=["drug_name"]), cleanup_queries.COLUMNS)
    assert paths == [] and shuffles(clean) == 1


def test_plain_summary_rows_too(spark):
    with materialize.recorded() as paths:
        clean = cleanup_queries.row_cleanup_summary(spark, SF)
    assert paths == [] and shuffles(clean) == 2  # the first is of the query's own input


def test_answers_are_dealt_out_however_small_they_are(spark):
    rows = pipelines.assembled_rows("pk_summary", pipeline_queries._answers(spark, SF, "pk_summary"), ["doc_id"])
    assert rows.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_cells_of_studies_stay_where_they_are_dealt_out(spark):
    cells = spark.createDataFrame([(1, 0, 0, "Group", "Sub A"), (1, 1, 0, "Group", "Age"), (1, 1, 1, "Exposed", "5")], "doc_id bigint, row_idx int, col_idx int, header string, value string")
    kind, row_kind = F.when(F.col("header") == "Group", "Row headers").otherwise("Exposure"), F.when(F.col("value") == "Age", "Characteristic").otherwise("Subheader")
    records = reshape.matrix_records(inputs.dealt_out(cells, ["doc_id"]), ["doc_id"], kind, row_kind)
    assert shuffles(records) == 1
    assert [r.asDict() for r in records.collect()] == [{"doc_id": 1, "row_idx": 1, "col_idx": 1, "characteristic": "Sub A; Age", "exposure": "Exposed", "outcome": "N/A", "value": "5", "p_value": None}]


def test_study_outcomes_write_their_answers_alone(spark):
    with materialize.recorded() as paths:
        graph_queries.graph_pe_study_outcome(spark, SF)
    assert len(paths) == 1


def test_a_line_separator_is_no_blank_cell(spark):
    cells = ["", " ", "\t\n", "\u2028", "\u0085", "!", "n/a", None, " x", "s.d."]
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(cells)], "i int, c string")
    assert [r.c for r in C.normalized(rows, ["c"]).orderBy("i").collect()] == ["N/A", "N/A", "N/A", "\u2028", "\u0085", "!", "N/A", None, " x", "SD"]
    assert [r.i for r in C.without_errors(rows.withColumn("c", F.when(F.col("i") == 5, "ERROR").otherwise(F.col("c"))), ["c"]).orderBy("i").collect()] == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    assert [r.i for r in C.with_numbers(rows.withColumn("d", F.when(F.col("i") > 6, F.lit("\u0663"))), ["c", "d"]).orderBy("i").collect()] == [7, 8, 9]


def test_summaries_step_by_step_write_their_answers_alone(spark):
    with materialize.recorded() as paths:
        told = graph_queries.graph_pk_summary(spark, SF)
    # answers, the orders that cells are made of, and times
    assert len(paths) == 1 and shuffles(told) == 3


def test_single_patients_step_by_step_shuffle_their_orders_alone(spark):
    with materialize.recorded() as paths:
        told = graph_queries.graph_pk_individual(spark, SF)
    # once for cells, once for answers
    assert paths == [] and shuffles(told) == 2


def test_steps_are_planned_without_each_set_of_their_columns(spark):
    for query in (graph_queries.graph_pk_summary, graph_queries.graph_pk_individual):
        plan = query(spark, SF)._jdf.queryExecution()
        plan.optimizedPlan()
        # what is known of rows below a filter over all columns; the first took 34 s and 2.8 GB
        assert plan.tracker().rules().get("org.apache.spark.sql.catalyst.optimizer.PruneFilters").get().totalTimeNs() < 4e9
