"""Rows by hand for what SQL doesn't say, and for the places where results are easily got wrong."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tableweave.functions import scalars as S
from tableweave.functions import similarity as M
from tableweave.operators import cells as T
from tableweave.operators import cleanup as C
from tableweave.operators import codecs, evaluate, positional, reshape, store
from tableweave.plans import batch, pipelines
from tableweave.sources import files, html_tables
from tableweave.streaming.ingest import ingest_new


def values(spark, f, items, schema="x string"):
    rows = [(k, *(i if isinstance(i, tuple) else (i,))) for k, i in enumerate(items)]
    df = spark.createDataFrame(rows, f"k int, {schema}")
    return [r.v for r in df.select("k", f(*[F.col(c) for c in df.columns[1:]]).alias("v")).orderBy("k").collect()]


def test_numbers(spark):
    assert values(spark, S.first_number, ["~7.25", "~-0.5", "81.5x", "none", None, ".25", "b 3 4"]) == [7.25, -0.5, 81.5, None, None, 0.25, 3.0]
    assert values(spark, S.all_numbers, ["~7.25 0.125", "none"]) == [[7.25, 0.125], None]
    assert values(spark, S.pure_integers, ["17 or 230, 2.75, 9%, 9 ％, 0, 17", ".5 2.0"]) == [[17, 230], []]
    given = ["9,876.5", "-7,654,321.0", "+98,765", ",98765", ",98,765", " 31 ", "c,d", ",,9,876"]
    assert values(spark, S.ungrouped_number, given) == ["9876.5", "-7654321.0", "+98765", ",98765", ",98765", "31", "c,d", ",,9876"]


def test_texts(spark):
    assert values(spark, S.without_references, ["a References b REFERENCES c", "none", "references"]) == ["a References b ", "none", ""]
    assert values(spark, S.escaped_braces, ["{a} {{b}} }", "x"]) == ["{{a}} {{b}} }}", "x"]
    assert values(spark, S.short_title, ["", " abc ", "x" * 49, "x" * 50]) == [None, "abc", "x" * 49, "x" * 48 + " ..."]
    assert values(spark, S.without_fences, ["```json\n[1]\n```", "[1]"]) == ["[1]", "[1]"]
    assert values(spark, S.quoted_property_names, ['{a: 1, b_c : "x"}']) == ['{"a": 1, "b_c" : "x"}']
    assert values(spark, S.without_empty_fields, ['{"a": 1, ""}', '{"", "a": 1}']) == ['{"a": 1}', '{ "a": 1}']
    assert values(spark, S.after_thinking, ["<think>x</think> ok", "so [1, 2, 3, 4]", "a long answer [1]"]) == ["ok", "[1, 2, 3, 4]", "a long answer [1]"]
    assert values(spark, S.judge_score, ["[[83.5]] x", "none"]) == [83.5, None]
    assert values(spark, S.without_pipes, ["a|b", "a"]) == ["Content from Table: a-b", "a"]
    assert html_tables.decoded_url("a%2520b&amp;c+d") == "a b&c d"


def test_similarity(spark):
    pairs = [("SD", "standard deviation"), ("", ""), ("", "a"), ("123", "x123"), ("xz", "abc"), (None, "a"), ("ab", "ba")]
    assert values(spark, M.is_abbreviation, pairs, "a string, b string") == [True, True, False, False, False, False, False]
    pairs = [("1.0", "1"), ("a", "a"), (None, None), (None, "text"), (None, "5"), ("12 mg", "12"), ("x", "7"), ("abc", "xyz"), ("3", None)]
    assert values(spark, M.loosely_equal, pairs, "a string, b string") == [True, True, True, True, False, True, False, False, False]
    pairs = [("'A'", "a"), (None, " "), (None, "x"), (None, None)]
    assert values(spark, M.equal_text, pairs, "a string, b string") == [True, True, False, True]
    pairs = [("1.0 mg", "1"), ("x", None), ("1", "2")]
    assert values(spark, M.equal_number, pairs, "a string, b string") == [True, True, False]


NAMES = C.Names()
COLS = ["main_value", "statistics_type", "variation_type", "variation_value", "interval_type", "lower_bound", "upper_bound", "subject_n"]


def frame(spark, rows):
    return spark.createDataFrame([("d", k, *r) for k, r in enumerate(rows)], "doc_id string, row_idx int, " + ", ".join(f"{c} string" for c in COLS))


def test_rules_come_before_normalization(spark):
    df = frame(spark, [("5", "Mean", "SD", "1", "95% CI", "", "", "9"), ("5", "Mean", "SD", "1", "95% CI", "3", "7", "9"), ("3", "N/A", "SD", "N/A", "IQR", "3", "7", "9")])
    got = [tuple(r)[2:] for r in C.normalized(C.rewritten(df, C.value_rules(NAMES)), COLS).orderBy("row_idx").collect()]
    assert got[0] == ("N/A", "N/A", "SD", "1", "Range", "N/A", "N/A", "9")
    assert got[1] == ("5", "Mean", "SD", "1", "Range", "3", "7", "9")
    assert got[2] == ("N/A", "N/A", "N/A", "N/A", "Range", "3", "7", "9")


def test_ranges_split_at_decimals_alone(spark):
    bounds = [("10-20", "N/A"), ("47.5-86.2", "N/A"), ("N/A", "1.5 to 2.5"), ("1.5 2.5", "9")]
    df = frame(spark, [("1", "a", "b", "c", "d", lo, hi, "9") for lo, hi in bounds])
    got = [(r.lower_bound, r.upper_bound) for r in C.split_ranges(df, NAMES).orderBy("row_idx").collect()]
    assert got == [("10-20", "N/A"), ("47.5", "-86.2"), ("1.5", "2.5"), ("1.5 2.5", "9")]


def test_containment_leaves_an_antichain(spark):
    r = random.Random(3)
    rows = [(r.choice("ab"), *[r.choice(["x", "N/A", "y"]) for _ in range(7)]) for _ in range(60)]

    def covered(i, j):
        return all(a in (b, "N/A") for a, b in zip(rows[i], rows[j], strict=True)) and (rows[i] != rows[j] or j > i)

    want = [i for i in range(60) if not any(i != j and covered(i, j) for j in range(60))]
    assert [x.row_idx for x in C.without_contained(frame(spark, rows), ["doc_id"], COLS).orderBy("row_idx").collect()] == want


def test_pairs_merge_greedily(spark):
    df = spark.createDataFrame([("d", 0, "k", "1", "N/A"), ("d", 1, "k", "N/A", "2"), ("d", 2, "k", "N/A", "2"), ("d", 3, "k", "9", "N/A")], "doc_id string, row_idx int, k string, a string, b string")
    got = [(r.row_idx, r.a, r.b) for r in C.merged_pairs(df, ["doc_id"], ["k"], ["k", "a", "b"]).orderBy("row_idx").collect()]
    assert got == [(0, "1", "2"), (2, "9", "2")]


def test_transposing_twice_gives_the_table_again(spark):
    cells = spark.createDataFrame([("t", r, c, f"h{c}", f"{r}{c}") for r, c in itertools.product(range(3), range(4))], "t string, row_idx int, col_idx int, header string, value string")
    assert sorted(map(tuple, T.transpose(T.transpose(cells, ["t"]), ["t"]).collect())) == sorted(map(tuple, cells.collect()))


def test_header_suffixes_may_collide(spark):
    heads = spark.createDataFrame([("t", k, h) for k, h in enumerate(["a", "a", "a_0", "", "Unnamed_4"])], "t string, col_idx int, header string")
    filled = T.fill_empty_headers(heads, ["t"])
    assert [r.header for r in T.deduplicate_headers(filled, ["t"]).orderBy("col_idx").collect()] == ["a_0", "a_1", "a_0", "Unnamed_5", "Unnamed_4"]


def test_uncovered_groups_are_told(spark):
    cells = spark.createDataFrame([("t", 0, c, f"h{c}", "v") for c in range(3)], "t string, row_idx int, col_idx int, header string, value string")
    groups = spark.createDataFrame([("t", [["h0", "h1"], ["h9"]])], "t string, groups array<array<string>>")
    told = T.uncovered(cells, groups, ["t"]).first()
    assert (told.missing, told.unknown) == (["h2"], ["h9"]) and T.split_by_columns(cells, groups, ["t"]).count() == 0


def test_csv_and_json_payloads(spark):
    assert values(spark, codecs.repaired_csv, ["a,b\n1,2,\n3,4\n5,6,7"]) == ["a,b\n1,2\n3,4\n5,6,7"]
    codes = {"DN": "Drug name", "V": "Value"}
    assert values(spark, lambda x: codecs.json_rows_to_csv(x, codes), ['[{"dn": "a,b", "V": "1"}, {"DN": "c"}]']) == ["Drug name, Value\na b, 1\nc, "]


def test_names_are_matched_by_likeness(spark):
    df = spark.createDataFrame([("a", 1), ("Subject n", 2), (None, 3), ("zzz", 4)], "`Drug nam` string, other int")
    assert C.fuzzily_renamed(df, ["Drug name", "Subject N"]).columns == ["Drug name", "other"]
    got = C.resolved_names(df, "Drug nam", ["Drug name", "Subject N"]).orderBy("other").collect()
    assert [r[0] for r in got] == [None, "Subject N", None, None]
    assert values(spark, S.column_definitions, [(["a", "b"], ["x", "y"])], "n array<string>, d array<string>") == ["a: x\nb: y"]


def test_parameters_are_aligned(spark):
    cells = spark.createDataFrame([(t, r, c, f"h{c}", f"{r}{c}") for t, r, c in itertools.product("ab", range(2), range(2))], "t string, row_idx int, col_idx int, header string, value string")
    told = reshape.aligned_parameters(cells, ["t"], spark.createDataFrame([("a", "h1"), ("b", None)], "t string, column string"))
    heads = {(r.t, r.col_idx, r.header) for r in told.collect()}
    assert heads == {("a", 0, "h0"), ("a", 1, "Parameter type"), ("b", 0, "Parameter type"), ("b", 1, "00"), ("b", 2, "10")}
    wide = spark.createDataFrame([("a", 0, "x", "1 mg")], "t string, row_idx int, name string, dose string")
    parsed = spark.createDataFrame([("a", 0, "1", "mg")], "t string, row_idx int, amount string, unit string")
    assert reshape.replaced_column(wide, ["t"], "dose", parsed, ["amount", "unit"]).columns == ["t", "row_idx", "name", "amount", "unit"]


def test_decision_vectors(spark):
    v = lambda f, items: values(spark, f, items, "m array<int>, n int")
    assert v(positional.repaired_match, [([-1, 1], 2), ([2], 2)]) == [[0, 1], None]
    assert v(positional.known_matches, [([0, 1, 5], 2), ([5], 2)]) == [[0, 1], [5]]
    w = lambda f, items: values(spark, f, items, "m array<string>, n int")
    assert w(positional.fitted, [(["a"], 3), (["a", "b"], 1)]) == [["a", "N/A", "N/A"], ["a"]]
    assert w(positional.spread, [(["a", "a"], 3), (["a", "b"], 3)]) == [["a"] * 3, ["a", "b"]]
    maps = lambda m, n: positional.header_categories_fault(m, n, "Parameter type")
    assert values(spark, maps, [({"a": "Parameter type"}, 1), ({"a": "x"}, 1), ({"a": "x"}, 2)], "m map<string,string>, n int") == [None, "Parameter type count", "column count"]


def match_brute(row, rows, anchors):
    """The narrowing of anchors over equal texts, said with plain loops."""
    hits, left = [], list(range(len(rows)))
    for a in anchors:
        if not row[a].strip():
            continue
        hits = [k for k in left if rows[k][a] == row[a]]
        if len(hits) == 1:
            break
        left = hits or list(range(len(rows)))
    return hits[0] if hits else -1


def test_anchor_matching(spark):
    r = random.Random(5)
    word = lambda: r.choice(["", "alpha", "bravo", "kilo"])
    tables = [([(word(), word(), word())], [(word(), word(), word()) for _ in range(4)]) for _ in range(60)]
    to_struct = "struct<a: string, b: string, c: string>"
    df = spark.createDataFrame([(k, row[0], rows) for k, (row, rows) in enumerate(tables)], f"k int, r {to_struct}, rows array<{to_struct}>")
    got = [x.at for x in df.select("k", evaluate.best_anchor_match(F.col("r"), F.col("rows"), ["a", "b", "c"]).alias("at")).orderBy("k").collect()]
    named = lambda t: dict(zip("abc", t, strict=True))
    assert got == [match_brute(named(row[0]), [named(x) for x in rows], "abc") for row, rows in tables]


def test_scores(spark):
    rows = lambda items: spark.createDataFrame([("p", k, *i) for k, i in enumerate(items)], "pmid string, row_idx int, a string, v string")
    rated = [("a", False, 1.0), ("v", True, 1.0)]
    same = rows([("x", "1"), ("y", "2")])
    score = lambda b, t: evaluate.score_tables(b, t, ["pmid"], ["a"], rated).first().score
    assert score(same, same) == 100
    assert score(same, rows([("x", "1")])) == 90  # one row more than the other: one point of eleven
    assert score(same, rows([("x", "1"), ("kkk", "2")])) == 50


def test_store(spark, tmp_path):
    s = store.CurationStore(spark, f"{tmp_path}/store")
    assert s.count() == 0
    row = lambda pmid, text: spark.createDataFrame([(pmid, "pk", text)], "pmid string, curation_type string, md_table string")
    s.upsert(row("1", "a"))
    s.upsert(row("1", "b"))
    assert s.count() == 1 and s.get("1", "pk").first().md_table == "b"
    assert not s.update(row("2", "x")) and s.update(row("1", "c"))
    assert s.by_type("pk").first().md_table == "c" and s.by_pmid("1").count() == 1
    assert s.delete(row("1", "")) and s.count() == 0 and not s.delete(row("1", ""))


def test_stream_of_new_rows(spark, tmp_path):
    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string").write.parquet(src)
    run = lambda: ingest_new(spark.readStream.schema("id int, v string").parquet(src), out, f"{tmp_path}/state", ["id"]).awaitTermination()
    run()
    spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string").write.mode("append").parquet(src)
    run()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [(1, "a"), (2, "b"), (3, "d")]


PAGE = """<html><body><div class="page-title"><h1>A <b>paper</b></h1></div><h2>Abstract</h2><p>First line.</p><p>First line.</p>
<h2>Results</h2><p>Some text<div class="wrap"><h3>Table 1. Levels</h3><table><tr><th>Name</th><th colspan=2>Dose</th></tr><tr><th>x</th><th>low</th><th>high</th></tr>
<tr><td rowspan=2>A</td><td>1<sup>-1</sup></td><td>2</td></tr><tr><td>3</td><td colspan="50%">4</td></tr></table><p class="footnote">a note</p></div>
<h2>References</h2><p>none</p></body></html>"""


def test_pages(spark):
    page = html_tables.page_of(PAGE)
    assert page["title"] == "A paper" and page["abstract"] == "First line."
    (t,) = page["tables"]
    assert t["headers"] == ["Name.x", "Dose.low", "Dose.high"] and t["rows"] == [["A", "1", "2"], ["A", "3", "4"]]
    assert t["footnote"] == "a note" and t["caption"] == "Table 1. Levels"
    assert [s["section"] for s in page["sections"]][:2] == ["Abstract", "Results"] and "none" not in str(page["sections"])
    script = '<script>x.data = {"tables": [{"title": "T", "content": "<table><tr><th>a</th></tr><tr><td>1</td></tr></table>"}]};</script>'
    assert html_tables.page_of(script)["tables"][0]["caption"] == "T"
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "id int, html string")
    assert html_tables.page_tables(html_tables.parse_pages(df, ["id"]), ["id"]).count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "123_gpt4o.csv").write_text("﻿a,b\n1,﻿2\n")
    (tmp_path / "b" / "123_other.csv").write_text("a\n1\n")
    (tmp_path / "m.csv").write_text("pmid,html_path\n1,x.html\n,\n2,/abs.html\n")
    assert [(r.pmid, r.model) for r in files.benchmark_files(spark, str(tmp_path), ["gpt4o"]).collect()] == [("123", "gpt4o")]
    df = files.read_csv(spark, f"{tmp_path}/b/123_gpt4o.csv")
    assert df.columns == ["a", "b"] and tuple(df.first()) == ("1", "2")
    assert [tuple(r) for r in files.manifest(spark, f"{tmp_path}/m.csv", "/base").orderBy("pmid").collect()] == [("1", "/base/x.html"), ("2", "/abs.html")]
    assert [r.pmid for r in files.pmid_list(spark, "1, 2,,3").collect()] == ["1", "2", "3"]
    assert files.result_folder("a/b", "base") == "a_b-base"


def test_summary_rows_from_decisions(spark):
    answers = {
        "param_value": '[["1","Mean","SD","2","N/A","N/A","N/A","N/A"],["3","Mean","SD","4","N/A","N/A","N/A","0.05"]]',
        "param_type_unit": '[["AUC","h"],["Cmax","ng"]]',
        "time_unit": '[["0","h"],["1","h"]]',
        "drug_info": '[["A","a","plasma"],["B","b","urine"]]',
        "drug_match": "[1,7]",
        "patient_info": '[["women","N/A","N/A","12"]]',
    }
    decisions = spark.createDataFrame([("d", k, v) for k, v in answers.items()], "doc_id string, step string, payload string")
    rows = pipelines.summary_rows(decisions, ["doc_id"]).orderBy("row_idx").collect()
    assert [(r["Drug name"], r["Population"], r["Subject N"], r["Parameter type"], r["Parameter value"], r["P value"], r["Time value"]) for r in rows] == [
        ("B", "women", "12", "AUC", "1", "N/A", "0"), ("ERROR", "women", "12", "Cmax", "3", "0.05", "1"),
    ]
    assert rows[0].asDict().keys() == {"doc_id", "row_idx", *pipelines.OUTPUTS["pk_summary"]}


@pytest.mark.parametrize("name", sorted(pipelines.OUTPUTS))
def test_output_columns_are_distinct(name):
    assert len(set(pipelines.OUTPUTS[name])) == len(pipelines.OUTPUTS[name])


def test_abbreviations_that_fail_late_fail_fast(spark):
    assert values(spark, M.is_abbreviation, [("a" * 9 + "b", "a" * 400), ("abc", "a\nxb\nc")], "a string, b string") == [False, True]


def test_null_anchors_count_as_missing_numbers(spark):
    rows = spark.createDataFrame([("t", 0, None, "x"), ("t", 1, "k", "y")], "doc_id string, row_idx int, anchor string, v string")
    other = spark.createDataFrame([("t", 0, "word", "x"), ("t", 1, "k", "y")], "doc_id string, row_idx int, anchor string, v string")
    # a missing number equals every text that isn't a number, so the first row matches both and takes the first
    assert [r.score for r in evaluate.score_tables(rows, other, ["doc_id"], ["anchor"], [("v", False, 1.0)]).collect()] == [100]
    wider = other.withColumn("more", F.lit(1))
    assert [r.score for r in evaluate.score_tables(rows, wider, ["doc_id"], ["anchor"], [("v", False, 1.0)]).collect()] == [0]
    assert [(r.less_rows, r.score) for r in evaluate.score_tables(rows, other.limit(0), ["doc_id"], ["anchor"], [("v", False, 1.0)]).collect()] == [(0, 0)]


def test_chosen_tables(spark):
    tables = spark.createDataFrame([("p", k) for k in range(3)], "pmid string, table_id int")
    pick = lambda *k: spark.createDataFrame([("p", list(k))], "pmid string, indices array<int>")
    assert sorted(r.table_id for r in positional.chosen(pick(2, 0, 2), tables, ["pmid"]).collect()) == [0, 2]
    with pytest.raises(Exception, match="no table 3"):
        positional.chosen(pick(1, 3), tables, ["pmid"]).collect()


def test_captions_and_pages_from_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.json").write_text('{\n"caption": "Table 1", "footnote": null}')
    assert [(r.caption, r.footnote) for r in files.captions(spark, str(tmp_path / "c")).collect()] == [("Table 1", None)]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "1.html").write_text("<p>a\nb</p>")
    assert [r.html for r in files.html_files(spark, str(tmp_path / "h")).collect()] == ["<p>a\nb</p>"]


def test_csv_texts_that_cannot_be_tables(spark):
    docs = spark.createDataFrame([(0, 'a,b\n1,"x, y"\n3'), (1, "a\n1,2"), (2, None), (3, "")], "k int, csv string")
    got = [(r.valid, r.headers, r.rows) for r in codecs.from_csv_texts(docs, ["k"]).orderBy("k").collect()]
    assert got == [(True, ["a", "b"], [["1", "x, y"], ["3", ""]]), (True, None, None), (True, None, None), (True, None, None)]


def test_pipelines_that_are_not_known(spark):
    with pytest.raises(ValueError, match="no pipeline"):
        pipelines.curated("other", spark.createDataFrame([], "doc_id long, step string, payload string"), ["doc_id"])


def test_scratch_is_given_back(spark):
    import os

    from tableweave.plans import materialize

    with materialize.recorded() as paths:
        table = materialize.cut(spark.range(3).toDF("k"), "test")
    place = paths[0].removeprefix("file://")
    assert table.count() == 3 and os.path.isdir(place)
    materialize.dropped(table)
    assert not os.path.exists(place)


def test_file_readers_and_writers(spark, tmp_path):
    for pmid, name, html in (("11", "2024-01.html", "<p>old\n</p>"), ("11", "2024-02.html", "<p>new\nest</p>"), ("12", "a.html", "x")):
        (tmp_path / "pages" / pmid).mkdir(parents=True, exist_ok=True)
        (tmp_path / "pages" / pmid / name).write_text(html)
    assert sorted((r.pmid, r.html) for r in files.saved_pages(spark, str(tmp_path / "pages")).collect()) == [("11", "<p>new\nest</p>"), ("12", "x")]
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, " "), (3, "c")], "n int, v string")
    assert sorted(r.v for r in files.first_column_list(rows, "n", "v").collect()) == ["a", "b"]
    assert values(spark, files.benchmark_kind, ["/x/pk-summary/y.csv", "/x/pe/y.csv", "/x/other/y.csv"]) == ["pk-summary", "pe", None]
    assert files.result_folder("a/b", "c") == "a_b-c"
    told = spark.createDataFrame([("1", "pk", "v", None), ("2", "pk", None, "failed")], "pmid string, pipeline string, value string, error string")
    files.write_curated(told, str(tmp_path / "out"))
    assert [(r.value, r.pmid) for r in spark.read.option("header", True).csv(str(tmp_path / "out" / "tables")).collect()] == [("v", 1)]
    assert [r.error for r in spark.read.json(str(tmp_path / "out" / "errors")).collect()] == ["failed"]
    scores = spark.createDataFrame([("m", "1", 80)], "model string, pmid string, score int")
    for _ in range(2):
        files.append_scores(scores, str(tmp_path / "log"))
    assert spark.read.csv(str(tmp_path / "log")).count() == 2
    (tmp_path / "t.csv").write_text("\ufeffa,b\n1,2\n")
    files.rewritten_copy(spark, str(tmp_path / "t.csv"), str(tmp_path / "copy"), lambda df: df.withColumn("b", F.lit("z")))
    assert [(r.a, r.b) for r in spark.read.option("header", True).csv(str(tmp_path / "copy")).collect()] == [("1", "z")]
    assert (tmp_path / "t.csv").read_text() == "\ufeffa,b\n1,2\n"


def test_small_text_and_column_functions(spark):
    df = spark.createDataFrame([(["1", "2"], ["h", "h"]), (["1", "2"], ["h", "d"])], "t array<string>, u array<string>")
    time, unit = positional.collapsed_times(F.col("t"), F.col("u"))
    assert [tuple(r) for r in df.select(time, unit).collect()] == [("1, 2", "h"), (None, None)]
    sections = spark.createDataFrame([([("A", "x"), ("B", "y")],)], "s array<struct<section: string, content: string>>")
    assert sections.select(S.joined_sections(F.col("s")).alias("v")).first().v == "A\nx\nB\ny"
    prompt = spark.createDataFrame([(1, "cap", "| a |", "")], "i int, c string, t string, f string")
    assert prompt.select(S.table_prompt(*[F.col(c) for c in "ictf"]).alias("v")).first().v == "Table 1\ncaption: cap\ntable: | a |"
    assert C.renamed(spark.createDataFrame([(1, 2)], "a int, b int"), {"a": "x"}, ["b", "x"]).columns == ["b", "x"]
    assert values(spark, M.text_similarity, [("SD", "standard deviation"), ("ab 1", "ba 2"), ("Same", "same"), ("x", "y")], "a string, b string") == [1.0, 0.0, 1.0, 0.0]


def test_batch_rows_as_files(spark, tmp_path):
    columns = pipelines.OUTPUTS["pk_specimen_summary"]
    rows = spark.createDataFrame([("7", 0, *["x"] * len(columns)), ("9", 0, *[None] * len(columns))], ["pmid", "row_idx", *columns])
    files.write_curated(batch.batch_files("pk_specimen_summary", rows), str(tmp_path / "out"))
    told = spark.read.option("header", True).csv(str(tmp_path / "out" / "tables"))
    assert {(r.pmid, r.pipeline, r.Specimen) for r in told.collect()} == {(7, "pk_specimen_summary", "x"), (9, "pk_specimen_summary", None)}


def test_answers_are_asked_for_once_a_type_column(spark):
    tables = spark.createDataFrame([("d", 2, "a"), ("d", 1, "a"), ("d", 3, None), ("e", 5, "a")], "doc_id string, table_id int, kind string")
    assert {tuple(r) for r in positional.unanswered(tables, ["doc_id"], "kind").collect()} == {("d", 1, "a"), ("d", 3, None), ("e", 5, "a")}
    answers = spark.createDataFrame([("d", "a", "x")], "doc_id string, kind string, answer string")
    got = {(r.doc_id, r.table_id, r.answer) for r in positional.reused(tables, answers, ["doc_id"], "kind").collect()}
    assert got == {("d", 1, "x"), ("d", 2, "x"), ("d", 3, None), ("e", 5, None)}
