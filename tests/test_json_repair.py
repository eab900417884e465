from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from tableweave.functions.json_repair import first_fault, repaired_answers, surely_whole
from tableweave.plans import decision_queries


def faults(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    return [r.f for r in df.select("i", first_fault(F.col("t")).alias("f")).orderBy("i").collect()]


def test_a_text_is_at_fault_where_the_standard_library_says(spark):
    r = random.Random(2)

    def value(depth=0):
        kind = r.randint(0, 7 if depth < 3 else 4)
        if kind > 5:
            return {"".join(r.choices('ab"\\é', k=2)) + str(k): value(depth + 1) for k in range(r.randint(0, 3))}
        return [r.choice([1, -2.5, 1e30, 0]), "te\"x\\t{}[],:", None, True, "é ", [value(depth + 1) for _ in range(r.randint(0, 3))] if depth < 3 else 3][min(kind, 5)]

    whole = [json.dumps(value(), ensure_ascii=r.random() < 0.5) for _ in range(60)] + [" 1 ", "[ ]", "{ }", '"\\u00e9"']
    texts = list(whole)
    for t in whole:
        k = r.randint(0, len(t))
        texts += [t[:k], t[:k] + r.choice('x,}]{["') + t[k:], t + " x"]
    texts += ["", " ", "[1 2]", '{"a" 1}', "{1: 2}", "tru", "[01]", '"\\x"', '"a\nb"', "[1]]", '{"a": }', '{"a": 1, "b"', "nul l"]
    for text, got in zip(texts, faults(spark, texts), strict=True):
        try:
            json.loads(text)
            want = None
        except json.JSONDecodeError as e:
            want = e.pos
        assert (got is None) == (want is None), (text, got, want)
        # places may differ where a number or word breaks off, a list ends in a comma or an escape is cut
        if want is not None and not any(x in text for x in (",]", ", ]", ",}", ", }", "\\")) and not (set(text[max(0, min(got, want) - 1) : max(got, want) + 1]) & set("0123456789.-+eEtrufalsn")):
            assert got == want, (text, got, want)


def test_three_forms_of_answers(spark):
    whole = ['[{"aaa": "...", "bbb": "..."}, {"aaa": "...", "bbb": ', '"..."}]']
    anew = ['[{"aaa": "...", "bbb": "..."}, {"aaa": "...", "bbb": ', '[{"aaa": "...", "bbb": "..."}]']
    broken = ['[{"a": "1", "b": "x"}, {"a": "2", "b": "y"}, {"a": "3', '"and": {"a": "4", "b": "z"}, {"a": "5", "b": "w"}]']
    cases = [(whole, 2, False), (anew, 2, True), (broken, 4, True), (['[{"a": 1}, {"a": 2'], 1, True), ([None, '[{"a": 1}]'], 1, False)]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "i int, p array<string>")
    for row, (_, n, cut) in zip(df.select("i", repaired_answers(F.col("p")).alias("r")).orderBy("i").collect(), cases, strict=True):
        assert len(json.loads(row.r.text)) == n and row.r.truncated == cut
    odd = spark.createDataFrame([(0, []), (1, [None]), (2, ["not json"]), (3, None)], "i int, p array<string>").select("i", repaired_answers(F.col("p")).alias("r")).orderBy("i").collect()
    assert [x.r and x.r.text for x in odd][:2] == ["", ""] and len(odd) == 4


def test_long_text(spark):
    text = json.dumps([{"k": "v" * 50, "n": k} for k in range(3000)])
    assert faults(spark, [text, text[:-1]]) == [None, len(text) - 1]


def test_most_whole_texts_are_told_without_the_fold(spark):
    whole = ['[{"a": "x{,\\n\\u00e9", "b": -1.5e3}, {"c": [1, {"d": null}], "e": {}}]', "[]", ' "a" ', "NaN", '[true,false]', "[" * 5 + "]" * 5]
    broken = ['["a" "b"]', "[1 2]", "[1true]", '["a"true]', '{"a" 1}', '{1: 2}', "[01]", '["\\x"]', '["a\nb"]', "[1,]", "\x01", "[\x02]", '["]', '[""", ""]', "[1]]", "", '["a]', "+1", "[1.]", "tru", '{"a": {]}', "\u00a0[1]"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(whole + broken)], "i int, t string")
    got = df.select("i", surely_whole(F.col("t")).alias("w"), first_fault(F.col("t")).alias("f")).orderBy("i").collect()
    assert [r.w for r in got] == [True] * len(whole) + [False] * len(broken)
    assert [r.f is None for r in got] == [r.w for r in got]
    deep = "[" * 9 + '"' + "\\n" * 60 + '"' + "]" * 9
    long = json.dumps([{"k": "v" * 50, "n": [k]} for k in range(30000)])
    assert faults(spark, [deep, deep[:-1], long]) == [None, len(deep) - 1, None]


def test_repaired_answers_are_dealt_out(spark):
    df = decision_queries.repaired_answers(spark, "/root/testdata/sf0.001")
    assert df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
