"""Steps that are made of a value name it once in the plan: a tree that repeats it is computed as often."""

from locflow.functions import text as T
from locflow.operators import classify as K
from locflow.plans.flows import split_files


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_value_is_split_from_one_copy_of_each_step(spark):
    df = spark.range(3).selectExpr("concat('<b>x', id, '</b>') AS text")
    p = plan(df.select(T.split_value("text").alias("s")))
    assert p.count("RLIKE") <= 3 and p.count("regexp_extract(") == 3


def test_kinds_and_values_of_literals_are_made_once(spark):
    src = spark.createDataFrame([("a.cs", 'var a = "Open file" + @"c:\\d" + "";')], "path string, content string")
    classified, _, _, _ = split_files(src, K.stoplist(spark))
    p = plan(classified)
    assert p.count("//) THEN comment") == 1         # the kind of a token
    assert p.count(T._PIECES) == 1                  # its value
    assert sorted(r.text for r in classified.collect()) == ["Open file", "c:\\d"]
