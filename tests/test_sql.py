import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from epistride.functions import arrays as A
from epistride.functions import sql
from epistride.functions import values as V
from epistride.operators import labels, sequence
from epistride.plans import views

SF = "/root/testdata/sf0.001"


def plan(df):
    """The optimized plan without numbers of expressions and names of lambda variables, which differ where a body is used twice."""
    text = re.sub(r"[#=]\d+L?|\[id[^\]]*\]|plan_id\S*", "", df._jdf.queryExecution().optimizedPlan().toString())
    return re.sub(r"lambda \w+", "lambda v", text)


@pytest.fixture(scope="module")
def lines(spark):
    line = "array<struct<x:double,y:double>>"
    rows = [([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], [1, 1, 2], [1, 2, 2], " Yes", 4.0), ([(1.0, 2.0)], [], [1], "0", float("nan")), ([], [3], [3], "maybe", float("inf")),
            ([(0.0, 0.0), (0.0, 0.0)], [5, 6], [6, 5], "", -4.0), (None, None, None, None, None)]
    spark.createDataFrame(rows, f"l {line}, a array<int>, b array<int>, t string, x double").createOrReplaceTempView("sql_lines")
    sql.install(spark)
    return spark.table("sql_lines")


CASES = {
    "finite(x)": lambda: V.finite(F.col("x")), "number(t)": lambda: V.number(F.col("t")), "truth(t)": lambda: V.truth(F.col("t")), "strict_truth(t)": lambda: V.truth(F.col("t"), True),
    "progress(x, 2.0D)": lambda: V.progress(F.col("x"), 2.0), "entropy(a)": lambda: A.entropy(F.col("a")), "hamming(a, b)": lambda: A.hamming(F.col("a"), F.col("b")), "segments(l)": lambda: A.segments(F.col("l")),
    "path_length(l)": lambda: A.length(F.col("l")), "chord(l)": lambda: A.chord(F.col("l")), "straightness(l)": lambda: A.straightness(F.col("l")), "curvature(l)": lambda: A.curvature(F.col("l")),
    "spread(l)": lambda: A.spread(F.col("l")), "direction(l)": lambda: A.direction(F.col("l")), "wrapped(x)": lambda: A.wrapped(F.col("x")),
}


def test_every_function_is_tested():
    assert {c.split("(")[0] for c in CASES} == set(sql.SCALARS)


@pytest.mark.parametrize("call", CASES)
def test_scalar_functions_are_those_of_python(spark, lines, call):
    one, other = spark.sql(f"SELECT {call} AS y FROM sql_lines"), lines.select(CASES[call]().alias("y"))
    assert str(one.collect()) == str(other.collect())
    assert plan(one) == plan(other)


def test_table_functions(spark):
    views.steps(spark, SF).createOrReplaceTempView("sql_steps")
    rows = spark.table("sql_steps")
    scored = rows.select("episode_key", "step_id", (F.col("value") / 1000).alias("score"), F.lit(0.2).alias("threshold"))
    scored.createOrReplaceTempView("sql_scores")
    names = sql.install(spark, "sql_steps", scores="sql_scores", window=5, min_start=3, eps=0.05)
    assert names[-3:] == ["plateau_onsets", "online_labels", "detector_alerts"]
    each = lambda df: sorted(map(tuple, df.collect()), key=str)
    onsets, want = spark.sql("SELECT * FROM plateau_onsets()"), sequence.plateau_onset(rows, "p", 5, 0.05, 3)
    assert each(onsets) == each(want) and any(r.onset is not None for r in onsets.collect())
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert exchanges(onsets) == exchanges(want)
    found = labels.online_labels(sequence.with_onset(rows, "p", 5, 0.05, 3)).select("episode_key", "step_id", "onset", "horizon", "valid", "label")
    assert each(spark.sql("SELECT * FROM online_labels()")) == each(found)
    alerts = labels.detector_alerts(F.col("score"), F.col("threshold"), Window.partitionBy("episode_key").orderBy("step_id"))
    assert each(spark.sql("SELECT * FROM detector_alerts()")) == each(scored.withColumns(alerts))
    spark.sql("SELECT * FROM sql_steps LIMIT 0").createOrReplaceTempView("sql_steps_empty")
    sql.install(spark, "sql_steps_empty")
    assert spark.sql("SELECT * FROM plateau_onsets()").count() == 0
