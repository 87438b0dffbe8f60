"""The quality report: what it computes and how often."""

from pyspark.sql import functions as F

from corpusforge.functions import quality as Q


def test_measures_are_computed_once(spark):
    rows = spark.createDataFrame([("t", "x"), ("t", None)], "title string, text string")
    found = Q.report(rows, F.col("title"), F.col("text"))
    plan = found.where("NOT complete").select("score", F.explode("issues").alias("issue"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("human") <= 2  # the one list of patterns that has the word


def test_navigation_lines(spark):
    rows = spark.createDataFrame([("Home | About\nplain words of a text\n\n  首页 登录  \nABOUT us home",), ("",), ("no such line",)], "text string")
    assert [r[0] for r in rows.select(Q.navigation_ratio(F.col("text"))).collect()] == [0.75, 0.0, 0.0]
