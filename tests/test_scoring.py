from pyspark.sql import functions as F

from tessera.operators import scoring as E
from tessera.operators import tasks as G


def _one(spark, text, answer="", prompt="", task=G.RETRIEVAL):
    df = spark.createDataFrame([(task, text, answer, prompt)], "task string, text string, answer string, prompt string")
    return E.score(df).first().correct


def test_first_int_unicode_digit(spark):
    assert _one(spark, "value ٤٢ here", "٤٢")
    assert not _one(spark, "no digits", "1")


def test_substring_gold(spark):
    assert _one(spark, "12", "1", task=G.AR)


def test_first_line_edge_cases(spark):
    assert not _one(spark, "", "123", task=G.PHONE_BOOK)
    assert not _one(spark, "\n123", "123", task=G.PHONE_BOOK)
    assert _one(spark, "  123 \nmore", "123", task=G.PHONE_BOOK)


def test_topk_zero_and_explanation(spark):
    df = spark.createDataFrame([("Explanation aa bb", "aa bb cc")], "text string, allowed string")
    allowed = F.split("allowed", " ")
    r = df.select(E.top_k_tokens(F.col("text"), allowed, 0).alias("k0"),
                  E.top_k_tokens(F.col("text"), allowed, 2).alias("k2")).first()
    assert r.k0 == [] and r.k2 == []
    df2 = spark.createDataFrame([("bb, aa bb cc Explanation dd", "aa bb cc dd")], "text string, allowed string")
    assert df2.select(E.top_k_tokens(F.col("text"), F.split("allowed", " "), 2)).first()[0] == ["bb", "aa"]


def test_var_set_whole_words(spark):
    df = spark.createDataFrame([("X1 X2, X3a éX4 X5",)], "text string")
    assert df.select(E.var_set(F.col("text"))).first()[0] == ["X1", "X2", "X5"]
