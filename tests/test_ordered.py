from pyspark.sql import functions as F

from conftest import rows
from tessera.operators import ordered as O


def test_keep_first_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, None, 1), (4, None, 1), (5, "a", 2)], "id int, x string, y int")
    assert rows(O.keep_first(df, [F.col("x"), F.col("y")], ["id"]).select("id")) == [(1,), (3,), (5,)]
    assert O.keep_first(df.limit(0), [F.col("x")], ["id"]).count() == 0


def test_carry_forward_resets(spark):
    df = spark.createDataFrame([(1, "A", False), (2, None, False), (3, None, True), (4, "B", None), (5, None, False)], "i int, v string, r boolean").withColumn("p", F.lit(1))
    out = O.carry_forward(df, ["p"], ["i"], F.col("r"), F.col("v"), "c").select("i", "c")
    assert rows(out) == [(1, "A"), (2, "A"), (3, None), (4, "B"), (5, "B")]


def test_majority_is_null_on_a_tie(spark):
    df = spark.createDataFrame([("f", 1, "a"), ("f", 2, None), ("f", 3, "b"), ("f", 4, "b"), ("g", 1, "a"), ("g", 2, None), ("g", 3, "b"), (None, 1, None)], "f string, p int, d string")
    out = {(r.f, r.p): r.m for r in O.majority_around(df, ["f"], "p", "d", 2, "m").collect()}
    assert out[("f", 2)] == "b" and out[("g", 2)] is None and out[(None, 1)] is None and len(out) == 8


def test_pick_or_null(spark):
    df = spark.createDataFrame([("k", "a", 2), ("k", "b", 1), ("m", "a", 1), ("m", "b", 1)], "k string, v string, s int")
    assert rows(O.pick_or_null(df, "k", "v", "s", "x")) == [("k", "a"), ("m", None)]
