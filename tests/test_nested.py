from pyspark.sql import functions as F

from conftest import rows
from tessera.operators.nested import Child, flatten_children, flatten_positions

SCHEMA = "k string, items array<struct<name string, tags array<struct<t int>>>>, parent_id int, pos int"
DATA = [
    ("a", [("x", [(1,), None, (2,)]), None, ("y", None)], 1, 2),
    ("a", [("x", [(1,), None, (2,)]), None, ("y", None)], 1, 2),  # delivered twice
    ("b", [], None, None),
    ("c", None, 3, None),
    (None, [("z", [])], None, None),
]


def test_elements_keep_parent_and_place(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    out = flatten_children(df, "k", Child("items", ("items",), ("name",)))
    assert rows(out) == [("a", 0, "x"), ("a", 2, "y"), (None, 0, "z")]


def test_grandchildren_carry_both_places(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    out = flatten_children(df, "k", Child("tags", ("items", "tags"), ("t",)))
    assert out.columns == ["parent_id", "pos_0", "pos", "t"]
    assert rows(out) == [("a", 0, 0, 1), ("a", 0, 2, 2)]


def test_positions_of_several_sources(spark):
    df = spark.createDataFrame(DATA, SCHEMA)
    out = flatten_positions([(df, "k", [Child("items", ("items",))]), (df.where("k = 'a'"), "k", [Child("again", ("items",))])])
    assert rows(out) == [("again", "a", 0), ("again", "a", 2), ("items", "a", 0), ("items", "a", 2), ("items", None, 0)]


def test_empty_table_keeps_schema(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = flatten_children(df, "k", Child("items", ("items",), ("name",)))
    assert out.columns == ["parent_id", "pos", "name"] and out.count() == 0


def test_plan_has_one_shuffle_and_no_python(spark):
    df = spark.createDataFrame(DATA, SCHEMA).withColumn("extra", F.lit(1))
    plan = flatten_children(df, "k", Child("items", ("items",), ("name",)))._jdf.queryExecution().toString()
    assert "Python" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange hashpartitioning") == 1
