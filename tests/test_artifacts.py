import json

import pytest

from conftest import rows
from tessera.functions import salvage
from tessera.sources import files
from tessera.streaming import memory


def test_jsonl_strict_and_lenient(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n{"a": bad\n', encoding="utf-8")
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string").collect()
    assert rows(files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int, b string", strict=False)) == [(1, "x"), (2, None)]
    assert files.read_jsonl(spark, str(tmp_path / "none"), "a int", missing_ok=True).count() == 0


def test_json_arrays_and_cases(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"category": "q", "cases": [{"id": "1", "title": "é"}, {"id": "2"}]}), encoding="utf-8")
    (tmp_path / "r.json").write_text(json.dumps({"category": "r", "cases": [{"id": "3"}]}), encoding="utf-8")
    schema = "category string, cases array<struct<id string, title string>>"
    assert rows(files.read_cases(spark, str(tmp_path), schema)) == [("q", 0, "1", "é"), ("q", 1, "2", None), ("r", 0, "3", None)]
    assert rows(files.read_cases(spark, str(tmp_path), schema, "r")) == [("r", 0, "3", None)]
    (tmp_path / "f.json").write_text('[{"id": 1}, {"id": 2}]', encoding="utf-8")
    assert rows(files.read_json_array(spark, str(tmp_path / "f.json"), "id int")) == [(1,), (2,)]


def test_xml_with_corrupt_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<r><Document id='a'><n>1</n></Document><Document id='b'><n>two</n></Document></r>", encoding="utf-8")
    good, bad = files.read_xml(spark, str(tmp_path / "a.xml"), "Document", "_id string, n int")
    assert rows(good) == [("a", 1)] and "two" in bad.first()[0]


def test_upsert_takes_the_last_change(spark):
    target = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (None, "n", 0)], "k int, v string, t int")
    changes = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1), (None, "m", 1)], "k int, v string, t int")
    assert rows(files.upsert(target, changes, "k", "t")) == [(1, "a", 0), (2, "d", 2), (3, "e", 1), (None, "m", 1), (None, "n", 0)]
    assert rows(files.upsert(target, changes.limit(0), "k", "t")) == rows(target)


def test_sync_policies(spark):
    old, new = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    assert rows(files.sync_plan(old, new, "id", "skip")) == [("a", "skip"), ("b", "create")]
    with pytest.raises(ValueError):
        files.sync_plan(old, new, "id", "other")


def test_run_log(spark, tmp_path):
    run = spark.createDataFrame([(1, "m", 0.5)], "at int, metric string, value double")
    files.append_run(spark, str(tmp_path / "log"), run)
    assert files.append_run(spark, str(tmp_path / "log"), run).count() == 2


@pytest.mark.parametrize("text, want", [
    ('x {"a": {"b": "}"}} y {"c": 1}', ['{"a": {"b": "}"}}', '{"c": 1}']), ('{"a": [1, 2,],}', ['{"a": [1, 2]}']), ("{not json}", []), ('{"a": "\\"{"}', ['{"a": "\\"{"}']), ("{ {", []), ("", []), (None, []),
])
def test_objects_in_text(text, want):
    assert salvage.objects(text) == want


def test_flattened_paths():
    assert salvage.flattened({"a": {"b": [1, None, {"c": True}]}, "d": "x"}) == ["a.b[0]: 1", "a.b[2].c: true", "d: x"]


def test_rolling_memory(spark, tmp_path):
    data = [(1, 1, "q1", "a1"), (1, 2, "q2", None), (2, 1, "x", "y"), (1, 3, "q3", "a3" * 400)]
    df = spark.createDataFrame(data, "conv_id long, turn long, question string, answer string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = memory.rolling_memory(stream).writeStream.format("memory").queryName("notes").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.conv_id, r.turn): r.summary for r in spark.table("notes").collect()}
    assert got[(1, 2)] == "Q: q1 A: a1 | Q: q2 A:" and got[(2, 1)] == "Q: x A: y" and len(got[(1, 3)]) == memory.MEMORY_CHARACTERS


def test_incremental_upsert_and_compaction(spark, tmp_path):
    schema = "k int, v string, t int"
    for i, part in enumerate([[(1, "a", 1), (2, "b", 1)], [(1, "c", 3), (1, "old", 2), (None, "n", 1)], [(3, "d", 1)]]):
        spark.createDataFrame(part, schema).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        memory.incremental_upsert(stream, str(tmp_path / "log"), "k", "t", str(tmp_path / "state")).awaitTermination()
    want = [(1, "c", 3), (2, "b", 1), (3, "d", 1), (None, "n", 1)]
    assert rows(memory.current_table(spark, str(tmp_path / "log"), "k", "t")) == want
    assert rows(memory.compact(spark, str(tmp_path / "log"), str(tmp_path / "new"), "k", "t")) == want


@pytest.mark.parametrize("text, want", [
    ('{ {"a": 1} and {"b": 2}', ['{"a": 1}', '{"b": 2}']), ('{"x": "cut\n{"c": 3}', ['{"c": 3}']), ('} {"a": {"b": 1}} }', ['{"a": {"b": 1}}']), ('"{"\n{"a": 1}', ['{"a": 1}']),
])
def test_objects_after_unclosed_ones(text, want):
    assert salvage.objects(text) == want
    assert len(salvage.objects("{" * 200_000)) == 0  # one pass


def test_marked_blocks():
    text = 'Data metadata: {"document_id": "a",}\nData  metadata:\nnothing here data metadata: {"b": }'
    found = salvage.marked_blocks(text)
    assert [f[0] for f in found] == ['{"document_id": "a"}', None, None] and found[2][1] == '{"b": }'
