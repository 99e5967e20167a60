"""Sources and sinks on small files."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException

from quillon.sources import jsonl as J


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("é a", "x::b", "k", "train"), ("c", "y::d", "l", "test")], "text string, label string, _key string, split string")
    J.write_jsonl(rows, str(tmp_path / "out"), "split")
    got = J.read_jsonl(spark, str(tmp_path / "out" / "split=train"), "intent")
    assert [tuple(r) for r in got.collect()] == [("é a", "x::b")]
    with pytest.raises(PySparkException):
        J.write_jsonl(rows, str(tmp_path / "out"))


def test_bad_line_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "a", "label": "b"}\n\n{"text": \n')
    with pytest.raises((PySparkException, Py4JJavaError)):  # the failure of a task may reach the driver as it is
        J.read_jsonl(spark, str(tmp_path / "a.jsonl"), "intent").collect()


def test_nested(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, "{broken"), (3, '{"a": 3}')], "id long, state string")
    good, skipped = J.parse_nested(rows, {"state": "a int"})
    assert sorted((r.id, r.state.a) for r in good.collect()) == [(1, 1), (3, 3)] and skipped.first().skipped == 1


def test_latest_and_answered(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, " ")], "source string, v int, answer string")
    assert sorted(map(tuple, J.latest_by(rows, "source", "v").collect())) == [("a", 2, "y"), ("b", 1, " ")]
    assert J.answered(rows, rows, answer="answer").count() == 4


def test_log_tail(spark, tmp_path):
    (tmp_path / "old.log").write_text("x\n")
    (tmp_path / "train.log").write_text("a\nb\nc\n")
    (tmp_path / "dashboard.log").write_text("self\n")
    assert [r.line for r in J.log_tail(spark, str(tmp_path), 2).collect()] == ["c", "b"]


def test_append_and_versions(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "text string, _n int")
    J.append_jsonl(rows, str(tmp_path / "log"))
    J.append_jsonl(rows, str(tmp_path / "log"))
    got = spark.read.json(str(tmp_path / "log"))
    assert got.columns == ["text"] and got.count() == 2
    out = str(tmp_path / "corpus")
    more = rows.unionByName(rows)
    assert J.write_filtered(rows, out, first=more).endswith("version=1")
    assert J.write_filtered(rows, out, first=rows).endswith("version=2")
    assert spark.read.json(out + "/unfiltered").count() == 2  # kept once, as it first was


def test_append_stream(spark, tmp_path):
    spark.createDataFrame([(1,), (2,)], "step long").write.json(str(tmp_path / "in"))
    for _ in range(2):  # a restart adds nothing twice
        stream = spark.readStream.schema("step long").json(str(tmp_path / "in"))
        J.append_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 2
