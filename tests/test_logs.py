"""Byte ranges of logs, tails, streams that go on after a restart, and a sink that is killed between write and commit."""

import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quillon.sources import logs as L
from quillon.sources import metrics as M


def lines_of(data: bytes):
    return [x.removesuffix(b"\r").decode("utf-8", "replace") for x in (data[:-1] if data.endswith(b"\n") else data).split(b"\n")] if data else []


@pytest.mark.parametrize(("block", "size"), [(1 << 16, 32 << 20), (4, 7), (1, 1), (3, 100)])
def test_ranges_and_tails(tmp_path, monkeypatch, block, size):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "RANGE", size)
    rng = random.Random(block)
    for n, data in enumerate([b"", b"\n", b"a", b"a\n", b"\n\n\n", b"a\nbb\nccc", b"a\r\nbb\r\n\xff\xfe\n", "é\n日本語 text\n".encode() * 3, b"x" * 50 + b"\n" + b"y" * 50, b"".join(bytes([rng.choice(b"ab\n")]) for _ in range(90))]):
        folder = tmp_path / f"f{n}"
        (folder / "train.log").mkdir(parents=True)
        for i, part in enumerate((b"first\nsecond\n", data)):
            (folder / "train.log" / f"part-{i}").write_bytes(part)
        want = ["first", "second", *lines_of(data)]
        whole = [r for p, s in L.parts_of(str(folder)).items() for r in L.ranges(p, 0, s)]
        got = [x for r in whole for x in L.lines_in(str(folder), r)]
        assert [x[2] for x in got] == want
        for k in (0, 1, 2, 3, len(want), len(want) + 5):
            tail = [x[2] for r in L.tail_ranges(str(folder), k) for x in L.lines_in(str(folder), r)]
            assert tail == (want[-k:] if k else [])


def test_which_log(tmp_path):
    assert L.parts_of(str(tmp_path / "absent")) == {} and L.parts_of(str(tmp_path)) == {}
    for i, name in enumerate(("b.log", "a.log", "dashboard.log", "notes.txt")):
        (tmp_path / name).write_text(name)
        os.utime(tmp_path / name, (i, i))
    assert list(L.parts_of(str(tmp_path))) == ["a.log"]
    assert list(L.parts_of(str(tmp_path), own="a.log")) == ["dashboard.log"]
    (tmp_path / "train.log").write_text("x")
    os.utime(tmp_path / "train.log", (0, 0))
    assert list(L.parts_of(f"file://{tmp_path}")) == ["train.log"]


def test_batch_and_partitions(spark, tmp_path, monkeypatch):
    (tmp_path / "train.log").write_text("".join(f"line {i}\n" for i in range(1000)))
    monkeypatch.setattr(L, "RANGE", 1000)
    assert len(L._Reader({"path": str(tmp_path)}).partitions()) == 9
    df = L.log_lines(spark, str(tmp_path))
    assert sorted(r.line for r in df.collect()) == sorted(f"line {i}" for i in range(1000))
    assert [r.line for r in L.log_lines(spark, str(tmp_path), 3).orderBy("at").collect()] == ["line 997", "line 998", "line 999"]
    assert L.log_lines(spark, str(tmp_path / "none")).count() == 0


def test_stream_goes_on(spark, tmp_path):
    log, out = tmp_path / "logs", str(tmp_path / "out")
    log.mkdir()

    def run():
        s = L.log_stream(spark, str(log)).select("line")
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.line for r in spark.read.parquet(out).collect())

    (log / "train.log").write_text("a\nb\nhalf")
    assert run() == ["a", "b"]  # a line without its end waits
    assert run() == ["a", "b"]
    with (log / "train.log").open("a") as f:
        f.write(" line\nc\n")
    assert run() == ["a", "b", "c", "half line"]


class Killed(Exception):
    pass


@pytest.mark.parametrize("when", ["before the rows", "before the manifest", "after the manifest"])
def test_killed_between_write_and_commit(spark, tmp_path, monkeypatch, when):
    spark.range(10).select(F.col("id").alias("step")).coalesce(1).write.json(str(tmp_path / "in"))
    path, state, calls = str(tmp_path / "m"), str(tmp_path / "state"), []
    real = M.write_batch

    def dies(rows, batch, path, run):
        calls.append(batch)
        if len(calls) == 1:
            if when == "before the manifest":
                M.numbers(rows).write.json(f"{path}/rows/run={run}/batch={batch}/version=1")
            if when == "after the manifest":
                real(rows, batch, path, run)
            raise Killed(when)
        real(rows, batch, path, run)

    monkeypatch.setattr(M, "write_batch", dies)

    def start():
        s = spark.readStream.schema("step long").json(str(tmp_path / "in"))
        s = s.select("step", (F.col("step") * 2).alias("loss"), F.lit("note").alias("text"), (F.col("step") > 4).alias("late"), F.lit("train").alias("kind"), F.array("step").alias("list"))
        M.metrics_sink(s, path, "r", state).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(StreamingQueryException):
        start()
    start()
    start()
    assert calls == [0, 0]
    got = M.read_metrics(spark, path, "step long, loss double, late double, kind string")
    assert sorted((r.step, r.loss, r.late, r.kind, r.run, r.batch) for r in got.collect()) == [(i, 2.0 * i, float(i > 4), "train", "r", 0) for i in range(10)]
    assert [tuple(r) for r in M.manifest(spark, path).collect()] == [("r", 0, {"before the rows": 1, "before the manifest": 2, "after the manifest": 2}[when], 10)]
    raw = spark.read.json(f"{path}/rows")
    assert "text" not in raw.columns and "list" not in raw.columns


def test_append_metrics(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", 0.5, True, "no", 3)], "step long, kind string, loss double, ok boolean, note string, n int")
    for _ in range(2):
        M.append_metrics(rows, str(tmp_path / "m"))
    got = spark.read.json(str(tmp_path / "m"))
    assert got.count() == 2 and set(got.columns) == {"step", "kind", "loss", "ok", "n"} and got.first().ok == 1.0
