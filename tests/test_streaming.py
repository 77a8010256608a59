"""Streamed queries and command logs."""

import json

import pytest

from lumenfold.engine import Engine
from lumenfold.operators.keyed import LOG
from lumenfold.streaming import commands, rows


def test_filter_and_join_stream(spark, tmp_path):
    engine = Engine(spark)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"id": i, "team": i % 3}) for i in range(9)))
    engine.catalog.register("people", spark.readStream.schema("id long, team long").json(str(tmp_path / "in")))
    engine.catalog.register("teams", spark.createDataFrame([(0, "Core"), (1, "Edge")], "id long, name string"))
    query = rows.start(engine, "FROM CACHE('people') AS p JOIN CACHE('teams') AS t ON p.team = t.id WHERE p.id > 2 SELECT p.id, t.name AS team", "memory", str(tmp_path / "cp"), "streamed")
    query.processAllAvailable()
    query.stop()
    assert {tuple(r) for r in spark.table("streamed").collect()} == {(3, "Core"), (4, "Edge"), (6, "Core"), (7, "Edge")}
    with pytest.raises(ValueError, match="aggregation"):
        rows.stream(engine, "FROM CACHE('people') AS p SELECT COUNT(*) AS n")
    with pytest.raises(ValueError, match="no source"):
        rows.stream(engine, "FROM CACHE('teams') AS p SELECT id")


def test_command_stream_keeps_state(spark, tmp_path):
    names = [c.split()[0] for c in LOG.split(", ")]
    (tmp_path / "in").mkdir()

    def put(k, items):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps(dict.fromkeys(names) | x) for x in items))

    log = spark.readStream.schema(LOG).json(str(tmp_path / "in"))
    query = commands.respond(log).writeStream.format("memory").queryName("answers").option("checkpointLocation", str(tmp_path / "cp")).start()
    put(1, [{"seq": 1, "command": "INC", "key": "a", "value": "2"}, {"seq": 2, "command": "ADDSET", "key": "b", "values": ["x", "y"]}])
    query.processAllAvailable()
    put(2, [{"seq": 3, "command": "INC", "key": "a"}, {"seq": 4, "command": "GETSET", "key": "b"}])
    query.processAllAvailable()
    query.stop()
    assert {r["seq"]: r["value"] for r in spark.table("answers").collect()} == {1: "2", 2: "2", 3: "3", 4: '["x","y"]'}


def test_upsert(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"k":"a","s":1,"v":1}\n{"k":"a","s":3,"v":3}\n{"k":"b","s":2,"v":2}')
    changes = spark.readStream.schema("k string, s long, v long").json(str(tmp_path / "in"))
    query = rows.upsert(changes, ["k"], "s", str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert {(r["k"], r["v"]) for r in spark.read.parquet(str(tmp_path / "out" / "batch-0")).collect()} == {("a", 3), ("b", 2)}
