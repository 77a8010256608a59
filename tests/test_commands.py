"""Typed commands, their SQL and their logs."""

import json

import pytest

from lumenfold.operators.keyed import COMMANDS, LOG, Store, apply_log, normal
from lumenfold.plans.commands import compile_command
from lumenfold.plans.tokens import Diagnostic


@pytest.fixture
def store():
    now = [1000.0]
    s = Store(lambda: now[0])
    s.now = now
    return s


def run(store, command, key="k", **fields):
    r = store.run({"command": command, "key": key, **fields})
    return (r["message"], r["value"]) if r["ok"] else r["message"]


def test_every_command_answers(store):
    assert len(COMMANDS) == 92
    for name in COMMANDS:
        if name != "BATCH":
            assert "message" in store.run({"command": name, "key": f"k:{name}", "value": "1", "subkey": "1" if name.endswith("FW") or "CMS" in name else "0.1", "ttl_seconds": 5, "priority": 1})


def test_names():
    assert normal("map.put") == "PUTMAP" and normal("BF.ADD") == normal("bfadd") == "ADDBF" and normal("CMS.EST") == "ESTCMS" and normal(" getstr ") == "GET"


def test_strings_counters_ttl(store):
    assert run(store, "SET", value="v") == ("stored string", None) and run(store, "GET") == ("ok", "v") and run(store, "EXISTS") == ("ok", "1")
    assert run(store, "INC", value="5") == ("incremented", "5")  # another family is replaced
    assert run(store, "INC") == ("incremented", "6") and run(store, "INC", value=str((1 << 31) - 1)) == "counter overflow"
    assert run(store, "EXPIRE", ttl_seconds=10) == ("ttl updated", None) and run(store, "TTL") == ("ok", "10")
    store.now[0] += 11
    assert run(store, "GET") == ("key not found", None) and run(store, "TTL") == ("ok", "-1") and run(store, "PERSIST") == ("key not found or no ttl", None)
    assert run(store, "SETX", value="v") == "positive ttl_seconds is required" and run(store, "SETINT", value="x") == "value must be a 32-bit integer"
    assert run(store, "NOPE") == "unsupported command" and run(store, "GET", key="") == "key is required" and run(store, "DEL") == ("key not found", None)


def test_collections(store):
    assert run(store, "PUTMAP", subkey="a", value="1") == ("stored map fields", None) and run(store, "TAKEMAP", subkey="a") == ("removed", "1") and run(store, "PEEKMAP", subkey="a") == ("value not found", None)
    run(store, "PUSHSLICE", key="s", values=["a", "b", "c"])
    assert [run(store, c, key="s")[1] for c in ("HEADSLICE", "TAILSLICE", "SHIFTSLICE", "POPSLICE", "GET")] == ["a", "c", "a", "c", '["b"]']
    assert run(store, "ADDSET", key="t", values=["b", "a", "a"]) == ("added set values", "2") and run(store, "GETSET", key="t") == ("ok", '["a","b"]') and run(store, "REMSET", key="t", value="a") == ("removed set values", "1")
    for p, v in ((5, "x"), (1, "y"), (1, "z")):
        run(store, "PUSHPQ", key="q", priority=p, value=v)
    assert [json.loads(run(store, "POPPQ", key="q")[1])["value"] for _ in range(3)] == ["y", "z", "x"] and run(store, "PEEKPQ", key="q") == ("value not found", None)
    assert run(store, "PUTRT", key="r", pairs={"ab": 1, "a": 2, "b": 3}) == ("stored radix tree values", "3")
    assert [x["key"] for x in json.loads(run(store, "PREFIXRT", key="r", subkey="a")[1])] == ["a", "ab"]


def test_sketches(store):
    run(store, "ADDBF", key="b", values=["x", "y"])
    assert run(store, "HASBF", key="b", value="x") == ("ok", "1") and json.loads(run(store, "INFOBF", key="b")[1])["insertions"] == 2
    run(store, "ADDXF", key="f", values=["x", "y"])
    assert run(store, "HASXF", key="f", value="x") == "xor filter is not built"
    assert run(store, "BUILDXF", key="f")[0] == "built xor filter" and run(store, "HASXF", key="f", value="x") == ("ok", "1") and run(store, "ADDXF", key="f", value="z") == "xor filter is already built"
    assert run(store, "INCRCMS", key="c", value="x", subkey="3") == ("incremented count-min sketch", "3") and run(store, "ESTCMS", key="c", value="x") == ("ok", "3")
    for k in range(200):
        run(store, "ADDHLL", key="h", value=str(k))
    assert abs(int(run(store, "COUNTHLL", key="h")[1]) - 200) <= 4
    run(store, "CREATETOPK", key="t", value="2")
    for v in "aabac":
        run(store, "ADDTOPK", key="t", value=v)
    top = json.loads(run(store, "GETTOPK", key="t")[1])
    assert top[0] == {"count": 3, "error": 0, "value": "a"} and top[1]["count"] - top[1]["error"] <= 1
    for v in range(1, 101):
        run(store, "ADDQ", key="q", value=str(v))
    assert abs(json.loads(run(store, "ESTQ", key="q", value="0.5")[1])["value"] - 50) <= 2 and run(store, "ADDQ", key="q", value="nan") == "value must be a finite number"
    run(store, "CREATEFW", key="w", value="8")
    for i, d in ((0, 5), (3, 2), (7, 1)):
        run(store, "ADDFW", key="w", subkey=str(i), value=str(d))
    assert run(store, "SUMFW", key="w", subkey="3") == ("ok", "7") and run(store, "RANGEFW", key="w", subkey="1", value="7") == ("ok", "3") and run(store, "ADDFW", key="w", subkey="8", value="1") == "fenwick tree update is out of range or overflows"
    run(store, "CREATERS", key="s", value="2")
    run(store, "ADDRS", key="s", values=["a", "b", "c"])
    assert len(json.loads(run(store, "GETRS", key="s")[1])) == 2
    assert run(store, "ADDRB", key="m", values=[3, 1, 3]) == ("added roaring bitmap values", "2") and run(store, "GETRB", key="m") == ("ok", "[1,3]") and run(store, "ADDRB", key="m", value=str(1 << 32)) == "value must be an unsigned 32-bit integer"
    assert run(store, "ADDSB", key="n", value=str((1 << 64) - 1)) == ("added sparse bitset values", "1")


def test_operations_without_commands(store):
    assert store.append("k", "b") == "b" and store.append("k", "a", front=True) == "ab" and store.bytes_of("k") == b"ab"
    store.upsert("m", "map", {"x": 1})
    store.upsert("s", "set", ["b", "a", "a"])
    store.upsert("l", "slice", [1, 2])
    assert store.whole_of("m", "map") == {"x": 1} and store.whole_of("s", "set") == ["a", "b"] and store.whole_of("l", "slice") == [1, 2] and store.whole_of("k", "map") is None
    store.expiry["m"] = store.now[0] - 1
    assert [k for k, _ in store.entries()] == ["k", "l", "s"] and [k for k, _ in store.entries("s")] == ["s"]


def test_batches(store):
    got = store.run({"command": "BATCH", "batch": [{"command": "SET", "key": "a", "value": "1"}, {"command": "NOPE", "key": "a"}, {"command": "GET", "key": "a"}]})
    assert not got["ok"] and [r["value"] for r in got["responses"]] == [None, None, "1"]


@pytest.mark.parametrize("sql,want", [
    ("SELECT value FROM cache WHERE key = 'k'", {"command": "GETSTR", "key": "k"}),
    ("SELECT ttl FROM cache WHERE key = 'it''s'", {"command": "TTL", "key": "it's"}),
    ("INSERT INTO cache (key, value, ttl_seconds) VALUES ('k', 'v', 60)", {"command": "SETSTRX", "key": "k", "value": "v", "ttl_seconds": 60}),
    ("INSERT INTO cache (key, counter) VALUES ('k', -3)", {"command": "SETINT", "key": "k", "value": "-3"}),
    ("UPDATE cache SET value = value - 2 WHERE key = 'k'", {"command": "INC", "key": "k", "value": "-2"}),
    ("UPDATE cache SET unix_seconds = 99 WHERE key = 'k'", {"command": "EXPIREAT", "key": "k", "unix_seconds": 99}),
    ("DELETE FROM cache WHERE key = 'k'", {"command": "DEL", "key": "k"}),
    ("CALL INC('k', 4)", {"command": "INC", "key": "k", "value": "4"}),
    ("CALL BF.ADD(key => 'k', values => ('a', 1))", {"command": "BF.ADD", "key": "k", "values": ["a", 1]}),
])
def test_command_sql(sql, want):
    assert compile_command(sql) == want


def test_command_sql_batches_and_faults():
    assert [c["command"] for c in compile_command("DELETE FROM cache WHERE key = 'a'; CALL GET('b');")["batch"]] == ["DEL", "GET"]
    for sql, message in (("SELEC value", "did you mean SELECT"), ("CALL INTERNALSET(key => 'k')", "unknown command"), ("CALL SET(nope => 'k')", "unknown field"), ("DELETE FROM cache", "expected WHERE")):
        with pytest.raises(Diagnostic, match=message):
            compile_command(sql)


def test_log_folds_by_key(spark):
    names = [c.split()[0] for c in LOG.split(", ")]
    base = dict.fromkeys(names)
    log = [base | {"seq": i, "command": c, "key": k, "value": v} for i, (c, k, v) in enumerate([("INC", "a", "2"), ("SET", "b", "x"), ("INC", "a", None), ("GET", "a", None), ("GET", "b", None), ("GET", "c", None)])]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in log], LOG).repartition(3)
    got = {r["seq"]: r["value"] for r in apply_log(df, now=0.0).collect()}
    assert got == {0: "2", 1: None, 2: "3", 3: "3", 4: "x", 5: None}
    assert apply_log(df.limit(0)).count() == 0


def test_fenwick_sums_and_overflow(store):
    run(store, "CREATEFW", key="f", value="1000")
    for i in range(0, 1000, 7):
        run(store, "ADDFW", key="f", subkey=str(i), value=str(i))
    assert run(store, "SUMFW", key="f", subkey="500") == ("ok", str(sum(range(0, 501, 7)))) and run(store, "RANGEFW", key="f", subkey="10", value="20") == ("ok", "14")
    assert run(store, "ADDFW", key="f", subkey="0", value=str((1 << 63) - 1)) == "fenwick tree update is out of range or overflows"
    assert run(store, "GETFW", key="f", subkey="0") == ("ok", "0") and run(store, "ADDFW", key="f", subkey="1000", value="1") == "fenwick tree update is out of range or overflows"


def test_logs_with_batches_and_spellings(spark):
    fields = LOG.split(", ")[1:]
    schema = f"{LOG}, batch array<struct<{', '.join(':'.join(f.split(' ', 1)) for f in fields)}>>"
    row = lambda seq, command, key, **c: (seq, command, key, c.get("subkey"), c.get("value"), None, None, None, None, c.get("priority"), c.get("batch"))
    part = lambda command, key, **c: row(0, command, key, **c)[1:10]
    big = (1 << 53) + 1
    log = spark.createDataFrame([
        row(1, "INC", " n"), row(2, "batch", None, batch=[part("INC", "n\t"), part("SET", "s", value="v"), part("BATCH", "n"), part("NOPE", "s")]), row(3, "INC", "n"), row(4, "GET", "s"),
        row(5, "BATCH", "x", batch=[]), row(6, "PUSHPQ", "q", priority=big, value="a"), row(7, "PUSHPQ", "q", priority=big - 1, value="b"), row(8, "PUSHPQ", "q", value="c"), row(9, "POPPQ", "q"), row(10, "POPPQ", "q"),
    ], schema)
    got = {r["seq"]: r for r in apply_log(log, now=0.0).collect()}
    assert sorted(got) == list(range(1, 11)) and got[3]["value"] == "3" and got[4]["value"] == "v" and not got[5]["ok"] and not got[8]["ok"]
    assert not got[2]["ok"] and [(x["ok"], x["message"]) for x in json.loads(got[2]["value"])] == [(True, "incremented"), (True, "stored string"), (False, "nested batch"), (False, "unsupported command")]
    assert [json.loads(got[k]["value"])["priority"] for k in (9, 10)] == [big - 1, big]
    assert {r["seq"]: r["value"] for r in apply_log(log.drop("batch").where("command <> 'batch' and command <> 'BATCH'"), now=0.0).collect()}[3] == "2"
