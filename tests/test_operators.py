"""Sketches, sets and keyed collections against exact answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions.hashing import canonical, fnv1, fnv1a, hash_all, item_json
from lumenfold.operators import sets, sketches


def test_hashes_agree_with_their_definition():
    items = [b"", b"a", b'"foobar"', "é<>&".encode()]
    a, b = hash_all(items)
    assert a.tolist() == [fnv1a(x) for x in items] and b.tolist() == [fnv1(x) for x in items]
    assert fnv1a(b"foobar") == 0x85944171F73967E8  # the published test vector
    assert canonical({"b": 1, "a": "<"}) == b'{"a":"\\u003c","b":1}' and canonical(2.0) == b"2"


def test_item_json(spark):
    df = spark.createDataFrame([("a<b",), ('q"',), (None,)], "t string")
    assert [r[0] for r in df.select(item_json(F.col("t"), "text")).collect()] == ['"a\\u003cb"', '"q\\""', "null"]


def test_bloom(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("v"), (F.col("id") % 2).alias("g"))
    shape = sketches.BloomShape.of(500, 0.01)
    bits = sketches.bloom_build(df, item_json(F.col("v"), "text"), shape, ["g"])
    both = df.union(spark.range(500, 1500).select(F.col("id").cast("string"), (F.col("id") % 2)))
    got = sketches.bloom_probe(both, item_json(F.col("v"), "text"), bits, shape, ["g"]).groupBy((F.col("v").cast("int") < 500).alias("is_in")).agg(F.avg(F.col("member").cast("int"))).collect()
    rates = dict(got)
    assert rates[True] == 1.0 and rates[False] < 0.05
    assert sketches.bloom_info(bits, shape, ["g"]).count() == 2


def test_cms_hll_topk(spark):
    df = spark.range(3000).select((F.col("id") % 100 % (F.col("id") % 7 + 1)).cast("string").alias("v"))
    item = item_json(F.col("v"), "text")
    true = {r[0]: r[1] for r in df.groupBy(item.alias("i")).count().collect()}
    est = {r["item"]: r["estimate"] for r in sketches.cms_estimate(df, item, sketches.cms_build(df, item, 64, 4), 64, 4).collect()}
    assert all(est[k] >= n for k, n in true.items())
    assert sketches.hll_count(sketches.hll_build(spark.range(5000), item_json(F.col("id"), "int"))).first()[0] == pytest.approx(5000, rel=0.03)
    top = sketches.top_k(df, item, 3).collect()
    assert [r["count"] for r in top] == sorted(true.values(), reverse=True)[:3]


def test_reservoir_is_deterministic(spark):
    df = spark.range(1000).select("id", F.col("id").cast("string").alias("v"))
    one = sketches.reservoir(df, item_json(F.col("v"), "text"), "id", 16).collect()
    two = sketches.reservoir(df.repartition(7), item_json(F.col("v"), "text"), "id", 16).collect()
    assert one == two and len(one) == 16
    ranked = sorted(range(1000), key=lambda i: (fnv1a(i.to_bytes(8, "little") + f'"{i}"'.encode()), i))[:16]
    assert [r["sequence"] for r in one] == ranked


def test_quantiles(spark):
    got = sketches.quantiles(spark.range(1001).select(F.col("id").alias("x")), F.col("x"), [0.0, 0.5, 1.0]).collect()
    assert {r["quantile"]: r["value"] for r in got} == {0.0: 0, 0.5: pytest.approx(500, abs=11), 1.0: 1000}


@pytest.mark.parametrize("kind", ["cuckoo", "xor"])
def test_sharded_filters(spark, kind):
    members = spark.range(2000).select(F.col("id").cast("string").alias("v"))
    asked = spark.range(4000).select(F.col("id").cast("string").alias("v"))
    got = sketches.probe_sharded(members, F.col("v"), asked, F.col("v"), kind, 3).collect()
    hits = {int(r["item"]) for r in got if r["member"]}
    assert len(got) == 4000 and set(range(2000)) <= hits and len(hits) < 2100


def test_cuckoo_add_remove():
    f = sketches.Cuckoo(100)
    assert f.add(12345) and f.add(12345) is False and f.has(12345) and f.remove(12345) and not f.has(12345)
    f = sketches.Cuckoo(8)
    before = None
    for h in np.random.default_rng(1).integers(0, 1 << 62, 200).tolist():
        before = f.table.copy()
        if f.add(h) is None:
            assert (f.table == before).all()
            break
    else:
        pytest.fail("it never filled")


def test_sets(spark):
    df = spark.createDataFrame([("a", 1), ("a", 70000), ("a", 1), ("b", 5)], "g string, x long")
    ids = sets.bitmap(df, F.col("x"), ["g"])
    assert {tuple(r) for r in sets.bitmap_containers(ids, ["g"]).collect()} == {("a", 2, 2, 2, 0), ("b", 1, 1, 1, 0)}
    assert sets.bitmap_count_packed(sets.bitmap(df, F.col("x"))).first()[0] == 3
    with pytest.raises(Exception, match="id out of range"):
        sets.bitmap(df.withColumn("x", F.lit(-1)), F.col("x")).collect()
    cells = spark.createDataFrame([(0, 5), (3, 2), (3, 1), (9, 4)], "i long, d long")
    assert [tuple(r) for r in sets.prefix_sums(cells, "i", "d", 4).orderBy("i").collect()] == [(0, 5, 5), (3, 3, 8), (9, 4, 12)]
    assert sets.range_sum(cells, "i", "d", 1, 8).first()[0] == 3 and sets.range_sum(cells, "i", "d", 20, 30).first()[0] == 0
    with pytest.raises(Exception, match="counter overflow"):
        sets.counters(spark.createDataFrame([("k", 1 << 31)], "k string, d long"), "k", F.col("d")).collect()


def test_prefix_scan_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([("ab", 1), ("b", 2)], "k string, v int").write.parquet(str(tmp_path / "t"))
    scan = sets.prefix_scan(spark.read.parquet(str(tmp_path / "t")), "k", "a")
    assert [r["v"] for r in scan.collect()] == [1]
    assert "StringStartsWith(k,a)" in scan._jdf.queryExecution().executedPlan().toString()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "v string")
    item = item_json(F.col("v"), "text")
    assert sketches.hll_count(sketches.hll_build(empty, item)).first()[0] == 0
    assert sketches.cms_build(empty, item).count() == 0 and sketches.top_k(empty, item).count() == 0
