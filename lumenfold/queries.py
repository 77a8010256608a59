"""Queries over the driver's tables, one for each operator, with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .engine import Engine
from .functions.hashing import item_json
from .operators import keyed, sets, sketches
from .workers import reach

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


class Tables(Engine):
    """An engine whose unknown keys are the tables of a folder, read when a query names them."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark)
        known, read = self.catalog.get, self.catalog.register_path

        def get(key: str):
            if key in TABLES and key not in self.catalog.frames:
                read(key, f"{folder}/{key}.parquet")
            return known(key)

        self.catalog.get = get


FLAGSHIP = """FROM CACHE('orders') AS o LEFT JOIN CACHE('customer') AS c ON o.o_custkey = c.c_custkey
WHERE o.o_totalprice > 1000
SELECT c.c_mktsegment AS segment, COUNT(*) AS n, SUM(o.o_totalprice) AS total
GROUP BY c.c_mktsegment HAVING COUNT(*) > 0 ORDER BY total DESC, segment"""

LINE = "l_orderkey, l_linenumber"

#: name -> (engine SQL, the same rows in plain SQL)
SQL: dict[str, tuple[str, str]] = {
    "scan_project_filter": (f"FROM CACHE('lineitem') AS l WHERE l_quantity >= 25 AND l_discount < 0.05 SELECT {LINE}, l_extendedprice * (1 - l_discount) AS net", f"SELECT {LINE}, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_quantity >= 25 AND l_discount < 0.05"),
    "filter_3vl_like": ("FROM CACHE('part') AS p WHERE (p_name LIKE '%a%' OR p_size > 40) AND NOT p_brand LIKE '%1%' AND p_type IS NOT NULL SELECT p_partkey, p_name", "SELECT p_partkey, p_name FROM part WHERE (p_name LIKE '%a%' OR p_size > 40) AND NOT p_brand LIKE '%1%' AND p_type IS NOT NULL"),
    "int_div_mod_null": (f"FROM CACHE('lineitem') AS l SELECT {LINE}, l_orderkey / l_linenumber AS q, l_orderkey % l_linenumber AS r, l_orderkey / (l_linenumber - 1) AS z", f"SELECT {LINE}, l_orderkey // l_linenumber AS q, l_orderkey % l_linenumber AS r, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_orderkey // (l_linenumber - 1) END AS z FROM lineitem"),
    "cast_matrix": ("FROM CACHE('orders') AS o SELECT o_orderkey, CAST(o_orderkey AS TEXT) AS t, CAST(o_orderkey AS NUMBER) AS n, CAST(o_orderdate AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) AS TEXT) AS dt, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, CAST(o_orderkey % 2 AS BOOLEAN) AS b", "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS t, CAST(o_orderkey AS DOUBLE) AS n, CAST(o_orderdate AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS dt, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS ts, o_orderkey % 2 = 1 AS b FROM orders"),
    "join_inner_equi": ("FROM CACHE('orders') AS o JOIN CACHE('customer') AS c ON o.o_custkey = c.c_custkey SELECT o.o_orderkey, c.c_name", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_theta": ("FROM CACHE('nation') AS a JOIN CACHE('nation') AS b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey SELECT a.n_name AS low, b.n_name AS high", "SELECT a.n_name AS low, b.n_name AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey"),
    "join_cross": ("FROM CACHE('region') AS r CROSS JOIN CACHE('nation') AS n SELECT r.r_name, n.n_name", "SELECT r_name, n_name FROM region CROSS JOIN nation"),
    "join_left": ("FROM CACHE('customer') AS c LEFT JOIN CACHE('orders') AS o ON c.c_custkey = o.o_custkey SELECT c.c_custkey, o.o_orderkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey"),
    "join_right": ("FROM CACHE('orders') AS o RIGHT OUTER JOIN CACHE('customer') AS c ON c.c_custkey = o.o_custkey SELECT c.c_custkey, o.o_orderkey", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey"),
    "join_full": ("FROM CACHE('supplier') AS s FULL JOIN CACHE('customer') AS c ON s.s_suppkey = c.c_custkey SELECT s.s_suppkey, c.c_custkey", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey"),
    "join_multiway_reorder": ("FROM CACHE('lineitem') AS l JOIN CACHE('orders') AS o ON l.l_orderkey = o.o_orderkey JOIN CACHE('customer') AS c ON o.o_custkey = c.c_custkey JOIN CACHE('nation') AS n ON c.c_nationkey = n.n_nationkey JOIN CACHE('region') AS r ON n.n_regionkey = r.r_regionkey SELECT r.r_name, COUNT(*) AS n, MAX(l.l_extendedprice) AS top GROUP BY r.r_name", "SELECT r_name, count(*) AS n, max(l_extendedprice) AS top FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "join_self": ("FROM CACHE('nation') AS a JOIN CACHE('nation') AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey != b.n_nationkey SELECT a.n_nationkey AS x, b.n_nationkey AS y", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey <> b.n_nationkey"),
    "agg_group": ("FROM CACHE('lineitem') AS l SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS qty, AVG(l_quantity) AS mean, MIN(l_extendedprice) AS low, MAX(l_extendedprice) AS high GROUP BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, avg(l_quantity) AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY 1, 2"),
    "agg_global": ("FROM CACHE('orders') AS o SELECT COUNT(*) AS n, COUNT(o_orderstatus) AS s, SUM(o_orderkey) AS keys, MAX(o_totalprice) AS top, MIN(o_orderstatus) AS nothing", "SELECT count(*) AS n, count(o_orderstatus) AS s, CAST(sum(o_orderkey) AS DOUBLE) AS keys, max(o_totalprice) AS top, CAST(NULL AS DOUBLE) AS nothing FROM orders"),
    "agg_empty": ("FROM CACHE('orders') AS o WHERE o_orderkey < 0 SELECT COUNT(*) AS n, SUM(o_totalprice) AS s", "SELECT count(*) AS n, sum(o_totalprice) AS s FROM orders WHERE o_orderkey < 0"),
    "agg_having": ("FROM CACHE('orders') AS o SELECT o_custkey, COUNT(*) AS n GROUP BY o_custkey HAVING COUNT(*) > 12 AND MAX(o_totalprice) > 1000", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 1000"),
    "agg_expr_key": ("FROM CACHE('orders') AS o SELECT o_custkey % 10 AS bucket, COUNT(*) * 2 AS twice, SUM(o_orderkey) + 1 AS s GROUP BY o_custkey % 10", "SELECT o_custkey % 10 AS bucket, count(*) * 2 AS twice, CAST(sum(o_orderkey) AS DOUBLE) + 1 AS s FROM orders GROUP BY 1"),
    "having_no_group": ("FROM CACHE('orders') AS o SELECT o_orderkey HAVING o_totalprice > 100000", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000"),
    "distinct_rows": ("FROM CACHE('orders') AS o SELECT DISTINCT o_orderstatus, o_orderpriority", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders"),
    "set_union": ("FROM CACHE('customer') AS c SELECT c_nationkey AS k UNION FROM CACHE('supplier') AS s SELECT s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "set_union_all": ("FROM CACHE('customer') AS c SELECT c_nationkey AS k UNION ALL FROM CACHE('supplier') AS s SELECT s_nationkey AS k", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier"),
    "set_intersect": ("FROM CACHE('customer') AS c SELECT c_custkey AS k INTERSECT FROM CACHE('supplier') AS s SELECT s_suppkey AS k", "SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier"),
    "set_except": ("FROM CACHE('customer') AS c SELECT c_custkey AS k EXCEPT FROM CACHE('orders') AS o SELECT o_custkey AS k", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders"),
    "set_right_assoc": ("FROM CACHE('customer') AS c SELECT c_custkey AS k UNION FROM CACHE('supplier') AS s SELECT s_suppkey AS k EXCEPT FROM CACHE('customer') AS d SELECT c_custkey AS k", "SELECT c_custkey AS k FROM customer UNION (SELECT s_suppkey FROM supplier EXCEPT SELECT c_custkey FROM customer)"),
    "win_row_number": ("FROM CACHE('orders') AS o SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS n FROM orders"),
    "win_rank_dense": ("FROM CACHE('part') AS p SELECT p_partkey, RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, DENSE_RANK() OVER (PARTITION BY p_brand ORDER BY p_size) AS d", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size NULLS FIRST) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size NULLS FIRST) AS d FROM part"),
    "win_lag_lead": ("FROM CACHE('events') AS e SELECT event_id, LAG(value, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, LEAD(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q", "SELECT event_id, lag(value, 1, 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, lead(event_type, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM events"),
    "win_running_sum": ("FROM CACHE('orders') AS o SELECT o_orderkey, SUM(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS s", "SELECT o_orderkey, CAST(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS s FROM orders"),
    "win_moving_frames": ("FROM CACHE('orders') AS o SELECT o_orderkey, MIN(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS low, MAX(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS high", "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS low, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS high FROM orders"),
    "order_limit_offset": ("FROM CACHE('orders') AS o SELECT o_orderkey, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 5"),
    "topk_sort": ("FROM CACHE('lineitem') AS l SELECT l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 10"),
    "cte_chain": ("WITH big(k, c) AS (FROM CACHE('orders') AS o WHERE o_totalprice > 1000 SELECT o_orderkey, o_custkey), per(c, n) AS (FROM big SELECT c, COUNT(*) AS n GROUP BY c) FROM per WHERE n > 5 SELECT c, n", "WITH big AS (SELECT o_orderkey k, o_custkey c FROM orders WHERE o_totalprice > 1000), per AS (SELECT c, count(*) n FROM big GROUP BY c) SELECT c, n FROM per WHERE n > 5"),
    "derived_table": ("FROM (FROM CACHE('customer') AS c SELECT c_nationkey AS k, COUNT(*) AS n GROUP BY c_nationkey) AS d JOIN CACHE('nation') AS n ON d.k = n.n_nationkey SELECT n.n_name, d.n", "SELECT n_name, d.n FROM (SELECT c_nationkey k, count(*) n FROM customer GROUP BY 1) d JOIN nation ON d.k = n_nationkey"),
    "values_join": ("FROM VALUES ('BUILDING', 1), ('MACHINERY', 2) AS v(segment, code) JOIN CACHE('customer') AS c ON v.segment = c.c_mktsegment SELECT c.c_custkey, v.code", "SELECT c_custkey, CAST(code AS BIGINT) AS code FROM (VALUES ('BUILDING', 1), ('MACHINERY', 2)) v(segment, code) JOIN customer ON segment = c_mktsegment"),
    "recursive_seq": ("WITH RECURSIVE s(n) AS (FROM VALUES (1) AS v(n) SELECT n UNION ALL FROM s WHERE n < 8 SELECT n + 1 AS n) FROM s SELECT n", "SELECT CAST(unnest(range(1, 9)) AS BIGINT) AS n"),
    "recursive_walk_cycle": ("WITH RECURSIVE w(node, level) AS (FROM CACHE('nation') AS s WHERE s.n_nationkey = 0 SELECT n_nationkey AS node, 0 AS level UNION ALL FROM CACHE('nation') AS e JOIN w AS p ON e.n_regionkey = p.node SELECT e.n_nationkey AS node, p.level + 1 AS level) SEARCH BREADTH FIRST BY node SET place CYCLE node SET again FROM w SELECT node, level, place, again", "WITH RECURSIVE w AS (SELECT CAST(n_nationkey AS BIGINT) AS node, CAST(0 AS BIGINT) AS level, FALSE AS again, [n_nationkey] AS path FROM nation WHERE n_nationkey = 0 UNION ALL SELECT e.n_nationkey, p.level + 1, list_contains(p.path, e.n_nationkey), list_append(p.path, e.n_nationkey) FROM nation e JOIN w p ON e.n_regionkey = p.node AND NOT p.again) SELECT CAST(node AS INTEGER) AS node, level, row_number() OVER (ORDER BY level, node) AS place, again FROM w"),
    "recursive_union_distinct": ("WITH RECURSIVE r(k) AS (FROM CACHE('nation') AS s WHERE s.n_nationkey = 1 SELECT n_nationkey AS k UNION FROM CACHE('nation') AS e JOIN r AS p ON e.n_regionkey = p.k SELECT e.n_nationkey AS k) FROM r SELECT k", "WITH RECURSIVE r(k) AS (SELECT n_nationkey FROM nation WHERE n_nationkey = 1 UNION SELECT e.n_nationkey FROM nation e JOIN r ON e.n_regionkey = r.k) SELECT k FROM r"),
    "typed_source": ("FROM CACHE('orders') AS o(o_orderkey INTEGER, o_totalprice NUMBER, o_orderstatus TEXT) SELECT o_orderkey, o_totalprice, o_orderstatus", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders"),
    "star_merge": ("FROM CACHE('nation') AS n JOIN CACHE('region') AS r ON n.n_regionkey = r.r_regionkey SELECT *", "SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey"),
}

Query = Callable[[SparkSession, str], DataFrame]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).sql(FLAGSHIP)


def flagship_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship with its money to cents: sums of doubles depend on their order in the last digits."""
    return flagship(spark, sf_dir).withColumn("total", F.round("total", 2))


def from_sql(text: str) -> Query:
    return lambda spark, sf_dir: Tables(spark, sf_dir).sql(text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def params_bind(spark, sf_dir):
    return Tables(spark, sf_dir).sql("FROM CACHE($1) AS o WHERE o_totalprice > $2 AND o_orderstatus = $3 SELECT o_orderkey", ["orders", 50000, "F"])


def udf_go(spark, sf_dir):
    e = Tables(spark, sf_dir)
    e.sql("CREATE FUNCTION cheap(price NUMBER, quantity NUMBER) LANGUAGE GO AS 'return price < 20000 && quantity > 10'")
    e.sql("CREATE FUNCTION gross(price NUMBER, tax NUMBER) LANGUAGE GO AS 'return price * (1 + tax)'")
    return e.sql(f"FROM CACHE('lineitem') AS l WHERE CHEAP(l_extendedprice, l_quantity) SELECT {LINE}, GROSS(l_extendedprice, l_tax) AS g")


def page_second(spark, sf_dir):
    e, sql = Tables(spark, sf_dir), "FROM CACHE('orders') AS o SELECT o_orderkey, o_custkey ORDER BY o_orderkey"
    second = e.page(sql, 25, e.page(sql, 25).next_cursor)
    return spark.createDataFrame(second.rows, "o_orderkey bigint, o_custkey bigint")


def explain_steps(spark, sf_dir):
    return Tables(spark, sf_dir).sql("EXPLAIN " + FLAGSHIP).select("node", "detail")


def keys_catalog(spark, sf_dir):
    e = Engine(spark)
    e.catalog.register_folder(sf_dir, TABLES)
    return e.sql("FROM KEYS SELECT key, type, ttl_ms, on_disk")


def text_item(name: str):
    return item_json(F.col(name), "text")


def bloom_no_false_negative(spark, sf_dir):
    parts, shape = table(spark, sf_dir, "part"), sketches.BloomShape.of(10_000, 0.01)
    bits = sketches.bloom_build(parts, text_item("p_name"), shape)
    return asked_of(lambda asked: sketches.bloom_probe(asked, text_item("p_name"), bits, shape), parts, 0.05)


def asked_of(probe, parts, most: float) -> DataFrame:
    """A filter asked for every part's name, and for as many names that no part has: members missed, members asked, and
    whether at most a share `most` of the others pass."""
    own = parts.select("p_name", F.lit(1).alias("own"))
    others = parts.select(F.concat("p_name", F.lit(" #"), F.col("p_partkey").cast("string")).alias("p_name"), F.lit(0).alias("own"))
    probed = probe(own.union(others))
    if "own" not in probed.columns:  # one row for each different item
        probed = probed.withColumn("own", F.when(F.col("item").contains(" #"), 0).otherwise(1))
    few = F.count_if(F.col("member") & (F.col("own") == 0)) <= most * F.count_if(F.col("own") == 0) + 3
    return probed.agg(F.count_if(~F.col("member") & (F.col("own") == 1)).alias("missed"), F.count_if(F.col("own") == 1).alias("asked"), few.alias("few_others"))


def filter_no_false_negative(kind: str) -> Query:
    def run(spark, sf_dir):
        parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
        shards = sketches.shards_for(parts.count())
        return asked_of(lambda asked: sketches.probe_sharded(parts, text_item("p_name"), asked, text_item("p_name"), kind, shards), parts, 0.05)

    return run


def cms_upper_bound(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    item = item_json(F.col("user_id"), "int")
    cells = sketches.cms_build(events, item)
    true = events.groupBy(item.alias("item")).agg(F.count("*").alias("n"))
    both = sketches.cms_estimate(events, item, cells).join(true, "item")
    over = F.count_if(F.col("estimate") > F.col("n") + math.e / 2048 * F.lit(events.count())) <= 0.05 * F.count("*")
    return both.agg(F.count_if(F.col("estimate") < F.col("n")).alias("under"), F.count("*").alias("items"), over.alias("seldom_far_over"))


def hll_within_error(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    got = sketches.hll_count(sketches.hll_build(lines, item_json(F.col("l_partkey"), "int"), by=["l_returnflag"]), by=["l_returnflag"])
    true = lines.groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("n"))
    return got.join(true, "l_returnflag").select("l_returnflag", "n", (F.abs(F.col("estimate") - F.col("n")) <= 0.05 * F.col("n")).alias("close"))


def quantile_within_error(spark, sf_dir):
    lines, at = table(spark, sf_dir, "lineitem"), [0.0, 0.25, 0.5, 0.9, 1.0]
    got = sketches.quantiles(lines, F.col("l_extendedprice"), at)
    points = [(r["quantile"], r["value"]) for r in got.collect()]  # a row for each of `at`
    price = F.col("l_extendedprice")
    counted = F.array(*(F.struct(F.lit(q).alias("quantile"), F.count_if(price < v).alias("under"), F.count_if(price <= v).alias("upto"), F.count("*").alias("n")) for q, v in points))
    below = lines.agg(counted.alias("c")).select(F.explode("c").alias("c")).select("c.*")
    room = 0.01 * F.col("n") + 1
    return below.select("quantile", ((F.col("under") - room <= F.col("quantile") * F.col("n")) & (F.col("upto") + room >= F.col("quantile") * F.col("n"))).alias("close"))


def topk_heavy_hitters(spark, sf_dir):
    return sketches.top_k(table(spark, sf_dir, "events"), text_item("event_type"), 100)


def reservoir_size(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    sample = sketches.reservoir(events, item_json(F.col("user_id"), "int"), "event_id", 128)
    again = sketches.reservoir(events.repartition(5), item_json(F.col("user_id"), "int"), "event_id", 128).select(F.col("sequence").alias("other"))
    spread = F.avg(F.when(F.col("sequence") <= events.agg(F.percentile_approx("event_id", 0.5)).first()[0], 1.0).otherwise(0.0)).between(0.25, 0.75)
    found = sample.join(events, F.col("sequence") == F.col("event_id")).join(again, F.col("sequence") == F.col("other"), "left")
    return found.agg(F.count("*").alias("size"), F.count_distinct("sequence").alias("distinct_rows"), F.count("other").alias("same_if_dealt_anew"), spread.alias("spread"))


def bitmap_set_ops(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    a = sets.bitmap(orders.where("o_orderstatus = 'F'"), F.col("o_custkey"))
    b = sets.bitmap(orders.where("o_orderstatus = 'O'"), F.col("o_custkey"))
    return sets.bitmap_count(sets.bitmap_union(a, b)).crossJoin(sets.bitmap_count(a.intersect(b)).withColumnRenamed("cardinality", "both_sides")).crossJoin(sets.bitmap_containers(a).select("containers"))


def sparse_bitset_count(spark, sf_dir):
    return sets.bitmap_count(sets.bitmap(table(spark, sf_dir, "lineitem"), F.col("l_orderkey"), ["l_returnflag"], wide=True), ["l_returnflag"])


def fenwick_prefix(spark, sf_dir):
    return sets.prefix_sums(table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber"), "l_partkey", "l_linenumber", 256)


def fenwick_range(spark, sf_dir):
    return sets.range_sum(table(spark, sf_dir, "lineitem"), "l_partkey", "l_linenumber", 10, 150)


def radix_prefix_scan(spark, sf_dir):
    return sets.prefix_scan(table(spark, sf_dir, "pages").select("url", "page_id"), "url", "https://www.")


def pq_pop_order(spark, sf_dir):
    return sets.queue_order(table(spark, sf_dir, "events").select("event_id", "user_id", F.length("event_type").alias("priority")), "user_id", "priority", "event_id").select("event_id", "place")


def deque_ends(spark, sf_dir):
    return sets.deque_ends(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type")


def set_membership(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.where("event_type = 'click'").select("user_id").distinct().join(events.where("event_type = 'purchase'").select("user_id"), "user_id", "left_semi")


def counter_inc(spark, sf_dir):
    return sets.counters(table(spark, sf_dir, "events"), "user_id", F.lit(1))


def latest_write(spark, sf_dir):
    return sets.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


def ttl_live(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("expires_at", F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY"))
    top = events.agg(F.max("ts").cast("timestamp").alias("now"))
    return sets.live(events.crossJoin(top), "expires_at", F.col("now")).select("event_id")


def command_batch_fold(spark, sf_dir):
    """Each user's events as a command log: a counter up by one for each, and the reads at the end."""
    events = table(spark, sf_dir, "events")
    names = [c.split()[0] for c in keyed.LOG.split(", ")]
    types = dict(c.split() for c in keyed.LOG.split(", "))

    def log(df, **cols):
        return df.select(*(cols[n].cast(types[n]).alias(n) if n in cols else F.lit(None).cast(types[n]).alias(n) for n in names))

    writes = log(events, seq=F.col("event_id"), command=F.lit("INC"), key=F.concat(F.lit("n:"), F.col("user_id")))
    users = events.select("user_id").distinct()
    reads = log(users, seq=F.lit(1 << 40) + F.col("user_id"), command=F.lit("GET"), key=F.concat(F.lit("n:"), F.col("user_id")))
    return keyed.apply_log(writes.union(reads), now=0.0).where(F.col("seq") >= 1 << 40).select((F.col("seq") - (1 << 40)).alias("user_id"), F.col("value").alias("n"))


STEPS = [("SCAN", 'CACHE("orders") AS o'), ("JOIN", 'LEFT JOIN CACHE("customer") AS c ON (o.o_custkey = c.c_custkey)'), ("FILTER", "(o.o_totalprice > 1000)"), ("AGGREGATE", "c.c_mktsegment"), ("HAVING", "(COUNT(*) > 0)"), ("PROJECT", "c.c_mktsegment AS segment, COUNT(*) AS n, SUM(o.o_totalprice) AS total"), ("SORT", "total DESC, segment ASC")]


def command_families(spark, sf_dir):
    """A command log with writes and a read of each family, folded key by key."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("r"))
    text = lambda c: c.cast("string")
    name, r = F.col("name"), F.col("r")
    steps = [  # family, command, fields
        ("string", "SET", {"value": name}), ("string", "GET", {}), ("counter", "SETINT", {"value": text(r)}), ("counter", "INC", {"value": F.lit("5")}), ("counter", "GET", {}),
        ("map", "PUTMAP", {"subkey": F.lit("a"), "value": name}), ("map", "PEEKMAP", {"subkey": F.lit("a")}), ("slice", "PUSHSLICE", {"values": F.array(name, text(r))}), ("slice", "POPSLICE", {}), ("slice", "HEADSLICE", {}),
        ("set", "ADDSET", {"values": F.array(name, name, text(r))}), ("set", "HASSET", {"value": name}), ("set", "REMSET", {"value": F.lit("none")}), ("queue", "PUSHPQ", {"priority": r + F.lit((1 << 53) + 1), "value": name}), ("queue", "PUSHPQ", {"priority": F.lit(1 << 60), "value": F.lit("last")}), ("queue", "POPPQ", {}),
        ("tree", "CREATEFW", {"value": F.lit("16")}), ("tree", "ADDFW", {"subkey": text(r), "value": F.lit("7")}), ("tree", "SUMFW", {"subkey": F.lit("2")}), ("tree", "RANGEFW", {"subkey": F.lit("1"), "value": F.lit("9")}),
        ("bits", "CREATERB", {}), ("bits", "ADDRB", {"values": F.array(text(r), F.lit("70000"))}), ("bits", "COUNTRB", {}), ("bits", "HASRB", {"value": F.lit("3")}), ("radix", "CREATERT", {}), ("radix", "PUTRT", {"subkey": name, "value": F.lit("x")}), ("radix", "HASRT", {"subkey": F.lit("CHINA")}),
        ("bloom", "CREATEBF", {}), ("bloom", "ADDBF", {"value": name}), ("bloom", "HASBF", {"value": name}), ("cuckoo", "CREATECF", {}), ("cuckoo", "ADDCF", {"value": name}), ("cuckoo", "HASCF", {"value": name}), ("count", "CREATECMS", {}), ("count", "INCRCMS", {"subkey": name, "value": F.lit("3")}), ("string", "DEL", {}), ("string", "EXISTS", {}),
    ]
    types = dict(c.split() for c in keyed.LOG.split(", "))
    log = None
    for i, (family, command, own) in enumerate(steps):
        fixed = {"seq": F.col("k") * 1000 + i, "command": F.lit(command), "key": F.concat(F.lit(" " * (i % 2) + family + ":"), text(F.col("k")))}
        rows = nations.select(*((fixed | own).get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()))
        log = rows if log is None else log.union(rows)
    reads = [i for i, (_, c, _) in enumerate(steps) if c in READS]
    out = keyed.apply_log(log, now=0.0).where((F.col("seq") % 1000).isin(reads))
    return out.select("seq", "ok", "value")


#: Commands whose values the log query returns, with their values in SQL.
READS = {"GET": None, "PEEKMAP": "n_name", "POPSLICE": "CAST(n_regionkey AS VARCHAR)", "HEADSLICE": "n_name", "HASSET": "'1'", "REMSET": "'0'", "POPPQ": None, "SUMFW": "CASE WHEN n_regionkey <= 2 THEN '7' ELSE '0' END", "RANGEFW": "CASE WHEN n_regionkey BETWEEN 1 AND 9 THEN '7' ELSE '0' END", "COUNTRB": "'2'", "HASRB": "CASE WHEN n_regionkey = 3 THEN '1' ELSE '0' END", "HASRT": "CASE WHEN n_name = 'CHINA' THEN '1' ELSE '0' END", "HASBF": "'1'", "HASCF": "'1'", "EXISTS": "'0'"}
FAMILIES_SQL = "SELECT CAST(n_nationkey AS BIGINT) * 1000 + i AS seq, TRUE AS ok, v AS value FROM (" + " UNION ALL ".join(
    f"SELECT n_nationkey, {i} AS i, {sql} AS v FROM nation"
    for i, sql in [(1, "n_name"), (4, "CAST(n_regionkey + 5 AS VARCHAR)"), (6, READS["PEEKMAP"]), (8, READS["POPSLICE"]), (9, READS["HEADSLICE"]), (11, "'1'"), (12, "'0'"), (15, "'{\"priority\":' || CAST(9007199254740993 + n_regionkey AS VARCHAR) || ',\"value\":\"' || n_name || '\"}'"), (18, READS["SUMFW"]), (19, READS["RANGEFW"]), (22, "'2'"), (23, READS["HASRB"]), (26, READS["HASRT"]), (29, "'1'"), (32, "'1'"), (36, "'0'")]
) + ")"


NATIVE: dict[str, tuple[Query, str | None]] = {
    "flagship": (flagship_rounded, "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY 1"),
    "command_families": (command_families, FAMILIES_SQL),
    "params_bind": (params_bind, "SELECT o_orderkey FROM orders WHERE o_totalprice > 50000 AND o_orderstatus = 'F'"),
    "udf_go_where_select": (udf_go, f"SELECT {LINE}, l_extendedprice * (1 + l_tax) AS g FROM lineitem WHERE l_extendedprice < 20000 AND l_quantity > 10"),
    "page_second": (page_second, "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 25"),
    "explain_steps": (explain_steps, "SELECT node, detail FROM (VALUES " + ", ".join(f"('{n}', '{d}')" for n, d in STEPS) + ") AS t(node, detail)"),
    "keys_catalog": (keys_catalog, f"SELECT key, 'table' AS type, CAST(NULL AS BIGINT) AS ttl_ms, TRUE AS on_disk FROM (VALUES {', '.join(f"('{t}')" for t in TABLES)}) AS t(key)"),
    "bloom_no_false_neg": (bloom_no_false_negative, "SELECT CAST(0 AS BIGINT) AS missed, count(*) AS asked, TRUE AS few_others FROM part"),
    "cuckoo_no_false_neg": (filter_no_false_negative("cuckoo"), "SELECT CAST(0 AS BIGINT) AS missed, count(DISTINCT p_name) AS asked, TRUE AS few_others FROM part"),
    "xor_no_false_neg": (filter_no_false_negative("xor"), "SELECT CAST(0 AS BIGINT) AS missed, count(DISTINCT p_name) AS asked, TRUE AS few_others FROM part"),
    "cms_upper_bound": (cms_upper_bound, "SELECT CAST(0 AS BIGINT) AS under, count(DISTINCT user_id) AS items, TRUE AS seldom_far_over FROM events"),
    "hll_within_err": (hll_within_error, "SELECT l_returnflag, count(DISTINCT l_partkey) AS n, TRUE AS close FROM lineitem GROUP BY 1"),
    "quantile_within_err": (quantile_within_error, "SELECT CAST(q AS DOUBLE) AS quantile, TRUE AS close FROM (VALUES (0.0), (0.25), (0.5), (0.9), (1.0)) v(q)"),
    "topk_heavy_hitters": (topk_heavy_hitters, "SELECT '\"' || event_type || '\"' AS item, count(*) AS count, CAST(0 AS BIGINT) AS error FROM events GROUP BY 1"),
    "reservoir_size_and_subset": (reservoir_size, "SELECT CAST(least(128, count(*)) AS BIGINT) AS size, CAST(least(128, count(*)) AS BIGINT) AS distinct_rows, CAST(least(128, count(*)) AS BIGINT) AS same_if_dealt_anew, TRUE AS spread FROM events"),
    "bitmap_set_ops": (bitmap_set_ops, "SELECT (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_orderstatus IN ('F', 'O')) AS cardinality, (SELECT count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')) AS both_sides, (SELECT count(DISTINCT o_custkey // 65536) FROM orders WHERE o_orderstatus = 'F') AS containers"),
    "sparse_bitset_count": (sparse_bitset_count, "SELECT l_returnflag, count(DISTINCT l_orderkey) AS cardinality FROM lineitem GROUP BY 1"),
    "fenwick_prefix_sum": (fenwick_prefix, "SELECT l_partkey, CAST(value AS BIGINT) AS value, CAST(sum(value) OVER (ORDER BY l_partkey) AS BIGINT) AS prefix_sum FROM (SELECT l_partkey, sum(l_linenumber) AS value FROM lineitem GROUP BY 1)"),
    "fenwick_range_sum": (fenwick_range, "SELECT CAST(coalesce(sum(l_linenumber), 0) AS BIGINT) AS range_sum FROM lineitem WHERE l_partkey BETWEEN 10 AND 150"),
    "radix_prefix_scan": (radix_prefix_scan, "SELECT url, page_id FROM pages WHERE starts_with(url, 'https://www.') ORDER BY url"),
    "pq_pop_order": (pq_pop_order, "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY length(event_type), event_id) AS INTEGER) AS place FROM events"),
    "deque_ends": (deque_ends, "SELECT user_id, arg_min(event_type, event_id) AS head, arg_max(event_type, event_id) AS tail, count(*) AS size FROM events GROUP BY 1"),
    "set_membership": (set_membership, "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase')"),
    "counter_inc": (counter_inc, "SELECT user_id, CAST(count(*) AS INTEGER) AS counter FROM events GROUP BY 1"),
    "latest_write": (latest_write, "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1"),
    "ttl_live_filter": (ttl_live, "SELECT event_id FROM events WHERE ts + INTERVAL 1 DAY > (SELECT max(ts) FROM events)"),
    "command_batch_fold": (command_batch_fold, "SELECT user_id, CAST(count(*) AS VARCHAR) AS n FROM events GROUP BY 1"),
}


def queries() -> dict[str, Query]:
    return {n: from_sql(q) for n, (q, _) in SQL.items()} | {n: q for n, (q, _) in NATIVE.items()}


def oracle_sql() -> dict[str, str]:
    return {n: o for n, (_, o) in SQL.items()} | {n: o for n, (_, o) in NATIVE.items() if o}
