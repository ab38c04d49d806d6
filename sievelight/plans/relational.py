"""Extensions without a counterpart in the survey's inventory: general relational coverage on the star schema and the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def money(c):
    return F.round(c, 2)


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
 round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def ext_pricing_summary(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        money(F.sum("l_quantity")).alias("sum_qty"),
        money(F.sum("l_extendedprice")).alias("sum_base_price"),
        money(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
        F.round(F.avg("l_discount"), 6).alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


@query("""SELECT n_name, count(*) AS items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
 WHERE r_name = 'ASIA' GROUP BY 1""")
def ext_join_star(spark, d):
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("lineitem", "orders", "customer", "nation", "region")}
    nations = t["nation"].join(t["region"].where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = t["customer"].join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = t["orders"].join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    items = t["lineitem"].join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return items.groupBy("n_name").agg(F.count("*").alias("items"), money(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).alias("revenue"))


@query("SELECT c_nationkey, c_custkey, c_acctbal, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def ext_window_topn(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return spark.read.parquet(f"{d}/customer.parquet").withColumn("place", F.row_number().over(w)).where("place <= 3").select("c_nationkey", "c_custkey", "c_acctbal", "place")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n, event_id FROM events),
s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, epoch_us(max(ts)) - epoch_us(min(ts)) AS length_us FROM s GROUP BY 1, 2""")
def ext_sessionize(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    gap = F.when(F.col("ts") - F.lag("ts").over(w) <= 30 * 60 * 1_000_000, 0).otherwise(1)
    s = e.withColumn("n", gap).withColumn("session", F.sum("n").over(w))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("events"), (F.max("ts") - F.min("ts")).alias("length_us"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def ext_json_props(spark, d):
    k = F.from_json("props", "k bigint")["k"]
    return spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("k"))
