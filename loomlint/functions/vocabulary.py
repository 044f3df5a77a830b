"""Equivalences that the idiom rules assert, as Spark queries over the driver's tables.

The rules recognise collection operations by name and never run them; these queries are derived material: the meaning
of each replacement in DataFrame terms, with the same query in SQL.  Every query is declarative, prunes its columns at
the scan and needs at most one shuffle unless a global order is asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f: Query) -> Query:
        QUERIES[f"vocabulary_{name}"] = f
        ORACLES[f"vocabulary_{name}"] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("sort_first", "SELECT min(l_shipdate) AS first_date FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").agg(F.min("l_shipdate").alias("first_date"))


@query("sort_last", "SELECT max(l_shipdate) AS last_date FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").agg(F.max("l_shipdate").alias("last_date"))


@query("sort_at", "SELECT p_brand, p_retailprice FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r = 3")
def _(spark, sf):
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf, "part").withColumn("r", F.row_number().over(w)).where("r = 3").select("p_brand", "p_retailprice")


@query("sort_reverse", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey")
def _(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.desc("s_acctbal"), "s_suppkey")


@query("take_last", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 5")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), F.desc("c_custkey")).limit(5)


@query("frequencies", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("frequencies_by", "SELECT lower(o_orderpriority) AS priority, count(*) AS n FROM orders GROUP BY lower(o_orderpriority)")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy(F.lower("o_orderpriority").alias("priority")).agg(F.count(F.lit(1)).alias("n"))


@query("uniq_first", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("event_type", "event_id").alias("event_type"))


@query("uniq", "SELECT DISTINCT c_mktsegment FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_mktsegment").distinct()


@query(
    "dedup",
    "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE event_type IS DISTINCT FROM p",
)
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("p", F.lag("event_type").over(w)).where(~F.col("event_type").eqNullSafe(F.col("p"))).select("user_id", "event_id", "event_type")


@query("extremes", "SELECT max(l_quantity) AS most, min(l_quantity) AS least, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").agg(F.max("l_quantity").alias("most"), F.min("l_quantity").alias("least"), F.sum("l_linenumber").alias("total"))


@query("map_aggregate", "SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("one_pass", "SELECT o_orderstatus, count(*) AS n, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_orderstatus")
def _(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query("slice", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10 OFFSET 20")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name").orderBy("p_partkey").offset(20).limit(10)


@query("drop_last", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 2")
def _(spark, sf):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(spark, sf, "orders").withColumn("r", F.row_number().over(w)).where("r > 2").select("o_custkey", "o_orderkey")


@query(
    "take_while_count",
    "SELECT user_id, count(*) FILTER (ok) AS n FROM (SELECT user_id, bool_and(value < 90) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ok FROM events) GROUP BY user_id",
)
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("user_id", F.bool_and(F.col("value") < 90).over(w).alias("ok")).groupBy("user_id").agg(F.count_if("ok").alias("n"))


@query("member", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")
def _(spark, sf):
    large = table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(large, "c_custkey", "left_semi")


@query("fetch_or_default", "SELECT c_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def _(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "customer").select("c_custkey").join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("no_sentinel", "SELECT count(*) AS without_orders FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, sf):
    buyers = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").select("c_custkey").join(buyers, "c_custkey", "left_anti").agg(F.count(F.lit(1)).alias("without_orders"))


@query("iterate_pairs", "SELECT n_nationkey, k, v FROM (SELECT n_nationkey, 'name' AS k, n_name AS v FROM nation UNION ALL SELECT n_nationkey, 'region', CAST(n_regionkey AS VARCHAR) FROM nation)")
def _(spark, sf):
    pairs = F.create_map(F.lit("name"), F.col("n_name"), F.lit("region"), F.col("n_regionkey").cast("string"))
    return table(spark, sf, "nation").select("n_nationkey", F.explode(pairs).alias("k", "v"))


@query("map_join", "SELECT n_regionkey, string_agg(upper(n_name), ',' ORDER BY upper(n_name)) AS names FROM nation GROUP BY n_regionkey")
def _(spark, sf):
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(F.upper("n_name"))), ",").alias("names"))


@query("concat", "SELECT string_agg(r_name, '' ORDER BY r_name) AS names FROM region")
def _(spark, sf):
    return table(spark, sf, "region").agg(F.concat_ws("", F.array_sort(F.collect_list("r_name"))).alias("names"))


@query("string_reverse", "SELECT n_name, reverse(n_name) AS backwards FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_name", F.reverse("n_name").alias("backwards"))


@query("string_length", "SELECT doc_id, length(text) AS n FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.char_length("text").cast("long").alias("n"))


@query("palindrome", "SELECT part.p_partkey FROM part WHERE CAST(p_partkey AS VARCHAR) = reverse(CAST(p_partkey AS VARCHAR))")
def _(spark, sf):
    digits = F.col("p_partkey").cast("string")
    return table(spark, sf, "part").where(digits == F.reverse(digits)).select("p_partkey")


@query("split_count", "SELECT doc_id, CAST(len(string_split(text, 'the')) - 1 AS BIGINT) AS n FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.size(F.split("text", "the", -1)) - 1).cast("long").alias("n"))


@query("sliding", "SELECT n_name, gram, count(*) AS n FROM (SELECT n_name, substr(n_name, CAST(i AS INTEGER), 3) AS gram FROM nation, range(1, 100) r(i) WHERE i <= length(n_name) - 2) GROUP BY n_name, gram")
def _(spark, sf):
    grams = F.transform(F.sequence(F.lit(1), F.char_length("n_name") - 2), lambda i: F.substr("n_name", i, F.lit(3)))
    names = table(spark, sf, "nation").where(F.char_length("n_name") >= 3)
    return names.select("n_name", F.explode(grams).alias("gram")).groupBy("n_name", "gram").agg(F.count(F.lit(1)).alias("n"))


@query("digits", "SELECT digit, count(*) AS n FROM (SELECT unnest(string_split(CAST(o_orderkey AS VARCHAR), '')) AS digit FROM orders) GROUP BY digit")
def _(spark, sf):
    digits = F.explode(F.split(F.col("o_orderkey").cast("string"), ""))
    return table(spark, sf, "orders").select(digits.alias("digit")).groupBy("digit").agg(F.count(F.lit(1)).alias("n"))


@query("larger_smaller", "SELECT l_orderkey, l_linenumber, greatest(l_discount, l_tax) AS larger, least(l_discount, l_tax) AS smaller FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.greatest("l_discount", "l_tax").alias("larger"), F.least("l_discount", "l_tax").alias("smaller"))


@query("fold", "SELECT vec_id, count(x) AS n, CAST(count(*) FILTER (x > 0) AS BIGINT) AS positive FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) GROUP BY vec_id")
def _(spark, sf):
    positive = F.aggregate("embedding", F.lit(0).cast("long"), lambda a, x: a + F.when(x > 0, 1).otherwise(0))
    return table(spark, sf, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), positive.alias("positive"))


@query("reverse_append", "SELECT doc_id, list_concat(list_reverse(string_split(source, 'r')), [lang]) [1] AS head FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.element_at(F.concat(F.reverse(F.split("source", "r", -1)), F.array("lang")), 1).alias("head"))


@query("with_index", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations")
def _(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", (F.row_number().over(w) - 1).cast("long").alias("i"))


@query("float_cast", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS size FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"))


@query("not_empty", "SELECT doc_id, length(text) > 0 AS filled FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.char_length("text") > 0).alias("filled"))
