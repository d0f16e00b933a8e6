"""Queries over texts by the routing rules, and over events as ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import routing
from siftline.operators import ranks
from siftline.session import table

QUERIES, SQL = {}, {}


def _words(words: list[str]) -> str:
    return "coalesce(regexp_matches(lower(text), '\\b(" + "|".join(words) + ")\\b'), false)"


def route_documents(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", routing.target(t).alias("target"), routing.mode(t).alias("mode"), routing.region(t).alias("region"), routing.overclaims(t).alias("overclaims"))


QUERIES["route_documents"] = route_documents
SQL["route_documents"] = (
    "SELECT doc_id, CASE " + " ".join(f"WHEN {_words(w)} THEN '{n}'" for n, w in routing.TARGETS) + f" END AS target, CASE WHEN {_words(routing.UNSUPERVISED)} THEN 'unsupervised' ELSE 'supervised' END AS mode, CASE "
    + " ".join(f"WHEN {_words([r])} THEN '{r}'" for r in sorted(routing.REGIONS, key=lambda r: (-len(r), r))) + f" END AS region, {_words(routing.FORBIDDEN)} AS overclaims FROM documents"
)


def route_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").groupBy(routing.target(t).alias("target"), "source").agg(F.count("*").alias("n"), F.count_distinct("author_id").alias("authors"))


QUERIES["route_counts"] = route_counts
SQL["route_counts"] = "SELECT CASE " + " ".join(f"WHEN {_words(w)} THEN '{n}'" for n, w in routing.TARGETS) + " END AS target, source, count(*) AS n, count(DISTINCT author_id) AS authors FROM documents GROUP BY ALL"


def events_first_conversion(spark: SparkSession, d: str) -> DataFrame:
    """Users whose first event is a view and who bought later."""
    e = table(spark, d, "events").where("user_id is not null and ts is not null")
    g = e.groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first"), F.count("*").alias("n"), F.max(F.when(F.col("event_type") == "purchase", F.struct("ts", "event_id"))).alias("last"), F.min(F.struct("ts", "event_id")).alias("start"))
    return g.select("user_id", "first", "n", F.when((F.col("first") == "view") & (F.col("n") > 1), F.coalesce(F.col("last") > F.col("start"), F.lit(False)).cast("int")).alias("conversion"))


QUERIES["events_first_conversion"] = events_first_conversion
SQL["events_first_conversion"] = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL) SELECT user_id, max(event_type) FILTER (k = 1) AS first, count(*) AS n, CASE WHEN max(event_type) FILTER (k = 1) = 'view' AND count(*) > 1 THEN max((k > 1 AND event_type = 'purchase')::INT) END AS conversion FROM r GROUP BY user_id"


def orders_nearest_ship(spark: SparkSession, d: str) -> DataFrame:
    """Each order's line shipped nearest to the order's date."""
    o, li = table(spark, d, "orders").select("o_orderkey", "o_orderdate"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    from siftline.operators.tables import nearest_to_anchor

    return nearest_to_anchor(o.withColumnRenamed("o_orderkey", "l_orderkey"), li, "l_orderkey", "o_orderdate", "l_shipdate", "l_linenumber").select("l_orderkey", "l_linenumber", "gap_days")


QUERIES["orders_nearest_ship"] = orders_nearest_ship
SQL["orders_nearest_ship"] = "WITH p AS (SELECT l_orderkey, l_linenumber, abs(date_diff('day', CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE))) g, row_number() OVER (PARTITION BY l_orderkey ORDER BY abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)), l_shipdate, l_linenumber) k FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT l_orderkey, l_linenumber, CAST(g AS INT) AS gap_days FROM p WHERE k = 1"


def top_parts_by_brand(spark: SparkSession, d: str) -> DataFrame:
    """The three best-selling parts of each brand."""
    v = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("v"))
    p = table(spark, d, "part")
    j = p.join(v, p["p_partkey"] == v["l_partkey"]).select("p_brand", "p_partkey", "v")
    return ranks.top_k(j, ["p_brand"], [F.col("v").desc(), F.col("p_partkey")], 3).withColumn("rank", F.col("rank").cast("bigint"))


QUERIES["top_parts_by_brand"] = top_parts_by_brand
SQL["top_parts_by_brand"] = "WITH s AS (SELECT p_brand, p_partkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS v FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY v DESC, p_partkey) AS rank FROM s) SELECT * FROM r WHERE rank <= 3"
