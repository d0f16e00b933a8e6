"""Queries over readers, sinks and streams: given tables are written in each format to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators import history
from siftline.operators.ledger import PRIOR
from siftline.plans.measures import _C, _trade
from siftline.session import scratch, table
from siftline.sources import cohort as co
from siftline.sources import files, sinks
from siftline.streaming import ledger

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("source_csv", "SELECT s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier")
def source_csv(spark: SparkSession, d: str) -> DataFrame:
    """Delimited text with "#" lines; only the columns used are parsed."""
    at, t = scratch(spark), table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    t.write.option("header", True).csv(at)
    t.select(F.concat(F.lit("# row "), F.col("s_suppkey").cast("string"), F.lit(",x"))).write.mode("append").text(at)
    return files.csv(spark, at, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double", comment="#").select("s_suppkey", "s_name", F.round("s_acctbal", 2).alias("s_acctbal"))


@query("source_tsv_strict", "SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_nationkey <> 7")
def source_tsv_strict(spark: SparkSession, d: str) -> DataFrame:
    """Tab-separated text; rows that are too short are dropped."""
    at, c = scratch(spark), table(spark, d, "customer")
    row = F.when(F.col("c_nationkey") == 7, F.concat_ws("\t", "c_custkey", "c_name")).otherwise(F.concat_ws("\t", "c_custkey", "c_name", "c_nationkey"))
    c.select(row.alias("value")).write.text(at)
    return files.strict(spark, at, "c_custkey bigint, c_name string, c_nationkey int", header=False).where("c_nationkey is not null")


@query("source_strings", """SELECT coalesce(ID, '') AS ID, coalesce("M/F", '') AS sex, coalesce(Hand, '') AS Hand, coalesce(CAST(Educ AS VARCHAR), '') AS Educ FROM oasis_cross_sectional""")
def source_strings(spark: SparkSession, d: str) -> DataFrame:
    """All columns as text, gaps as empty text."""
    at = scratch(spark)
    table(spark, d, "oasis_cross_sectional").select("ID", F.col("M/F").alias("sex"), "Hand", "Educ").write.option("header", True).csv(at)
    return files.strings(spark, at)


@query("source_edges", "WITH t AS (SELECT 's' || l_suppkey AS a, 'n' || c_nationkey AS b, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT a AS src, b AS dst, CAST(w AS DOUBLE) AS w FROM t")
def source_edges(spark: SparkSession, d: str) -> DataFrame:
    """An edge list with provenance lines, loops and unreadable weights, which are dropped."""
    at, e = scratch(spark), _trade(spark, d)
    rows = e.select(F.col("a").alias("gene_a"), F.col("b").alias("gene_b"), F.col("w").cast("string").alias("combined_score"))
    bad = e.select("a", "a", F.lit("5")).union(e.select("a", "b", F.lit("n/a"))).union(e.select(F.concat(F.lit("# from "), "a"), F.lit(None), F.lit(None)))
    rows.union(bad).write.option("header", True).csv(at)
    return files.edges(spark, at)


@query("source_snapshot", "SELECT 's' || s_suppkey AS key, s_name AS value FROM supplier")
def source_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """JSON files that hold one object each, {field: {key: value}}, of at most 500 keys; its entries are the rows."""
    at, s = scratch(spark), table(spark, d, "supplier")
    chunk = s.groupBy(F.floor(F.col("s_suppkey") / 500)).agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), "s_name"))).alias("names"))).alias("value"))
    chunk.select("value").write.option("maxRecordsPerFile", 1).text(at)
    return files.snapshot(spark, at, "names")


@query("source_gene_sets", "SELECT p_brand || '/' || CAST(p_partkey // 500 AS VARCHAR) AS set_id, p_brand AS name, CAST(p_partkey AS VARCHAR) AS item FROM part")
def source_gene_sets(spark: SparkSession, d: str) -> DataFrame:
    """Sets with their members from JSON files of one set each."""
    at, p = scratch(spark), table(spark, d, "part")
    of = F.concat("p_brand", F.lit("/"), F.floor(F.col("p_partkey") / 500).cast("string"))
    s = p.groupBy(of.alias("id"), F.col("p_brand").alias("name")).agg(F.collect_list(F.col("p_partkey").cast("string")).alias("genes"))  # 500 at most
    s.select(F.to_json(F.struct(F.array(F.struct("id", "name", "genes")).alias("gene_sets"))).alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    return files.gene_sets(spark, at)


@query("source_html_table", "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation")
def source_html_table(spark: SparkSession, d: str) -> DataFrame:
    """The table that a page keeps as JSON columns, with tags in its cells; a page a region."""
    at, n = scratch(spark), table(spark, d, "nation")
    cells = n.groupBy("n_regionkey").agg(F.to_json(F.array(F.collect_list(F.col("n_nationkey").cast("string")), F.collect_list(F.concat(F.lit("<b>"), "n_name", F.lit("</b>"))))).alias("j"))  # the few nations of a region
    cells.select(F.concat(F.lit('<html><script>var t = {"data": '), "j", F.lit("};</script></html>")).alias("value")).write.option("maxRecordsPerFile", 1).text(at)
    return files.html_table(spark, at, ["id", "name"])


@query("source_segment_stats", """SELECT "MRI ID" AS scan, round(any_value(eTIV), 1) AS icv, round(any_value(eTIV) * 0.25, 1) AS hippocampus FROM oasis_longitudinal WHERE "MRI ID" LIKE '%_MR1' AND eTIV IS NOT NULL GROUP BY 1""")
def source_segment_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics with "# Measure" headers and a table of parts, of each first scan."""
    at, o = scratch(spark), table(spark, d, "oasis_longitudinal").where("`MRI ID` like '%\\_MR1' and eTIV is not null")
    o = o.groupBy(F.col("MRI ID").alias("scan")).agg(F.max("eTIV").alias("v"))
    n = lambda f: F.format_string("%.3f", F.col("v") * f)
    text = F.concat(F.lit("# Measure EstimatedTotalIntraCranialVol, eTIV, x, "), n(1.0), F.lit(", mm^3\n 1 17 10 "), n(0.1), F.lit(" Left-Hippocampus 1\n 2 53 10 "), n(0.15), F.lit(" Right-Hippocampus 1"))
    # every scan's lines carry its name, as one file a scan would be too many files
    lines = o.select("scan", F.explode(F.split(text, "\n")).alias("value"))
    lines.write.parquet(at)
    return files.segment_lines(spark.read.parquet(at).select(F.col("scan").alias("file"), "value")).select(F.col("file").alias("scan"), F.round("icv", 1).alias("icv"), F.round("hippocampus", 1).alias("hippocampus"))


@query("sink_contract", f"WITH {_C} SELECT coalesce(site, '__HIVE_DEFAULT_PARTITION__') AS site, count(*) AS n, count(DISTINCT subject_id) AS subjects FROM c GROUP BY 1")
def sink_contract(spark: SparkSession, d: str) -> DataFrame:
    """The contract written by site and read back."""
    at = scratch(spark)
    sinks.write_contract(co.contract(spark, d), at)
    back = spark.read.schema("subject_id string, site string").parquet(at)
    return back.groupBy(F.coalesce("site", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("site")).agg(F.count("*").alias("n"), F.count_distinct("subject_id").alias("subjects"))


@query("sink_ledger", "SELECT event_type AS arm, 2 * count(*) AS n FROM events GROUP BY 1")
def sink_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Rows appended to a ledger twice."""
    at, rows = scratch(spark), table(spark, d, "events").select(F.col("event_type").alias("arm"), "value")
    for _ in range(2):
        sinks.append_ledger(rows, at)
    return spark.read.parquet(at).groupBy("arm").agg(F.count("*").alias("n"))


@query("sink_report", f"WITH {_C} SELECT dx, CAST(count(*) AS VARCHAR) AS n FROM c GROUP BY dx")
def sink_report(spark: SparkSession, d: str) -> DataFrame:
    """A report written as CSV and read back as text."""
    at = scratch(spark)
    sinks.write_report(co.contract(spark, d).groupBy("dx").agg(F.count("*").alias("n")), at)
    return files.csv(spark, at)


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A given table as a stream of its files."""
    return spark.readStream.schema(table(spark, d, name).schema).option("recursiveFileLookup", True).parquet(f"{d}/{name}.parque[t]")


def _run(stream: DataFrame, mode: str) -> DataFrame:
    """The stream's result after all that is there was read: each batch replaces (complete) or adds to (append) a table."""
    spark, at = stream.sparkSession, scratch(stream.sparkSession)
    how = "overwrite" if mode == "complete" else "append"
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode(how).parquet(at)).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)


def _experiments(e: DataFrame) -> DataFrame:
    return e.select(F.col("event_type").alias("arm"), (F.col("value") > 50).alias("success"), (F.col("value") / 40).alias("effect"), F.col("ts").cast("timestamp").alias("ts"))


@query("stream_beliefs", f"""WITH e AS (SELECT event_type AS arm, value > 50 AS ok, least(greatest(abs(coalesce(value / 40, 0)), 0.5), 2) AS w FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL)
SELECT arm, round({PRIOR} + coalesce(sum(w) FILTER (ok), 0), 4) AS alpha, round({PRIOR} + coalesce(sum(w) FILTER (NOT ok), 0), 4) AS beta, count(*) AS experiments FROM e GROUP BY arm""")
def stream_beliefs(spark: SparkSession, d: str) -> DataFrame:
    """Beliefs about arms kept over a stream of events."""
    return _run(ledger.running_beliefs(_experiments(_stream(spark, d, "events"))), "complete").select("arm", F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"), "experiments")


@query("stream_windows", "SELECT date_trunc('hour', ts) AS start, event_type AS arm, CAST(count(*) FILTER (value > 50) AS BIGINT) AS successes, count(*) AS experiments FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL AND ts IS NOT NULL GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Successes by hour and arm under a watermark."""
    return _run(ledger.windowed_beliefs(_experiments(_stream(spark, d, "events")), "ts"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_visits", """WITH v AS (SELECT DISTINCT RID, EXAMDATE, DIAGNOSIS FROM dxsum WHERE RID IS NOT NULL AND EXAMDATE IS NOT NULL AND DIAGNOSIS IN (1, 2, 3)), w AS (SELECT RID, EXAMDATE, max(DIAGNOSIS) AS s FROM v GROUP BY ALL), u AS (SELECT *, lag(s) OVER (PARTITION BY RID ORDER BY EXAMDATE) AS before FROM w)
SELECT RID, EXAMDATE AS valid_from, CAST(CAST(s AS INT) AS VARCHAR) AS state FROM u WHERE before IS NULL OR before <> s""")
def stream_visits(spark: SparkSession, d: str) -> DataFrame:
    """Visits without repeats from a stream, and the history of their states; of several states at one time the highest."""
    v = _stream(spark, d, "dxsum").where("RID is not null and EXAMDATE is not null and DIAGNOSIS in (1, 2, 3)").select("RID", F.col("EXAMDATE").cast("timestamp").alias("EXAMDATE"), F.col("DIAGNOSIS").cast("int").cast("string").alias("state"))
    once = _run(ledger.versions(v, "RID", "EXAMDATE", "state", "36500 days"), "append")
    return history.satellite(once, "RID", "EXAMDATE", ["state"], [F.col("state")]).select("RID", F.col("valid_from").cast("timestamp_ntz").alias("valid_from"), "state")
