"""Scans, sinks and streaming ingest over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagline.operators.groups import frequency
from lagline.plans.common import load, query
from lagline.session import shared_path
from lagline.sources.sinks import write_bucketed, write_metric_csv, write_parquet, write_text_fields, write_votes
from lagline.sources.tables import prune, read_bucketed, read_csv, read_name_list, read_parquet, read_parquet_before, read_votes, rows_to_table, split_text_lines
from lagline.streaming.ingest import hourly_counts, ingest_by_hour, ingest_compacted, read_ingested, stream_parquet


@query("parquet_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def parquet_scan(spark, sf_dir):
    """Two columns and a filter, both of which reach the scan."""
    return prune(read_parquet(spark, f"{sf_dir}/lineitem.parquet"), ["l_orderkey", "l_quantity"], F.col("l_quantity") > 45)


@query("scan_before_date", "SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'")
def scan_before_date(spark, sf_dir):
    """Files of a glob restricted to rows before a date."""
    bound = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    return read_parquet_before(spark, f"{sf_dir}/orders*.parquet", "o_orderdate", bound).select("o_orderkey")


@query("scan_with_schema", "SELECT o_orderkey, o_totalprice FROM orders")
def scan_with_schema(spark, sf_dir):
    return read_parquet(spark, f"{sf_dir}/orders.parquet", schema="o_orderkey bigint, o_totalprice double")


@query("csv_text_scan", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_text_scan(spark, sf_dir):
    """A table written as CSV and read back as text."""
    path = shared_path(spark, "csv")
    load(spark, sf_dir, "customer").write.option("header", True).csv(path)
    return read_csv(spark, path).select("c_custkey", "c_name", "c_mktsegment")


@query("csv_typed_scan", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_typed_scan(spark, sf_dir):
    path = shared_path(spark, "csv")
    customers = load(spark, sf_dir, "customer")
    customers.write.option("header", True).csv(path)
    return read_csv(spark, path, schema=customers.schema)


@query("csv_inferred_scan", "SELECT CAST(p_partkey AS INTEGER) AS p_partkey, p_brand, p_size, p_retailprice FROM part")
def csv_inferred_scan(spark, sf_dir):
    path = shared_path(spark, "csv")
    load(spark, sf_dir, "part").write.option("header", True).csv(path)
    return read_csv(spark, path, infer=True).select("p_partkey", "p_brand", "p_size", "p_retailprice")


@query("partitioned_round_trip", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1998")
def partitioned_round_trip(spark, sf_dir):
    """Written by year; the year filter then reads one partition."""
    path = shared_path(spark, "orders-by-year")
    write_parquet(load(spark, sf_dir, "orders").withColumn("yr", F.year("o_orderdate")), path, partition_by=["yr"])
    return read_parquet(spark, path).filter(F.col("yr") == 1998).select("o_orderkey", "o_totalprice")


@query(
    "bucketed_order_totals",
    """SELECT o_orderkey, o_custkey, count(*) AS n_lines, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS quantity
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2""",
)
def bucketed_order_totals(spark, sf_dir):
    """Both tables bucketed by order; the join and the sums per order then need no shuffle."""
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_path(spark, "bucketed")
    write_bucketed(load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), f"{path}/orders", ["o_orderkey"], buckets)
    write_bucketed(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity"), f"{path}/lines", ["l_orderkey"], buckets)
    orders, lines = read_bucketed(spark, f"{path}/orders"), read_bucketed(spark, f"{path}/lines")
    quantity = F.sum(F.col("l_quantity").cast("decimal(12,2)")).cast("double")
    totals = lines.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"), quantity.alias("quantity"))
    return orders.join(totals, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", "n_lines", "quantity")


@query("metric_csv_round_trip", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def metric_csv_round_trip(spark, sf_dir):
    path = shared_path(spark, "metrics")
    write_metric_csv(frequency(load(spark, sf_dir, "events"), "event_type"), path)
    return read_csv(spark, path, schema="event_type string, n bigint")


@query("votes_round_trip", "SELECT p_brand AS feature, CAST(count(*) AS INTEGER) AS votes FROM part GROUP BY 1 HAVING count(*) >= 2")
def votes_round_trip(spark, sf_dir):
    path = shared_path(spark, "votes")
    counts = frequency(load(spark, sf_dir, "part"), "p_brand", name="votes")
    write_votes(counts.select(F.col("p_brand").alias("feature"), F.col("votes").cast("int").alias("votes")), path)
    return read_votes(spark, path, 2)


@query("name_list_round_trip", "SELECT row_number() OVER (ORDER BY n_name) - 1 AS position, n_name AS feature FROM nation")
def name_list_round_trip(spark, sf_dir):
    """Names written as one comma separated line, then read with their positions."""
    path = shared_path(spark, "names")
    names = load(spark, sf_dir, "nation").agg(F.sort_array(F.collect_list("n_name")).alias("fields"))
    write_text_fields(names, path, sep=",")
    return read_name_list(spark, path)


@query("text_lines_round_trip", "SELECT CAST(n_nationkey AS VARCHAR) AS source, CAST(n_regionkey AS VARCHAR) AS target FROM nation")
def text_lines_round_trip(spark, sf_dir):
    """Tab separated pairs written as text, then split again."""
    path = shared_path(spark, "edges")
    pairs = load(spark, sf_dir, "nation").select(F.array(F.col("n_nationkey").cast("string"), F.col("n_regionkey").cast("string")).alias("fields"))
    write_text_fields(pairs, path)
    return split_text_lines(spark, path).select(F.col("fields")[0].alias("source"), F.col("fields")[1].alias("target"))


@query("stream_ingest", "SELECT strftime(ts, '%Y-%m-%d-%H') AS hour, count(*) AS n FROM events GROUP BY 1")
def stream_ingest(spark, sf_dir):
    """Files drained by a stream into hourly partitions, then counted."""
    out, checkpoint = shared_path(spark, "stream-out"), shared_path(spark, "stream-state")
    schema = load(spark, sf_dir, "events").schema
    ingest_by_hour(stream_parquet(spark, f"{sf_dir}/events*.parquet", schema), "ts", out, checkpoint).awaitTermination()
    return hourly_counts(spark.read.schema("event_id bigint, hour string").parquet(out))


@query("compacted_ingest", "SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS period FROM events")
def compacted_ingest(spark, sf_dir):
    """All events through three batches, the last of which merges every day's files; each row once."""
    source, out, checkpoint = (shared_path(spark, n) for n in ("arrivals", "compacted", "compacted-state"))
    load(spark, sf_dir, "events").repartition(3, "event_id").write.parquet(source)
    schema = spark.read.parquet(source).schema
    ingest_compacted(stream_parquet(spark, source, schema, max_files=1), "ts", out, checkpoint, files_per_period=1, most_files=2, pattern="yyyy-MM-dd").awaitTermination()
    return read_ingested(spark, out, schema).select("event_id", "event_type", "period")


@query("result_rows", "SELECT 'lineitem' AS tbl, count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders")
def result_rows(spark, sf_dir):
    """Small results brought back as a table."""
    counts = [(name, load(spark, sf_dir, name).count()) for name in ("lineitem", "orders")]
    return rows_to_table(spark, counts, "tbl string, n bigint")
