"""Streaming queries: the events table read as a stream and drained."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..streaming import history, loading, state
from .fact import table


def st1_running_state(spark, d):
    """Each event's user history before it, by keyed state; as many rows as events."""
    schema = table(spark, d, "events").schema
    work = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{d}/events.parquet")
    stream = stream.withColumns({"ts": F.col("ts").cast("timestamp"), "value": F.round(F.col("value") * 100)})
    out = state.running_state(stream, "user_id", "value", ["event_id"])
    out.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/log").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{work}/out")
    return got.select("user_id", "event_id", "last_mean", "n_before", F.round("ewm", 4).alias("ewm"))


def st1_event_time_history(spark, d):
    """Each event's user history before it, in event time; a closing entry of no user moves the watermark past all events."""
    work = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", history.STORE)
    events = table(own, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.round(F.col("value") * 100).alias("value"))
    events.write.parquet(f"{work}/in")
    end = events.agg(F.max("ts").alias("ts")).selectExpr("cast(null AS bigint) AS user_id", "ts + INTERVAL 3 DAYS AS ts", "cast(null AS bigint) AS event_id", "cast(null AS double) AS value")
    end.write.mode("append").parquet(f"{work}/in")
    out = history.history_before(own.readStream.schema(events.schema).parquet(f"{work}/in"), "user_id", "value", ["event_id"], slot="1 day")
    out.writeStream.format("parquet").option("path", f"{work}/out").option("checkpointLocation", f"{work}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{work}/out").select("user_id", "event_id", "last_mean", "long_term_mean", "n_before", F.round("ewm", 4).alias("ewm"))


def io6_stream_load(spark, d):
    """Orders that arrive as a stream, some of them twice and some loaded before: each is in the table once."""
    work = f"{shared_folder(spark)}/load-{uuid.uuid4().hex}"
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    target = loading.Target(f"{work}/table", ("o_orderkey",))
    loading.add_batch(orders.where("o_orderkey % 3 = 0"), -1, target)
    orders.union(orders.where("o_orderkey % 5 = 0")).write.partitionBy("o_orderstatus").parquet(f"{work}/arrived")
    stream = spark.readStream.schema(orders.schema).option("maxFilesPerTrigger", 4).parquet(f"{work}/arrived")
    loading.load_new(stream, target, f"{work}/log").awaitTermination()
    return target.table(spark).select(orders.columns)


QUERIES = {"st1_running_state": st1_running_state, "st1_event_time_history": st1_event_time_history, "io6_stream_load": io6_stream_load}
ORACLE_SQL = {
    "io6_stream_load": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders",
    "st1_running_state": "SELECT user_id, event_id, avg(v) OVER w10 AS last_mean, count(*) OVER wall AS n_before,"
    " round(CASE WHEN count(*) OVER wall > 0 THEN list_reduce(list(v) OVER wall, lambda a, x: a + (2.0 / 6) * (x - a)) END, 4) AS ewm FROM (SELECT *, round(value * 100) AS v FROM events)"
    " WINDOW w10 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), wall AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
}
# Users have no two events of one time, so frames of rows see what frames of times do.
ORACLE_SQL["st1_event_time_history"] = (
    ORACLE_SQL["st1_running_state"]
    .replace("avg(v) OVER w10 AS last_mean,", "avg(v) OVER w10 AS last_mean, avg(v) OVER w500 AS long_term_mean,")
    .replace(" WINDOW w10", " WINDOW w500 AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING), w10")
)
