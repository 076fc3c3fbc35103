"""Named queries: states from events, snapshots, chases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.plans import tools as T
from provena.plans.bind import money, table
from provena.plans.registry import query
from provena.sources import erasure as E
from provena.storage import write_table
from provena.streaming import chases as C
from provena.streaming import snapshots as S


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    """The event table as each user's numbered log."""
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).cast("bigint")
    return table(spark, sf, "events").select(F.col("user_id").alias("tenant"), nth.alias("seq"), F.col("event_type").alias("key"), money("value").alias("amount"), F.col("props").alias("body"))


EVENT_LOG = """l AS (
  SELECT user_id AS tenant, event_type AS key, CAST(value AS DECIMAL(18,2)) AS amount, props AS body,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"""


@query(
    f"""
WITH {EVENT_LOG},
p AS (SELECT *, ('0x' || substr(sha256(tenant || chr(10) || seq || chr(10) || coalesce(body, '')), 1, 15))::BIGINT AS proof, max(seq) OVER (PARTITION BY tenant) // 20 * 20 AS upto FROM l)
SELECT tenant, key, count(*) AS n, sum(amount)::DECIMAL(28,2) AS amount, min(seq) AS first_seq, max(seq) AS last_seq, arg_max(body, seq) AS last_body,
       sum(proof)::DECIMAL(38,0) AS proof, any_value(upto) AS resumed_from, true AS same
FROM p GROUP BY tenant, key"""
)
def state_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The state of every user's events, resumed from the newest snapshot (every 20 events) and compared with the full replay."""
    log = write_table(event_log(spark, sf), "event-log")
    shots = write_table(S.snapshots(log, 20), "snapshots")
    resumed = write_table(S.resume(shots, log), "resumed")
    told = resumed.join(S.compare_states(resumed, S.fold(log)).select("tenant", "same"), "tenant").join(S.newest(shots), "tenant", "left")
    return told.select(*S.STATE, F.coalesce("upto", F.lit(0)).cast("bigint").alias("resumed_from"), "same")


@query(
    """
WITH c AS (
  SELECT o_orderkey AS chase_id, CAST(o_orderdate AS DATE) AS asked_on, CAST(min(l_shipdate) AS DATE) AS answered_on
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate GROUP BY o_orderkey, o_orderdate),
s AS (
  SELECT chase_id, asked_on AS day, 'ask' AS step FROM c
  UNION ALL
  SELECT chase_id, asked_on + d, step FROM c, (VALUES (6, 'remind'), (12, 'remind'), (18, 'escalate'), (30, 'give_up')) v(d, step)
  WHERE answered_on IS NULL OR asked_on + d < answered_on
  UNION ALL
  SELECT chase_id, answered_on, 'answer' FROM c WHERE answered_on <= asked_on + 30)
SELECT step, day, count(*) AS n, min(chase_id) AS first_chase, max(chase_id) AS last_chase FROM s WHERE day <= DATE '1998-06-30' GROUP BY step, day"""
)
def chase_steps_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """What falls due each day in the chases for all orders until their first shipment: reminders, escalations, ends."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("chase_id"), F.to_date("o_orderdate").alias("asked_on"))
    sent = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chase_id"), F.to_date("l_shipdate").alias("sent_on"))
    # shipments before the order answer nothing; each order's first later one is taken behind the join
    answered = sent.join(orders, "chase_id").where("sent_on >= asked_on").groupBy("chase_id").agg(F.min("sent_on").alias("answered_on"))
    steps = C.chase_timeline(orders.join(answered, "chase_id", "left"), F.lit("1998-06-30").cast("date"))
    return steps.groupBy("step", F.col("at").alias("day")).agg(F.count("*").alias("n"), F.min("chase_id").alias("first_chase"), F.max("chase_id").alias("last_chase"))


@query(
    """
SELECT source AS tenant, count(*) AS rows_before, count(text) AS readable_before, CASE WHEN source = (SELECT min(source) FROM documents) THEN 0 ELSE count(*) END AS rows_after,
       CASE WHEN source = (SELECT min(source) FROM documents) THEN 0 ELSE count(text) END AS readable_after, source <> (SELECT min(source) FROM documents) AS unchanged
FROM documents WHERE source IS NOT NULL GROUP BY source"""
)
def tenant_erased(spark: SparkSession, sf: str) -> DataFrame:
    """Documents sealed by source; the first source's key is dropped and its rows are rewritten away; what is left of each."""
    docs = table(spark, sf, "documents").where("source IS NOT NULL")
    keys = write_table(E.new_keys(docs, "source"), "keys")
    sealed = E.SealedTable.write(docs.select("doc_id", "source", "text"), "source", ["text"], keys, F.col("doc_id"))
    digests = lambda k: E.tenant_digests(sealed.readable(k), "source", ["text", "doc_id"])
    before = write_table(digests(keys), "digests")
    gone = before.agg(F.min("tenant")).first()[0]
    left = write_table(E.drop_key(keys, gone), "keys")
    sealed.erase(gone)
    after = digests(left).select("tenant", F.col("rows").alias("rows_after"), F.col("readable").alias("readable_after"), F.col("digest").alias("now"))
    told = before.join(after, "tenant", "left").fillna(0, ["rows_after", "readable_after"])
    return told.select("tenant", F.col("rows").alias("rows_before"), F.col("readable").alias("readable_before"), "rows_after", "readable_after", F.coalesce(F.col("digest") == F.col("now"), F.lit(False)).alias("unchanged"))


@query(
    """
SELECT 'spending' AS tool, o_orderpriority AS label, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DECIMAL(28,2) AS amount FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-06-30' GROUP BY o_orderpriority
UNION ALL
SELECT 'largest', label, n, amount FROM (
  SELECT c_custkey, c_name || ' ' || c_mktsegment AS label, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DECIMAL(28,2) AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name, c_mktsegment HAVING sum(CAST(o_totalprice AS DECIMAL(18,2))) > 1000000.5 ORDER BY amount DESC, c_custkey LIMIT 10)
UNION ALL
SELECT 'documents', source, count(*), sum(n_chars)::DECIMAL(28,2) FROM documents WHERE contains(lower(text), 'the ') AND lang = 'en' GROUP BY source"""
)
def tool_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Three tools called with JSON arguments."""
    calls = [("spending", '{"start": "1995-01-01", "end": "1996-06-30"}'), ("largest", '{"above": 1000000.5}'), ("documents", '{"phrase": "The ", "lang": "en"}')]
    return reduce(DataFrame.unionByName, [T.call(spark, sf, name, args).select(F.lit(name).alias("tool"), "label", "n", "amount") for name, args in calls])
