"""The test tables as domain relations: documents with lines, payments, bank lines.

Doubles become DECIMAL(18,2) here, once. Each relation has the same definition as SQL text for the oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(x: Column | str, digits: int = 2, precision: int = 18) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast(f"decimal({precision},{digits})")


def doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice headers: one for each order."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("party"),
        F.to_date("o_orderdate").alias("issue_date"),
        money("o_totalprice").alias("gross"),
        F.when(F.col("o_orderstatus") == "F", "invoice").when(F.col("o_orderstatus") == "O", "open").otherwise("partial").alias("doc_type"),
        F.col("o_orderpriority").alias("category"),
    )


DOC = """doc AS (
  SELECT o_orderkey AS id, o_custkey AS party, CAST(o_orderdate AS DATE) AS issue_date, CAST(o_totalprice AS DECIMAL(18,2)) AS gross,
         CASE o_orderstatus WHEN 'F' THEN 'invoice' WHEN 'O' THEN 'open' ELSE 'partial' END AS doc_type, o_orderpriority AS category
  FROM orders)"""


def doc_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice lines: one for each line item; ``net`` is after discount, in cents."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"),
        F.col("l_linenumber").cast("bigint").alias("line"),
        F.col("l_partkey").alias("product"),
        F.col("l_suppkey").alias("supplier"),
        money("l_quantity").alias("qty"),
        money("l_extendedprice").alias("listed"),
        money(F.round(money("l_extendedprice") * (1 - money("l_discount")), 2)).alias("net"),
        money("l_tax").alias("vat_rate"),
        F.to_date("l_shipdate").alias("on_day"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
    )


DOC_LINE = """doc_line AS (
  SELECT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS line, l_partkey AS product, l_suppkey AS supplier,
         CAST(l_quantity AS DECIMAL(18,2)) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS listed,
         CAST(round(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))), 2) AS DECIMAL(18,2)) AS net, CAST(l_tax AS DECIMAL(18,2)) AS vat_rate,
         CAST(l_shipdate AS DATE) AS on_day, l_returnflag AS flag, l_linestatus AS status
  FROM lineitem)"""


def payment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments derived from documents: later by id % 12 days, with a fee of 1.50 on every seventh, four in five paid."""
    return (
        doc(spark, sf_dir)
        .where(F.col("id") % 5 != 4)
        .select(
            F.col("id").alias("pay_id"),
            "party",
            F.date_add("issue_date", (F.col("id") % 12).cast("int")).alias("booked_on"),
            money(F.col("gross") + F.when(F.col("id") % 7 == 0, F.lit("1.50").cast("decimal(18,2)")).otherwise(F.lit("0.00").cast("decimal(18,2)"))).alias("amount"),
        )
    )


PAYMENT = """payment AS (
  SELECT id AS pay_id, party, issue_date + CAST(id % 12 AS INTEGER) AS booked_on,
         CAST(gross + CASE WHEN id % 7 = 0 THEN 1.50 ELSE 0.00 END AS DECIMAL(18,2)) AS amount
  FROM doc WHERE id % 5 <> 4)"""


def tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bank lines: one for each event; purchases and views are money out."""
    amount = money("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("account"),
        "ts",
        F.to_date("ts").alias("booked_on"),
        F.col("event_type").alias("kind"),
        money(F.when(F.col("event_type").isin("purchase", "view"), -amount).otherwise(amount)).alias("amount"),
    )


TX = """tx AS (
  SELECT event_id AS id, user_id AS account, ts, CAST(ts AS DATE) AS booked_on, event_type AS kind,
         CAST(CASE WHEN event_type IN ('purchase', 'view') THEN -CAST(value AS DECIMAL(18,2)) ELSE CAST(value AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS amount
  FROM events)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
