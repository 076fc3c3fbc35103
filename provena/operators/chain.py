"""Hash chains and state histories (F10, F11, F12, J02): recomputed links, first break, illegal steps."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GENESIS = "genesis:"


def genesis(tenant: Column) -> Column:
    return F.sha2(F.concat(F.lit(GENESIS), tenant.cast("string")), 256)


def link(prev: Column, body: Column) -> Column:
    """SHA-256 of the link before, a newline and the body."""
    return F.sha2(F.concat(prev, F.lit("\n"), body), 256)


def chained(rows: DataFrame, tenant: str, order: str, body: str, tails: DataFrame | None = None) -> DataFrame:
    """(tenant, seq, body, prev_hash, hash): each tenant's bodies in order, numbered and linked on from its tail.

    ``tails`` (tenant, seq, hash) are the last links so far; without one a chain begins at its genesis. A link needs
    the one before it, so a tenant's rows pass through one task, sorted, and are given out as they come: the task
    holds one batch and the last link, however long the log. The window that numbers the rows keeps them together.
    """
    told = rows.select(F.col(tenant).alias("tenant"), F.col(order).alias("order"), F.col(body).alias("body"))
    told = told.withColumn("nth", F.row_number().over(W.partitionBy("tenant").orderBy("order")))
    if tails is None:
        told = told.withColumns({"seq": F.lit(0).cast("bigint"), "hash": F.lit(None).cast("string")})
    else:
        told = told.join(tails.select(F.col(tenant).alias("tenant"), F.col("seq").cast("bigint").alias("seq"), "hash"), "tenant", "left")
        # numbered again behind the join, which may have dealt the rows anew
        told = told.withColumn("nth", F.row_number().over(W.partitionBy("tenant").orderBy("order")))
    told = told.select("tenant", "body", F.col("nth").cast("bigint").alias("nth"), F.coalesce("seq", F.lit(0)).alias("seq"), F.coalesce("hash", genesis(F.col("tenant"))).alias("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = ""
        for batch in batches:
            links: list[str] = []
            before: list[str] = []
            for text, nth, start in zip(*(batch.column(c).to_pylist() for c in ("body", "nth", "hash")), strict=True):
                before.append(start if nth == 1 else last)
                last = hashlib.sha256(f"{before[-1]}\n{text}".encode()).hexdigest() if text is not None else ""
                links.append(last)
            seq = pa.array([s + n for s, n in zip(batch.column("seq").to_pylist(), batch.column("nth").to_pylist(), strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("tenant"), seq, batch.column("body"), pa.array(before, pa.string()), pa.array(links, pa.string())], [tenant, "seq", "body", "prev_hash", "hash"])

    return told.mapInArrow(run, f"`{tenant}` {dict(rows.dtypes)[tenant]}, seq bigint, body string, prev_hash string, hash string")


def build_chain(events: DataFrame, tenant: str, seq: str, body: str) -> DataFrame:
    """(tenant, seq, body, prev_hash, hash) for a whole append-only log whose numbers run from 1."""
    return chained(events, tenant, seq, body).withColumnsRenamed({"seq": seq, "body": body})


def verify_chain(log: DataFrame, tenant: str, seq: str, body: str, expected_last: DataFrame | None = None) -> DataFrame:
    """one row for each tenant: entries, the first sequence number with a problem, and what it is.

    Problems, in the order of the chain: a gap in the numbers, a link that does not follow the one before, a body
    that does not fit its hash. ``expected_last`` (tenant, last_seq, last_hash) also finds a chain that was cut off.
    """
    w = W.partitionBy(tenant).orderBy(seq)
    prev_hash, prev_seq = F.lag("hash").over(w), F.lag(seq).over(w)
    expected = F.coalesce(prev_hash, genesis(F.col(tenant)))
    problem = F.when(prev_seq.isNotNull() & (F.col(seq) != prev_seq + 1), "gap").when(F.col("prev_hash") != expected, "broken_link").when(F.col("hash") != link(F.col("prev_hash"), F.col(body)), "edited")
    seen = log.withColumn("problem", problem)
    bad = F.min(F.when(F.col("problem").isNotNull(), F.struct(F.col(seq).alias("at"), "problem")))
    out = seen.groupBy(tenant).agg(F.count("*").alias("entries"), bad.alias("bad"), F.max(F.struct(F.col(seq).alias("at"), "hash")).alias("last"))
    if expected_last is not None:
        out = out.join(expected_last, tenant, "full").withColumn("entries", F.coalesce("entries", F.lit(0)))
        short = F.col("bad").isNull() & F.col("last_hash").isNotNull() & ~F.col("last.hash").eqNullSafe(F.col("last_hash"))
        out = out.withColumn("bad", F.when(short, F.struct(F.col("last_seq").cast(dict(log.dtypes)[seq]).alias("at"), F.lit("cut_off").alias("problem"))).otherwise(F.col("bad")))
    return out.select(tenant, "entries", F.col("bad.at").alias("first_bad"), F.col("bad.problem").alias("problem"), F.col("bad").isNull().alias("intact"))


def step_counts(steps: DataFrame, legal: Sequence[tuple[str, str]]) -> DataFrame:
    """how often each pair of states follows each other, and whether the pair is legal."""
    allowed = F.array(*[F.lit(f"{a}>{b}") for a, b in legal])
    pairs = steps.where("from_state IS NOT NULL").groupBy("from_state", "to_state").agg(F.count("*").alias("n"))
    return pairs.withColumn("legal", F.array_contains(allowed, F.concat_ws(">", "from_state", "to_state")))
