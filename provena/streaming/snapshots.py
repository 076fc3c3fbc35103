"""Event-sourced state with snapshots (J01): fold, snapshot every n events, resume from the newest, prove the replay.

A state is rows of (tenant, key): what the events of that key add up to. Its parts are sums, extremes and "the last by
number", so a state is merged with the fold of further events by the same aggregates, in any grouping; nothing is
folded one after another and no tenant has to fit into one task. ``proof`` is the sum of a digest of every event with
its number: states of the same events in the same order have the same proof, however they were put together, and
an edited, dropped, repeated or renumbered event changes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.storage import scratch_path

STATE = ("tenant", "key", "n", "amount", "first_seq", "last_seq", "last_body", "proof")
#: Hex digits of an event's digest that enter the proof: 60 bits, whose sums stay exact for 10**20 events.
PROOF_DIGITS = 15


def event_proof(tenant: Column, seq: Column, body: Column) -> Column:
    """The digest of one event at its place, as a whole number."""
    told = F.concat_ws("\n", tenant.cast("string"), seq.cast("string"), F.coalesce(body, F.lit("")))
    return F.conv(F.substring(F.sha2(told, 256), 1, PROOF_DIGITS), 16, 10).cast("decimal(38,0)")


def fold(log: DataFrame) -> DataFrame:
    """The state of a log (tenant, seq, key, amount decimal, body); an empty log has none."""
    rows = log.withColumn("proof", event_proof(F.col("tenant"), F.col("seq"), F.col("body")))
    return rows.groupBy("tenant", "key").agg(
        F.count("*").alias("n"),
        F.sum("amount").cast("decimal(28,2)").alias("amount"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        F.max_by("body", "seq").alias("last_body"),
        F.sum("proof").cast("decimal(38,0)").alias("proof"),
    )


def merge(*states: DataFrame) -> DataFrame:
    """The state of the events of all ``states`` together."""
    rows = states[0]
    for s in states[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("tenant", "key").agg(
        F.sum("n").alias("n"),
        F.sum("amount").cast("decimal(28,2)").alias("amount"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
        F.max_by("last_body", "last_seq").alias("last_body"),
        F.sum("proof").cast("decimal(38,0)").alias("proof"),
    )


def snapshots(log: DataFrame, every: int) -> DataFrame:
    """(upto, state...): each tenant's state after every ``every`` events: keys that change between two of them have a row.

    A key's state at a snapshot is its newest row up to it (:func:`state_at`). Each stretch is folded once, and running
    aggregates over the stretches of a key make the states, so a snapshot costs what changed and not what there is.
    """
    stretch = F.floor((F.col("seq") - 1) / every)
    whole = log.groupBy("tenant").agg(F.floor(F.max("seq") / every).alias("full"))
    stretches = log.withColumn("stretch", stretch)
    parts = stretches.withColumn("key", F.struct("key", "stretch")).drop("stretch")
    folded = fold(parts).select("tenant", F.col("key.key").alias("key"), F.col("key.stretch").alias("stretch"), *STATE[2:])
    until = W.partitionBy("tenant", "key").orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)
    running = folded.select(
        "tenant",
        "key",
        ((F.col("stretch") + 1) * every).cast("bigint").alias("upto"),
        F.sum("n").over(until).alias("n"),
        F.sum("amount").over(until).cast("decimal(28,2)").alias("amount"),
        F.min("first_seq").over(until).alias("first_seq"),
        "last_seq",
        "last_body",
        F.sum("proof").over(until).cast("decimal(38,0)").alias("proof"),
    )
    return running.join(whole, "tenant").where(F.col("upto") <= F.col("full") * every).drop("full")


def newest(shots: DataFrame) -> DataFrame:
    """(tenant, upto): the last snapshot of each tenant."""
    return shots.groupBy("tenant").agg(F.max("upto").alias("upto"))


def state_at(shots: DataFrame, at: DataFrame) -> DataFrame:
    """The state of each tenant at a snapshot (tenant, upto)."""
    rows = shots.join(at.withColumnRenamed("upto", "__at"), "tenant").where(F.col("upto") <= F.col("__at"))
    best = F.max_by(F.struct(*STATE[2:]), "upto").alias("s")
    return rows.groupBy("tenant", "key").agg(best).select("tenant", "key", "s.*")


def resume(shots: DataFrame, log: DataFrame) -> DataFrame:
    """The state of the whole log from the newest snapshots and the fold of the events behind them only."""
    at = newest(shots)
    tail = log.join(at.withColumnRenamed("upto", "__at"), "tenant", "left").where(F.col("seq") > F.coalesce("__at", F.lit(0))).drop("__at")
    return merge(state_at(shots, at), fold(tail))


def compare_states(a: DataFrame, b: DataFrame) -> DataFrame:
    """(tenant, keys, same): whether two states of each tenant agree in every part; a key that one lacks differs."""
    one = a.select("tenant", "key", F.struct(*STATE[2:]).alias("one"))
    two = b.select("tenant", "key", F.struct(*STATE[2:]).alias("two"))
    both = one.join(two, ["tenant", "key"], "full")
    return both.groupBy("tenant").agg(F.count("*").alias("keys"), F.bool_and(F.col("one").eqNullSafe(F.col("two"))).alias("same"))


class StateTable:
    """A state that a stream keeps up to date: one version for each micro-batch, the last two of which are kept.

    ``update`` merges a batch into the version before and writes the version of its number; a batch that is replayed
    after a failure writes its version again from the same predecessor, so nothing counts twice.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "state")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def versions(self) -> list[int]:
        """Complete versions, oldest first."""
        fs, of = self._fs()
        if not fs.exists(of(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(of(self.path))]
        return sorted(int(n.removeprefix("v")) for n in names if n.startswith("v") and fs.exists(of(f"{self.path}/{n}/_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame | None:
        """The state at a version, by default the newest; None before the first."""
        have = self.versions()
        if not have:
            return None
        return self.spark.read.parquet(f"{self.path}/v{have[-1] if version is None else version}")

    def update(self, batch: DataFrame, number: int) -> None:
        before = [v for v in self.versions() if v < number]
        state = fold(batch)
        if before:
            state = merge(self.spark.read.parquet(f"{self.path}/v{before[-1]}"), state)
        state.write.mode("overwrite").parquet(f"{self.path}/v{number}")
        fs, of = self._fs()
        for old in before[:-1]:
            fs.delete(of(f"{self.path}/v{old}"), True)

    def follow(self, log: DataFrame, checkpoint: str, trigger: dict | None = None):
        """Keep the state of a streamed log (tenant, seq, key, amount, body); the query that does so."""
        return log.writeStream.foreachBatch(self.update).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
