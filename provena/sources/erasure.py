"""Export and erasure of a tenant (B08): sealed tables, erased by dropping the key, rewritten, and proved.

A sealed table holds its tenants' texts encrypted (AES-GCM), each under its tenant's own key from a small key table
that is kept apart. Dropping a tenant's key makes every copy of its texts unreadable at once, backups included.
:func:`erase` then rewrites the partitions that hold the tenant, without its rows, and :func:`tenant_digests` before and
after prove that nothing else has changed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions.normalise import state_digest
from provena.storage import scratch_path


def new_keys(tenants: DataFrame, tenant: str) -> DataFrame:
    """(tenant, key): a random 256-bit key for each distinct tenant; a null tenant has none."""
    return tenants.where(F.col(tenant).isNotNull()).select(F.col(tenant).alias("tenant")).distinct().withColumn("key", F.unhex(F.replace(F.concat(F.expr("uuid()"), F.expr("uuid()")), F.lit("-"), F.lit(""))))


def seal(rows: DataFrame, tenant: str, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """``rows`` with ``columns`` encrypted; where the tenant has no key, or the value is null, null."""
    told = rows.join(keys.select(F.col("tenant").alias("__of"), F.col("key").alias("__key")), F.col(tenant) == F.col("__of"), "left")
    sealed = {c: F.when(F.col("__key").isNotNull(), F.aes_encrypt(F.encode(F.col(c), "UTF-8"), F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit(""), F.col(tenant).cast("string"))) for c in columns}
    return told.withColumns(sealed).drop("__of", "__key")


def unseal(rows: DataFrame, tenant: str, columns: Sequence[str], keys: DataFrame) -> DataFrame:
    """The readable rows: a value whose tenant's key is gone is null. A value moved to another tenant doesn't decrypt and is null too."""
    told = rows.join(keys.select(F.col("tenant").alias("__of"), F.col("key").alias("__key")), F.col(tenant) == F.col("__of"), "left")
    plain = lambda c: F.when(F.col("__key").isNotNull(), F.decode(F.try_aes_decrypt(F.col(c), F.col("__key"), F.lit("GCM"), F.lit("DEFAULT"), F.col(tenant).cast("string")), "UTF-8"))
    return told.withColumns({c: plain(c) for c in columns}).drop("__of", "__key")


def tenant_digests(rows: DataFrame, tenant: str, columns: Sequence[str]) -> DataFrame:
    """(tenant, rows, readable, digest): each tenant's rows, those with a readable first column, and a digest of them in any order."""
    return rows.groupBy(F.col(tenant).alias("tenant")).agg(F.count("*").alias("rows"), F.count(F.col(columns[0])).alias("readable"), state_digest(*[F.col(c) for c in columns]).alias("digest"))


@dataclass
class SealedTable:
    """A table in a folder, in parts (``part=k``) by a hash of the id, so that every part holds several tenants.

    A large part is written by several tasks, as files of about the planner's advisory size.
    """

    spark: SparkSession
    path: str
    tenant: str
    columns: tuple[str, ...]

    @classmethod
    def write(cls, rows: DataFrame, tenant: str, columns: Sequence[str], keys: DataFrame, by: Column, parts: int = 8, path: str | None = None) -> SealedTable:
        path = path or scratch_path(rows.sparkSession, "sealed")
        seal(rows, tenant, columns, keys).withColumn("part", F.pmod(F.xxhash64(by), F.lit(parts))).hint("rebalance", "part").write.partitionBy("part").parquet(path)
        return cls(rows.sparkSession, path, tenant, tuple(columns))

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def readable(self, keys: DataFrame) -> DataFrame:
        return unseal(self.read(), self.tenant, self.columns, keys)

    def erase(self, tenant) -> list[int]:
        """Rewrite the parts that hold the tenant without its rows, one transaction of the commit for all; the parts' numbers.

        The rewritten parts are first written beside the table and read back, then replace their parts alone, so a
        failure in between leaves the old ones, and a repeat does the same again. A part that is left empty goes.
        """
        rows = self.read()
        held = [r.part for r in rows.where(F.col(self.tenant) == tenant).select("part").distinct().collect()]
        if not held:
            return []
        kept = rows.where(F.col("part").isin(held)).where(~F.col(self.tenant).eqNullSafe(F.lit(tenant)))
        beside = scratch_path(self.spark, "rewritten")
        kept.write.partitionBy("part").parquet(beside)
        new = self.spark.read.schema(kept.schema).parquet(beside)
        left = {r.part for r in new.select("part").distinct().collect()}
        new.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for folder in [beside, *(f"{self.path}/part={k}" for k in held if k not in left)]:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(conf).delete(at, True)
        return sorted(held)


def drop_key(keys: DataFrame, tenant) -> DataFrame:
    """The key table without a tenant's key."""
    return keys.where(~F.col("tenant").eqNullSafe(F.lit(tenant)))


def export_tenant(table: SealedTable, keys: DataFrame, tenant, path: str) -> DataFrame:
    """Write a tenant's readable rows as JSON lines and return the manifest (rows, digest) of what was written, read back."""
    rows = table.readable(keys).where(F.col(table.tenant) == tenant).drop("part")
    rows.write.mode("overwrite").json(path)
    back = table.spark.read.schema(rows.schema).json(path)
    return tenant_digests(back, table.tenant, table.columns).select("rows", "digest")
