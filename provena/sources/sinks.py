"""Writers (B01-B09): hash-chained logs, packages with manifests, content-addressed stores, ledgers, canonical JSON."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.operators.chain import chained
from provena.storage import scratch_path


class LogMoved(RuntimeError):
    """Another writer has appended since this one read the log."""


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The rows of all committed batches at ``path``; None where there is none yet."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _commit(rows: DataFrame, path: str, label: str) -> DataFrame:
    """Write ``rows`` in the shared folder and move them to ``path`` as the next batch, which only one writer can do."""
    spark, context = rows.sparkSession, rows.sparkSession.sparkContext
    staged = scratch_path(spark, label)
    rows.write.parquet(staged)
    jvm, conf = context._jvm, context._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(conf)
    store.mkdirs(at)
    batches = [x.getPath().getName() for x in store.listStatus(at) if x.getPath().getName().startswith("batch-")]
    goal = f"{path.rstrip('/')}/batch-{len(batches) + 1:06d}"
    rename = context._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), conf).rename(jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(goal), rename)
    except Py4JJavaError as e:
        raise LogMoved(goal) from e
    return spark.read.schema(rows.schema).parquet(goal)


LOG = "seq bigint, body string, prev_hash string, hash string"


def append_events(new: DataFrame, path: str, *, tenant: str = "tenant_id", expected: DataFrame | None = None) -> DataFrame:
    """Append events (tenant, order, body) to a hash-chained log at ``path``; returns what was written.

    Numbers go on from each tenant's last one. ``expected`` (tenant, last_seq) holds what the writer had read: a
    tenant whose log has moved on since is refused as a whole (optimistic locking). An append is one new batch
    folder, put in place by a rename that fails where another writer was first (:class:`LogMoved`). Only the last
    links are read from the log.
    """
    log = _stored(new.sparkSession, path, f"`{tenant}` {dict(new.dtypes)[tenant]}, {LOG}")
    tail = None if log is None else log.groupBy(tenant).agg(F.max(F.struct("seq", "hash")).alias("t")).select(tenant, "t.seq", "t.hash")
    if expected is not None:
        seen = expected.withColumn("seq", F.lit(0).cast("bigint")) if tail is None else expected.join(tail, tenant, "left")
        new = new.join(seen.where(F.coalesce("seq", F.lit(0)) != F.col("last_seq")).select(tenant), tenant, "left_anti")
    return _commit(chained(new, tenant, "order", "body", tail), path, "events")


def write_ledger(rows: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """A ledger as delimited text with amounts as written decimals, in one order over its part files."""
    rows.orderBy(*order).select(*columns).write.mode("overwrite").csv(path, header=True, sep=";", dateFormat="yyyy-MM-dd")


def manifest(entries: DataFrame, name: str, content: str) -> DataFrame:
    """One line for each file of a package: name, bytes, hash; names are unique by hash suffix."""
    digest = F.sha2(content, 256)
    nth = F.row_number().over(W.partitionBy(name).orderBy(digest))
    unique = F.when(nth == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("-"), F.left(digest, F.lit(8))))
    return entries.select(unique.alias("name"), F.length(content).cast("bigint").alias("bytes"), digest.alias("sha256"))


def package_hash(lines: DataFrame) -> DataFrame:
    """A digest of a manifest whatever the order of its lines: their number and two sums over 128 bits of each line's hash."""
    digest = F.sha2(F.concat_ws("  ", "sha256", "name"), 256)
    part = lambda i: F.conv(F.substring(digest, i, 15), 16, 10).cast("decimal(38,0)")
    sums = lines.agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum(part(1)).alias("x"), F.sum(part(16)).alias("y"))
    return sums.select(F.sha2(F.concat_ws(":", "files", "x", "y"), 256).alias("package_sha256"), "files", "bytes")


def verify_package(lines: DataFrame, files: DataFrame, name: str, content: str) -> DataFrame:
    """Files against their manifest: ok, changed, missing or unexpected."""
    have = files.select(F.col(name).alias("name"), F.sha2(content, 256).alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("found") == F.col("sha256"), "ok").otherwise("changed")
    return lines.join(have, "name", "full").select("name", state.alias("state"))


def put_objects(objects: DataFrame, path: str, content: str = "content") -> DataFrame:
    """Write-once storage under the content's hash (``key``); returns the objects that were new.

    They are one new batch folder, put in place by a rename that only one writer can do.
    """
    keyed = objects.withColumn("key", F.sha2(content, 256)).dropDuplicates(["key"])
    have = _stored(objects.sparkSession, path, "key string")
    if have is not None:
        keyed = keyed.join(have.select("key"), "key", "left_anti")
    return _commit(keyed, path, "objects")


def enqueue_once(jobs: DataFrame, queue: DataFrame | None, keys: Sequence[str] = ("tenant_id", "kind", "key")) -> DataFrame:
    """Jobs that are not in the queue yet, each once."""
    fresh = jobs.dropDuplicates(list(keys))
    return fresh if queue is None else fresh.join(queue.select(*keys), list(keys), "left_anti")


def canonical_json(*columns: str) -> Column:
    """A JSON object with sorted keys, decimals as text, dates in ISO form, nulls kept."""
    return F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in sorted(columns)]), {"ignoreNullFields": "false"})


def period_report(rows: DataFrame, keys: Sequence[str], amount: str) -> DataFrame:
    """Totals of a period by keys with a grand total row (null keys)."""
    return rows.rollup(*keys).agg(F.sum(amount).cast("decimal(28,2)").alias("amount"), F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level")).where((F.col("level") == 0) | (F.col("level") == 2 ** len(keys) - 1))


def export_tenant(rows: DataFrame, path: str, tenant: str, tenant_col: str = "tenant_id") -> None:
    """Everything of one tenant, as JSON lines."""
    rows.where(F.col(tenant_col) == tenant).write.mode("overwrite").json(path)
