"""Incremental readers (A03, A31): a landing folder of dated JSON lines as a Spark data source with stream offsets.

Layout: ``<path>/day=YYYY-MM-DD/*.json``. A provider may deliver a day's lines late or again, so a reader that has come
to a day reads the ``overlap`` days before it once more, and lines are told apart by their id: :func:`sync` for batches,
``once_each`` behind the stream. Lines that arrive later than the overlap allows need a backfill (a batch read with
an earlier ``since``).
"""

from __future__ import annotations

import io
import json
import os
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, timedelta
from decimal import Decimal

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

NAME, OVERLAP, BATCH_LINES = "landed_feed", 5, 10_000


@dataclass
class LandedFile(InputPartition):
    path: str


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}")


class Landing:
    """The files of a landing folder by day."""

    def __init__(self, path: str):
        self.path = path

    def files(self, since: date | None, until: date | None = None) -> list[tuple[str, str]]:
        """(day, path) of the files of a span of days, in order."""
        store, root = _store(self.path)
        found = []
        for day in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            name = day.base_name.removeprefix("day=")
            if day.base_name == name or (since and name < since.isoformat()) or (until and name > until.isoformat()):
                continue
            found += [(name, f.path) for f in store.get_file_info(fs.FileSelector(day.path)) if f.base_name[0] not in "._" and f.size]
        return sorted(found)


def _value(x, kind: T.DataType):
    """A JSON value as a column's type; null where it doesn't fit."""
    if x is None:
        return None
    try:
        if isinstance(kind, T.DecimalType):
            return Decimal(str(x)).quantize(Decimal(1).scaleb(-kind.scale))
        if isinstance(kind, T.DateType):
            return date.fromisoformat(x)
        if isinstance(kind, T.IntegralType):
            return int(x)
        return str(x) if isinstance(kind, T.StringType) else float(x)
    except (ValueError, TypeError, ArithmeticError):
        return None


def read_file(path: str, root: str, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """A file's lines as batches; a line that is no JSON object has nulls only."""
    store, _ = _store(root)
    arrow = to_arrow_schema(schema)
    held: list[dict] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({f.name: [_value(r.get(f.name), f.dataType) for r in held] for f in schema.fields}, arrow)

    with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as stream:
        for line in io.BufferedReader(stream):
            if not line.strip():
                continue
            try:
                row = json.loads(line)
            except ValueError:
                row = {}
            held.append(row if isinstance(row, dict) else {})
            if len(held) >= BATCH_LINES:
                yield batch()
                held = []
    if held:
        yield batch()


class FeedReader(DataSourceReader):
    """All files from ``since`` less the overlap on; a task for each file."""

    def __init__(self, options, schema):
        self.path, self.schema = options["path"], schema
        since = options.get("since")
        self.since = date.fromisoformat(since) - timedelta(int(options.get("overlap", OVERLAP))) if since else None

    def partitions(self) -> list[InputPartition]:
        return [LandedFile(p) for _, p in Landing(self.path).files(self.since)] or [LandedFile("")]

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        return read_file(partition.path, self.path, self.schema) if partition.path else iter(())


class FeedStream(DataSourceStreamReader):
    """Offsets are the newest day and the number of files within the overlap before it, so a late file makes a batch too."""

    def __init__(self, options, schema):
        self.path, self.schema, self.overlap = options["path"], schema, timedelta(int(options.get("overlap", OVERLAP)))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"day": "", "files": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        days = [d for d, _ in Landing(self.path).files(None)]
        if not days:
            return self.initialOffset()
        least = (date.fromisoformat(days[-1]) - self.overlap).isoformat()
        return {"day": days[-1], "files": sum(d >= least for d in days)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        since = date.fromisoformat(start["day"]) - self.overlap if start["day"] else None
        found = Landing(self.path).files(since, date.fromisoformat(end["day"])) if end["day"] else []
        return [LandedFile(p) for _, p in found] or [LandedFile("")]

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        return read_file(partition.path, self.path, self.schema) if partition.path else iter(())


class LandedFeed(DataSource):
    """``spark.read.format("landed_feed")`` and ``spark.readStream.format("landed_feed")``; options path, since, overlap."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "line_id string, account string, booked_on date, amount decimal(18,2), text string"

    def reader(self, schema: T.StructType) -> FeedReader:
        return FeedReader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> FeedStream:  # noqa: N802
        return FeedStream(self.options, schema)


def register_feed(spark: SparkSession) -> None:
    """Make the source known to a session."""
    spark.dataSource.register(LandedFeed)


def sync(spark: SparkSession, path: str, known: DataFrame | None, cursor: date | None, *, key: str = "line_id", day: str = "booked_on", schema: str | None = None, overlap: int = OVERLAP) -> DataFrame:
    """The lines of a folder that are not known yet, from ``overlap`` days before the cursor on, each id once.

    Of lines with one id the one with the smallest day counts. The next cursor is the largest day of the result (or
    the one before, if there is nothing new).
    """
    register_feed(spark)
    reader = spark.read.format(NAME).option("path", path).option("overlap", overlap)
    reader = reader.schema(schema) if schema else reader
    rows = (reader.option("since", cursor.isoformat()) if cursor else reader).load()
    others = [c for c in rows.columns if c != key]
    once = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*others), F.struct(day, *others)).alias("__r")).select(key, "__r.*").select(*rows.columns)
    return once if known is None else once.join(known.select(key), key, "left_anti")


def scan_after(log: DataFrame, cursors: DataFrame, tenant: str = "tenant", seq: str = "seq") -> DataFrame:
    """Each tenant's entries behind its cursor (tenant, seen), all of them where it has none."""
    at = cursors.select(F.col(tenant).alias("__of"), F.col("seen").alias("__seen"))
    return log.join(at, F.col(tenant).eqNullSafe(F.col("__of")), "left").where(F.col(seq) > F.coalesce("__seen", F.lit(0))).drop("__of", "__seen")
