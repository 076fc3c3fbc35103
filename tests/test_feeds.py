"""A growing landing folder: batches with a cursor and a stream over restarts against one read of the whole."""

import json
from datetime import date, timedelta

from pyspark.sql import functions as F

from provena.sources import feeds
from provena.streaming.streams import once_each

DAY0 = date(2024, 3, 1)


def land(path, name, *lines):
    """Lines (id, day, amount) into the file ``name`` of their days."""
    by = {}
    for i, d, a in lines:
        day = (DAY0 + timedelta(d)).isoformat()
        by.setdefault(day, []).append({"line_id": i, "account": "x", "booked_on": day, "amount": a, "text": f"t{i}"})
    for day, rows in by.items():
        folder = path / f"day={day}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n\n")


FIRST = [("a", 0, "1.00"), ("b", 1, "2.50"), ("c", 8, "3.00"), ("c", 8, "3.00")]
SECOND = [("c", 8, "3.00"), ("late", 4, "7.00"), ("d", 9, "4.00"), ("a", 9, "1.00")]


def test_sync_reads_five_days_again_and_counts_once(spark, tmp_path):
    land(tmp_path, "one", *FIRST)
    one = feeds.sync(spark, str(tmp_path), None, None).collect()
    assert sorted((r.line_id, str(r.amount)) for r in one) == [("a", "1.00"), ("b", "2.50"), ("c", "3.00")]
    known, cursor = spark.createDataFrame(one), max(r.booked_on for r in one)
    land(tmp_path, "two", *SECOND, ("too_late", 1, "9.00"))
    two = feeds.sync(spark, f"file://{tmp_path}", known, cursor).collect()
    assert sorted(r.line_id for r in two) == ["d", "late"]
    whole = feeds.sync(spark, str(tmp_path), None, None)
    assert {r.line_id for r in whole.collect()} - {r.line_id for r in one + two} == {"too_late"}
    backfill = feeds.sync(spark, str(tmp_path), spark.createDataFrame(one + two), DAY0).collect()
    assert [r.line_id for r in backfill] == ["too_late"]
    again = spark.createDataFrame(one + two)
    assert feeds.sync(spark, str(tmp_path), again, DAY0 + timedelta(9)).count() == 0


def test_files_are_partitions_and_bad_lines_are_null(spark, tmp_path):
    feeds.register_feed(spark)
    assert spark.read.format(feeds.NAME).option("path", str(tmp_path / "none")).load().count() == 0
    land(tmp_path, "one", *FIRST)
    land(tmp_path, "two", ("z", 0, "1.00"))
    (tmp_path / f"day={DAY0}" / "bad.json").write_text('no json\n[1]\n{"line_id": 5, "amount": "x", "booked_on": "2024-13-01"}\n')
    (tmp_path / f"day={DAY0}" / "_SUCCESS").write_text("")
    df = spark.read.format(feeds.NAME).option("path", str(tmp_path)).load()
    assert df.rdd.getNumPartitions() == 5 and df.count() == 8
    assert [tuple(r) for r in df.where("line_id = '5'").collect()] == [("5", None, None, None, None)]
    assert df.where("line_id IS NULL").count() == 2
    own = spark.read.format(feeds.NAME).schema("line_id string, amount double").option("path", str(tmp_path)).load()
    assert own.where("line_id = 'b'").first().amount == 2.5


def test_stream_over_restarts_equals_the_whole(spark, tmp_path):
    feeds.register_feed(spark)

    def run():
        rows = spark.readStream.format(feeds.NAME).option("path", str(tmp_path / "in")).load().withColumn("ts", F.col("booked_on").cast("timestamp"))
        once = once_each(rows, ["line_id"], "ts", "9 days").drop("ts")
        q = once.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r.line_id for r in spark.read.schema(once.schema).parquet(str(tmp_path / "out")).collect())

    land(tmp_path / "in", "one", *FIRST)
    assert run() == ["a", "b", "c"]
    assert run() == ["a", "b", "c"]
    land(tmp_path / "in", "two", *[x for x in SECOND if x[0] != "a"])
    assert run() == ["a", "b", "c", "d", "late"]
    land(tmp_path / "in", "three", ("late", 4, "7.00"), ("later", 5, "1.00"))  # no new day, files within the overlap only
    assert run() == ["a", "b", "c", "d", "late", "later"]
