from pathlib import Path

from pyspark.sql import functions as F

from provena.sources import erasure as E
from provena.storage import write_table

SECRET = "the tenant's own words"


def table(spark, tmp_path):
    rows = [(i, "abc"[i % 3], f"{SECRET} {i}" if i % 3 == 0 else f"text {i}", None if i == 4 else i) for i in range(60)] + [(99, None, "of nobody", 0)]
    df = spark.createDataFrame(rows, "id int, tenant string, text string, n int")
    keys = write_table(E.new_keys(df, "tenant"), "keys")
    return df, keys, E.SealedTable.write(df, "tenant", ["text"], keys, F.col("id"), parts=4, path=str(tmp_path / "t"))


def test_sealed_and_read_back(spark, tmp_path):
    df, keys, t = table(spark, tmp_path)
    assert keys.count() == 3 and all(len(r.key) == 32 for r in keys.collect())
    got = {r.id: (r.tenant, r.text, r.n) for r in t.readable(keys).collect()}
    assert got == {r.id: (r.tenant, r.text if r.tenant else None, r.n) for r in df.collect()}
    assert not any(SECRET.encode() in p.read_bytes() for p in Path(t.path).rglob("*.parquet"))
    moved = t.read().withColumn("tenant", F.lit("b"))
    assert E.unseal(moved, "tenant", ["text"], keys).where("text IS NOT NULL").count() == 20  # its own rows only


def test_erased_by_key_and_rewritten(spark, tmp_path):
    _, keys, t = table(spark, tmp_path)
    told = lambda k: {r.tenant: (r.rows, r.readable, r.digest) for r in E.tenant_digests(t.readable(k), "tenant", ["text", "id", "n"]).collect()}
    before = told(keys)
    manifest = E.export_tenant(t, keys, "a", str(tmp_path / "export")).first()
    assert manifest.rows == 20 and manifest.digest == E.tenant_digests(t.readable(keys).where("tenant = 'a'"), "tenant", ["text"]).first().digest
    left = write_table(E.drop_key(keys, "a"), "keys")
    unread = told(left)
    assert unread["a"][:2] == (20, 0) and {k: unread[k] for k in "bc"} == {k: before[k] for k in "bc"}
    assert t.erase("a") == [0, 1, 2, 3]
    after = told(left)
    assert "a" not in after and {k: after[k] for k in ("b", "c", None)} == {k: before[k] for k in ("b", "c", None)}
    assert t.erase("a") == [] and t.read().count() == 41


def test_a_part_of_one_tenant_goes(spark, tmp_path):
    df = spark.createDataFrame([(i, "a", "x") for i in range(9)] + [(1, "b", "y")], "id int, tenant string, text string")
    keys = write_table(E.new_keys(df, "tenant"), "keys")
    t = E.SealedTable.write(df, "tenant", ["text"], keys, F.col("tenant"), parts=50, path=str(tmp_path / "t"))
    assert len(t.erase("a")) == 1
    assert [tuple(r) for r in t.readable(keys).select("tenant", "text").collect()] == [("b", "y")]


def test_a_large_part_is_written_by_several_tasks(spark, tmp_path):
    df = spark.range(4000).select("id", F.concat(F.lit("t"), F.col("id") % 3).alias("tenant"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("text")).repartition(6)
    keys = write_table(E.new_keys(df, "tenant"), "keys")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    try:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "100k")
        t = E.SealedTable.write(df, "tenant", ["text"], keys, F.col("id"), parts=2, path=str(tmp_path / "t"))
        files = lambda: [len(list(p.glob("*.parquet"))) for p in (tmp_path / "t").glob("part=*")]
        assert len(files()) == 2 and min(files()) > 1
        assert t.erase("t1") == [0, 1]
        assert min(files()) > 1
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert t.readable(keys).where("text IS NOT NULL").count() == 4000 - 1333
