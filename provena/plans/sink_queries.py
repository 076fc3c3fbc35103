"""Named queries: what is written is read back, what is streamed is drained: writers, readers of packed forms, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.operators import chain as H
from provena.plans.bind import money, table
from provena.plans.registry import query
from provena.sources import files as R
from provena.sources import sinks as S
from provena.sources import texts as T
from provena.storage import scratch_path, write_table
from provena.streaming import states as A
from provena.streaming import streams as X

SUM = "decimal(28,2)"


@query(
    """
SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DECIMAL(28,2) AS amount, max(o_orderpriority) AS last_label
FROM orders GROUP BY 1"""
)
def ledger_read_back(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as a delimited ledger, in order of day and id, and what its files hold."""
    rows = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("label"), money("o_totalprice").alias("amount"))
    path = scratch_path(spark, "ledger")
    S.write_ledger(rows, path, ["day", "id", "label", "amount"], ["day", "id"])
    back = spark.read.schema("day date, id bigint, label string, amount decimal(18,2)").csv(path, header=True, sep=";", dateFormat="yyyy-MM-dd")
    return back.groupBy("day").agg(F.count("*").alias("n"), F.sum("amount").cast(SUM).alias("amount"), F.max("label").alias("last_label"))


@query(
    """
SELECT year(o_orderdate)::INTEGER AS year, o_orderpriority AS label, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DECIMAL(28,2) AS amount, count(*) AS n, 0::BIGINT AS level FROM orders GROUP BY 1, 2
UNION ALL SELECT NULL, NULL, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DECIMAL(28,2), count(*), 3 FROM orders"""
)
def period_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals of every year by priority, and of all."""
    rows = table(spark, sf, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("label"), money("o_totalprice").alias("amount"))
    return S.period_report(rows, ["year", "label"], "amount")


@query(
    """
WITH p AS (SELECT page_id, sha256(html) AS key, strlen(html) AS bytes FROM pages WHERE html IS NOT NULL),
a AS (SELECT DISTINCT key, bytes FROM p WHERE page_id % 2 = 0),
b AS (SELECT DISTINCT key, bytes FROM p WHERE key NOT IN (SELECT key FROM a))
SELECT 'first' AS run, count(*) AS objects, coalesce(sum(bytes), 0)::BIGINT AS bytes FROM a UNION ALL SELECT 'second', count(*), coalesce(sum(bytes), 0)::BIGINT FROM b
UNION ALL SELECT 'again', 0, 0"""
)
def objects_stored(spark: SparkSession, sf: str) -> DataFrame:
    """Pages put under their content's hash in three runs: the even ones, all, and all again; what each run adds."""
    pages, path = table(spark, sf, "pages").where("html IS NOT NULL").select("page_id", F.encode("html", "UTF-8").alias("content")), scratch_path(spark, "objects")
    out = []
    for run, rows in (("first", pages.where("page_id % 2 = 0")), ("second", pages), ("again", pages)):
        new = S.put_objects(rows, path)
        out.append(new.agg(F.count("*").alias("objects"), F.coalesce(F.sum(F.length("content")), F.lit(0)).cast("bigint").alias("bytes")).select(F.lit(run).alias("run"), "objects", "bytes"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    """
WITH k AS (SELECT user_id, event_type, date_trunc('day', ts) AS day, min(event_id % 3) AS least FROM events GROUP BY ALL)
SELECT event_type AS kind, count(*) FILTER (least = 0) AS first_run, count(*) FILTER (least > 0) AS second_run FROM k GROUP BY event_type"""
)
def jobs_enqueued_once(spark: SparkSession, sf: str) -> DataFrame:
    """A job for each user, kind and day, asked for by every event; a third of the events first, then all."""
    jobs = table(spark, sf, "events").select(F.col("user_id").alias("tenant_id"), F.col("event_type").alias("kind"), F.to_date("ts").cast("string").alias("key"), (F.col("event_id") % 3).alias("third"))
    first = write_table(S.enqueue_once(jobs.where("third = 0").drop("third"), None), "queue")
    second = S.enqueue_once(jobs.drop("third"), first)
    both = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    return both.groupBy("kind").agg(F.count(F.when(F.col("run") == 1, 1)).alias("first_run"), F.count(F.when(F.col("run") == 2, 1)).alias("second_run"))


@query("SELECT user_id AS tenant_id, count(*) AS entries, count(*)::BIGINT AS last_seq, true AS intact FROM events GROUP BY user_id")
def audit_log_appended(spark: SparkSession, sf: str) -> DataFrame:
    """All events appended to an audit log in two batches, each chained on to the last; the log checked as read back."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("tenant_id"), F.struct("ts", "event_id").alias("order"), F.to_json(F.struct("event_type", "props")).alias("body"), F.to_date("ts").alias("day"))
    path, middle = scratch_path(spark, "audit"), e.agg(F.percentile_approx(F.datediff("day", F.lit("2000-01-01").cast("date")), 0.5)).first()[0] or 0
    early = F.datediff("day", F.lit("2000-01-01").cast("date")) <= middle
    for rows in (e.where(early), e.where(~early)):
        S.append_events(rows.drop("day"), path)
    log = spark.read.option("recursiveFileLookup", "true").parquet(path)
    checked = H.verify_chain(log, "tenant_id", "seq", "body")
    return checked.join(log.groupBy("tenant_id").agg(F.max("seq").alias("last_seq")), "tenant_id").select("tenant_id", "entries", "last_seq", "intact")


@query(
    r"""
SELECT conv_id, turn, '<' || conv_id || '.' || turn || '@mail.example>' AS message_id, CASE WHEN turn > 0 THEN '<' || conv_id || '.' || (turn - 1) || '@mail.example>' END AS in_reply_to,
       role || '@mail.example' AS sender, 'Conversation ' || conv_id AS subject, sha256(text) AS text_sha256, 1::BIGINT AS parts, 0 AS depth
FROM conversations WHERE text IS NOT NULL"""
)
def mails_read(spark: SparkSession, sf: str) -> DataFrame:
    """Every turn as a mail with an attachment, answering the one before, and what the reader finds in it."""
    c = table(spark, sf, "conversations").where("text IS NOT NULL")
    number = lambda t: F.concat(F.lit("<"), "conv_id", F.lit("."), t, F.lit("@mail.example>"))
    headers = [
        F.concat(F.lit("Message-ID: "), number(F.col("turn"))),
        F.when(F.col("turn") > 0, F.concat(F.lit("In-Reply-To: "), number(F.col("turn") - 1))),
        F.concat(F.lit("From: "), "role", F.lit("@mail.example")),
        F.concat(F.lit("Subject: Conversation "), "conv_id"),
        F.lit('MIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="cut"'),
    ]
    part = lambda kind, body, more="": F.concat(F.lit(f"--cut\r\nContent-Type: {kind}\r\nContent-Transfer-Encoding: base64\r\n{more}\r\n"), F.base64(F.encode(body, "UTF-8")), F.lit("\r\n"))
    body = F.concat(part("text/plain; charset=utf-8", F.col("text")), part("application/octet-stream", F.col("role"), 'Content-Disposition: attachment; filename="role.bin"\r\n'), F.lit("--cut--\r\n"))
    mail = F.encode(F.concat(F.concat_ws("\r\n", *headers), F.lit("\r\n\r\n"), body), "UTF-8")
    got = T.read_mail(c.select(F.concat_ws("/", "conv_id", "turn").alias("path"), mail.alias("content")))
    place = F.split("path", "/")
    return got.select(place[0].cast("bigint").alias("conv_id"), place[1].cast("bigint").alias("turn"), "message_id", "in_reply_to", "sender", "subject", F.sha2("text", 256).alias("text_sha256"), F.size("parts").cast("bigint").alias("parts"), "depth")


@query(
    """
WITH p AS (SELECT page_id, page_id // 8 AS box, html FROM pages WHERE html IS NOT NULL)
SELECT box, count(*) AS members, sum(strlen(html))::BIGINT AS bytes, md5(string_agg('p' || page_id || ':' || sha256(html), ',' ORDER BY page_id)) AS digest, 0::BIGINT AS skipped FROM p GROUP BY box"""
)
def archives_expanded(spark: SparkSession, sf: str) -> DataFrame:
    """Pages packed by eights into ZIP files, every other page in an inner archive, and their members as expanded."""
    import io
    import zipfile

    import pandas as pd

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        inner, outer = io.BytesIO(), io.BytesIO()
        with zipfile.ZipFile(inner, "w", zipfile.ZIP_DEFLATED) as a, zipfile.ZipFile(outer, "w", zipfile.ZIP_DEFLATED) as b:
            for k, (i, html) in enumerate(zip(group.page_id, group.html, strict=True)):
                (a if k % 2 else b).writestr(f"p{i}", html.encode())
            a.close()
            b.writestr("inner.zip", inner.getvalue())
        return pd.DataFrame({"path": [str(group.box.iloc[0])], "content": [outer.getvalue()]})

    pages = table(spark, sf, "pages").where("html IS NOT NULL").select("page_id", F.floor(F.col("page_id") / 8).alias("box"), "html")
    packed = write_table(pages.groupBy("box").applyInPandas(pack, "path string, content binary"), "zips")
    got = T.expand_zips(packed).withColumn("page", F.regexp_extract("member", "p([0-9]+)$", 1).try_cast("bigint"))
    told = F.transform(F.array_sort(F.collect_list(F.struct("page", F.concat(F.lit("p"), "page", F.lit(":"), F.sha2("content", 256)).alias("t")))), lambda x: x["t"])
    return got.groupBy(F.col("path").cast("bigint").alias("box")).agg(F.count("content").alias("members"), F.sum(F.length("content")).cast("bigint").alias("bytes"), F.md5(F.array_join(told, ",")).alias("digest"), F.count("skipped").alias("skipped"))


@query(
    """
SELECT o_custkey AS member, count(*) AS receipts, sum(CAST(o_totalprice AS DECIMAL(18,2)))::DECIMAL(28,2) AS amount, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day
FROM orders GROUP BY o_custkey"""
)
def receipts_list(spark: SparkSession, sf: str) -> DataFrame:
    """All orders as a receipts list under a provider's own headers and number format, bound by aliases and read."""
    from provena.functions.money import amount_readings
    from provena.functions.normalise import date_readings

    o = table(spark, sf, "orders")
    european = F.translate(F.format_number(money("o_totalprice"), 2), ",.", ".,")
    path = scratch_path(spark, "receipts")
    o.select(F.col("o_orderkey").alias("Nº Recibo"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Data de Emissão"), F.col("o_custkey").alias("Sócio"), european.alias("Valor (€)")).write.csv(path, header=True, sep=";")
    aliases = {"number": ["n recibo", "receipt"], "on": ["data de emissao", "date"], "member": ["socio", "client"], "amount": ["valor", "valor (€)", "total"], "note": ["obs"]}
    rows = R.read_csv(spark, path, aliases)
    rows = rows.select(F.col("member").cast("bigint").alias("member"), F.get(date_readings("on", day_first=True), F.lit(0)).alias("on"), F.get(amount_readings("amount"), F.lit(0)).alias("amount"))
    return rows.groupBy("member").agg(F.count("*").alias("receipts"), F.sum("amount").cast(SUM).alias("amount"), F.min("on").alias("first_day"), F.max("on").alias("last_day"))


@query(
    """
WITH m AS (SELECT o_custkey AS key, last_day(max(CAST(o_orderdate AS DATE))) AS close_on, count(*) AS n FROM orders GROUP BY o_custkey),
s AS (SELECT * FROM (VALUES ('collect', -7), ('chase', -4), ('review', -1), ('package', 2)) v(step, off))
SELECT key, step, close_on + off AS due_on, close_on + off < DATE '1998-07-01' AS late FROM m, s
WHERE close_on + off <= DATE '1998-07-01' AND NOT (n % 2 = 0 AND step = 'collect') AND NOT (n % 3 = 0 AND step IN ('collect', 'chase'))"""
)
def close_steps_due(spark: SparkSession, sf: str) -> DataFrame:
    """The steps of each customer's last month that are due and not done on 1 July 1998."""
    n = F.col("n")
    done = F.when(n % 3 == 0, F.array(F.lit("collect"), F.lit("chase"))).when(n % 2 == 0, F.array(F.lit("collect"))).otherwise(F.array().cast("array<string>"))
    last = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.last_day(F.max(F.to_date("o_orderdate"))).alias("close_on"), F.count("*").alias("n"))
    steps = spark.createDataFrame([("collect", -7), ("chase", -4), ("review", -1), ("package", 2)], "step string, offset int")
    due = A.due_steps(last.select("key", "close_on", done.alias("done")), steps, F.lit("1998-07-01").cast("date"))
    return due.select("key", "step", "due_on", "late")


@query(
    """
WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view')
SELECT event_id AS id, user_id, ts AS polled_at FROM v
WHERE NOT EXISTS (SELECT 1 FROM events c WHERE c.event_type = 'click' AND c.user_id = v.user_id AND c.ts BETWEEN v.ts - INTERVAL 10 MINUTE AND v.ts + INTERVAL 10 MINUTE)"""
)
def unannounced_views(spark: SparkSession, sf: str) -> DataFrame:
    """Views of a user that no click of theirs came within ten minutes of: what a poll sees and no push announced."""
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    polled = e.where("event_type = 'view'").select(F.col("event_id").alias("id"), "user_id", F.col("at").alias("polled_at"))
    announced = e.where("event_type = 'click'").select("user_id", F.col("at").alias("announced_at"))
    return X.unannounced(polled, announced, "user_id", "polled_at", "announced_at").select("id", "user_id", F.col("polled_at").cast("timestamp_ntz").alias("polled_at"))


def _drained(spark: SparkSession, rows: DataFrame, label: str, files: int = 3) -> tuple[DataFrame, str]:
    """A stream over ``rows``, written as some files, and a fresh checkpoint for it."""
    path = scratch_path(spark, label)
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), scratch_path(spark, f"{label}-checkpoint")


@query(
    """
SELECT conv_id AS capture_id, count(DISTINCT turn)::INTEGER AS of_pages, sha256(string_agg(h, '' ORDER BY turn)) AS digest
FROM (SELECT conv_id, turn, sha256(min(coalesce(text, ''))) AS h FROM conversations GROUP BY conv_id, turn) GROUP BY conv_id"""
)
def captures_assembled(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as captures whose pages (turns) come in a stream in any order, given out once all are there."""
    c = table(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.sha2(F.min(F.coalesce("text", F.lit(""))), 256).alias("sha256"))
    pages = c.select(F.col("conv_id").cast("string").alias("capture_id"), F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("page"), F.count("*").over(W.partitionBy("conv_id")).cast("int").alias("of_pages"), "sha256")
    stream, checkpoint = _drained(spark, pages, "captures")
    out = X.assembled(stream)
    found = scratch_path(spark, "assembled")
    out.writeStream.format("parquet").option("path", found).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(found).select(F.col("capture_id").cast("bigint").alias("capture_id"), "of_pages", F.sha2(F.array_join("hashes", ""), 256).alias("digest"))


@query("SELECT event_type, count(*) AS n, sum(CAST(value AS DECIMAL(18,2)))::DECIMAL(28,2) AS amount, true AS final FROM events GROUP BY event_type")
def micro_batches_flushed(spark: SparkSession, sf: str) -> DataFrame:
    """Events streamed in micro-batches that are each written once under their number; totals over all, and that the last one flushed all."""
    rows = table(spark, sf, "events").select("event_id", "event_type", money("value").alias("amount"))
    stream, checkpoint = _drained(spark, rows, "batches")
    path, seen = scratch_path(spark, "flushed"), []
    X.append_batches(stream, path, checkpoint, then=lambda batch, number: seen.append(number)).awaitTermination()
    back = spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(path)
    return back.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("amount").cast(SUM).alias("amount")).withColumn("final", F.lit(seen == sorted(set(seen)) and len(seen) > 0))
