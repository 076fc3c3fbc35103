"""Named queries: search over vectors and phrases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.functions import domains as N
from provena.functions.text import MARKED, PLAIN
from provena.operators import layout as L
from provena.operators import phrases as P
from provena.operators import vectors as V
from provena.plans.bind import table
from provena.plans.registry import query
from provena.sources import extractors as X


@query()
def embedding_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The five nearest vectors of each query vector (ids divisible by 50) by an inverted-file index over all rows."""
    e = table(spark, sf, "embeddings")
    index = V.VectorIndex.build(e, "vec_id", "embedding", k=5)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank long, found_id long, cosine double")
    return index.search(e.where("vec_id % 50 = 0"), "vec_id", "embedding")


#: Characters of the texts whose boxes a task lays out.
PAGE_CHARS = 4 << 20

FOLDED_WORDS = r"""regexp_extract_all(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[a-z0-9]+')"""


def known_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Identifiers of all kinds: every supplier's and customer's name, every part name, all runs of three words of the benchmark."""
    words = F.regexp_extract_all(F.translate(F.lower("text"), MARKED, PLAIN), F.lit("[a-z0-9]+"), 0)
    runs = table(spark, sf, "benchmark").select(words.alias("w")).where("size(w) >= 3").select(F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).alias("phrase"))
    names = lambda t, c: table(spark, sf, t).select(F.col(c).alias("phrase"))
    kinds = [("supplier", names("supplier", "s_name")), ("customer", names("customer", "c_name")), ("part", names("part", "p_name")), ("passage", runs)]
    return reduce(DataFrame.unionByName, [rows.distinct().withColumn("kind", F.lit(kind)) for kind, rows in kinds])


KNOWN_PHRASES = f"""
b AS (SELECT {FOLDED_WORDS.format('text')} AS w FROM benchmark),
k AS (
  SELECT DISTINCT 'supplier' AS kind, s_name AS phrase FROM supplier UNION ALL SELECT DISTINCT 'customer', c_name FROM customer UNION ALL SELECT DISTINCT 'part', p_name FROM part
  UNION ALL SELECT DISTINCT 'passage', array_to_string(w[i:i + 2], ' ') FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM b WHERE len(w) >= 3)),
f AS (SELECT kind, phrase, array_to_string({FOLDED_WORDS.format('phrase')}, ' ') AS words, len({FOLDED_WORDS.format('phrase')}) AS m FROM k),
d AS (SELECT doc_id, {FOLDED_WORDS.format('text')} AS w FROM documents),
n AS (SELECT doc_id, i - 1 AS word, m, array_to_string(w[i:i + m - 1], ' ') AS words FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM f) WHERE len(w) >= m)),
h AS (SELECT n.doc_id, n.word, f.kind, f.phrase, f.words FROM n JOIN f ON n.words = f.words AND n.m = f.m)"""


@query(
    f"""
WITH {KNOWN_PHRASES}
SELECT doc_id, count(*) AS hits, count(DISTINCT words) AS phrases, min(word)::INTEGER AS first_word, arg_min(phrase, (word, words, phrase)) AS first_phrase,
       count(*) FILTER (kind = 'passage') AS passages
FROM h GROUP BY doc_id"""
)
def identifiers_in_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every known name and passage in every whole document, in one pass over each text."""
    hits = P.phrase_hits(table(spark, sf, "documents"), "doc_id", "text", known_phrases(spark, sf), "phrase")
    first = F.min_by("phrase", F.struct("word", "words", "phrase")).alias("first_phrase")
    return hits.groupBy("doc_id").agg(F.count("*").alias("hits"), F.count_distinct("words").alias("phrases"), F.min("word").alias("first_word"), first, F.count(F.when(F.col("kind") == "passage", 1)).alias("passages"))


@query(
    f"""
WITH b AS (SELECT item_id, {FOLDED_WORDS.format('text')} AS w FROM benchmark),
r AS (SELECT row_number() OVER (ORDER BY length(item_id::VARCHAR), item_id::VARCHAR) AS rank, item_id, w FROM b),
f AS (SELECT DISTINCT rank, item_id, array_to_string(w[i:i + 3], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - 2)) AS i FROM r WHERE len(w) >= 4)),
d AS (SELECT doc_id, {FOLDED_WORDS.format('text')} AS w FROM documents),
n AS (SELECT doc_id, i - 1 AS word, array_to_string(w[i:i + 3], ' ') AS words FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 4)),
h AS (SELECT n.doc_id, f.rank, f.item_id, n.word, n.words FROM n JOIN f ON n.words = f.words),
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rank, word) AS nth FROM h)
SELECT d.doc_id, x.rank::INTEGER AS rank, x.item_id, x.words AS phrase, x.word::INTEGER AS word FROM d LEFT JOIN x ON d.doc_id = x.doc_id AND x.nth = 1"""
)
def first_rule_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """An ordered chain of rules from a table (each benchmark item: its runs of four words) decides on every whole document."""
    words = F.regexp_extract_all(F.translate(F.lower("text"), MARKED, PLAIN), F.lit("[a-z0-9]+"), 0)
    ranked = table(spark, sf, "benchmark").select("item_id", words.alias("w"), F.row_number().over(W.orderBy(F.length(F.col("item_id").cast("string")), F.col("item_id").cast("string"))).alias("rank"))
    rules = ranked.where("size(w) >= 4").select("rank", "item_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.array_join(F.slice("w", i, 4), " "))).alias("phrase")).distinct()
    out = P.first_rule(table(spark, sf, "documents"), "doc_id", "text", rules)
    return out.select("doc_id", "rank", "item_id", "phrase", "word")


@query(
    r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
f AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM w WHERE n > 0)
SELECT doc_id AS page, doc_id % 9 - 4 AS skew, sum(n)::BIGINT AS boxes, count(*) AS rows, count(DISTINCT run) AS blocks, max(n)::BIGINT AS widest FROM f GROUP BY doc_id"""
)
def page_rows_of_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every document set as a page of word boxes, turned by up to four degrees: skew, lines and paragraphs are found again."""
    texts = table(spark, sf, "documents").where("text IS NOT NULL").select(F.col("doc_id").alias("page"), "text")
    # texts are dealt by page, not their boxes, which are many times larger; few enough to a task for its sorts to stay in memory
    parts = max(1, -(-(texts.agg(F.sum(F.length("text"))).first()[0] or 0) // PAGE_CHARS))
    docs = texts.repartition(parts, "page").select("page", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    words = docs.select("page", "line", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0)).alias("nth", "word"))
    angle = F.radians(F.col("page") % 9 - 4)
    left, top = F.col("nth") * 30.0, F.col("line") * 20.0
    right, bottom = left + 10.0 + F.least(F.length("word"), F.lit(15)), top + 12.0
    x = lambda a, b: a * F.cos(angle) - b * F.sin(angle)
    y = lambda a, b: a * F.sin(angle) + b * F.cos(angle)
    box = (F.col("line").cast("long") * (1 << 31) + F.col("nth")).alias("box")
    boxes = words.select("page", box, x(left, top).alias("x0"), y(left, top).alias("y0"), x(right, top).alias("x1"), y(right, top).alias("y1"), x(left, bottom).alias("x2"), y(left, bottom).alias("y2"))
    rows = L.page_rows(boxes).groupBy("page", "row").agg(F.count("*").alias("n"), F.first("block").alias("block"), F.first("skew").alias("skew"))
    return rows.groupBy("page").agg(F.round(F.first("skew")).cast("bigint").alias("skew"), F.sum("n").alias("boxes"), F.count("*").alias("rows"), F.count_distinct("block").alias("blocks"), F.max("n").alias("widest"))


#: Extractors of what web texts state about themselves; each field by its first occurrence.
TEXT_EXTRACTORS = [
    X.PatternExtractor("contacts", {"email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "string"), "address": (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "string")}, r"@|[0-9]\.[0-9]", 0.9),
    X.PatternExtractor("numbers", {"number": (r"\b([0-9]{6,18})\b", "bigint"), "address": (r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "string")}, "[0-9]", 0.7),
]


@query(
    r"""
WITH d AS (
  SELECT doc_id, text, regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}') AS email,
         regexp_extract(text, '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b') AS address, regexp_extract(text, '\b([0-9]{6,18})\b', 1) AS number FROM documents),
o AS (
  SELECT doc_id, 'email' AS field, email AS value, 'contacts' AS extractor, 0.9::DOUBLE AS confidence, 1 AS agree FROM d WHERE email <> ''
  UNION ALL SELECT doc_id, 'address', address, 'contacts', 0.9, 2 FROM d WHERE address <> ''
  UNION ALL SELECT doc_id, 'number', number::BIGINT::VARCHAR, 'numbers', 0.7, 1 FROM d WHERE number <> '')
SELECT doc_id, field, value, extractor, confidence, agree::BIGINT AS agree FROM o"""
)
def extracted_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Two extractors called from SQL over all documents, one by its own columns, one as first match, and merged."""
    X.register_extractors(spark, TEXT_EXTRACTORS)
    docs = table(spark, sf, "documents")
    contacts = spark.sql("SELECT doc_id, c.email, c.address FROM {docs} d, LATERAL extract_fields(d.text, 'contacts') c", docs=docs)
    told = contacts.select("doc_id", F.lit("contacts").alias("extractor"), F.lit(0.9).alias("confidence"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("email", "address")])).alias("o")).select("doc_id", "extractor", "confidence", "o.*")
    first = spark.sql("SELECT doc_id, n.* FROM {docs} d, LATERAL first_extraction(d.text, 'numbers', 'contacts') n", docs=docs)
    return X.merged(told.where("value IS NOT NULL"), first, id_col="doc_id")


@query(
    r"""
WITH h AS (SELECT DISTINCT regexp_extract(lower(url), '^[a-z]+://([^/?#:.]+)', 1) AS n FROM pages)
SELECT a.n AS a, b.n AS b FROM h a JOIN h b ON a.n < b.n AND damerau_levenshtein(a.n, b.n) = 1"""
)
def close_host_names(spark: SparkSession, sf: str) -> DataFrame:
    """The first host labels of all pages that one edit or swapped pair of letters turns into each other."""
    names = table(spark, sf, "pages").select(F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#:.]+)", 1).alias("n"))
    return N.close_names(names, "n")
