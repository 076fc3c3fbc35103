"""Operator 7 [native]: quality rules from cross-document line frequency, with the usual per-text statistics.

Only DataFrame functions run here. Normalised lines are hashed, the documents that hold each line are counted for
each host (one entry for each document, combined before the shuffle), lines above the host's limit are removed,
and documents with too little left are rejected. The set of removed lines is written and joined back: broadcast
while its counted rows are few, else by a shuffle that adaptive execution splits at hot lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import join_sized, without, write_table

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOL = r"[#*$%&|<>]"
OUTPUTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "n_removed_words", "kept")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of ``text``: what is left between runs of blanks."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def normalised(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(BLANKS)))


def worded_lines(text: Column) -> Column:
    """The lines of ``text`` that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more in ``words``.

    Each window becomes one long: the high bits of its hash above its position, in as many low bits as the text
    needs. Sorting these longs brings equal windows together in order of position; neighbours count as equal only
    if their full 64-bit hashes are. The covered words follow from the sorted starts of such windows.
    """

    def covered(w: Column) -> Column:
        n = F.size(w) - 2
        bits = F.ceil(F.log2(n + 1)).cast("int") + 1
        hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))

        def starts(h: Column, b: Column) -> Column:
            position = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1).cast("int")
            high = lambda x: F.call_function("shiftright", x, b)
            packed = F.sort_array(F.transform(h, lambda x, i: F.call_function("shiftleft", F.call_function("shiftright", x, b), b).bitwiseOR(i.cast("long"))))

            def repeats(p: Column) -> Column:
                same = lambda x, i: (i >= 0) & (i < F.size(p)) & (high(F.get(p, i)) == high(x)) & (F.get(h, position(F.get(p, i))) == F.get(h, position(x)))
                return F.transform(F.filter(p, lambda x, i: same(x, i - 1) | same(x, i + 1)), position)

            return F.sort_array(let(packed, repeats))

        def total(s: Column) -> Column:
            steps = F.transform(s, lambda x, i: F.when(i > 0, F.least(F.lit(3), x - F.get(s, i - 1))).otherwise(F.lit(3)))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(hashes, lambda h: let(bits, lambda b: let(starts(h, b), total)))

    return let(words, lambda w: F.when(F.size(w) >= 4, covered(w)).otherwise(F.lit(0).cast("long")))


def _line(x: Column) -> Column:
    return F.struct(F.xxhash64(normalised(x)).alias("line"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words"))


def quality_rules(
    docs: DataFrame,
    *,
    text_col: str = "text",
    host_col: str = "source",
    id_col: str = "doc_id",
    min_docs: int = 30,
    max_share: float = 0.03,
    min_words: int = 50,
    max_repeat_share: float = 0.5,
    min_kept_share: float = 0.3,
    min_kept_words: int = 20,
) -> DataFrame:
    """Per-text statistics, the text without over-frequent lines, and the verdict ``kept``.

    A line (trimmed, lower-cased) that at least ``min_docs`` documents of one host hold, and more than
    ``max_share`` of the host's documents, is removed from that host's texts. A document fails the base rules if it
    has fewer than ``min_words`` words or more than ``max_repeat_share`` of them lie in repeated 3-word windows.
    It is rejected if it fails them or if the words left are fewer than ``min_kept_words`` or than
    ``min_kept_share`` of its words.

    Returns one row for each input row: the input's columns, with ``text`` the lines left joined by newlines, and
    ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_removed_lines, n_removed_words,
    kept``; input columns of these names are replaced. Every row is a document, also a repeated one. A null text
    counts as empty and comes back as null; documents with a null host form one host; an empty table gives an
    empty result.
    """
    docs = without(docs, *OUTPUTS, "__key", "__gone")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # rows with equal keys are equal in id, host and text, so they share their verdict
    keyed = docs.withColumn("__key", F.struct(F.col(id_col).cast("string").alias("id"), F.xxhash64(host_col).alias("h"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b")))
    distinct = F.array_distinct(F.transform(worded_lines(text), lambda x: F.xxhash64(normalised(x))))
    held = docs.select(F.col(host_col).alias("host"), F.explode(distinct).alias("line")).groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    sizes = write_table(docs.groupBy(F.col(host_col).alias("of")).agg(F.count("*").alias("of_docs")), "hosts")
    frequent = join_sized(held, sizes, held["host"].eqNullSafe(sizes["of"]), "inner").where(F.col("docs") > max_share * F.col("of_docs"))
    frequent = write_table(frequent.select(F.col("host").alias("of"), F.col("line").alias("frequent")), "frequent-lines")
    each = keyed.select(F.col(host_col).alias("host"), "__key", F.posexplode(F.transform(F.split(text, "\n"), _line)).alias("pos", "at")).select("host", "__key", "pos", "at.line", "at.words").where(F.col("words") > 0)
    gone = join_sized(each, frequent, (each["line"] == frequent["frequent"]) & each["host"].eqNullSafe(frequent["of"]), "inner")
    gone = gone.groupBy("__key").agg(F.collect_set(F.struct("pos", "words")).alias("__gone"))
    counted = keyed.select(
        "*",
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
        F.char_length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        let(worded_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words_of(text)).alias("n_repeat_words"),
    )
    joined = counted.join(gone.withColumnRenamed("__key", "__of"), F.col("__key") == F.col("__of"), "left")
    gone_words = F.coalesce(F.aggregate("__gone", F.lit(0).cast("long"), lambda a, x: a + x["words"]), F.lit(0).cast("long"))
    judged = joined.withColumns(
        {
            "base_failed": (F.col("n_words") < min_words) | (F.col("n_repeat_words") > max_repeat_share * F.col("n_words")),
            "n_removed_lines": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"),
            "n_removed_words": gone_words,
        }
    )
    left = F.col("n_words") - F.col("n_removed_words")
    judged = judged.withColumn("kept", ~F.col("base_failed") & (left >= min_kept_words) & (left >= min_kept_share * F.col("n_words")))
    rest = let(F.split(F.col(f"`{text_col}`"), "\n"), lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.transform("__gone", lambda g: g["pos"])), lambda i: x[i]), "\n"))
    cleaned = F.when(F.col("__gone").isNull(), F.col(f"`{text_col}`")).otherwise(rest).alias(text_col)
    return judged.select(*[cleaned if c == text_col else F.col(f"`{c}`") for c in docs.columns], *OUTPUTS)
