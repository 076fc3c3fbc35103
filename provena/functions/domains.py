"""Sender domains (I24): decoded labels, edit distance with swaps, and what a domain is to a supplier's own.

Python runs over Arrow batches for what has no expression: Bootstring decoding and the distance.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from provena.functions.normalise import skeleton
from provena.functions.web import registrable_domain
from provena.functions.wording import FREE_MAIL


def decode_label(label: str) -> str:
    """A label as it is shown: ``xn--`` labels by their Bootstring encoding; what can't be decoded stays."""
    if not label.startswith("xn--"):
        return label
    try:
        return label[4:].encode("ascii").decode("punycode")
    except (UnicodeError, ValueError, OverflowError):
        return label


@pandas_udf(T.StringType())
def decoded_host(hosts: pd.Series) -> pd.Series:
    """Lower-case hosts with all labels decoded; null for an empty one."""

    def one(host):
        if host is None or host != host:
            return None
        return ".".join(decode_label(p) for p in host.strip().strip(".").lower().split(".") if p) or None

    return hosts.map(one)


def swap_distance(a: str, b: str) -> int:
    """Insertions, deletions, replacements and swaps of neighbours that turn one text into the other, no place edited twice."""
    before: list[int] = []
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        before = last
    return row[-1]


@pandas_udf(T.IntegerType())
def edit_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """:func:`swap_distance` of two columns; null where either is."""
    return pd.Series([None if x is None or y is None else swap_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def sender_host(sender: Column | str) -> Column:
    """The decoded host of a mail address (behind the last @, with or without a name before it) or of a bare host."""
    s = F.col(sender) if isinstance(sender, str) else sender
    address = F.regexp_replace(s, r"^.*<([^<>]*)>\s*$", "$1")
    return decoded_host(F.lower(F.trim(F.regexp_replace(address, "^.*@", ""))))


def check_senders(messages: DataFrame, known: DataFrame) -> DataFrame:
    """(id, host, verdict, imitated) of messages (id, party, sender) against the parties' known entries (party, entry).

    An entry is a domain or an address, whose domain is known too. ``known``: a known domain or one below it;
    ``new_address``: a free mailbox of the party's provider under another address; ``lookalike``: a domain that can be
    taken for a known one (``imitated``, the first by name): its brand looks the same, is one edit away (two from nine
    letters on), or holds the known brand; else ``free_mail`` or ``changed``; ``unknown`` without a sender or known entries.
    """
    m = messages.select("id", "party", F.lower(F.trim(F.regexp_replace("sender", r"^.*<([^<>]*)>\s*$", "$1"))).alias("address"), sender_host("sender").alias("host"))
    m = m.withColumn("reg", registrable_domain("host"))
    k = known.where("entry IS NOT NULL").select("party", F.lower(F.trim("entry")).alias("entry"), sender_host("entry").alias("known_host"))
    k = k.select("party", "entry", registrable_domain("known_host").alias("known_reg")).where("known_reg IS NOT NULL").distinct()
    pairs = m.join(k, "party", "left")
    brand = lambda c: F.split(c, r"\.")[0]
    own, theirs = brand("reg"), brand("known_reg")
    pairs = pairs.withColumns({"a": skeleton(own), "b": skeleton(theirs), "same": own == theirs, "size": F.length(theirs)})
    few = F.when(F.col("size") < 9, 1).otherwise(2)
    pairs = pairs.withColumn("apart", F.when((F.col("size") >= 4) & (F.abs(F.length("a") - F.length("b")) <= few), edit_distance("a", "b")))
    alike = ~F.col("same") & (F.col("a") == F.col("b")) | F.col("apart").between(1, few) | (F.col("size") >= 4) & ~F.col("same") & F.contains(skeleton("host"), F.col("b"))
    is_known = F.col("reg") == F.col("known_reg")
    agg = pairs.groupBy("id").agg(
        F.first("host").alias("host"),
        F.first("reg").alias("reg"),
        F.count("known_reg").alias("entries"),
        F.bool_or(is_known).alias("known"),
        F.bool_or(is_known & (F.col("entry") == F.col("address"))).alias("own_address"),
        F.min(F.when(alike, F.col("known_reg"))).alias("imitated"),
    )
    free = F.col("reg").isin(*FREE_MAIL)
    verdict = (
        F.when(F.col("host").isNull() | (F.col("entries") == 0), "unknown")
        .when(F.col("known"), F.when(free & ~F.col("own_address"), "new_address").otherwise("known"))
        .when(F.col("imitated").isNotNull(), "lookalike")
        .when(free, "free_mail")
        .otherwise("changed")
    )
    return agg.select("id", "host", verdict.alias("verdict"), F.when(verdict == "lookalike", F.col("imitated")).alias("imitated"))


def close_names(names: DataFrame, name: str) -> DataFrame:
    """(a, b): all pairs a < b of distinct names that one edit or swap turns into each other.

    Two such names have a form in common that is one of them or lacks one letter of them; pairs meet by these forms,
    so names are never compared with all others. A null name has no pair.
    """
    own = names.select(F.col(name).alias("n")).where("n IS NOT NULL").distinct()
    size = F.char_length("n")
    less = F.transform(F.sequence(F.lit(1), size), lambda i: F.concat(F.substring(F.col("n"), F.lit(1), i - 1), F.substring(F.col("n"), i + 1, size)))
    forms = own.select("n", F.explode(F.array_distinct(F.concat(F.array("n"), F.when(size > 0, less).otherwise(F.array())))).alias("form"))
    pairs = forms.select(F.col("n").alias("a"), "form").join(forms.select(F.col("n").alias("b"), "form"), "form").where("a < b").select("a", "b").distinct()
    return pairs.where(edit_distance("a", "b") == 1)
