"""Aggregations (E01-E31): exact money, ordered buckets, rates, votes and statuses."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.functions.dates import seconds_between

MONEY = "decimal(28,2)"
#: What a caller may put in as a key: a column's name, or a function of the rows that gives a column.
Key = str | Callable[[DataFrame], Column]


def summed_by(rows: DataFrame, keys: Mapping[str, Key], amounts: Sequence[str], *, levels: bool = False) -> DataFrame:
    """Sums and counts by keys that the caller puts in by name, with all leading levels and the total if ``levels``.

    A key is any expression over the rows, a registered function's too, so an aggregation never fixes what it groups by.
    A row whose key is null is a group of its own; of totals the keys left out are null and ``level`` counts them.
    """
    told = rows.select(*amounts, *[(F.col(k) if isinstance(k, str) else k(rows)).alias(n) for n, k in keys.items()])
    sums = [F.sum(a).cast("decimal(28,2)").alias(a) for a in amounts]
    if not levels:
        return told.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    out = told.rollup(*keys).agg(F.count("*").alias("n"), *sums, F.grouping_id().alias("__id"))
    return out.withColumn("level", F.bit_count("__id").cast("int")).drop("__id")


def total(x: Column | str) -> Column:
    """An exact sum of cents; no rows give 0.00."""
    return F.coalesce(F.sum(x), F.lit(0)).cast(MONEY)


def first_bucket(*rules: tuple[str, Column], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for name, holds in reversed(rules):
        out = F.when(holds, F.lit(name)).otherwise(out)
    return out


def by_groups(rows: DataFrame, amount: str, sets: Sequence[Sequence[str]], keys: Sequence[str]) -> DataFrame:
    """Sums and counts for several groupings in one pass, with ``grouping_id`` over ``keys``."""
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(total(amount).alias("amount"), F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("grouping_id"))


def vat_summary(lines: DataFrame, keys: Sequence[str], sign: Column) -> DataFrame:
    """Net, tax and gross for each key; ``sign`` is -1 for credit notes."""
    tax = F.round(F.col("net") * F.col("vat_rate"), 2).cast("decimal(18,2)")
    return lines.select(*keys, (F.col("net") * sign).cast("decimal(18,2)").alias("net"), (tax * sign).cast("decimal(18,2)").alias("tax")).groupBy(*keys).agg(total("net").alias("net"), total("tax").alias("tax"), total(F.col("net") + F.col("tax")).alias("gross"), F.count("*").alias("n"))


def lines_against_header(lines: DataFrame, headers: DataFrame, on: str, line_amount: str, header_amount: str, tolerance: str = "0.01") -> DataFrame:
    """The sum of lines against the stated total, within a cent for each line."""
    sums = lines.groupBy(on).agg(total(line_amount).alias("lines_total"), F.count("*").alias("n_lines"))
    diff = (F.col("lines_total") - F.col("stated")).cast(MONEY)
    joined = headers.select(on, F.col(header_amount).cast(MONEY).alias("stated")).join(sums, on)
    return joined.withColumn("diff", diff).withColumn("ok", F.abs("diff") <= F.col("n_lines") * F.lit(tolerance).cast("decimal(5,2)"))


def median_mad(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Each row with its group's median, median absolute deviation and modified z (0.6745 * deviation / MAD).

    An even count takes the mean of the two middles. Where the MAD is 0 the score is null.
    """
    w = W.partitionBy(*keys)
    x = F.col(value).cast("double")
    out = rows.withColumn("median", F.median(x).over(w)).withColumn("mad", F.median(F.abs(x - F.col("median"))).over(w))
    return out.withColumn("past", F.count("*").over(w)).withColumn("z", F.when(F.col("mad") > 0, 0.6745 * F.abs(x - F.col("median")) / F.col("mad")))


def amount_outliers(scored: DataFrame, value: str, *, least: int = 5, z: float = 3.5, share: float = 0.5) -> DataFrame:
    """I32: amounts with enough history, a high modified z and far from the median in proportion."""
    return scored.where((F.col("past") >= least) & (F.col("z") >= z) & (F.abs(F.col(value).cast("double") - F.col("median")) >= share * F.col("median")))


def stable_mode(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest on a tie, with its count and share."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    w = W.partitionBy(*keys).orderBy(F.col("n").desc(), F.col(value).asc_nulls_last())
    ranked = counts.withColumn("rn", F.row_number().over(w)).withColumn("of", F.sum("n").over(W.partitionBy(*keys)))
    return ranked.where("rn = 1").drop("rn")


def majority(rows: DataFrame, keys: Sequence[str], vote: str, weight: Column | None = None) -> DataFrame:
    """The value with the most weight; a tie leaves it null and says ``ambiguous``."""
    votes = rows.groupBy(*keys, vote).agg(F.sum(weight if weight is not None else F.lit(1)).cast("bigint").alias("w"))
    top = votes.withColumn("top", F.max("w").over(W.partitionBy(*keys)))
    return top.where("w = top").groupBy(*keys).agg(F.when(F.count("*") == 1, F.min(vote)).alias("winner"), F.max("w").alias("weight"), (F.count("*") > 1).alias("ambiguous"))


def strict_majority(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The value that more than half of the readings agree on, else null, with readings and agreement."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    of = counts.withColumn("readings", F.sum("n").over(W.partitionBy(*keys)))
    return of.groupBy(*keys).agg(F.max(F.when(F.col("n") * 2 > F.col("readings"), F.col(value))).alias("agreed"), F.max("n").alias("agreement"), F.max("readings").alias("readings"))


def floor_share(part: Column, whole: Column, digits: int = 1) -> Column:
    """A percentage rounded down, for figures of which more is better; null without a whole."""
    k = 10**digits
    return F.when(whole > 0, F.floor(part * 100 * k / whole).cast("double") / k)


def ceil_share(part: Column, whole: Column, digits: int = 1) -> Column:
    """A percentage rounded up, for figures of which less is better; null without a whole."""
    k = 10**digits
    return F.when(whole > 0, F.ceil(part * 100 * k / whole).cast("double") / k)


def percent_closed(closed: Column, whole: Column) -> Column:
    """Whole percent closed, rounded down and at most 99 unless everything is."""
    return F.when(whole == 0, F.lit(100)).when(closed == whole, F.lit(100)).otherwise(F.least(F.lit(99), F.floor(closed * 100 / whole))).cast("bigint")


def coverage_share(rows: DataFrame, keys: Sequence[str], covered: Column, amount: str) -> DataFrame:
    """The smaller of the covered share by count and by volume, in percent rounded down to a tenth."""
    agg = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(covered, 1)).alias("n_covered"), total(F.abs(amount)).alias("volume"), total(F.when(covered, F.abs(amount))).alias("volume_covered"))
    by_count = floor_share(F.col("n_covered"), F.col("n"))
    by_volume = floor_share(F.col("volume_covered").cast("double"), F.col("volume").cast("double"))
    return agg.withColumn("share", F.least(by_count, by_volume))


def funnel(events: DataFrame, user: str, kind: str, ts: str, steps: Sequence[str]) -> DataFrame:
    """The first time of each step for each user, and minutes from the first step to each later one."""
    firsts = events.groupBy(user).agg(*[F.min(F.when(F.col(kind) == s, F.col(ts))).alias(f"{s}_at") for s in steps])
    begin = F.col(f"{steps[0]}_at")
    return firsts.withColumns({f"{s}_minutes": F.when(F.col(f"{s}_at") >= begin, F.floor(seconds_between(begin, F.col(f"{s}_at")) / 60).cast("bigint")) for s in steps[1:]})


def worst(rank_of: dict[str, int], level: str) -> Column:
    """The most severe level of a group (highest rank), as its name."""
    rank = F.coalesce(*[F.when(F.col(level) == k, F.lit(v)) for k, v in rank_of.items()])
    top = F.max(rank)
    return F.coalesce(*[F.when(top == v, F.lit(k)) for k, v in rank_of.items()])


def five_states(personal: Column, closed: Column, not_needed: Column, needs_you: Column) -> Column:
    """Exactly one state for each row, in this order."""
    return first_bucket(("personal", personal), ("proven", closed), ("not_needed", not_needed), ("needs_you", needs_you), otherwise="looking")


def gate_counts(rows: DataFrame, keys: Sequence[str], truth: Column, said: Column) -> DataFrame:
    """True and false answers against labels; precision and recall rounded down to a tenth of a percent."""
    count = lambda c: F.count(F.when(c, 1))
    agg = rows.groupBy(*keys).agg(count(truth & said).alias("tp"), count(~truth & said).alias("fp"), count(truth & ~said).alias("fn"), count(~truth & ~said).alias("tn"))
    return agg.withColumns({"precision_pct": floor_share(F.col("tp"), F.col("tp") + F.col("fp")), "recall_pct": floor_share(F.col("tp"), F.col("tp") + F.col("fn"))})


def largest_remainder(rows: DataFrame, whole: str, group: str, weight: Column, order: Sequence[Column], out: str = "share") -> DataFrame:
    """Split a group's whole over its rows by weight in exact cents.

    Each share is rounded down; the cents left over go to the first row with the largest weight. Groups without
    weight give everything to their first row. Amounts and weights are 64-bit cents, as is their product.
    """
    w = W.partitionBy(group)
    rows = rows.withColumns({"__c": (F.col(whole) * 100).cast("bigint"), "__w": (weight * 100).cast("bigint")}).withColumn("__s", F.sum("__w").over(w))
    rows = rows.withColumn("__low", F.when(F.col("__s") > 0, F.expr("(__c * __w) div __s")).otherwise(F.lit(0)))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.col("__w").desc(), *order))
    left = F.col("__c") - F.sum("__low").over(w)
    share = (F.col("__low") + F.when(rank == 1, left).otherwise(0)).cast("decimal(20,0)") / 100
    return rows.withColumn(out, share.cast("decimal(18,2)")).drop("__c", "__w", "__s", "__low")
