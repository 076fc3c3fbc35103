"""Joins and matching (D01-D36): bands, scores, one-to-one, subsets, intervals, votes, rules, names."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import Context, Decimal
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from provena.functions.text import name_similarity
from provena.operators.folds import fold_groups
from provena.operators.graph import connected_components
from provena.operators.vectors import NearestRows, unit_rows
from provena.storage import Scratch, write_table

CENT = "0.01"


def dec(x, scale: int = 2) -> Column:
    return F.lit(x).cast(f"decimal(18,{scale})")


def near_tolerance(amount: Column) -> Column:
    """What still counts as near: min(max(2.00, 1 %), 25.00)."""
    return F.least(F.greatest(dec("2.00"), F.round(F.abs(amount) * dec("0.01"), 2)), dec("25.00")).cast("decimal(18,2)")


#: Whole cents that ``band_join`` leaves with its pairs when asked: the left amount, the right one and its tolerance.
CENTS = ("__paid", "__due", "__near")


def in_cents(rows: DataFrame, *amounts: str) -> bool:
    """Whether the amounts have at most two places and their cents fit into 64 bits."""
    types = [rows.schema[a].dataType for a in amounts]
    return all(isinstance(t, DecimalType) and t.scale <= 2 and t.precision - t.scale <= 16 for t in types)


def band_join(left: DataFrame, right: DataFrame, left_amount: str, right_amount: str, *, width: str = "25.00", on: Sequence[str] = (), looks: int = 3, cents: bool = False) -> DataFrame:
    """Pairs whose amounts lie within the near tolerance of the right one.

    Amounts fall into buckets, and a left row looks into the ``looks`` ones that can hold a match within ``width``, the
    largest tolerance: an equi-join with a residual filter, so no row meets more than its amount's neighbourhood. More
    looks copy a left row more often into smaller buckets. Where amounts have at most two places, a right row's bounds
    are computed once, in cents, and a pair costs two comparisons of integers; with ``cents`` the columns ``CENTS`` stay.
    Without other keys pairs are far more than rows, so both sides are dealt by bucket, in as many parts as shuffles
    have, however few the bytes.
    """
    whole = in_cents(left, left_amount) and in_cents(right, right_amount)
    if whole:
        reach = int(Decimal(width) * 100)
        step = F.lit(-(-2 * reach // (looks - 1))).cast("bigint")
        cent = lambda x: (x * 100).cast("bigint")
        a, b = left.withColumn("__paid", cent(F.col(left_amount))), right.withColumn("__due", cent(F.col(right_amount)))
        b = b.withColumn("__near", cent(near_tolerance(F.col(right_amount))))
        b = b.withColumns({"__b": F.col("__due") - F.pmod("__due", step), "__low": F.col("__due") - F.col("__near"), "__high": F.col("__due") + F.col("__near")})
        inside = (F.col("__paid") >= F.col("__low")) & (F.col("__paid") <= F.col("__high"))
        lowest = F.col("__paid") - reach - F.pmod(F.col("__paid") - reach, step)
    else:
        assert not cents, "amounts have more than two places"
        step = F.lit(1)
        place = lambda c: F.floor(F.col(c).cast("double") * ((looks - 1) / 2) / float(width)).cast("bigint")
        lowest, a, b = place(left_amount) - (looks // 2), left, right.withColumn("__b", place(right_amount))
        looks = 2 * (looks // 2) + 1
        inside = F.abs(F.col(left_amount) - F.col(right_amount)) <= near_tolerance(F.col(right_amount))
    a = a.withColumn("__b", F.explode(F.array(*[lowest + step * k for k in range(looks)])))
    if not on:
        parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        a, b = a.repartition(parts, "__b"), b.repartition(parts, "__b")
    return a.join(b, [*on, "__b"]).where(inside).drop("__b", "__low", "__high", *(() if cents else CENTS))


def amount_status(paid: Column, due: Column, *, fee: str = "1.50") -> Column:
    """Exact, adjusted (by a known fee), near, partial or mismatch."""
    diff = F.abs(paid - due)
    return F.when(diff <= dec(CENT), "exact").when(F.abs(paid - due - dec(fee)) <= dec(CENT), "adjusted").when(diff <= near_tolerance(due), "near").when((paid > 0) & (paid < due), "partial").otherwise("mismatch")


def amount_points(status: Column, paid: Column, due: Column) -> Column:
    """40 for exact or adjusted, 20/12/6 for near by quarter, half and whole tolerance, 15 for partial."""
    share = F.abs(paid - due).cast("double") / near_tolerance(due).cast("double")
    return F.when(status.isin("exact", "adjusted"), 40).when(status == "near", F.when(share <= 0.25, 20).when(share <= 0.5, 12).otherwise(6)).when(status == "partial", 15).otherwise(0)


def day_points(days: Column) -> Column:
    """10, 8, 6, 4 for up to 3, 7, 14, 31 days apart, 3 in the window of -7 to 60 days, else 0."""
    apart = F.abs(days)
    return F.when(days.isNull() | (days < -7) | (days > 60), 0).when(apart <= 3, 10).when(apart <= 7, 8).when(apart <= 14, 6).when(apart <= 31, 4).otherwise(3)


def cent_kind(paid: Column, due: Column, near: Column, *, fee: int = 150) -> Column:
    """D08 in whole cents, as a number: the place of the status in ``STATUSES``."""
    diff = F.abs(paid - due)
    return F.when(diff <= 1, 0).when(F.abs(paid - due - fee) <= 1, 1).when(diff <= near, 2).when((paid > 0) & (paid < due), 3).otherwise(4)


#: From the best to none.
STATUSES = ("exact", "adjusted", "near", "partial", "mismatch")


def score_pairs(pairs: DataFrame, *, paid: str, due: str, paid_on: str, issued_on: str, same_supplier: Column, quoted: Column | None = None) -> DataFrame:
    """Status, days apart, points (0-100), viability and grade of candidate pairs.

    ``same_supplier`` is worth 20 points (15 less than nothing said is -40 for a different one); a quoted number 25.
    Not viable: amounts that mismatch, a partial payment without a quoted number, days outside the window.
    Pairs with the columns ``CENTS`` (which are dropped) are scored in whole numbers, with the same result.
    """
    quoted = F.coalesce(quoted, F.lit(False)) if quoted is not None else F.lit(False)
    days = F.datediff(F.col(paid_on), F.col(issued_on)).cast("bigint")
    if set(CENTS) <= set(pairs.columns):
        at, of, near = (F.col(c) for c in CENTS)
        out = pairs.withColumns({"__kind": cent_kind(at, of, near), "__apart": F.abs(at - of) * 2})
        kind, apart = F.col("__kind"), F.col("__apart")
        worth = F.when(kind <= 1, 40).when(kind == 2, F.when(apart * 2 <= near, 20).when(apart <= near, 12).otherwise(6)).when(kind == 3, 15).otherwise(0)
        named = F.when(kind == 0, STATUSES[0])
        for n, status in enumerate(STATUSES[1:-1], 1):
            named = named.when(kind == n, status)
        out = out.withColumns({"status": named.otherwise(STATUSES[-1]), "days": days})
        exact, fits = kind == 0, (kind <= 2) | (quoted & (kind == 3))
    else:
        out = pairs.withColumns({"status": amount_status(F.col(paid), F.col(due)), "days": days})
        worth = amount_points(F.col("status"), F.col(paid), F.col(due))
        exact, fits = F.col("status") == "exact", (F.col("status") != "mismatch") & ((F.col("status") != "partial") | quoted)
    points = worth + 5 + F.when(same_supplier, 20).otherwise(-40) + F.when(quoted, 25).otherwise(0) + day_points(F.col("days"))
    viable = fits & same_supplier & (F.col("days").between(-7, 60) | quoted)
    out = out.withColumns({"points": F.greatest(F.lit(0), F.least(F.lit(100), points)).cast("bigint"), "viable": F.coalesce(viable, F.lit(False))})
    grade = F.when(F.col("viable") & (F.col("points") >= 70) & exact, "green").when(F.col("viable") & (F.col("points") >= 45), "amber").otherwise("red")
    return out.withColumn("grade", grade).drop(*CENTS, "__kind", "__apart")


#: Rounds before what is left is looked at by components, and pairs of a component that one task may take in order.
ROUNDS, COMPONENT_PAIRS = 4, 50_000


def greedy_one_to_one(candidates: DataFrame, left: str, right: str, order: Sequence[tuple[str, bool]]) -> DataFrame:
    """Take pairs in one global order, each side at most once.

    ``order`` are numeric (column, ascending); ties fall to the ids, so the order is total. A pair that comes first
    for both of its sides is taken by any run through that order, whatever else it takes: each round takes all such
    pairs, drops their rivals and goes on, with one minimum for each side and no group in one task. Pairs that decide
    each other one after another would need a round each; so after ``ROUNDS`` rounds the components that are left
    are run through in order, each in one task if it has at most ``COMPONENT_PAIRS`` pairs. Larger ones take further
    rounds, by which they fall apart. A round's tables are written and the one before deleted.
    """
    place = F.struct(*[(F.col(c) if up else -F.col(c)).alias(f"o{i}") for i, (c, up) in enumerate(order)], left, right)
    taken: list[DataFrame] = []
    with Scratch(candidates.sparkSession) as scratch:
        rest = scratch.write(candidates.withColumn("__at", place), "pairs")
        rounds = 0
        while not rest.isEmpty():
            best = lambda side: rest.groupBy(side).agg(F.min("__at").alias("__at")).select("__at")  # noqa: B023, E731
            first = write_table(rest.join(best(left), "__at", "left_semi").join(best(right), "__at", "left_semi"), "taken")
            taken.append(first)
            rest = scratch.write(rest.join(first.select(left), left, "left_anti").join(first.select(right), right, "left_anti"), "pairs")
            scratch.drop(keep=1)
            rounds += 1
            if rounds % ROUNDS == 0 and not rest.isEmpty():
                done, rest = _by_component(rest, left, right, scratch)
                taken.append(done)
    return reduce(DataFrame.unionByName, taken).drop("__at") if taken else candidates.limit(0)


def _by_component(rest: DataFrame, left: str, right: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(pairs taken, pairs left): components of few pairs are run through in order, the others stay."""
    node = lambda side, c: F.concat(F.lit(side), F.to_json(F.struct(F.col(c).alias("k"))))
    known = rest.withColumns({"__l": node("l", left), "__r": node("r", right)})
    roots = connected_components(known.select(F.col("__l").alias("u"), F.col("__r").alias("v")))
    known = known.join(roots.select(F.col("node").alias("__l"), F.col("root").alias("__root")), "__l")
    sizes = known.groupBy("__root").agg(F.count("*").alias("__n"))
    known = scratch.write(known.join(sizes, "__root"), "pair-components")
    small = known.where(F.col("__n") <= COMPONENT_PAIRS)

    def run(group: pd.DataFrame) -> list[tuple]:
        used: set[str] = set()
        out = []
        for n, (a, b) in enumerate(zip(group["__l"], group["__r"], strict=True)):
            if a not in used and b not in used:
                used |= {a, b}
                out.append((n + 1,))
        return out

    chosen = fold_groups(small.select("__root", "__at", "__l", "__r"), ["__root"], ["__at"], run, "__nth bigint")
    nth = F.row_number().over(W.partitionBy("__root").orderBy("__at")).cast("bigint")
    done = write_table(small.withColumn("__nth", nth).join(chosen, ["__root", "__nth"], "left_semi").select(*rest.columns), "taken")
    return done, scratch.write(known.where(F.col("__n") > COMPONENT_PAIRS).select(*rest.columns), "pairs")


#: Digits enough for amounts of 38 digits, whatever their places.
WIDE = Context(prec=60)


def _whole_numbers(amounts: Sequence) -> list[int]:
    """Decimal amounts in units of their smallest decimal place: exact, whatever their size."""
    exact = [a if isinstance(a, Decimal) else Decimal(str(a)) for a in amounts]
    places = max(0, *(-a.as_tuple().exponent for a in exact))
    return [int(a.scaleb(places, WIDE)) for a in exact]


def subset_sums(groups: DataFrame, key: str, target: str, item: str, amount: str, *, near: str | None = None, most: int = 6, pool: int = 20, solutions: int = 8, nodes: int = 50_000) -> DataFrame:
    """For each key the sets of two to ``most`` items that sum to its target exactly.

    ``groups`` has a row for each (key, item), the target repeated. Of more than ``pool`` items those with the
    smallest ``near`` (days from the target) are tried, or those with the smallest ids without it; sums are of whole
    numbers of the smallest decimal place; sums that can no longer reach the target are cut off by the smallest and largest sums of what is left.
    ``capped`` says that a bound ended the search, so an answer may be missing. Returns key, items (sorted),
    n_items, capped; a capped key without an answer has a row with null items.
    """

    def search(ids: list, amounts: list, aim, size: int) -> list[tuple]:
        capped = size > pool
        at = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i]))
        ids = [ids[i] for i in at]
        *cents, goal = _whole_numbers([*[amounts[i] for i in at], aim])
        low, high = [0] * (len(cents) + 1), [0] * (len(cents) + 1)
        for i in range(len(cents) - 1, -1, -1):
            low[i], high[i] = low[i + 1] + min(0, cents[i]), high[i + 1] + max(0, cents[i])
        found, visited = [], 0
        stack = [(0, goal, ())]
        while stack:
            at, left, chosen = stack.pop()
            visited += 1
            if visited > nodes or len(found) >= solutions:
                capped = True
                break
            if left == 0 and len(chosen) >= 2:
                found.append(chosen)
            if at == len(cents) or len(chosen) == most or not low[at] <= left <= high[at]:
                continue
            for i in range(len(cents) - 1, at - 1, -1):
                stack.append((i + 1, left - cents[i], (*chosen, i)))
        rows = [([ids[i] for i in f], len(f), capped) for f in found]
        return rows or ([(None, 0, True)] if capped else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("__ids")
            made = [(n, *t) for n, g in enumerate(zip(ids.to_pylist(), batch.column("__amounts").to_pylist(), batch.column("__goal").to_pylist(), batch.column("__n").to_pylist(), strict=True)) for t in search(*g)]
            kept = [pa.array([m[i] for m in made], kind) for i, kind in ((0, pa.int64()), (1, ids.type), (2, pa.int64()), (3, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(key).take(kept[0]), *kept[1:]], names=[key, "items", "n_items", "capped"])

    # one row for each key: a call to Python takes many keys, and no key is a table of its own there
    rows = groups.select(*dict.fromkeys([key, target, item, amount, *([near] if near else [])]))
    ranked = rows.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*([near, item] if near else [item]))))
    first = F.sort_array(F.collect_list(F.when(F.col("__rn") <= pool, F.struct("__rn", F.col(item).alias("i"), F.col(amount).alias("a")))))
    told = ranked.groupBy(key).agg(first.alias("__s"), F.max(F.when(F.col("__rn") == 1, F.col(target))).alias("__goal"), F.count("*").alias("__n"))
    lists = told.select(key, F.col("__s.i").alias("__ids"), F.col("__s.a").alias("__amounts"), "__goal", "__n")
    kinds = dict(groups.dtypes)
    return lists.mapInArrow(run, f"`{key}` {kinds[key]}, items array<{kinds[item]}>, n_items bigint, capped boolean")


def subset_rows(found: DataFrame, key: str) -> DataFrame:
    """One row for each key of ``subset_sums``: how many sets, the sets as text in order, and whether a bound ended the search."""
    text = F.when(F.col("items").isNotNull(), F.array_join(F.transform("items", lambda x: x.cast("string")), "+"))
    agg = found.groupBy(key).agg(F.count("items").alias("n_sets"), F.sort_array(F.collect_list(text)).alias("s"), F.max("capped").alias("capped"))
    return agg.select(key, "n_sets", F.when(F.col("n_sets") > 0, F.array_join("s", " ")).alias("sets"), "capped")


def as_of(rows: DataFrame, facts: DataFrame, on: Sequence[str], day: str, fact_day: str, value: str, *, lookback: int = 7) -> DataFrame:
    """The latest fact on or before each row's day, at most ``lookback`` days old; null without one.

    A fact is spread to the days that it can serve, so the join is on equal keys and days and meets at most
    ``lookback`` + 1 facts for each row.
    """
    spread = facts.select(*on, fact_day, value, F.explode(F.sequence(F.col(fact_day), F.date_add(fact_day, lookback), F.expr("INTERVAL 1 DAY"))).alias(day))
    best = spread.groupBy(*on, day).agg(F.max_by(value, fact_day).alias(value), F.max(fact_day).alias(fact_day))
    return rows.join(best, [*on, day], "left")


def nearest(left: DataFrame, right: DataFrame, on: Sequence[str], day: str, right_day: str, right_id: str, left_id: str, *, within: int = 45) -> DataFrame:
    """Each left row's nearest right row by days, then by id; nothing beyond ``within`` days."""
    apart = F.abs(F.datediff(F.col(day), F.col(right_day)))
    pairs = left.join(right, list(on)).withColumn("days_apart", apart.cast("bigint")).where(F.col("days_apart") <= within)
    w = W.partitionBy(left_id).orderBy("days_apart", right_id)
    return pairs.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def unique_pairs(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Pairs whose both sides have no rival; ``ambiguous`` marks the others."""
    n = lambda c: F.count("*").over(W.partitionBy(c))
    return pairs.withColumn("ambiguous", (n(left) > 1) | (n(right) > 1))


def fifo_overlap(takings: DataFrame, deposits: DataFrame, key: str, order_in: Sequence[Column], order_out: Sequence[Column], *, id_in: str, id_out: str, amount: str) -> DataFrame:
    """D26 without its window: first in, first out, as the overlap of running totals on both sides.

    Every taking is an interval of the money that came in, every deposit one of the money that went out; equal
    stretches belong together. Pairs come from a range join within the key.
    """
    def spans(rows: DataFrame, order: Sequence[Column], name: str, lo: str, hi: str) -> DataFrame:
        w = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        cum = F.sum(amount).over(w).cast("decimal(28,2)")
        return rows.select(key, F.col(name), (cum - F.col(amount)).cast("decimal(28,2)").alias(lo), cum.alias(hi))

    a, b = spans(takings, order_in, id_in, "a_lo", "a_hi"), spans(deposits, order_out, id_out, "b_lo", "b_hi")
    pairs = a.join(b, key).where((F.col("a_lo") < F.col("b_hi")) & (F.col("b_lo") < F.col("a_hi")))
    return pairs.select(key, id_in, id_out, (F.least("a_hi", "b_hi") - F.greatest("a_lo", "b_lo")).cast("decimal(28,2)").alias("allocated"))


def fifo_deposits(days: DataFrame, deposits: DataFrame, key: str, *, window: int = 21) -> DataFrame:
    """Deposits take till days of the ``window`` days before them, oldest first, all or nothing.

    ``days`` (key, day, cash) and ``deposits`` (key, id, day, amount); returns key, id, day, taken. A fold over one
    key's days and deposits in order; keys are companies' tills, so a group is bounded by the calendar.
    """

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out, cash = [], {}
        if len(left):
            for d, c in zip(left["day"], left["cash"], strict=True):
                cash[d] = cash.get(d, 0) + c
        who = (left if len(left) else right)[key].iloc[0]
        for _, r in right.sort_values(["day", "id"]).iterrows():
            usable = [d for d in sorted(cash) if 0 <= (r["day"] - d).days <= window and cash[d] > 0]
            if sum((cash[d] for d in usable), 0) < r["amount"]:
                continue
            left_over = r["amount"]
            for d in usable:
                take = min(cash[d], left_over)
                if take <= 0:
                    break
                cash[d] -= take
                left_over -= take
                out.append((who, r["id"], d, take))
        return pd.DataFrame(out, columns=[key, "id", "day", "taken"])

    kinds = dict(deposits.dtypes)
    return days.groupBy(key).cogroup(deposits.groupBy(key)).applyInPandas(fold, f"`{key}` {kinds[key]}, id {kinds['id']}, day date, taken decimal(18,2)")


def statement_check(lines: DataFrame, own: DataFrame, on: Sequence[str], stated: str, ours: str, *, tolerance: str = CENT) -> DataFrame:
    """A supplier's lines against our own documents by number: matched, differs, only theirs, only ours."""
    joined = lines.join(own, list(on), "full")
    outcome = F.when(F.col(ours).isNull(), "missing_here").when(F.col(stated).isNull(), "missing_there").when(F.abs(F.col(stated) - F.col(ours)) <= dec(tolerance), "matched").otherwise("differs")
    return joined.withColumn("outcome", outcome)


def decide_by_rules(hits: DataFrame, subject: str, field: str, value: str, rank: Sequence[Column], newest: Sequence[Column]) -> DataFrame:
    """The best-ranked rules decide each field; if they disagree it is a conflict, else the newest one wins."""
    best = hits.withColumn("__r", F.rank().over(W.partitionBy(subject, field).orderBy(*rank))).where("__r = 1")
    w = W.partitionBy(subject, field)
    values = best.withColumn("__n", F.size(F.collect_set(value).over(w))).withColumn("__rn", F.row_number().over(w.orderBy(*newest)))
    won = values.where("__rn = 1").withColumn("conflict", F.col("__n") > 1)
    return won.withColumn(value, F.when(~F.col("conflict"), F.col(value))).drop("__r", "__n", "__rn")


def resolve_strong_keys(rows: DataFrame, row_id: str, keys: Sequence[str], parties: DataFrame, party_id: str) -> DataFrame:
    """Parties found by any strong key (tax number, account, domain, name), with the keys that agree.

    ``parties`` (kind, value, party_id) holds one row for each key of a party. Keys that find different parties are
    a conflict and resolve nothing.
    """
    long = rows.select(row_id, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k")).select(row_id, "k.kind", "k.value").where("value IS NOT NULL")
    found = long.join(parties, ["kind", "value"]).select(row_id, "kind", party_id).distinct()
    agg = found.groupBy(row_id).agg(F.min(party_id).alias("low"), F.max(party_id).alias("high"), F.sort_array(F.collect_set("kind")).alias("by"))
    return agg.select(row_id, F.when(F.col("low") == F.col("high"), F.col("low")).alias(party_id), F.array_join("by", ",").alias("by"), (F.col("low") != F.col("high")).alias("conflict"))


def best_names(left: DataFrame, right: DataFrame, left_id: str, left_name: str, right_id: str, right_name: str, *, least: float = 0.86, margin: float = 0.02, others: bool = False) -> DataFrame:
    """D12 without a block: each left name against every right name, complete down to what can decide.

    A pair below ``least`` less ``margin`` can neither be accepted nor stand in the way, so only pairs of at least
    that similarity are made, each by a key of its own rule: names that are a run of words or the start of the other
    meet by equality with it, and names within so few edits share one of their rarest letter pairs (of k edits each
    touches at most two pairs, so the 2k + 1 rarest of both sides meet) and lie close in length. Names must be
    folded. ``others`` leaves out pairs with equal ids. Returns one row for each left row with the best right
    row, similarity, runner_up and accepted; the middle three are null where no name is that much alike.
    """
    low = round(least - margin, 6)
    share = 1 - low + 1e-6
    a = left.select(F.col(left_id).alias("x"), F.col(left_name).alias("p")).where("p != ''")
    b = right.select(F.col(right_id).alias("y"), F.col(right_name).alias("q")).where("q != ''")
    plain = lambda c: F.replace(F.col(c), F.lit(" "), F.lit(""))

    def runs(c: str) -> Column:
        words = F.split(c, " ")
        n = F.size(words)
        return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(words, i, k), " "))))

    def starts(c: str) -> Column:
        n = F.char_length(c)
        first = F.greatest(F.lit(1), F.floor(n * ((low - 0.80) / 0.15 - 1e-4)).cast("int"))
        return F.transform(F.sequence(first, n), lambda k: F.substring(F.col(c), F.lit(1), k))

    def parts(c: str) -> Column:
        return F.explode(F.array_distinct(F.concat(runs(c), starts(c)))).alias("key")

    same = a.select("x", "p", plain("p").alias("key")).join(b.select("y", "q", plain("q").alias("key")), "key")
    inner = a.select("x", "p", parts("p")).join(b.withColumn("key", F.col("q")), "key")
    outer = a.withColumn("key", F.col("p")).join(b.select("y", "q", parts("q")), "key")

    def grams(rows: DataFrame, i: str, name: str) -> DataFrame:
        n = F.char_length(name)
        g = rows.where(n > 1).select(i, name, F.posexplode(F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.substring(F.col(name), k, F.lit(2)))).alias("pos", "g"))
        return g.withColumn("nth", F.row_number().over(W.partitionBy(i, "g").orderBy("pos")))

    ga, gb = grams(a, "x", "p"), grams(b, "y", "q")
    df = ga.select("g", "nth").unionAll(gb.select("g", "nth")).groupBy("g", "nth").agg(F.count("*").alias("df"))

    def rarest(rows: DataFrame, i: str, name: str) -> DataFrame:
        edits = F.floor(F.floor(F.char_length(name) / (1 - share)) * share)
        ranked = rows.join(df, ["g", "nth"]).withColumn("rn", F.row_number().over(W.partitionBy(i).orderBy("df", "g", "nth")))
        return ranked.where(F.col("rn") <= 2 * edits + 1).select(i, name, "g", "nth")

    n = F.char_length("p")
    near = F.sequence(F.ceil(n * (1 - share)).cast("int"), F.floor(n / (1 - share)).cast("int"))
    close = rarest(ga, "x", "p").withColumn("size", F.explode(near)).join(rarest(gb, "y", "q").withColumn("size", F.char_length("q")), ["g", "nth", "size"])
    pairs = same.select("x", "p", "y", "q").unionByName(inner.select("x", "p", "y", "q")).unionByName(outer.select("x", "p", "y", "q")).unionByName(close.select("x", "p", "y", "q"))
    pairs = (pairs.where("x != y") if others else pairs).distinct()
    alike = pairs.select("x", "y", F.round(name_similarity("p", "q"), 6).alias("similarity")).where(F.col("similarity") >= low)
    w = W.partitionBy("x").orderBy(F.col("similarity").desc(), "y")
    top = alike.withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    first, second = F.col("rn") == 1, F.col("rn") == 2
    best = top.groupBy("x").agg(F.max(F.when(first, F.col("y"))).alias(right_id), F.max(F.when(first, F.col("similarity"))).alias("similarity"), F.max(F.when(second, F.col("similarity"))).alias("runner_up"))
    clear = (F.col("similarity") >= least) & (F.col("runner_up").isNull() | (F.col("similarity") - F.col("runner_up") >= margin))
    return left.join(best.withColumnRenamed("x", left_id), left_id, "left").withColumn("accepted", F.coalesce(clear, F.lit(False)))


def shared_reference_chains(rows: DataFrame, node: str, reference: Sequence[str]) -> DataFrame:
    """Rows that share a reference, directly or through others; references of one row only are dropped.

    Each reference links its rows to the smallest of them, so a reference that very many rows share adds one edge
    for each, never all pairs. Returns node, chain (smallest member).
    """
    pairs = rows.where(F.coalesce(*[F.col(r).cast("string") for r in reference]).isNotNull()).select(F.col(node).alias("node"), *reference).distinct()
    low = pairs.groupBy(*reference).agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    edges = write_table(pairs.join(low, list(reference)).where("node != low").select(F.col("node").alias("u"), F.col("low").alias("v")).distinct(), "chain-edges")
    return connected_components(edges).select(F.col("node").alias(node), F.col("root").alias("chain"))


def replies(turns: DataFrame, thread: str, order: str, role: str) -> DataFrame:
    """Each turn with the last turn of the other role before it in its thread."""
    w = W.partitionBy(thread).orderBy(order)
    runs = turns.withColumn("__before", F.lag(order).over(w)).withColumn("__new", F.when(F.lag(role).over(w).eqNullSafe(F.col(role)), 0).otherwise(1))
    runs = runs.withColumn("__run", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    # what stands right before a run of one role answers to all of the run
    return runs.withColumn("answers", F.first("__before").over(W.partitionBy(thread, "__run").orderBy(order).rowsBetween(W.unboundedPreceding, 0))).drop("__before", "__new", "__run")


def cosine_top_k(rows: DataFrame, queries: DataFrame, id_col: str, vector: str, k: int, *, block: int = 2000) -> DataFrame:
    """Exact cosine neighbours of query vectors among all rows.

    Queries are counted and broadcast in blocks of about ``block``, so what is broadcast doesn't grow with them; the
    rows may be any number and are never moved: a task meets a block in matrix products over slices of its rows and
    keeps only what can be among the best k of a query, rounding and equal cosines included. A vector that is zero,
    null or not finite in length has no direction: it finds nothing and is not found. Vectors have one length.
    """
    a = queries.select(F.col(id_col).alias("query_id"), F.col(vector).cast("array<double>").alias("q")).where(F.col("query_id").isNotNull() & F.col("q").isNotNull())
    b = rows.select(F.col(id_col).alias("found_id"), F.col(vector).cast("array<double>").alias("f")).where(F.col("found_id").isNotNull() & F.col("f").isNotNull())
    blocks = max(1, -(-a.count() // block))
    kind, found_kind = a.schema["query_id"].dataType.simpleString(), b.schema["found_id"].dataType.simpleString()
    w = W.partitionBy("query_id").orderBy(F.col("cosine").desc(), "found_id")

    def best(some_queries: DataFrame) -> DataFrame:
        held = some_queries.toArrow()
        ids, units = unit_rows(held.column("query_id").combine_chunks(), held.column("q").combine_chunks())
        shared = rows.sparkSession.sparkContext.broadcast((ids, units))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, units = shared.value
            near = NearestRows(units, k + 1)  # a query may find itself
            seen = None
            for batch in batches:
                seen = batch.schema.field("found_id").type
                near.add(*unit_rows(batch.column("found_id"), batch.column("f")))
            q, found, cosine = near.result()
            if len(q):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), pa.array(found, seen), pa.array(cosine)], ["query_id", "found_id", "cosine"])

        scored = b.mapInArrow(run, f"query_id {kind}, found_id {found_kind}, cosine double").where(F.col("query_id") != F.col("found_id"))
        return scored.withColumn("cosine", F.round("cosine", 6)).withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= k)

    return reduce(DataFrame.unionByName, [best(a.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n) if blocks > 1 else a) for n in range(blocks)])
