"""Window and sequence operators (F01-F16, J03, J13, J14): cadence, prices, balances, intervals, sessions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.functions.dates import seconds_between
from provena.operators.folds import fold_groups

#: Days between payments that count as each cadence (fixed values).
GAP_BANDS = {"weekly": (6, 8), "monthly": (26, 35), "quarterly": (84, 98), "yearly": (355, 376)}
#: Nominal days, tolerance and least payments of each recurring period (fixed values).
PERIODS = {"weekly": (7.0, 1, 4), "monthly": (30.4375, 6, 3), "quarterly": (91.3125, 12, 3), "annual": (365.25, 20, 2)}


def gaps_between(rows: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    """Each distinct day of a key after the first, with the days since the one before."""
    w = W.partitionBy(*keys).orderBy(day)
    days = rows.select(*keys, day).distinct()
    return days.withColumn("gap", F.datediff(F.col(day), F.lag(day).over(w)).cast("bigint")).where("gap IS NOT NULL")


def cadence(rows: DataFrame, keys: Sequence[str], day: str, least_days: int = 3) -> DataFrame:
    """The band that holds the median gap, if two thirds of the gaps lie in it and there are enough days."""
    gaps = gaps_between(rows, keys, day)
    agg = gaps.groupBy(*keys).agg(F.median(F.col("gap").cast("double")).alias("median_gap"), F.count("*").alias("n_gaps"), *[F.count(F.when(F.col("gap").between(lo, hi), 1)).alias(f"in_{k}") for k, (lo, hi) in GAP_BANDS.items()])
    band = F.lit(None).cast("string")
    inside = F.lit(0).cast("bigint")
    for k, (lo, hi) in reversed(GAP_BANDS.items()):
        band = F.when(F.col("median_gap").between(lo, hi), F.lit(k)).otherwise(band)
        inside = F.when(F.col("median_gap").between(lo, hi), F.col(f"in_{k}")).otherwise(inside)
    agg = agg.withColumns({"band": band, "n_inside": inside})
    regular = (F.col("n_gaps") + 1 >= least_days) & (F.col("n_inside") * 3 >= F.col("n_gaps") * 2)
    return agg.withColumn("cadence", F.when(regular, F.col("band"))).drop("band", *[f"in_{k}" for k in GAP_BANDS])


def price_jumps(purchases: DataFrame, keys: Sequence[str], price: str, order: Sequence[Column], *, window: int = 3, jump: float = 0.15) -> DataFrame:
    """The mean of the ``window`` prices before each one, and purchases at least ``jump`` above it."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(-window, -1)
    out = purchases.withColumn("usual", F.avg(F.col(price).cast("double")).over(w))
    rise = F.col(price).cast("double") / F.col("usual") - 1
    return out.where("usual > 0").withColumn("rise", rise).where(F.col("rise") >= jump)


def price_steps(rows: DataFrame, keys: Sequence[str], value: str, order: Sequence[Column], *, step: float = 0.05) -> DataFrame:
    """values that differ from the one before by ``step`` or more."""
    w = W.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("before", F.lag(value).over(w))
    change = F.col(value).cast("double") / F.col("before").cast("double") - 1
    return out.where("before > 0").withColumn("change", change).where(F.abs("change") >= step)


def price_regimes(rows: DataFrame, key: str, day: str, value: str, tie: str, *, stable: float = 0.005, change: float = 0.01) -> DataFrame:
    """runs of near-equal amounts and the last two levels.

    An amount stays in the run while it is within ``stable`` of the run's *first* amount; this fold over the rows
    of one key has no window form. Returns key, runs, level, previous, changed_on (null unless the last two levels
    differ by ``change`` or more).
    """

    def fold(group: pd.DataFrame) -> list[tuple]:
        runs: list[tuple] = []
        for d, x in zip(group[day], group[value].astype(float), strict=True):
            if not runs or abs(x - runs[-1][1]) > stable * abs(runs[-1][1]):
                runs.append((d, x))
        last, before = runs[-1], runs[-2] if len(runs) > 1 else None
        moved = before is not None and before[1] != 0 and abs(last[1] / before[1] - 1) >= change
        return [(len(runs), last[1], before[1] if before else None, last[0] if moved else None)]

    return fold_groups(rows.select(key, day, value, tie), [key], [day, tie], fold, f"runs bigint, level double, previous double, changed_on {dict(rows.dtypes)[day]}")


def _anchored(day: Column, family: Column, anchor: Column) -> Column:
    """struct(off, unit, at): days from the nearest anchor day (the earlier on a tie), its week or month, and that day.

    ``family`` is ``week`` (anchor 0 to 6, from Monday) or ``month`` (anchor 1 to 31, cut to the month's length).
    """
    back = F.pmod(anchor - F.weekday(day) + 3, F.lit(7)) - 3
    week = F.date_add(day, back)

    def in_month(k: int) -> Column:
        first = F.add_months(F.trunc(day, "month"), k)
        at = F.least(F.date_add(first, anchor - 1), F.last_day(first))
        return F.struct(F.abs(F.datediff(day, at)).alias("far"), at.alias("at"))

    at = F.when(family == "week", week).otherwise(F.array_min(F.array(*[in_month(k) for k in (-1, 0, 1)]))["at"])
    unit = F.when(family == "week", F.floor(F.datediff(week, F.lit("1970-01-05").cast("date")) / 7).cast("int")).otherwise(F.year(at) * 12 + F.month(at) - 1)
    return F.struct(F.datediff(day, at).alias("off"), unit.alias("unit"), at.alias("at"))


def recurring_series(rows: DataFrame, key: str, day: str, *, fit: float = 0.75, extras: float = 0.25) -> DataFrame:
    """the rhythm that a key's distinct days follow, the shortest that fits.

    Every weekday and every day of the month is tried as anchor against all days; the one nearest to them in total is
    taken. A day within a period's tolerance of it is on the cycle, one for each period; the others are extras, of
    which there may be ``extras`` of all. Of the gaps between days on the cycle, ``fit`` or more must be whole periods,
    most of them one, with a period in four skipped at most. Where months are skipped, or no rhythm fits, a season is
    tried: days in one unbroken stretch of months, quiet for the whole rest of every year (once if that is three
    months or more, else twice).

    Returns key, cadence, n (days), on_cycle, share (of gaps that fit), anchor, season (months, joined by commas),
    last_seen, next_expected; a key without a rhythm has nulls. Days are dealt by key once. An anchor is one sum over the
    key's days, made in the aggregate that also lists them; all the rest is expressions over that list (one date for each
    distinct day), so that no task holds or sorts more than days and one row for each key.
    """
    days = rows.select(key, F.col(day).alias("day")).distinct().repartition(key)
    # how far each anchor is from a day follows from a few small numbers of the day: one sum for each anchor, no row
    wd, d = F.weekday("day"), F.dayofmonth("day")
    l0, l1, l2 = (F.dayofmonth(F.last_day(F.add_months(F.trunc("day", "month"), k))) for k in (-1, 0, 1))
    in_week = lambda a: F.abs(F.pmod(F.lit(a + 3) - wd, F.lit(7)) - 3)
    cut = lambda a, m: F.least(F.lit(a), m)
    in_month = lambda a: F.least(F.abs(d - cut(a, l1)), d + l0 - cut(a, l0), l1 - d + cut(a, l2))
    families = {"week": [(a, in_week(a)) for a in range(7)], "month": [(a, in_month(a)) for a in range(1, 32)]}
    sums = [F.sum(off).alias(f"{family}{a}") for family, tries in families.items() for a, off in tries]
    least = lambda family: F.array_min(F.array(*[F.struct(F.col(f"{family}{a}").alias("cost"), F.lit(a).alias("anchor")) for a, _ in families[family]]))["anchor"]
    of_key = days.groupBy(key).agg(F.count("*").alias("n"), F.max("day").alias("last_seen"), F.collect_list("day").alias("days"), *sums)
    # rows without a key follow no rhythm
    listed = F.when(F.col(key).isNotNull(), F.sort_array("days")).otherwise(F.array().cast(of_key.schema["days"].dataType))
    out = of_key.select(key, "n", "last_seen", listed.alias("days"), *[least(f).alias(f"{f}_anchor") for f in families])

    def told(family: str) -> Column:
        at = F.transform("days", lambda x: F.struct(x.alias("day"), _anchored(x, F.lit(family), F.col(f"{family}_anchor")).alias("a")))
        return F.transform(at, lambda x: F.struct(x["a"]["unit"].alias("unit"), F.abs(x["a"]["off"]).alias("far"), x["day"].alias("day"), x["a"]["at"].alias("at")))

    out = out.withColumns({f"{f}_told": told(f) for f in families}).drop("days")
    family = {c: "week" if c == "weekly" else "month" for c in PERIODS}
    steps = {"weekly": 1, "monthly": 1, "quarterly": 3, "annual": 12}
    # each unit's nearest day is the first of it in order; a day's unit never falls from one day to the next
    near = lambda c: F.sort_array(F.filter(f"{family[c]}_told", lambda x: x["far"] <= PERIODS[c][1]))
    before = lambda c, i: F.get(f"{c}_days", i - 1)
    out = out.withColumns({f"{c}_days": near(c) for c in PERIODS}).drop("week_told", "month_told")
    first = lambda c: F.filter(f"{c}_days", lambda x, i: (i == 0) | (before(c, i)["unit"] != x["unit"]))
    out = out.withColumns({f"{c}_days": first(c) for c in PERIODS})

    def periods(c: str) -> Column:
        nominal, slack, _ = PERIODS[c]

        def of_gap(x: Column, i: Column) -> Column:
            gap, units = F.datediff(x["day"], before(c, i)["day"]), x["unit"] - before(c, i)["unit"]
            whole = F.round(gap / nominal).cast("int")
            by_days = (whole >= 1) & (F.abs(gap - whole * nominal) <= slack)
            return F.when(by_days, whole).when((units >= steps[c]) & (units % steps[c] == 0), (units / steps[c]).cast("int"))

        return F.filter(F.transform(f"{c}_days", of_gap), lambda x: x.isNotNull())

    apart = F.transform("monthly_days", lambda x, i: F.struct(before("monthly", i)["unit"].alias("before"), x["unit"].alias("unit")))
    out = out.withColumns({f"{c}_periods": periods(c) for c in PERIODS})
    out = out.withColumns({"pairs": F.filter(apart, lambda p: p["before"].isNotNull()), "months": F.sort_array(F.array_distinct(F.transform("monthly_days", lambda x: x["unit"] % 12 + 1)))})
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    starts = F.filter("months", lambda m: ~F.array_contains("months", (m + 10) % 12 + 1))
    one = F.size("months").between(2, 11) & (F.size(starts) == 1)
    season = F.when(one, F.transform(F.sequence(F.lit(0), F.size("months") - 1), lambda i: (starts[0] - 1 + i) % 12 + 1))
    between = F.transform("pairs", lambda p: F.when(p["unit"] - p["before"] > 1, F.sequence(p["before"] + 1, p["unit"] - 1)).otherwise(F.array().cast("array<int>")))
    outside = F.transform(between, lambda ms: F.size(F.filter(ms, lambda m: ~F.array_contains(F.col("months"), m % 12 + 1))))
    inside = F.transform(between, lambda ms: F.size(F.filter(ms, lambda m: F.array_contains(F.col("months"), m % 12 + 1))))
    out = out.withColumns({"off": outside, "skipped": inside})
    quiet = 12 - F.size("months")
    crossings = F.size(F.filter("off", lambda x: x > 0))
    rhythm = one & F.forall("off", lambda x: (x == 0) | (x == quiet)) & ((crossings >= 2) | (crossings == 1) & (quiet >= 3))

    def judged(order: int, c: str) -> Column:
        """Rank and figures of a period that the key's days follow, else null."""
        on_cycle, fitted = F.size(f"{c}_days"), F.size(f"{c}_periods")
        budget, few = F.greatest(F.lit(1), F.floor(on_cycle / 4)), F.col("n") - on_cycle <= F.col("n") * extras
        share, missed = F.when(on_cycle > 1, fitted / (on_cycle - 1)), total(f"{c}_periods") - fitted
        singles = F.size(F.filter(f"{c}_periods", lambda x: x == 1))
        fits = (on_cycle >= max(PERIODS[c][2], 2)) & few & (fitted > 0) & (share >= fit) & (singles * 2 > fitted) & (missed <= budget)
        steady = (total("skipped") <= budget) & (F.size(F.filter("skipped", lambda x: x == 0)) * 2 > F.size("pairs"))
        seasonal = (on_cycle >= PERIODS[c][2]) & few & rhythm & steady if c == "monthly" else F.lit(False)
        # a monthly series that skips months is seasonal if it can be; a season without a rhythm comes after all rhythms
        fits, seasonal = F.coalesce(fits, F.lit(False)), F.coalesce(seasonal, F.lit(False))
        as_season = seasonal & (~fits | (missed > 0))
        figures = {
            "rank": F.when(fits, F.lit(order)).otherwise(9),
            "cadence": F.lit(c),
            "on_cycle": on_cycle.cast("bigint"),
            "share": F.when(as_season, 1.0).otherwise(share),
            "anchor": F.col(f"{family[c]}_anchor"),
            "season": F.when(as_season, F.array_join(season, ",")),
            "last": F.get(f"{c}_days", on_cycle - 1)["at"],
            "as_season": as_season,
        }
        return F.when(fits | seasonal, F.struct(*[x.alias(name) for name, x in figures.items()]))

    out = out.withColumn("w", F.array_min(F.array(*[judged(k, c) for k, c in enumerate(PERIODS)]))).select(key, "n", "last_seen", "months", "w.*")
    month = lambda k: F.least(F.date_add(F.add_months(F.trunc("last", "month"), k), F.col("anchor") - 1), F.last_day(F.add_months(F.trunc("last", "month"), k)))
    in_season = F.array_min(F.filter(F.array(*[month(k) for k in range(1, 13)]), lambda x: F.array_contains("months", F.month(x))))
    ahead = F.when(F.col("as_season"), in_season).when(F.col("cadence") == "weekly", F.date_add("last", 7)).when(F.col("cadence") == "monthly", month(1)).when(F.col("cadence") == "quarterly", month(3)).otherwise(month(12))
    return out.select(key, "cadence", "n", "on_cycle", "share", "anchor", "season", "last_seen", ahead.alias("next_expected"))


def next_expected(last_seen: Column, months: Column, today: Column) -> Column:
    """the first step of whole months after ``last_seen`` that is not before ``today``.

    Steps are counted from the anchor, so a month without its day does not move later ones.
    """
    behind = F.floor(F.months_between(F.last_day(today), last_seen) / months).cast("int")
    steps = F.sequence(F.greatest(behind - 1, F.lit(1)), F.greatest(behind + 2, F.lit(3)))
    days = F.transform(steps, lambda k: F.add_months(last_seen, (k * months).cast("int")))
    return F.array_min(F.filter(days, lambda d: d >= today))


def next_in_season(last_seen: Column, season: Column, today: Column, *, years: int = 3) -> Column:
    """the first day from ``today`` on, in whole months after ``last_seen``, that lies in a season (array of month numbers).

    Months out of season are stepped over; a month without the anchor's day has its last day. Null for an empty season,
    and where a gap of more than ``years`` years lies between.
    """
    start = F.greatest(F.floor(F.months_between(today, last_seen)).cast("int") - 1, F.lit(1))
    days = F.transform(F.sequence(start, start + 12 * years), lambda k: F.add_months(last_seen, k))
    return F.array_min(F.filter(days, lambda d: (d >= today) & F.array_contains(season, F.month(d))))


def reset_balance(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], amount: Column, counted: Column) -> DataFrame:
    """A running balance that a count replaces; rows before any count run from 0."""
    w = W.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("__run", F.count(F.when(counted, 1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    within = W.partitionBy(*keys, "__run").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return out.withColumn("balance", F.sum(amount).over(within).cast("decimal(28,2)")).drop("__run")


def running_balance(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], amount: str) -> DataFrame:
    """F16: the sum of a key's amounts up to each row."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("balance", F.sum(amount).over(w).cast("decimal(28,2)"))


def day_windows(rows: DataFrame, key: str, day: str, amount: str, *, longest: int = 7) -> DataFrame:
    """Sums of every run of up to ``longest`` consecutive days with rows, from daily totals.

    Returns key, first_day, last_day, n_days (days with rows) and amount. Runs come from the running total of days:
    a day meets at most ``longest`` earlier ones, never all of them.
    """
    daily = rows.groupBy(key, day).agg(F.sum(amount).cast("decimal(28,2)").alias("total"))
    w = W.partitionBy(key).orderBy(day)
    cum = daily.withColumns({"cum": F.sum("total").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("decimal(28,2)"), "rn": F.row_number().over(w).cast("bigint")})
    ahead = F.explode(F.sequence(F.lit(0), F.lit(longest - 1)))
    begin = cum.select(key, F.col(day).alias("first_day"), (F.col("cum") - F.col("total")).alias("base"), F.col("rn").alias("rn0"), ahead.alias("k")).withColumn("rn", F.col("rn0") + F.col("k"))
    return begin.join(cum.select(key, "rn", F.col(day).alias("last_day"), "cum"), [key, "rn"]).select(key, "first_day", "last_day", (F.col("k") + 1).cast("bigint").alias("n_days"), (F.col("cum") - F.col("base")).cast("decimal(28,2)").alias("amount"))


def day_window_matches(rows: DataFrame, targets: DataFrame, key: str, day: str, amount: str, target_id: str, *, lookback: int = 62) -> DataFrame:
    """For each target every run of consecutive days with rows, however long, that sums exactly to it.

    ``targets`` (target_id, key, day, amount); a run begins at most ``lookback`` days before its target and ends on
    the target's day at the latest. Runs come from one window over a key's daily totals, at most ``lookback`` + 1 for
    each day with rows however many targets there are, and meet targets by equal sums. Nothing is broadcast: tables
    that look small in a shuffle are large in the driver's memory.
    Returns target_id, key, day, amount, first_day, last_day, n_days (days with rows) and ``ambiguous`` (more than
    one run); a target without a run has one row with nulls.
    """
    daily = rows.where(F.col(day).isNotNull()).groupBy(key, day).agg(F.sum(amount).cast("decimal(28,2)").alias("total"))
    w = W.partitionBy(key).orderBy(F.datediff(day, F.lit("1970-01-01").cast("date")))
    cum = daily.withColumn("cum", F.sum("total").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("decimal(28,2)"))
    ahead = F.collect_list(F.struct(F.col(day).alias("last_day"), "cum")).over(w.rangeBetween(0, lookback))
    begun = cum.select(key, F.col(day).alias("first_day"), (F.col("cum") - F.col("total")).alias("base"), ahead.alias("ahead"))
    runs = begun.select(key, "first_day", "base", F.posexplode("ahead").alias("nth", "e")).select(key, "first_day", "e.last_day", (F.col("nth") + 1).cast("bigint").alias("n_days"), (F.col("e.cum") - F.col("base")).cast("decimal(28,2)").alias("goal"))
    asked = targets.select(target_id, key, F.col(day).alias("until"), F.col(amount).cast("decimal(28,2)").alias("goal"))
    hits = asked.hint("merge").join(runs.hint("merge"), [key, "goal"]).where((F.col("last_day") <= F.col("until")) & (F.col("first_day") >= F.date_sub("until", lookback)))
    found = hits.select(target_id, "first_day", "last_day", "n_days", (F.count("*").over(W.partitionBy(target_id)) > 1).alias("ambiguous"))
    return targets.select(target_id, key, day, amount).hint("merge").join(found.hint("merge"), target_id, "left")


def merge_intervals(rows: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """The union of overlapping or touching intervals of each key, with how many went into each."""
    w = W.partitionBy(*keys).orderBy(F.col(start).asc_nulls_last(), F.col(end).asc_nulls_last())
    reach = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    islands = rows.withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn("__island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("__island")


def gaps_of(islands: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """What lies between consecutive merged intervals of a key."""
    w = W.partitionBy(*keys).orderBy(start)
    nxt = islands.withColumn("gap_end", F.lead(start).over(w)).where("gap_end IS NOT NULL")
    return nxt.select(*keys, F.col(end).alias("gap_start"), "gap_end")


def sessions(events: DataFrame, user: str, ts: str, *, minutes: int = 30) -> DataFrame:
    """Activity with pauses of at most ``minutes``; length in whole minutes, rounded up.

    A pause of exactly the limit begins a new session, as ``session_window`` does it.
    """
    w = W.partitionBy(user).orderBy(ts)
    pause = seconds_between(F.lag(ts).over(w), F.col(ts))
    marked = events.withColumn("__n", F.sum(F.when(pause.isNull() | (pause >= minutes * 60), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    agg = marked.groupBy(user, "__n").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_events"))
    return agg.withColumn("active_minutes", F.ceil(seconds_between(F.col("started"), F.col("ended")) / 60).cast("bigint")).drop("__n")


def sliding_counts(events: DataFrame, keys: Sequence[str], ts: str, *, length: str = "15 minutes", slide: str = "1 minute") -> DataFrame:
    """Events of each key in sliding windows."""
    return events.groupBy(F.window(ts, length, slide), *keys).agg(F.count("*").alias("attempts")).select(*keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "attempts")


def transitions(events: DataFrame, key: str, state: str, order: Sequence[Column]) -> DataFrame:
    """each row's state with the one before it."""
    w = W.partitionBy(key).orderBy(*order)
    return events.withColumn("from_state", F.lag(state).over(w)).withColumnRenamed(state, "to_state")
