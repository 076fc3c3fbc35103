"""Recurring series against brute force over all anchors."""

import calendar
import random
from datetime import date, timedelta
from itertools import pairwise

from provena.operators.windows import PERIODS, recurring_series


def nearest(d, family, anchor):
    if family == "week":
        at = min((d + timedelta(k) for k in range(-3, 4)), key=lambda x: (x.weekday() != anchor, x))
        return (d - at).days, (at - date(1970, 1, 5)).days // 7, at
    found = []
    for k in (-1, 0, 1):
        y, m = divmod(d.year * 12 + d.month - 1 + k, 12)
        found.append(date(y, m + 1, min(anchor, calendar.monthrange(y, m + 1)[1])))
    at = min(found, key=lambda x: (abs((d - x).days), x))
    return (d - at).days, at.year * 12 + at.month - 1, at


def brute(days):
    days = sorted(set(days))

    def cycle(family, slack):
        anchor = min(range(7) if family == "week" else range(1, 32), key=lambda a: (sum(abs(nearest(d, family, a)[0]) for d in days), a))
        kept = {}
        for d in days:
            off, unit, _ = nearest(d, family, anchor)
            if abs(off) <= slack and (unit not in kept or (abs(off), d) < kept[unit]):
                kept[unit] = (abs(off), d)
        return anchor, [(u, kept[u][1]) for u in sorted(kept)]

    def season():
        anchor, on = cycle("month", 6)
        if len(on) < 3 or len(days) - len(on) > 0.25 * len(days):
            return None
        months = {u % 12 + 1 for u, _ in on}
        starts = [m for m in months if (m - 2) % 12 + 1 not in months]
        if not 2 <= len(months) <= 11 or len(starts) != 1:
            return None
        quiet, missed, singles, crossed = 12 - len(months), 0, 0, 0
        for (a, _), (b, _) in pairwise(on):
            inside = [u % 12 + 1 in months for u in range(a + 1, b)]
            off = inside.count(False)
            if off not in (0, quiet):
                return None
            crossed += off > 0
            missed += inside.count(True)
            singles += not inside.count(True)
        if crossed == 0 or crossed < 2 and quiet < 3 or missed > max(1, len(on) // 4) or singles * 2 <= len(on) - 1:
            return None
        return "monthly", len(on), anchor, ",".join(str((starts[0] - 1 + i) % 12 + 1) for i in range(len(months)))

    for name, (nominal, slack, least) in PERIODS.items():
        per = {"weekly": 1, "monthly": 1, "quarterly": 3, "annual": 12}[name]
        anchor, on = cycle("week" if name == "weekly" else "month", slack)
        if len(on) < max(2, least) or len(days) - len(on) > 0.25 * len(days):
            continue
        fitted = []
        for (ua, a), (ub, b) in pairwise(on):
            k = int((b - a).days / nominal + 0.5)
            if k >= 1 and abs((b - a).days - k * nominal) <= slack:
                fitted.append(k)
            elif ub - ua >= per and (ub - ua) % per == 0:
                fitted.append((ub - ua) // per)
        missed = sum(k - 1 for k in fitted)
        if fitted and len(fitted) >= 0.75 * (len(on) - 1) and fitted.count(1) * 2 > len(fitted) and missed <= max(1, len(on) // 4):
            return (season() if name == "monthly" and missed else None) or (name, len(on), anchor, None)
    return season() or (None, None, None, None)


def test_series_against_brute_force(spark):
    r = random.Random(11)
    months = lambda start, n, step, day: [date(start.year + (start.month - 1 + i * step) // 12, (start.month - 1 + i * step) % 12 + 1, day) for i in range(n)]
    series = []
    for k in range(160):
        start = date(2020, r.randrange(1, 13), 1)
        kind = k % 8
        days = (
            [start + timedelta(7 * i + r.choice((-1, 0, 0, 1))) for i in range(r.randrange(3, 20))]
            if kind == 0
            else [start + timedelta(r.randrange(900)) for _ in range(r.randrange(1, 9))]
            if kind == 7
            else [d + timedelta(r.randrange(-3, 4)) for d in months(start, r.randrange(3, 20), {1: 1, 2: 3, 3: 12, 4: 1, 5: 1, 6: 1}[kind], r.choice((1, 5, 28)))]
        )
        if kind == 5:
            days = [d for d in days if d.month in (5, 6, 7, 8, 9)] + [d.replace(year=d.year + 1) for d in days if d.month in (5, 6, 7, 8, 9)]
        if kind in (4, 6):
            days = [d for d in days if r.random() < 0.9] + [start + timedelta(r.randrange(400)) for _ in range(r.randrange(0, 3))]
        series += [(k, d) for d in days]
    got = {x.k: (x.cadence, x.on_cycle, x.anchor, x.season) for x in recurring_series(spark.createDataFrame(series, "k int, day date"), "k", "day").collect()}
    want = {k: brute([d for q, d in series if q == k]) for k in {q for q, _ in series}}
    assert got == want
    assert len({w[0] for w in want.values()}) == 5 and any(w[3] for w in want.values())
