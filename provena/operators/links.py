"""Links between rows and their evidence.

Every link is an equi-join on what must be equal, with the windows as residual conditions; rivals are counted with
windows over the pairs, so an ambiguous row is named instead of dropped.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.functions.text import fold, name_similarity
from provena.operators.matching import as_of, greedy_one_to_one
from provena.storage import write_table

#: From worst to best (fixed values).
RELATIONS = ("different", "different_name", "unclear", "unknown", "similar", "same", "same_vat")


def rank_in_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], points: str, *, margin: int = 3) -> DataFrame:
    """Each candidate's place in a full order, the best one's lead over the runner-up, and whether that is too small."""
    w = W.partitionBy(*group).orderBy(*order)
    out = rows.withColumns({"place": F.row_number().over(w).cast("bigint"), "lead": (F.first(points).over(w) - F.nth_value(points, 2).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).cast("bigint")})
    return out.withColumn("ambiguous", F.coalesce(F.col("lead") <= margin, F.lit(False)))


def per_euro_rates(rows: DataFrame, rates: DataFrame, currency: str, day: str, out: str, *, lookback: int = 7) -> DataFrame:
    """``out``, units of ``currency`` for one euro, the latest up to ``lookback`` days old.

    ``rates`` (base, quote, day, rate) may state a currency per euro or the euro per currency (its inverse is taken
    where the direct rate is missing). The euro itself is 1.
    """
    direct = rates.where("base = 'EUR'").select(F.col("quote").alias(currency), F.col("day").alias("__on"), F.col("rate").alias("__direct"))
    inverse = rates.where("quote = 'EUR'").select(F.col("base").alias(currency), F.col("day").alias("__on"), F.col("rate").alias("__inverse"))
    told = as_of(rows, direct, [currency], day, "__on", "__direct", lookback=lookback).drop("__on")
    told = as_of(told, inverse, [currency], day, "__on", "__inverse", lookback=lookback).drop("__on")
    one = F.lit(1).cast("decimal(20,10)")
    rate = F.when(F.col(currency) == "EUR", one).otherwise(F.coalesce("__direct", F.try_divide(one, F.col("__inverse")).cast("decimal(20,10)")))
    return told.withColumn(out, rate).drop("__direct", "__inverse")


def convert(rows: DataFrame, rates: DataFrame, amount: str, base: str, quote: str, day: str, out: str, *, lookback: int = 7) -> DataFrame:
    """An amount of ``base`` in ``quote``, through the euro; null where either rate is unknown."""
    told = per_euro_rates(per_euro_rates(rows, rates, base, day, "__b", lookback=lookback), rates, quote, day, "__q", lookback=lookback)
    value = F.round(F.try_divide((F.col(amount) * F.col("__q")).cast("decimal(28,12)"), F.col("__b").cast("decimal(10,6)")), 2).cast("decimal(18,2)")
    return told.withColumn(out, F.when(F.col(base) == F.col(quote), F.col(amount)).otherwise(value)).drop("__b", "__q")


def relation(pairs: DataFrame, *, similar: float = 0.86, different: float = 0.5) -> DataFrame:
    """How a payee (t_key, t_strong, t_name, t_tax) relates to an issuer (d_key, d_strong, d_name, d_tax), worst to best.

    Known keys decide: unequal ones differ, equal ones are the same if both are strong, and by tax number if that
    agrees too. Else another tax number differs, and names tell the rest.
    """
    known, strong = F.col("t_key").isNotNull() & F.col("d_key").isNotNull(), F.col("t_strong") & F.col("d_strong")
    alike = name_similarity(fold("t_name"), fold("d_name"))
    by_name = F.when(F.col("t_name").isNull() | F.col("d_name").isNull(), "unknown").when(alike >= 0.98, "same").when(alike >= similar, "similar").when(alike <= different, "different_name").otherwise("unknown")
    by_key = F.when(F.col("t_key") != F.col("d_key"), F.when(strong, "different").otherwise("different_name")).when(~strong, "similar").when(F.col("t_tax") == F.col("d_tax"), "same_vat").otherwise("same")
    other_tax = F.coalesce(F.col("t_tax") != F.col("d_tax"), F.lit(False))
    return pairs.withColumn("relation", F.when(known, by_key).when(other_tax, F.when(F.col("t_strong"), "different").otherwise("different_name")).otherwise(by_name))


def worst_relation(pairs: DataFrame, group: Sequence[str]) -> DataFrame:
    """The worst relation over a group's pairs."""
    order = F.array_position(F.array(*map(F.lit, RELATIONS)), F.col("relation"))
    return pairs.groupBy(*group).agg(F.min_by("relation", order).alias("relation"), F.count("*").alias("pairs"))


def without_rivals(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``rivals``: how many other pairs share a side with this one."""
    n = lambda c: F.count("*").over(W.partitionBy(c))
    return pairs.withColumn("rivals", n(left) + n(right) - 2)


def match_payouts(payouts: DataFrame, reports: DataFrame, *, before: int = 3, after: int = 10, tight: tuple[int, int] = (1, 4), quiet: int = 14) -> DataFrame:
    """Payouts (pay_id, provider, currency, booked_on, amount, quoted) against reports (report_id, provider, currency, paid_on, net).

    Exact amounts by quoted reference, then exact amounts by date; pairs with a rival on either side are ambiguous and
    use up all of them. Then differing amounts by a unique reference, then differing amounts alone in a tight and
    quiet window. A null provider fits any. Returns pay_id, report_id, outcome (settled, ambiguous, differs), step.
    """
    # days in blocks as long as the window: a payout's days lie in two of them at most
    block = lambda day: F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / (before + after + 1))
    spread = payouts.withColumn("block", F.explode(F.array_distinct(F.array(block(F.date_sub("booked_on", after)), block(F.date_add("booked_on", before))))))
    p, r = payouts.alias("p"), reports.withColumn("block", block(F.col("paid_on"))).alias("r")
    same = (F.col("p.currency") == F.col("r.currency")) & F.coalesce(F.col("p.provider") == F.col("r.provider"), F.lit(True)) & F.datediff("p.booked_on", "r.paid_on").between(-before, after)
    by_reference = F.coalesce(F.col("p.quoted") == F.col("r.report_id").cast("string"), F.lit(False))
    exact = spread.alias("p").join(r, (F.col("p.amount") == F.col("r.net")) & (F.col("p.currency") == F.col("r.currency")) & (F.col("p.block") == F.col("r.block"))).where(same)
    exact = write_table(exact.select("p.pay_id", "r.report_id", by_reference.alias("by_reference")).distinct(), "payouts-exact")
    quoted = p.join(r, F.col("p.quoted") == F.col("r.report_id").cast("string")).where(same).select("p.pay_id", "r.report_id").distinct()

    out: list[DataFrame] = []

    def left_over(rows: DataFrame, *ids: str) -> DataFrame:
        for done in out:
            for i in ids:
                rows = rows.join(done.select(i), i, "left_anti")
        return rows

    for step, pairs in ((1, exact.where("by_reference")), (2, exact)):
        found = without_rivals(left_over(pairs, "pay_id", "report_id"), "pay_id", "report_id")
        out.append(write_table(found.select("pay_id", "report_id", F.when(F.col("rivals") == 0, "settled").otherwise("ambiguous").alias("outcome"), F.lit(step).alias("step")), "payouts"))
    found = without_rivals(left_over(quoted, "pay_id", "report_id"), "pay_id", "report_id").where("rivals = 0")
    out.append(write_table(found.select("pay_id", "report_id", F.lit("differs").alias("outcome"), F.lit(3).alias("step")), "payouts"))
    paid = write_table(left_over(payouts, "pay_id").select("pay_id", "provider", "currency", F.col("booked_on").alias("on")).distinct(), "payouts-left")
    told = write_table(left_over(reports, "report_id").select("report_id", "provider", "currency", F.col("paid_on").alias("on")).distinct(), "reports-left")
    early, late = min(before, quiet), min(after, quiet)
    pairs = _only_partner(paid, told, "pay_id", "report_id", late, early).join(_only_partner(told, paid, "report_id", "pay_id", early, late), ["pay_id", "report_id"])
    alone = pairs.join(paid.select("pay_id", F.col("on").alias("booked_on")), "pay_id").join(told.select("report_id", F.col("on").alias("paid_on")), "report_id")
    alone = alone.where(F.datediff("booked_on", "paid_on").between(-tight[0], tight[1]))
    out.append(alone.select("pay_id", "report_id", F.lit("differs").alias("outcome"), F.lit(4).alias("step")))
    return reduce(DataFrame.unionByName, out)


def _only_partner(rows: DataFrame, others: DataFrame, row_id: str, other_id: str, back: int, ahead: int) -> DataFrame:
    """(row_id, other_id) of rows that exactly one of ``others`` fits: from ``back`` days before to ``ahead`` days after.

    Others are counted by day, and rows of one day, provider and currency ask once, so no pair is made. A null
    provider fits any: it is entered and asked for apart.
    """
    key = lambda kind, provider: F.struct(F.lit(kind).alias("kind"), provider.alias("provider"))
    nobody, provider = F.lit(None).cast(others.schema["provider"].dataType), F.col("provider")
    entered = F.when(provider.isNull(), F.array(key("any", nobody), key("none", nobody))).otherwise(F.array(key("any", nobody), key("of", provider)))
    asked = F.when(provider.isNull(), F.array(key("any", nobody))).otherwise(F.array(key("none", nobody), key("of", provider)))
    hashed = lambda rows: rows.select("currency", "on", *[c for c in rows.columns if c not in ("currency", "on", "k")], F.col("k.kind").alias("kind"), F.coalesce(F.col("k.provider").cast("string"), F.lit("")).alias("who"))
    days = hashed(others.select("currency", "on", other_id, F.explode(entered).alias("k"))).groupBy("currency", "on", "kind", "who").agg(F.count("*").alias("n"), F.min(other_id).alias(other_id))
    asks = rows.select("currency", "provider", F.col("on").alias("day")).distinct()
    spread = asks.withColumn("on", F.explode(F.sequence(F.date_sub("day", back), F.date_add("day", ahead))))
    met = hashed(spread.withColumn("k", F.explode(asked))).join(days, ["currency", "on", "kind", "who"])
    one = met.groupBy("currency", "provider", "day").agg(F.sum("n").alias("n"), F.min(other_id).alias(other_id)).where("n = 1")
    a = rows.alias("a")
    return a.join(one.alias("o"), (F.col("a.currency") == F.col("o.currency")) & F.col("a.provider").eqNullSafe(F.col("o.provider")) & (F.col("a.on") == F.col("o.day"))).select(f"a.{row_id}", f"o.{other_id}")


def check_statement(lines: DataFrame, documents: DataFrame, payments: DataFrame, *, near: int = 10, pay_near: int = 7) -> DataFrame:
    """A supplier's lines (party, row, number, on, amount, is_payment) against our documents and payments.

    By number first (another amount ``differs``), then a unique equal amount within ``near`` days unless both sides
    carry numbers, then payments of equal amount within ``pay_near`` days, each used once, nearest first until none is left to take. Returns
    party, row, outcome, ours.
    """
    bills = lines.where("NOT is_payment")
    ours = documents.select("party", F.col("number").alias("own_number"), F.col("id").alias("ours"), F.col("amount").alias("own_amount"), F.col("on").alias("own_on"))
    by_number = bills.join(ours.withColumn("number", F.col("own_number")), ["party", "number"]).select("party", "row", "ours", F.when(F.col("amount") == F.col("own_amount"), "matched").otherwise("differs").alias("outcome"))
    rest = bills.join(by_number.select("party", "row"), ["party", "row"], "left_anti")
    free = ours.join(by_number.select("ours"), "ours", "left_anti")
    pairs = rest.join(free.withColumn("amount", F.col("own_amount")), ["party", "amount"]).where((F.abs(F.datediff("on", "own_on")) <= near) & (F.col("number").isNull() | F.col("own_number").isNull()))
    by_amount = without_rivals(pairs.withColumn("line", F.struct("party", "row")), "line", "ours").where("rivals = 0").select("party", "row", "ours", F.lit("matched").alias("outcome"))
    paid = lines.where("is_payment").join(payments.select("party", "amount", F.col("id").alias("ours"), F.col("on").alias("own_on")), ["party", "amount"]).withColumn("apart", F.abs(F.datediff("on", "own_on"))).where(F.col("apart") <= pay_near)
    pairs = paid.select(F.struct("party", "row").alias("line"), "ours", "apart")
    taken = greedy_one_to_one(pairs, "line", "ours", [("apart", True)]).select("line.party", "line.row", "ours", F.lit("paid").alias("outcome"))
    found = by_number.unionByName(by_amount).unionByName(taken)
    return lines.select("party", "row").join(found, ["party", "row"], "left").withColumn("outcome", F.coalesce("outcome", F.lit("not_found")))


def quoted_partials(payments: DataFrame, documents: DataFrame) -> DataFrame:
    """Payments (pay_id, amount, keys) of less than the document (number_key, id, gross) whose number they quote, and what is left."""
    quoted = payments.select("pay_id", "amount", F.explode("keys").alias("number_key")).distinct()
    pairs = quoted.join(documents, "number_key").where((F.col("amount") > 0) & (F.col("amount") < F.col("gross")))
    alone = pairs.withColumn("n", F.count("*").over(W.partitionBy("pay_id"))).where("n = 1")
    paid = F.sum("amount").over(W.partitionBy("id").orderBy("pay_id").rowsBetween(W.unboundedPreceding, 0))
    return alone.select("pay_id", "id", "amount", (F.col("gross") - paid).cast("decimal(18,2)").alias("left"))


def instalments(payments: DataFrame, documents: DataFrame, *, lag: int = 60) -> DataFrame:
    """Payments of a party that quote one document and together are exactly its total: id, parts, first and last day."""
    pairs = payments.select("pay_id", "amount", "booked_on", F.explode("keys").alias("number_key")).distinct().join(documents, "number_key").where(F.datediff("booked_on", "issue_date").between(-7, lag))
    agg = pairs.groupBy("id", "gross").agg(F.sum("amount").alias("paid"), F.count("*").alias("parts"), F.min("booked_on").alias("first_day"), F.max("booked_on").alias("last_day"))
    return agg.where("parts >= 2 AND paid = gross").select("id", "parts", "first_day", "last_day")


def same_person(a: Column | str, b: Column | str) -> Column:
    """Every word of the shorter name (two at least) is in the longer one."""
    words = lambda x: F.array_distinct(F.filter(F.split(fold(x), "[^a-z]+"), lambda w: F.length(w) > 1))
    both = F.size(F.array_intersect(words(a), words(b)))
    least = F.least(F.size(words(a)), F.size(words(b)))
    return (least >= 2) & (both == least)


def salary_proofs(payments: DataFrame, payslips: DataFrame, *, late: int = 10) -> DataFrame:
    """Payments (pay_id, amount out, booked_on, iban, name) that a payslip (slip_id, net, month, iban, employee) proves.

    Equal net pay, booked from the month's first day to ``late`` days after its last, and the employee's account, or
    their name where no account says otherwise.
    """
    s = payslips.select("slip_id", F.col("net").alias("amount"), "month", F.col("iban").alias("own_iban"), "employee")
    pairs = payments.join(s, "amount").where((F.col("booked_on") >= F.col("month")) & (F.col("booked_on") <= F.date_add(F.last_day("month"), late)))
    by_iban = F.coalesce(F.col("iban") == F.col("own_iban"), F.lit(False))
    other = F.col("iban").isNotNull() & F.col("own_iban").isNotNull() & ~by_iban
    return pairs.withColumn("by_iban", by_iban).where(F.col("by_iban") | (~other & same_person("name", "employee"))).select("pay_id", "slip_id", "by_iban")


def unique_within(left: DataFrame, right: DataFrame, on: Sequence[str], left_id: str, right_id: str, days: Column, windows: Sequence[tuple[int, int]]) -> DataFrame:
    """Links made only where exactly one candidate fits, in the first of the windows of ``days`` that has just one.

    Several candidates leave a row open; so does a candidate that several rows want.
    """
    pairs = left.join(right, list(on)).withColumn("days", days)
    out = None
    for k, (low, high) in enumerate(windows):
        inside = pairs.where(F.col("days").between(low, high))
        alone = without_rivals(inside, left_id, right_id).where("rivals = 0").select(left_id, right_id, "days", F.lit(k + 1).alias("window"))
        out = alone if out is None else out.unionByName(alone.join(out.select(left_id), left_id, "left_anti").join(out.select(right_id), right_id, "left_anti"))
    return out


def satisfy(obligations: DataFrame, facts: DataFrame) -> DataFrame:
    """Obligations (id, amount, by, reference) against facts (reference, evidence, amount, on, green).

    The first green fact of the exact amount satisfies; else green instalments that sum to it exactly; else a green
    fact of another amount is a conflict; weaker facts leave it in doubt. Evidence listed twice counts once, and
    evidence read two ways is a conflict. Returns id, outcome (satisfied, conflict, doubt, open), parts, late, proof.
    """
    readings = facts.groupBy("reference", "evidence").agg(F.count_distinct(F.struct("amount", "on", "green")).alias("readings"), F.first("amount").alias("paid"), F.first("on").alias("on"), F.first("green").alias("green"))
    pairs = obligations.join(readings, "reference", "left")
    exact, green = F.col("paid") == F.col("amount"), F.coalesce(F.col("green"), F.lit(False))
    part = green & (F.col("paid") < F.col("amount"))
    agg = pairs.groupBy("id", "amount", "by").agg(
        F.min(F.when(exact & green, F.struct("on", "evidence"))).alias("match"),
        F.sum(F.when(part, F.col("paid"))).alias("sum_parts"),
        F.count_if(part).alias("n_parts"),
        F.max(F.when(part, F.col("on"))).alias("last_part"),
        F.bool_or(F.coalesce(F.col("readings") > 1, F.lit(False))).alias("clash"),
        F.bool_or(green & ~exact).alias("other_amount"),
        F.count("evidence").alias("n"),
    )
    whole = (F.col("n_parts") >= 2) & (F.col("sum_parts") == F.col("amount"))
    ok = ~F.col("clash") & (F.col("match").isNotNull() | whole)
    outcome = F.when(F.col("clash"), "conflict").when(F.coalesce(ok, F.lit(False)), "satisfied").when(F.col("other_amount"), "conflict").when(F.col("n") > 0, "doubt").otherwise("open")
    told = agg.withColumn("outcome", outcome)
    done = F.col("outcome") == "satisfied"
    last = F.coalesce(F.col("match.on"), F.col("last_part"))
    parts = F.when(done, F.when(F.col("match").isNotNull(), 1).otherwise(F.col("n_parts"))).cast("bigint")
    return told.select("id", "outcome", parts.alias("parts"), F.when(done, last > F.col("by")).alias("late"), F.when(done, F.col("match.evidence")).alias("proof"))


def match_replies(mails: DataFrame, threads: DataFrame) -> DataFrame:
    """Inbound mails (mail, in_reply_to, references, subject, sender_domain) and the thread they answer, and by what.

    ``threads`` (thread, message_id, token, domain) has a row for each message sent. In-Reply-To first, then References
    from the last one, then a subject token that only one thread has (the sender's domain breaks a tie); else none.
    """
    sent = threads.select("thread", "message_id").distinct()
    direct = mails.join(sent, mails["in_reply_to"] == sent["message_id"]).select("mail", "thread", F.lit("in_reply_to").alias("by"), F.lit(0).alias("n"))
    chain = mails.select("mail", F.posexplode(F.reverse("references")).alias("pos", "message_id")).join(sent, "message_id").select("mail", "thread", F.lit("references").alias("by"), (F.col("pos") + 1).alias("n"))
    first = direct.unionByName(chain).groupBy("mail").agg(F.min(F.struct("n", "thread", "by")).alias("b")).select("mail", "b.thread", "b.by")
    tokens = threads.select("thread", "token", "domain").distinct()
    said = mails.join(first.select("mail"), "mail", "left_anti").select("mail", "sender_domain", F.explode(F.array_distinct(F.regexp_extract_all("subject", F.lit(r"\[([A-Z]+-[0-9a-z]+)\]"), 1))).alias("token")).join(tokens, "token")
    own = F.coalesce(F.col("sender_domain") == F.col("domain"), F.lit(False))
    counted = said.groupBy("mail").agg(F.count_distinct("thread").alias("n"), F.min("thread").alias("one"), F.count_distinct(F.when(own, F.col("thread"))).alias("n_own"), F.min(F.when(own, F.col("thread"))).alias("own"))
    subject = counted.select("mail", F.when(F.col("n") == 1, F.col("one")).when(F.col("n_own") == 1, F.col("own")).alias("thread"), F.lit("subject").alias("by")).where("thread IS NOT NULL")
    return mails.select("mail").join(first.unionByName(subject), "mail", "left")


def weighted_votes(votes: DataFrame, subject: str, target: str, weight: str, *, least: int = 1) -> DataFrame:
    """The target with the most weight for each subject; a tie at the top, or less than ``least``, decides nothing."""
    sums = votes.groupBy(subject, target).agg(F.sum(weight).alias("weight"))
    w = W.partitionBy(subject).orderBy(F.col("weight").desc(), target)
    ranked = sums.withColumns({"rn": F.row_number().over(w), "next": F.lead("weight").over(w)}).where("rn = 1")
    clear = (F.col("weight") >= least) & (F.col("next").isNull() | (F.col("next") < F.col("weight")))
    return ranked.select(subject, F.when(clear, F.col(target)).alias(target), F.col("weight").cast("bigint").alias("weight"), (~clear).alias("ask"))


def owners(lines: DataFrame, cards: DataFrame, accounts: DataFrame) -> DataFrame:
    """Whose a bank line is: the card's owner (card_last4) before the account's; both dimensions are joined left."""
    told = lines.join(cards.withColumnRenamed("owner", "card_owner"), "card_last4", "left").join(accounts.withColumnRenamed("owner", "account_owner"), "account", "left")
    return told.withColumns({"owner": F.coalesce("card_owner", "account_owner"), "by": F.when(F.col("card_owner").isNotNull(), "card").when(F.col("account_owner").isNotNull(), "account")}).drop("card_owner", "account_owner")


def till_card_days(tills: DataFrame, terminal_lines: DataFrame) -> DataFrame:
    """A till's card takings (company, day, card) against the terminal reports' lines of that day (company, day, sales, refunds)."""
    found = terminal_lines.groupBy("company", "day").agg(F.sum(F.col("sales") - F.col("refunds")).cast("decimal(18,2)").alias("found"))
    out = tills.join(found, ["company", "day"], "left")
    status = F.when(F.col("card") == 0, "none").when(F.col("found").isNull(), "open").when(F.col("found") == F.col("card"), "matched").otherwise("differs")
    return out.withColumn("status", status)


def reimbursements(paid: DataFrame, claims: DataFrame) -> DataFrame:
    """A reimbursement (employee, pay_id, amount) of one exact claim (claim_id, amount), else of all of the employee's together."""
    one = paid.join(claims, ["employee", "amount"]).groupBy("pay_id").agg(F.min("claim_id").alias("claim_id"), F.count("*").alias("n"))
    total = claims.groupBy("employee").agg(F.sum("amount").cast("decimal(18,2)").alias("amount"), F.count("*").alias("n_all"))
    told = paid.join(one, "pay_id", "left").join(total, ["employee", "amount"], "left")
    how = F.when(F.col("n") == 1, "one").when(F.col("n") > 1, "several").when(F.col("n_all").isNotNull(), "all")
    return told.select("pay_id", "employee", how.alias("how"), F.when(how == "one", F.col("claim_id")).alias("claim_id"), F.when(how == "all", F.col("n_all")).alias("n_claims"))


def nearest_of_usual_method(series: DataFrame, payments: DataFrame, *, within: int = 45) -> DataFrame:
    """Each series' (series, party, method, around) payment nearest its day, of its usual method before any other, then by id."""
    pairs = series.join(payments.withColumnRenamed("method", "paid_by"), "party").withColumn("apart", F.abs(F.datediff("booked_on", "around")).cast("bigint")).where(F.col("apart") <= within)
    best = F.min(F.struct(F.when(F.col("paid_by") == F.col("method"), 0).otherwise(1).alias("other"), "apart", "pay_id")).alias("b")
    return pairs.groupBy("series").agg(best).select("series", "b.pay_id", F.col("b.apart").alias("days_apart"), (F.col("b.other") == 0).alias("usual_method"))
