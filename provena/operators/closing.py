"""Ledger, verification and month close."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.functions.normalise import _map
from provena.operators.folds import fold_groups

#: How far each way of reading a value is trusted (fixed values), and from where it can confirm another.
METHOD_RANK = {"human": 100, "structured_xml": 90, "api": 90, "qr": 85, "bank": 85, "embedded_text": 80, "html_structured": 75, "barcode": 75, "arithmetic": 70, "vlm": 55, "ocr": 50}
HIGH_RANK, LEAST_CONFIDENCE = 70, 0.4
#: Money buckets in their order (fixed values): the first that fits takes a ledger line.
BUCKETS = ("private", "disputed", "given_back", "returned", "cash_banked", "claim_waiting", "client_money", "payout_waiting", "left_out", "not_wanted", "other_category", "other_company", "foreign", "counted")
#: Reasons why a month is open, most pressing first (fixed values).
BLOCKERS = ("no_sources", "connector", "catching_up", "needs_owner", "conflict", "obligation", "missing_documents", "unproven", "untracked", "in_progress", "month_not_over")


def union_ledger(sources: dict[str, DataFrame]) -> DataFrame:
    """One ledger of all sources' lines, each with its ``source``; a column that a source lacks is null."""
    parts = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def split_shares(lines: DataFrame, amount: str = "amount", client: str = "client_share", deposit: str = "deposit_share") -> DataFrame:
    """A line in parts: what is a client's, what is a deposit, and the rest of its own; parts of nothing are left out."""
    c, d = (F.coalesce(F.col(x), F.lit(0).cast("decimal(18,2)")) for x in (client, deposit))
    parts = F.array(F.struct(F.lit("client").alias("part"), c.cast("decimal(18,2)").alias("value")), F.struct(F.lit("deposit").alias("part"), d.cast("decimal(18,2)").alias("value")), F.struct(F.lit("own").alias("part"), (F.col(amount) - c - d).cast("decimal(18,2)").alias("value")))
    kept = F.filter(parts, lambda p: (p["value"] != 0) | ((p["part"] == "own") & (F.col(amount) == 0)))
    return lines.withColumn("__p", F.explode(kept)).withColumns({"part": F.col("__p.part"), amount: F.col("__p.value")}).drop("__p", client, deposit)


def money_bucket(*, wanted: Sequence[str], category: str | None = None, exclude: Sequence[str] = (), companies: Sequence[str] = (), currency: str = "EUR") -> Column:
    """The first bucket that fits a ledger line (private, kind, status, category, company, currency)."""
    kind, company = F.col("kind"), F.coalesce(F.col("company").isin(*companies), F.lit(False)) if companies else F.lit(True)
    other = (F.col("category") != category) if category else F.lit(False)
    if exclude:
        other = other | F.col("category").isin(*exclude)
    return (
        F.when(F.col("private"), "private")
        .when(kind.isin("disputed", "held"), "disputed")
        .when(kind == "given_back", "given_back")
        .when(kind == "returned", "returned")
        .when(kind == "cash_deposit", "cash_banked")
        .when(kind == "claim_waiting", "claim_waiting")
        .when(kind.isin("recharge", "paid_back", "client_money"), "client_money")
        .when(kind == "payout", F.when(F.col("status") == "settled", "left_out").otherwise("payout_waiting"))
        .when(kind.isin("transfer", "card_repayment", "cash_withdrawal"), "left_out")
        .when(~kind.isin(*wanted), "not_wanted")
        .when(F.coalesce(other, F.lit(False)), "other_category")
        .when(~company, "other_company")
        .when(F.col("currency") != currency, "foreign")
        .otherwise("counted")
    )


def cost_center_totals(shares: DataFrame) -> DataFrame:
    """For each cost center (line, center, share, direction, done, evidence): spent, received, open lines and distinct evidence."""
    total = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("share"))), F.lit(0)).cast("decimal(18,2)")
    return shares.groupBy("center").agg(total("out").alias("spent"), total("in").alias("received"), F.count_if(~F.col("done")).alias("open_lines"), F.count_distinct("evidence").alias("n_evidence"))


def recharge_receipts(events: DataFrame) -> DataFrame:
    """A client's costs and money in, in order (client, at, id, amount, is_cost, says_so): what each receipt pays back.

    A receipt counts only if its words say so or if it is exactly what is due, one cost, or the oldest costs together;
    with none due it is revenue. It pays the oldest costs first, but a single cost that it equals is paid itself.
    Returns client, id, paid. A fold over one client's rows in order.
    """

    def fold(group: pd.DataFrame) -> list[tuple]:
        open_, out = [], []
        for id_, amount, is_cost, says in zip(group["id"], group["amount"], group["is_cost"], group["says_so"], strict=True):
            if is_cost:
                open_.append(amount)
                continue
            due, sums, at = sum(open_, Decimal(0)), set(), Decimal(0)
            for c in open_:
                at += c
                sums.add(at)
            exact = amount in sums or amount in open_
            if due <= 0 or not (says or exact):
                continue
            if not says and amount != due and amount in open_ and amount not in sums:
                open_.remove(amount)
                out.append((id_, amount))
                continue
            left = paid = min(amount, due)
            while left > 0:
                take = min(left, open_[0])
                open_[0] -= take
                left -= take
                if not open_[0]:
                    open_.pop(0)
            out.append((id_, paid))
        return out

    kinds = dict(events.dtypes)
    return fold_groups(events, ["client"], ["at", F.col("is_cost").desc(), "id"], fold, f"id {kinds['id']}, paid decimal(18,2)")


def reconcile_rates(lines: DataFrame, parts: DataFrame) -> DataFrame:
    """Lines (doc, rate, net) against the stated totals of each rate (doc, rate, stated): sum, and whether it fits to one cent for each line."""
    sums = lines.groupBy("doc", "rate").agg(F.sum("net").cast("decimal(18,2)").alias("summed"), F.count("*").alias("lines"))
    out = parts.join(sums, ["doc", "rate"], "full")
    return out.withColumn("fits", F.coalesce(F.abs(F.col("stated") - F.col("summed")) <= F.col("lines") * F.lit("0.01").cast("decimal(4,2)"), F.lit(False)))


def order_key() -> list[Column]:
    """Observations (method, confidence, source, value) from strongest to weakest, in a total order."""
    return [F.element_at(_map([(k, F.lit(v)) for k, v in METHOD_RANK.items()]), F.col("method")).desc(), F.col("confidence").desc(), F.col("method"), F.col("source"), F.col("value")]


def channel() -> Column:
    """The way by which a value came in: one for each engine of readings (after @ in the source, else the source), else the method."""
    engine = F.when(F.col("source").contains("@"), F.substring_index("source", "@", -1)).otherwise(F.col("source"))
    return F.when(F.col("method").isin("ocr", "vlm"), F.concat_ws(":", "method", engine)).otherwise(F.col("method"))


def merge_observations(*maps: DataFrame) -> DataFrame:
    """The observations of several extractors as one set: repeats once, ranked within each document and field."""
    rows = reduce(DataFrame.unionByName, maps).distinct()
    return rows.withColumn("place", F.row_number().over(W.partitionBy("document", "field").orderBy(*order_key())))


def verify_fields(observations: DataFrame) -> DataFrame:
    """Each document's fields (document, field, value, method, source, confidence) as green, amber or red.

    Confident readings that differ are red and give no value. Green needs two agreeing readings of different channels,
    one of them high rank, and no tentative reading that differs. All else is amber. Values are compared as given, in
    their canonical form; a null value is no reading.
    """
    rank = F.element_at(_map([(k, F.lit(v)) for k, v in METHOD_RANK.items()]), F.col("method"))
    told = observations.where("value IS NOT NULL").withColumns({"rank": rank, "channel": channel(), "sure": F.col("confidence") >= LEAST_CONFIDENCE})
    sure = F.col("sure")
    agg = told.groupBy("document", "field").agg(
        F.count_distinct(F.when(sure, F.col("value"))).alias("values"),
        F.min(F.when(sure, F.col("value"))).alias("value"),
        F.count_distinct(F.when(sure, F.col("channel"))).alias("channels"),
        F.max(F.when(sure, F.col("rank"))).alias("best"),
        F.collect_set(F.when(~sure, F.col("value"))).alias("tentative"),
    )
    dissent = F.exists("tentative", lambda v: v != F.col("value"))
    quality = F.when(F.col("values") > 1, "red").when((F.col("values") == 1) & (F.col("channels") >= 2) & (F.col("best") >= HIGH_RANK) & ~dissent, "green").otherwise("amber")
    return agg.select("document", "field", quality.alias("quality"), F.when(F.col("values") == 1, F.col("value")).alias("value"), "channels")


def month_summary(activities: DataFrame, owner_time: DataFrame) -> DataFrame:
    """By entity and month: distinct subjects of each kind of activity, and the owner's minutes.

    Activities (entity, month, kind, actor, subject): retrieved documents count only where the system did it; one
    without a subject counts by itself. Owner time (entity, month, seconds) without an entity counts for every one; an entity with owner time only has its row.
    """
    alone = F.coalesce(F.col("subject").cast("string"), F.concat(F.lit("#"), F.col("id").cast("string")))
    of = lambda cond: F.count_distinct(F.when(cond, alone))
    kinds = activities.groupBy("entity", "month").agg(of((F.col("kind") == "retrieved") & (F.col("actor") == "system")).alias("retrieved"), of(F.col("kind") == "chased").alias("chased"), of(F.col("kind") == "resolved").alias("resolved"))
    own = owner_time.where("entity IS NOT NULL").groupBy("entity", "month").agg(F.sum("seconds").alias("own"))
    shared = owner_time.where("entity IS NULL").groupBy("month").agg(F.sum("seconds").alias("shared"))
    told = kinds.join(own, ["entity", "month"], "full").join(shared, "month", "left").fillna(0, ["retrieved", "chased", "resolved"])
    minutes = F.ceil((F.coalesce("own", F.lit(0)) + F.coalesce("shared", F.lit(0))) / 60).cast("bigint")
    return told.select("entity", "month", "retrieved", "chased", "resolved", minutes.alias("owner_minutes"))


def home_table(items: DataFrame) -> DataFrame:
    """By client: percent complete (floored, below 100 unless all is done), missing, needs accountant; sorted, most open first."""
    done = F.count_if(F.col("state") == "done")
    agg = items.groupBy("client").agg(done.alias("done"), F.count("*").alias("total"), F.count_if(F.col("state") == "missing").alias("missing"), F.count_if(F.col("state") == "conflict").alias("needs_accountant"))
    percent = F.when(F.col("done") == F.col("total"), 100).otherwise(F.least(F.lit(99), F.floor(F.col("done") * 100 / F.col("total"))))
    told = agg.select("client", percent.cast("bigint").alias("percent"), "missing", "needs_accountant")
    return told.orderBy(F.col("needs_accountant").desc(), F.col("missing").desc(), "client")


def latest_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """each group's row with the greatest ``order`` columns, as one aggregate (no sort)."""
    rest = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*group, "r.*")


def audit_tail(log: DataFrame, limit: int | None, *, default: int = 50, most: int = 1000) -> DataFrame:
    """The newest entries, their number clamped to 1 to ``most``."""
    n = default if limit is None else max(1, min(most, limit))
    return log.orderBy(F.col("at").desc(), F.col("id").desc()).limit(n)


def ordered_blockers(blockers: DataFrame) -> DataFrame:
    """Blockers (entity, kind, n) with their place in the fixed order of severity within the entity."""
    severity = F.array_position(F.array(*map(F.lit, BLOCKERS)), F.col("kind"))
    return blockers.withColumn("place", F.row_number().over(W.partitionBy("entity").orderBy(severity)).cast("bigint"))


def select_questions(candidates: DataFrame, *, limit: int) -> DataFrame:
    """The questions worth most, by amount x occurrences x uncertainty, one for each series; ties by id."""
    worth = (F.col("amount") * F.col("occurrences") * F.col("uncertainty")).cast("decimal(28,4)")
    scored = candidates.withColumn("worth", worth)
    best = scored.groupBy("series").agg(F.max_by(F.struct(*scored.columns), F.struct("worth", -F.col("id"))).alias("b")).select("b.*")
    return best.orderBy(F.col("worth").desc(), "id").limit(limit)


def fraud_signals(documents: DataFrame) -> DataFrame:
    """I32: the signals of each document as an array, whether one of them stops payment, and the severity.

    Documents (id, iban, known_ibans, iban_valid, twin_iban, domain_verdict, altered, text, first_payment, known_domain,
    domain, country, known_countries, recipient_matches, amount, median, mad, past, number_seen, currency, usual_currency).
    """
    amount, median = F.col("amount"), F.col("median")
    z = F.lit(0.6745) * F.abs(amount - median).cast("double") / F.nullif(F.col("mad").cast("double"), F.lit(0.0))
    unusual = (F.col("past") >= 5) & (F.abs(amount - median) >= F.abs(median) * F.lit("0.5").cast("decimal(3,2)")) & F.coalesce(z >= 3.5, F.lit(True))
    known = F.size("known_ibans") > 0
    tests = {
        "changed_iban": known & F.col("iban").isNotNull() & ~F.array_contains("known_ibans", F.col("iban")),
        "invalid_bank_details": F.col("iban").isNotNull() & ~F.col("iban_valid"),
        "duplicate_different_iban": F.col("twin_iban") != F.col("iban"),
        "lookalike_domain": F.col("domain_verdict") == "lookalike",
        "altered_document": F.col("altered"),
        "suspicious_instructions": F.lower("text").rlike("urgent|new bank details|do not call|novo iban"),
        "new_payment_recipient": F.col("first_payment") & ~known,
        "changed_email_domain": F.col("domain") != F.col("known_domain"),
        "unusual_country": (F.size("known_countries") > 0) & ~F.array_contains("known_countries", F.col("country")),
        "recipient_mismatch": ~F.col("recipient_matches"),
        "unusual_amount": unusual,
        "duplicate_invoice": F.col("number_seen"),
        "not_enough_history": F.col("past") < 3,
        "unusual_currency": F.col("currency") != F.col("usual_currency"),
    }
    signals = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), name) for name, t in tests.items()]))
    hard = F.arrays_overlap("signals", F.array(*map(F.lit, ("changed_iban", "invalid_bank_details", "duplicate_different_iban", "lookalike_domain", "altered_document"))))
    out = documents.withColumn("signals", signals).withColumn("hard_stop", hard)
    return out.withColumn("severity", F.when(F.col("hard_stop"), "high").when(F.size("signals") >= 2, "medium").when(F.size("signals") == 1, "low").otherwise("none"))


def tamper_signals(documents: DataFrame) -> DataFrame:
    """Documents whose metadata, text layer, scan and code disagree (created, modified, issued, text_total, scan_total, qr_total, print_total, producer)."""
    tests = {
        "modified_after_creation": F.col("modified") > F.date_add("created", 1),
        "created_long_after_issue": F.datediff("created", "issued") > 365,
        "created_before_issue": F.datediff("issued", "created") > 31,
        "text_differs_from_scan": F.col("text_total") != F.col("scan_total"),
        "code_differs_from_print": F.col("qr_total") != F.col("print_total"),
        "editing_software": F.lower("producer").rlike("photoshop|gimp|editor"),
    }
    return documents.withColumn("signals", F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), name) for name, t in tests.items()])))


def column_layout(boxes: DataFrame, *, gap: float = 20.0) -> DataFrame:
    """Text boxes (page, box, x0, x1, y0, y1) with their column: gaps of ``gap`` between what all boxes so far cover begin a new one."""
    w = W.partitionBy("page").orderBy("x0", "box")
    reach = F.max("x1").over(w.rowsBetween(W.unboundedPreceding, -1))
    begins = boxes.withColumn("__new", F.when(F.col("x0") - reach >= gap, 1).otherwise(0))
    return begins.withColumn("column", (F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)) + 1).cast("bigint")).drop("__new")


def field_consensus(observations: DataFrame) -> DataFrame:
    """What the readers of a field agree on: distinct voters (channels) for each value, and what decides.

    Anchors (high-rank methods) decide where all of them say the same; where they differ nothing is decided. Without
    anchors a value needs more than half of the voting channels. Consensus is never more than ``agreed``.
    """
    rank = F.element_at(_map([(k, F.lit(v)) for k, v in METHOD_RANK.items()]), F.col("method"))
    votes = observations.where("value IS NOT NULL").select("document", "field", "value", channel().alias("channel"), (rank >= HIGH_RANK).alias("anchor")).distinct()
    by_value = votes.groupBy("document", "field", "value").agg(F.count_distinct("channel").alias("voters"), F.count_if("anchor").alias("anchors"))
    agg = by_value.groupBy("document", "field").agg(F.sum("voters").alias("all"), F.max(F.struct("voters", "value")).alias("top"), F.count_if(F.col("anchors") > 0).alias("anchored"), F.max(F.when(F.col("anchors") > 0, F.col("value"))).alias("by_anchor"))
    majority = F.col("top.voters") * 2 > F.col("all")
    how = F.when(F.col("anchored") > 1, "anchors_differ").when(F.col("anchored") == 1, "anchor").when(majority, "majority").otherwise("split")
    value = F.when(F.col("anchored") == 1, F.col("by_anchor")).when((F.col("anchored") == 0) & majority, F.col("top.value"))
    return agg.select("document", "field", how.alias("how"), value.alias("value"), F.col("all").alias("voters"))


def net_vat(lines: DataFrame) -> DataFrame:
    """Tax by month and direction, credit notes negative, and advances taken off by the invoice that settles them.

    ``lines`` (month, direction, kind, vat, settles): kind is invoice, credit_note or advance; an invoice that
    ``settles`` advances states their tax there, which is not counted twice.
    """
    sign = F.when(F.col("kind") == "credit_note", -1).otherwise(1)
    own = (F.abs("vat") * sign - F.when(F.col("kind") == "invoice", F.coalesce("settles", F.lit(0))).otherwise(0)).cast("decimal(18,2)")
    agg = lines.groupBy("month").agg(F.coalesce(F.sum(F.when(F.col("direction") == "sale", own)), F.lit(0)).cast("decimal(28,2)").alias("charged"), F.coalesce(F.sum(F.when(F.col("direction") == "purchase", own)), F.lit(0)).cast("decimal(28,2)").alias("deductible"))
    return agg.withColumn("to_pay", (F.col("charged") - F.col("deductible")).cast("decimal(28,2)"))
