"""Scores of payment and document pairs with all their factors (D07, D08, D09): amounts, currencies, dates, identity.

A pair is a row. Amounts are signed by the direction of the money, so a payment out meets an invoice as two negative
numbers. Every factor is an expression over the row; a column that a table lacks tells nothing. Scoring moves no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.operators.matching import near_tolerance

#: Points of each factor (fixed values).
POINTS = {
    "amount_exact": 40,
    "amount_near": (20, 12, 6),
    "amount_partial": 15,
    "currency": 5,
    "relation": {"same_vat": 20, "same": 15, "similar": 8, "different_name": -15, "different": -40},
    "invoice_number": 25,
    "payment_reference": 25,
    "identifiers_most": 30,
    "bank_details": (15, -10),
    "card": (5, -5),
    "dates": ((3, 10), (7, 8), (14, 6), (31, 4)),
    "dates_in_window": 3,
    "due_date": 4,
    "history": 5,
}
#: Days before and after a document in which a payment may lie, days before it for a deposit, days around its due date (fixed values).
LEAD, LAG, DEPOSIT, DUE = 7, 60, 120, 2
#: The share by which a converted amount may differ from the reference rate's; points for a sure and a plausible pair (fixed values).
FX_TOLERANCE, SURE, PLAUSIBLE = "0.03", 70, 45
_CENT = "0.01"
_WIDE = "decimal(30,10)"
#: The columns of a pair and their types; those not given are null.
COLUMNS = {
    "paid": "decimal(18,2)", "paid_currency": "string", "fee": "decimal(18,2)", "paid_on": "date",
    "due": "decimal(18,2)", "due_currency": "string", "issued_on": "date", "due_on": "date",
    "original": "decimal(18,2)", "original_currency": "string", "stated_rate": "decimal(20,10)", "stated_in_text": "boolean", "conversion_fee": "decimal(18,2)", "reference_rate": "decimal(20,10)",
    "relation": "string", "number_quoted": "boolean", "reference_quoted": "boolean", "same_iban": "boolean", "same_card": "boolean", "fits_history": "boolean", "deposit": "boolean", "document_quality": "string",
}


def _dec(x: str) -> Column:
    return F.lit(x).cast("decimal(18,2)")


def _same_currency(covered: Column, due: Column, adjusted: Column) -> Column:
    """A covered amount against the document's in one currency."""
    gap = F.abs(covered - due)
    return (
        F.when((F.signum(covered) != F.signum(due)) | (due == 0), "mismatch")
        .when(gap == 0, F.when(adjusted, "adjusted").otherwise("exact"))
        .when(gap <= near_tolerance(due), "near")
        .when(F.abs(covered) < F.abs(due), "partial")
        .otherwise("mismatch")
    )


def with_amounts(pairs: DataFrame) -> DataFrame:
    """``status`` (exact, adjusted, near, partial, mismatch), ``covered`` in the document's currency, ``cost`` of conversion.

    In one currency a declared bank fee is added back. Where the bank states the original amount in the document's
    currency, that is compared; if it is equal, the booked money must follow from a stated rate to the cent (either
    way round, if the rate was read from text), or be within ``FX_TOLERANCE`` of the reference rate, else it is
    near at most. With a reference rate only, a pair is near within that tolerance. Anything else is a mismatch.
    """
    c = {n: F.col(n) for n in COLUMNS}
    fee = F.coalesce(c["fee"], _dec("0"))
    fees = fee + F.coalesce(c["conversion_fee"], _dec("0"))
    one = c["paid_currency"] == c["due_currency"]
    declared = ~one & (c["original_currency"] == c["due_currency"]) & c["original"].isNotNull()
    plain = c["paid"] + fee
    covered = F.when(one, plain).when(declared, F.signum(c["paid"]).cast("int") * c["original"])
    status = _same_currency(covered, c["due"], F.when(one, fee != 0).otherwise(True))
    # what a stated rate leaves unexplained of the booked money
    said = F.round(c["original"] * c["stated_rate"], 2)
    back = F.round((c["original"] / c["stated_rate"]).cast(_WIDE), 2)
    left = lambda expected: F.abs(c["paid"] + fees - F.signum(c["paid"]).cast("int") * expected)
    unexplained = F.when(F.coalesce(c["stated_in_text"], F.lit(False)), F.least(left(said), left(back))).otherwise(left(said))
    expected = (F.abs(c["due"]) * c["reference_rate"]).cast(_WIDE)
    # positive where the business is worse off than by the reference rate
    cost = F.round(F.signum(c["paid"]).cast("int") * expected - (c["paid"] + fees), 2).cast("decimal(18,2)")
    within = F.abs(cost) <= expected * F.lit(FX_TOLERANCE).cast("decimal(4,2)")
    unproved = F.coalesce(c["stated_in_text"], F.lit(False)) & c["stated_rate"].isNull()
    close = unexplained <= F.abs(c["paid"]) * F.lit(FX_TOLERANCE).cast("decimal(4,2)")
    verified = (
        F.when(c["stated_rate"].isNotNull(), F.when(unexplained <= _dec(_CENT), "adjusted").when(close, "near").otherwise("mismatch"))
        .when(c["reference_rate"].isNull(), F.when(unproved, "near").otherwise("adjusted"))
        .when(unproved, F.when(within, "near").otherwise("mismatch"))
        .otherwise(F.when(within, "adjusted").otherwise("near"))
    )
    by_reference = F.when(within & (F.signum(c["paid"] + fee) == F.signum(c["due"])), "near").otherwise("mismatch")
    told = F.when(one, status).when(declared, F.when(status == "adjusted", verified).otherwise(status)).when(c["reference_rate"].isNotNull(), by_reference)
    told = F.when(c["due"] == 0, "mismatch").otherwise(F.coalesce(told, F.lit("mismatch")))
    bridged = ~one & ~F.coalesce(declared, F.lit(False)) & c["reference_rate"].isNotNull()
    out = pairs.withColumns({"status": told, "declared": F.coalesce(declared, F.lit(False))})
    covered = F.when(bridged, F.when(F.col("status") == "near", c["due"]).otherwise(0)).otherwise(F.coalesce(covered, _dec("0")))
    shown = ~one & c["reference_rate"].isNotNull() & (bridged | (status == "adjusted") & c["stated_rate"].isNull())
    return out.withColumns({"covered": covered.cast("decimal(18,2)"), "cost": F.when(shown, cost)})


def _near_points() -> Column:
    """Full points within a quarter of the tolerance; a pure conversion gap within half of its own."""
    best, middle, low = POINTS["amount_near"]
    gap, most = F.abs(F.col("covered") - F.col("due")), near_tolerance(F.col("due"))
    by_rate = F.when(F.abs("cost") * 2 <= F.abs("paid") * F.lit(FX_TOLERANCE).cast("decimal(4,2)"), best).otherwise(middle)
    return F.when((gap == 0) & F.col("cost").isNotNull(), by_rate).otherwise(F.when(gap * 4 <= most, best).when(gap * 2 <= most, middle).otherwise(low))


def score_in_full(pairs: DataFrame) -> DataFrame:
    """Amounts, ``factors`` (name, points), ``points`` (0 to 100), ``rejection`` or null, and ``grade``.

    A pair is rejected whose amounts differ, that pays a part without a quoted number or reference, whose supplier is
    another, or that lies outside the date window without a quote. Red: the bank details disagree or the document is
    red itself. Green: ``SURE`` points, an exact amount, a sure identity, a green document, and nothing against it.
    """
    rows = with_amounts(pairs.withColumns({n: F.lit(None).cast(kind) for n, kind in COLUMNS.items() if n not in pairs.columns}))
    yes = lambda n: F.coalesce(F.col(n), F.lit(False))
    p = POINTS
    status = F.col("status")
    amount = F.when(status.isin("exact", "adjusted"), p["amount_exact"]).when(status == "near", _near_points()).when(status == "partial", p["amount_partial"]).otherwise(0)
    day = F.coalesce("issued_on", "due_on")
    days = F.datediff("paid_on", day)
    inside = F.coalesce(days.between(F.when(yes("deposit"), -DEPOSIT).otherwise(-LEAD), F.lit(LAG)), F.lit(True))
    dates = F.lit(p["dates_in_window"])
    for most, points in reversed(p["dates"]):
        dates = F.when(F.abs(days) <= most, points).otherwise(dates)
    relation = F.coalesce("relation", F.lit("unknown"))
    supplier = F.lit(0)
    for name, points in p["relation"].items():
        supplier = F.when(relation == name, points).otherwise(supplier)
    number = F.when(yes("number_quoted"), p["invoice_number"]).otherwise(0)
    reference = F.when(yes("reference_quoted"), F.least(F.lit(p["payment_reference"]), p["identifiers_most"] - number)).otherwise(0)
    either = lambda n: F.when(F.col(n), p["bank_details" if n == "same_iban" else "card"][0]).when(~F.col(n), p["bank_details" if n == "same_iban" else "card"][1]).otherwise(0)
    factors = {
        "amount": amount,
        "currency": F.when(status != "mismatch", p["currency"]).otherwise(0),
        "dates": F.when(days.isNull() | ~inside, 0).otherwise(dates),
        "due_date": F.when(F.abs(F.datediff("paid_on", "due_on")) <= DUE, p["due_date"]).otherwise(0),
        "supplier": supplier,
        "invoice_number": number,
        "payment_reference": reference,
        "bank_details": either("same_iban"),
        "card": either("same_card"),
        "history": F.when(yes("fits_history"), p["history"]).otherwise(0),
    }
    quoted = yes("number_quoted") | yes("reference_quoted")
    listed = F.array(*[F.struct(F.lit(n).alias("factor"), F.coalesce(f, F.lit(0)).cast("int").alias("points")) for n, f in factors.items()])
    rows = rows.withColumns({"days": days, "factors": F.filter(listed, lambda f: f["points"] != 0)})
    points = F.greatest(F.lit(0), F.least(F.lit(100), F.aggregate("factors", F.lit(0), lambda a, f: a + f["points"])))
    rejection = F.when(status == "mismatch", "amounts differ").when((status == "partial") & ~quoted, "partial payment without a reference").when(relation == "different", "different supplier").when(~inside & ~quoted, "outside the date window")
    rows = rows.withColumns({"points": points, "rejection": rejection})
    known = relation.isin("same", "same_vat") | quoted | yes("same_iban")
    quality = F.coalesce("document_quality", F.lit("green"))
    red = (quality == "red") | F.coalesce(~F.col("same_iban"), F.lit(False))
    against = ~inside | F.coalesce(~F.col("same_card"), F.lit(False)) | relation.isin("different", "different_name", "unclear")
    green = F.col("rejection").isNull() & (F.col("points") >= SURE) & known & status.isin("exact", "adjusted") & (quality == "green") & ~against
    return rows.withColumn("grade", F.when(red, "red").when(green, "green").otherwise("amber")).withColumn("plausible", F.col("rejection").isNull() & (F.col("points") >= PLAUSIBLE))
