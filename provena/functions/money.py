"""Amounts (I07, I15, I16): reading written amounts, exact splits, tax arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def amount_readings(x: Column | str) -> Column:
    """Every amount that a written number can mean, as a sorted array of DECIMAL(18,2); empty where none.

    With both marks the later one is the decimal mark. A single mark before exactly three digits can be a decimal
    or a thousands mark only if three decimals make sense; money has at most two, so it is a thousands mark. A mark
    that occurs twice separates thousands. Signs and a trailing minus, currency letters and blanks are allowed.
    """
    raw = F.regexp_replace(_col(x), r"[\s '€$£A-Za-z]", "")
    negative = raw.startswith("-") | raw.endswith("-") | (raw.startswith("(") & raw.endswith(")"))
    body = F.regexp_replace(raw, r"[-+()]", "")
    dot = F.when(body.rlike(r"^[0-9]{1,3}(,[0-9]{3})+(\.[0-9]{1,2})?$|^[0-9]+(\.[0-9]{1,2})?$"), F.replace(body, F.lit(","), F.lit("")))
    comma = F.when(body.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+(,[0-9]{1,2})?$|^[0-9]+(,[0-9]{1,2})?$"), F.translate(body, ",.", "."))
    values = F.transform(F.array_compact(F.array(dot, comma)), lambda v: v.cast("decimal(18,2)"))
    signed = F.transform(values, lambda v: F.when(negative, -v).otherwise(v).cast("decimal(18,2)"))
    return F.sort_array(F.array_distinct(signed))


def rate_fits(net: Column | str, tax: Column | str, rate: Column | str) -> Column:
    """Whether a tax amount fits its net at ``rate`` within max(0.01, 0.1 % of net)."""
    net, tax, rate = _col(net), _col(tax), _col(rate)
    slack = F.greatest(F.lit("0.01").cast("decimal(18,4)"), (F.abs(net) * F.lit("0.001").cast("decimal(5,3)")).cast("decimal(18,4)"))
    return F.abs(net * rate - tax) <= slack
