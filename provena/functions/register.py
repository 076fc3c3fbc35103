"""Functions under SQL names, so that queries written in SQL can call them.

Everything here is an expression of built-in functions, so a registered name is a SQL macro, not a Python function.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

MACROS = {
    "fold_text(x STRING) RETURNS STRING": "trim(regexp_replace(translate(lower(x), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '\\\\s+', ' '))",
    "squash_text(x STRING) RETURNS STRING": "regexp_replace(fold_text(x), '[^a-z0-9]', '')",
    "month_key(d DATE) RETURNS STRING": "date_format(d, 'yyyy-MM')",
    "month_day_distance(a INT, b INT) RETURNS INT": "least(abs(a - b), 31 - abs(a - b))",
    "signed_gross(doc_type STRING, gross DECIMAL(18,2)) RETURNS DECIMAL(18,2)": "CASE WHEN doc_type = 'credit_note' THEN -gross ELSE gross END",
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the macros as temporary functions and return their names."""
    for head, body in MACROS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    return [h.partition("(")[0] for h in MACROS]
