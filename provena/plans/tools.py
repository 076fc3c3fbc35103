"""Tools (K08): named questions with arguments, as a chat or another program calls them.

A tool is SQL with named parameters over the tables, and a JSON schema of its arguments. :func:`call` takes the arguments
as JSON, refuses what the schema doesn't allow with a reason for each fault, and binds the rest by ``spark.sql``: values
never become part of the SQL text.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.plans.bind import table


class BadArguments(ValueError):
    """Arguments that a tool's schema doesn't allow; ``reasons`` has one text for each fault."""

    def __init__(self, tool: str, reasons: list[str]):
        super().__init__(f"{tool}: " + "; ".join(reasons))
        self.reasons = reasons


@dataclass(frozen=True)
class Tool:
    """``sql`` reads ``{table}`` names of ``tables``; ``schema`` is an object schema whose properties are its parameters."""

    name: str
    answers: str
    sql: str
    tables: tuple[str, ...]
    schema: dict = field(hash=False)


TOOLS: dict[str, Tool] = {}


def tool(name: str, answers: str, sql: str, tables: tuple[str, ...], required: tuple[str, ...] = (), **properties: dict) -> None:
    """Register a tool; a property is a JSON schema of type string, integer, number, boolean or array of strings."""
    TOOLS[name] = Tool(name, answers, sql, tables, {"type": "object", "properties": properties, "required": list(required), "additionalProperties": False})


def _typed(name: str, value, rule: dict):
    """A value of a property as Spark takes it, or a reason why it isn't one."""
    kind = rule["type"]
    fits = {"string": isinstance(value, str), "integer": isinstance(value, int) and not isinstance(value, bool), "number": isinstance(value, (int, float, Decimal)) and not isinstance(value, bool), "boolean": isinstance(value, bool), "array": isinstance(value, list)}
    if not fits[kind]:
        return None, f"{name} must be of type {kind}"
    if kind == "array":
        if not all(isinstance(v, str) for v in value):
            return None, f"{name} must hold strings only"
        if len(value) > rule.get("maxItems", 1000):
            return None, f"{name} has more than {rule.get('maxItems', 1000)} items"
        return F.array(*[F.lit(v) for v in value]), None
    if "enum" in rule and value not in rule["enum"]:
        return None, f"{name} must be one of {', '.join(map(str, rule['enum']))}"
    if "minimum" in rule and value < rule["minimum"]:
        return None, f"{name} must be at least {rule['minimum']}"
    if "maximum" in rule and value > rule["maximum"]:
        return None, f"{name} must be at most {rule['maximum']}"
    if rule.get("format") == "date":
        try:
            return date.fromisoformat(value), None
        except ValueError:
            return None, f"{name} must be a date such as 2024-01-31"
    if kind == "number":
        try:
            return Decimal(str(value)), None
        except InvalidOperation:
            return None, f"{name} is no finite number"
    return value, None


def bound(name: str, arguments: str | dict) -> dict:
    """The parameters of a tool from JSON arguments; defaults fill what is left out, parameters without one are null."""
    if name not in TOOLS:
        raise BadArguments(name, [f"no such tool; there are {', '.join(sorted(TOOLS))}"])
    schema = TOOLS[name].schema
    try:
        given = json.loads(arguments, parse_float=Decimal) if isinstance(arguments, str) else arguments
    except ValueError:
        raise BadArguments(name, ["the arguments are no JSON"]) from None
    if not isinstance(given, dict):
        raise BadArguments(name, ["the arguments must be an object"])
    reasons = [f"{k} is no argument of this tool" for k in given if k not in schema["properties"]] + [f"{k} is missing" for k in schema["required"] if given.get(k) is None]
    out = {}
    for k, rule in schema["properties"].items():
        value = given.get(k, rule.get("default"))
        out[k], reason = (None, None) if value is None else _typed(k, value, rule)
        reasons += [reason] if reason else []
    if reasons:
        raise BadArguments(name, reasons)
    return out


def call(spark: SparkSession, sf_dir: str, name: str, arguments: str | dict) -> DataFrame:
    """The answer of a tool to JSON arguments; raises :class:`BadArguments`."""
    args, t = bound(name, arguments), TOOLS[name]
    return spark.sql(t.sql, args=args, **{n: table(spark, sf_dir, n) for n in t.tables})


def catalog() -> list[dict]:
    """What a caller is told: names, what they answer, and their arguments' schemas."""
    return [{"name": t.name, "answers": t.answers, "arguments": t.schema} for _, t in sorted(TOOLS.items())]


DAY = {"type": "string", "format": "date"}
tool(
    "spending",
    "Total, number and largest of orders of a period, by priority; of some customers only, if named.",
    "SELECT o_orderpriority AS label, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount FROM {orders} "
    "WHERE to_date(o_orderdate) BETWEEN coalesce(:start, DATE'1900-01-01') AND coalesce(:end, DATE'2999-12-31') AND (:customers IS NULL OR array_contains(CAST(:customers AS ARRAY<STRING>), CAST(o_custkey AS STRING))) GROUP BY o_orderpriority",
    ("orders",),
    ("start",),
    start=DAY,
    end=DAY,
    customers={"type": "array"},
)
tool(
    "largest",
    "The customers with the highest totals above an amount.",
    "SELECT concat(s.c_name, ' ', s.c_mktsegment) AS label, s.n, s.amount FROM (SELECT c_custkey, c_name, c_mktsegment, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount "
    "FROM {orders} JOIN {customer} ON o_custkey = c_custkey GROUP BY ALL) s WHERE s.amount > :above ORDER BY s.amount DESC, s.c_custkey LIMIT :most",
    ("orders", "customer"),
    above={"type": "number", "default": 0},
    most={"type": "integer", "minimum": 1, "maximum": 100, "default": 10},
)
tool(
    "documents",
    "Documents of a language whose text holds a phrase, by source.",
    "SELECT source AS label, count(*) AS n, CAST(sum(n_chars) AS DECIMAL(28,2)) AS amount FROM {documents} WHERE contains(lower(text), lower(:phrase)) AND (:lang IS NULL OR lang = :lang) GROUP BY source",
    ("documents",),
    ("phrase",),
    phrase={"type": "string"},
    lang={"type": "string", "enum": ["en", "de", "es", "fr"]},
)
