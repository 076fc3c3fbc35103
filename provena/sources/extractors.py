"""The extractor contract (K02, K07): field extractors as polymorphic table functions, called from SQL by name.

An extractor has a name, typed fields, a test whether it reads a text at all, and a reading. Registered ones are behind
two table functions for ``LATERAL`` joins:

- ``extract_fields(text, 'name')``: a row with the extractor's own columns, which ``analyze`` tells from the name;
- ``first_extraction(text, 'a', 'b', ...)``: (extractor, field, value, confidence) of the first named one that reads the
  text; the others aren't asked.

:func:`merged` puts the readings of several extractors together, best confidence first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import date
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: How the text of a field of each type is read.
_READERS = {"string": str, "bigint": int, "decimal(18,2)": lambda x: Decimal(x).quantize(Decimal("0.01")), "date": date.fromisoformat, "boolean": lambda x: True}
# types as objects: where a table function is analysed there is no session to parse their names
_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "decimal(18,2)": T.DecimalType(18, 2), "date": T.DateType(), "boolean": T.BooleanType()}
OBSERVED = T.StructType([T.StructField(n, T.StringType()) for n in ("extractor", "field", "value")] + [T.StructField("confidence", T.DoubleType())])


@dataclass(frozen=True)
class PatternExtractor:
    """Reads each field as the first group (or whole match) of its pattern; ``requires`` tells the texts that it reads.

    ``fields`` maps a name to (pattern, type); types are string, bigint, decimal(18,2), date (ISO) and boolean (found or
    not). A value that is no such thing is null.
    """

    name: str
    fields: Mapping[str, tuple[str, str]] = field(hash=False)
    requires: str = ""
    confidence: float = 0.9

    def __post_init__(self):
        for n, (pattern, kind) in self.fields.items():
            re.compile(pattern)
            if kind not in _READERS:
                raise ValueError(f"{self.name}.{n}: no type {kind}")

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(n, _TYPES[kind]) for n, (_, kind) in self.fields.items()])

    def matches(self, text: str) -> bool:
        return re.search(self.requires, text) is not None

    def read(self, text: str) -> dict:
        out = {}
        for n, (pattern, kind) in self.fields.items():
            m = re.search(pattern, text)
            value = None if m is None else m.group(1) if m.re.groups else m.group()
            try:
                out[n] = False if value is None and kind == "boolean" else None if value is None else _READERS[kind](value)
            except (ValueError, InvalidOperation):
                out[n] = None
        return out


def _constant(argument: AnalyzeArgument, known: Mapping[str, PatternExtractor]) -> PatternExtractor:
    if not argument.isConstantExpression or argument.value not in known:
        raise ValueError(f"an extractor's name is one of {', '.join(sorted(known))}, as a constant")
    return known[argument.value]


def register_extractors(spark: SparkSession, extractors: Sequence[PatternExtractor]) -> None:
    """Put extractors behind ``extract_fields`` and ``first_extraction`` in this session; names are unique."""
    known = {e.name: e for e in extractors}
    if len(known) != len(extractors):
        raise ValueError("two extractors of one name")

    class ExtractFields:
        @staticmethod
        def analyze(text: AnalyzeArgument, name: AnalyzeArgument) -> AnalyzeResult:
            return AnalyzeResult(_constant(name, known).schema())

        def eval(self, text: str, name: str) -> Iterator[tuple]:
            extractor = known[name]
            if text is not None and extractor.matches(text):
                yield tuple(extractor.read(text).values())

    class FirstExtraction:
        @staticmethod
        def analyze(text: AnalyzeArgument, *names: AnalyzeArgument) -> AnalyzeResult:
            for name in names:
                _constant(name, known)
            return AnalyzeResult(OBSERVED)

        def eval(self, text: str, *names: str) -> Iterator[tuple]:
            for name in names if text is not None else ():
                if known[name].matches(text):
                    for n, value in known[name].read(text).items():
                        if value is not None:
                            yield name, n, str(value).lower() if isinstance(value, bool) else str(value), known[name].confidence
                    return

    spark.udtf.register("extract_fields", udtf(ExtractFields))
    spark.udtf.register("first_extraction", udtf(FirstExtraction))


def merged(*readings: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, field, value, extractor, confidence, agree): of all readings (id, extractor, field, value, confidence) the best.

    The highest confidence wins, then the reading given first, then the smaller value; ``agree`` counts the extractors
    that read the same.
    """
    rows = readings[0].withColumn("__turn", F.lit(0))
    for k, r in enumerate(readings[1:], 1):
        rows = rows.unionByName(r.withColumn("__turn", F.lit(k)))
    by = rows.groupBy(id_col, "field", "value").agg(F.max_by(F.struct("extractor", "confidence", "__turn"), F.struct("confidence", -F.col("__turn"))).alias("r"), F.count_distinct("extractor").alias("agree"))
    best = W.partitionBy(id_col, "field").orderBy(F.col("r.confidence").desc(), "r.__turn", "value")
    return by.withColumn("__nth", F.row_number().over(best)).where("__nth = 1").select(id_col, "field", "value", "r.extractor", "r.confidence", "agree")
