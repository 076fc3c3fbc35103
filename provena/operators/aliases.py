"""Who a row's counterparty is (D11, K05): strong keys, aliases as they were known at the time, then likeness of names.

An alias is (descriptor, party, valid_from, valid_to, learned_at, retired_at): from when to when it is true of the
world, and when we learned it and gave it up; open ends are null. A row is decided with what was known at its moment
``decided_at`` about its day ``on``, so deciding old rows again gives the same answers, whatever was learned since.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provena.operators.matching import best_names
from provena.storage import write_table

#: Ways to a party, strongest first (fixed values).
METHODS = ("iban", "tax_id", "learned", "domain", "fuzzy")
ALIASES = "descriptor string, party bigint, valid_from date, valid_to date, learned_at timestamp, retired_at timestamp"


def known_aliases(rows: DataFrame, row_id: str, descriptor: str, on: str, decided_at: str, aliases: DataFrame) -> DataFrame:
    """(row_id, party): the aliases of each row's descriptor that held on its day and were known at its moment.

    Of several the one learned last counts; parties learned at the same moment are all given, as the conflict they are.
    """
    own = rows.select(F.col(row_id).alias("__row"), F.col(descriptor).alias("descriptor"), F.col(on).alias("__on"), F.col(decided_at).alias("__at")).where("descriptor IS NOT NULL")
    held = (F.coalesce(F.col("valid_from") <= F.col("__on"), F.lit(True))) & (F.coalesce(F.col("valid_to") > F.col("__on"), F.lit(True)))
    known = (F.col("learned_at") <= F.col("__at")) & (F.coalesce(F.col("retired_at") > F.col("__at"), F.lit(True)))
    met = own.join(aliases, "descriptor").where(held & known).select("__row", "party", "learned_at")
    last = met.groupBy("__row").agg(F.max("learned_at").alias("last"))
    return met.join(last, "__row").where(F.col("learned_at") == F.col("last")).select(F.col("__row").alias(row_id), "party").distinct()


def resolve(rows: DataFrame, row_id: str, keys: Sequence[str], parties: DataFrame, aliases: DataFrame, names: DataFrame, *, descriptor: str = "descriptor", on: str = "on", decided_at: str = "decided_at", least: float = 0.86, margin: float = 0.02) -> DataFrame:
    """(row_id, party, method, conflict, candidates) of each row, in an ordered chain.

    ``keys`` are columns of strong keys, ``parties`` (kind, value, party) their owners, a kind for each key column.
    Strong keys and aliases that agree decide by the strongest of them; if they name different parties the row stays
    open (``conflict``, all ``candidates`` listed). Rows without either are compared with ``names`` (party, name), both
    folded: the most alike is taken if it is at least ``least`` alike and ``margin`` ahead of the next. Equal
    descriptors are compared once. A null key, descriptor or party tells nothing.
    """
    long = rows.select(row_id, F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k")).select(row_id, "k.kind", "k.value").where("value IS NOT NULL")
    strong = long.join(parties.where("party IS NOT NULL"), ["kind", "value"]).select(row_id, "party", "kind")
    learned = known_aliases(rows, row_id, descriptor, on, decided_at, aliases.where("party IS NOT NULL")).withColumn("kind", F.lit("learned"))
    order = F.array_position(F.array(*map(F.lit, METHODS)), F.col("kind"))
    found = strong.unionByName(learned.select(row_id, "party", "kind")).distinct()
    found = found.groupBy(row_id).agg(F.sort_array(F.collect_set("party")).alias("candidates"), F.min_by("kind", order).alias("method"))
    told = write_table(rows.select(row_id, descriptor).join(found, row_id, "left"), "resolved-keys")
    asked = told.where("candidates IS NULL").where(F.col(descriptor).isNotNull()).select(F.col(descriptor).alias("name")).distinct()
    best = best_names(asked.withColumn("asked", F.col("name")), names.select("party", F.col("name").alias("known")), "asked", "name", "party", "known", least=least, margin=margin)
    like = best.where("accepted").select(F.col("asked").alias("__like"), F.col("party").alias("__party"))
    out = told.join(like, told[descriptor].eqNullSafe(F.col("__like")) & F.col("candidates").isNull(), "left")
    alone = F.size("candidates") == 1
    party = F.when(F.col("candidates").isNull(), F.col("__party")).when(alone, F.col("candidates")[0])
    method = F.when(F.col("candidates").isNull(), F.when(F.col("__party").isNotNull(), "fuzzy").otherwise("unresolved")).when(alone, F.col("method")).otherwise("conflict")
    return out.select(row_id, party.alias("party"), method.alias("method"), (method == "conflict").alias("conflict"), F.coalesce("candidates", F.array().cast(found.schema["candidates"].dataType)).alias("candidates"))


def learn(decisions: DataFrame, aliases: DataFrame, at) -> DataFrame:
    """The alias table after a user's decisions (descriptor, party, valid_from) at a moment: what they replace is retired then, never deleted."""
    new = decisions.select("descriptor", "party", F.col("valid_from").cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), at.alias("learned_at"), F.lit(None).cast("timestamp").alias("retired_at"))
    said = decisions.select("descriptor").distinct().withColumn("__said", F.lit(True))
    old = aliases.join(said, "descriptor", "left").withColumn("retired_at", F.when(F.col("__said") & F.col("retired_at").isNull(), at).otherwise(F.col("retired_at"))).drop("__said")
    return old.select(*new.columns).unionByName(new)
