"""Operator 5 [native]: temperature mixing of sources to target weights.

Source token shares p become weights p**a / sum(p**a). The exponent a is found by bisection: the largest one whose
weights have the target entropy (smaller exponents are flatter), raised again if some source would repeat more
often than the limit. Every round of the search is one small aggregate over the table of sources that evaluates
the exponents at which five bisection steps could arrive.

The weights are then realised: a source gets a budget of tokens, as whole epochs over all its documents and a last
part of one. An epoch is a permutation of the source's documents by a seeded hash, dealt into blocks of about
``block_rows``; the part takes documents in that order while their running tokens fit. Blocks are summed first, and
only the one block in which a source's budget ends is ordered: where it ends is one row for each source, against which
every document is held without being moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provena.llm.common import join_sized, without, write_table

WORD = r"[^\x20\x09-\x0D]+"
OUTPUTS = ("tokens", "epoch", "block", "shuffle_key")
#: A budget this close to whole epochs, as a share of one epoch, is those epochs: rounding must not cost a document.
WHOLE = 1e-6
#: Columns that a draw makes for itself.
_OWN = ("__of", "__id", "__hash", "__full", "__rest", "__blocks", "__last", "__end", "__u", "__b", "__epochs", "__source")
_STEPS = 32
_ROUNDS = 5


def _moments(sources: DataFrame, exponents: list[float], ratio: float) -> list:
    """For each exponent: the weights' entropy and the most epochs that a source would get."""
    x = F.explode(F.array(*[F.lit(float(e)) for e in exponents])).alias("a")
    rows = sources.where("share > 0").select("share", x).groupBy("a").agg(F.sum(F.pow("share", F.col("a"))).alias("z"), F.sum(F.pow("share", F.col("a")) * F.log("share")).alias("s"), F.max(F.pow("share", F.col("a") - 1)).alias("m"))
    return rows.select("a", (F.log("z") - F.col("a") * F.col("s") / F.col("z")).alias("entropy"), (F.lit(ratio) * F.col("m") / F.col("z")).alias("epochs")).orderBy("a").collect()


def _edge(sources: DataFrame, low: float, high: float, ratio: float, fits, rising: bool) -> float:
    """Where ``fits`` turns, between ``low`` and ``high``: its smallest exponent if it is rising, else its largest."""
    for _ in range(_ROUNDS):
        grid = [low + (high - low) * k / _STEPS for k in range(_STEPS + 1)]
        good = [r.a for r in _moments(sources, grid, ratio) if fits(r)]
        if not good:
            return high if rising else low
        if rising:
            high = min(good)
            low = max([g for g in grid if g < high], default=high)
        else:
            low = max(good)
            high = min([g for g in grid if g > low], default=low)
    return high if rising else low


def find_exponent(sources: DataFrame, target_entropy: float | None, max_epochs: float | None, ratio: float) -> float:
    """The exponent in [0, 1] for the target entropy (nats) and the repetition limit, to about 3e-8.

    Where both can't be met, the limit is. With exponent 1 every source repeats ``ratio`` times: a lower limit can't
    be met at all and raises ValueError.
    """
    if max_epochs is not None and ratio > max_epochs + 1e-12:
        raise ValueError(f"drawing {ratio} times all tokens repeats some source more than max_epochs = {max_epochs} times")
    a = 1.0
    if target_entropy is not None:
        a = _edge(sources, 0.0, 1.0, ratio, lambda r: r.entropy >= target_entropy - 1e-12, rising=False)
    if max_epochs is not None:
        a = _edge(sources, a, 1.0, ratio, lambda r: r.epochs <= max_epochs + 1e-12, rising=True)
    return round(a, 7)


def mixing_weights(docs: DataFrame, *, source_col: str = "source", target_share: float | None = 0.95, max_epochs: float | None = 4.0, budget_share: float = 1.0) -> DataFrame:
    """One row for each source: of, tokens, rows, share, weight, budget (tokens), full (epochs), rest (tokens of the last).

    ``docs`` has a ``tokens`` column. ``target_share`` is the target entropy as a share of the most that the
    sources allow, 1 at most; ``budget_share`` the tokens to draw as a share of all tokens.
    """
    if target_share is not None and target_share > 1:
        raise ValueError("target_share is a share of the largest entropy")
    by = docs.groupBy(F.col(f"`{source_col}`").alias("of")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    sources = write_table(by, "sources")
    total, kinds = sources.agg(F.sum("tokens"), F.sum(F.when(F.col("tokens") > 0, 1))).first()
    total, kinds = total or 0, kinds or 0
    budget = int(total * budget_share)
    sources = sources.withColumn("share", F.col("tokens") / F.lit(float(total or 1)))
    a = find_exponent(sources, None if target_share is None else target_share * math.log(kinds), max_epochs, budget_share) if kinds else 1.0
    z = sources.where("share > 0").agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
    weight = F.when(F.col("share") > 0, F.round(F.pow("share", F.lit(a)) / F.lit(z), 12)).otherwise(0.0)
    exact = F.col("weight") * budget
    near = F.round(F.try_divide(exact, F.col("tokens"))).cast("long") * F.col("tokens")
    tokens = F.when((F.col("tokens") > 0) & (F.abs(exact - near) <= WHOLE * F.col("tokens")), near).otherwise(F.floor(exact)).cast("long")
    full = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    return sources.withColumn("weight", weight).withColumn("budget", tokens).withColumn("full", full).withColumn("rest", F.col("budget") - F.col("full") * F.col("tokens")).withColumn("exponent", F.lit(a))


def shuffle_key(seed: int, epoch: Column, *of: Column) -> Column:
    """A document's place in its source's permutation for one epoch, from 0 to 2**62 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), epoch.cast("long"), *of), 2)


def _of_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source in a written table of sources (null is a source)."""
    told = sources.withColumnRenamed("__of", "__source")
    return join_sized(rows, told, F.col("__of").eqNullSafe(F.col("__source")), "inner").drop("__source")


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", target_share: float | None = 0.95, max_epochs: float | None = 4.0, budget_share: float = 1.0, block_rows: int = 4096, seed: int = 17) -> DataFrame:
    """Draw documents so that sources have their target weights: one row for each document and epoch it is drawn in.

    Returns the input's columns and ``tokens`` (words of the text), ``epoch`` (from 1), ``block`` (within the
    epoch's permutation of the source) and ``shuffle_key`` (the order within it); input columns of these names are
    replaced, as are those whose names begin with two underscores and one of of, id, hash, full, rest, blocks, last,
    end, u, b, epochs
    and source. Sorting by (epoch, block, shuffle_key) gives the block permutations. A source never exceeds its budget; a
    ``max_epochs`` below ``budget_share`` can't be met and raises ValueError. A null or empty text has no tokens: it
    is drawn in every whole epoch and where it falls into the last part; a source without tokens has weight 0 and is
    not drawn; documents with a null source form one source; repeated rows are drawn together or not at all; an empty
    table gives an empty result.
    """
    docs = without(docs, *OUTPUTS, *_OWN)
    names = [F.col(f"`{c}`") for c in docs.columns]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own = {"__of": F.col(f"`{source_col}`"), "__id": F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), "__hash": F.xxhash64(text), "tokens": F.regexp_count(text, F.lit(WORD)).cast("long")}
    # words are counted once for all that follows but the last pass over the documents themselves
    light = write_table(docs.select(*[c.alias(n) for n, c in own.items()]), "sized")
    weights = write_table(mixing_weights(light, source_col="__of", target_share=target_share, max_epochs=max_epochs, budget_share=budget_share), "weights")
    plan = weights.select(F.col("of").alias("__of"), F.col("full").alias("__full"), F.col("rest").alias("__rest"), F.greatest(F.lit(1), F.ceil(F.col("rows") / block_rows)).cast("long").alias("__blocks"))

    place = lambda epoch: shuffle_key(seed, epoch, F.col("__id"), F.col("__hash"))
    part = _of_source(light, plan.where("__rest > 0")).withColumn("u", place(F.col("__full") + 1)).withColumn("block", F.col("u") % F.col("__blocks"))
    sums = part.groupBy("__of", "block").agg(F.sum("tokens").alias("sum"), F.first("__rest").alias("rest"))
    running = F.sum("sum").over(W.partitionBy("__of").orderBy("block"))
    ends = sums.withColumn("run", running).where("run > rest").groupBy("__of").agg(F.min(F.struct("block", (F.col("rest") - F.col("run") + F.col("sum")).alias("left"))).alias("e"))
    ends = write_table(ends.select("__of", F.col("e.block").alias("__last"), F.col("e.left").alias("left")), "last-blocks")
    # a range frame: repeated rows are peers, with one running sum
    inside = W.partitionBy("__of").orderBy("u", "__id", "__hash").rangeBetween(W.unboundedPreceding, W.currentRow)
    fits = _of_source(part, ends).where("block = __last").withColumn("run", F.sum("tokens").over(inside)).where("run <= left")
    fits = fits.groupBy("__of").agg(F.max(F.struct("u", "__id", "__hash")).alias("__end"))
    cut = ends.alias("e").join(fits.alias("f"), F.col("e.__of").eqNullSafe(F.col("f.__of")), "left").select("e.__of", "e.__last", "f.__end")
    plan = plan.alias("p").join(cut.alias("c"), F.col("p.__of").eqNullSafe(F.col("c.__of")), "left").select("p.*", "c.__last", "c.__end")
    plan = write_table(plan, "mixing-plan")

    drawn = _of_source(docs.withColumns(own), plan).withColumn("__u", place(F.col("__full") + 1)).withColumn("__b", F.col("__u") % F.col("__blocks"))
    before = (F.col("__b") < F.col("__last")) | (F.col("__b") == F.col("__last")) & (F.struct(F.col("__u").alias("u"), "__id", "__hash") <= F.col("__end"))
    epochs = F.col("__full") + F.when((F.col("__rest") > 0) & before, 1).otherwise(0)
    out = drawn.withColumn("__epochs", epochs).where("__epochs > 0").select(*names, "tokens", "__id", "__hash", "__blocks", F.explode(F.sequence(F.lit(1).cast("long"), "__epochs")).alias("epoch"))
    u = place(F.col("epoch"))
    return out.select(*names, "tokens", "epoch", (u % F.col("__blocks")).alias("block"), u.alias("shuffle_key"))
