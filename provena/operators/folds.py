"""Folds over the ordered rows of a key, for what has no window form: many small groups in one stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Numbers the rows of a group on their way to Python; 1 begins a group.
NTH = "__nth"


def fold_groups(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], fold: Callable[[pd.DataFrame], list[tuple]], schema, *, keep_key: bool = True) -> DataFrame:
    """Call ``fold`` with each key's rows in order; its tuples, after the key's own values, are the result.

    Rows are dealt by key and sorted within each task, and a task reads its groups one after another: it holds one
    group and one batch at a time, and small groups cost no call to Python of their own. Null keys form a group.
    The window that numbers a group's rows holds them together: ``mapInPandas`` asks for no distribution, so after a
    plain repartition the adaptive planner may read a join's shuffle where it lies and cut groups in pieces.
    """
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    out = T.StructType([*[f for f in rows.schema.fields if f.name in keys], *kinds.fields]) if keep_key else kinds
    columns = rows.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(parts: list[pd.DataFrame]) -> list[tuple]:
            group = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
            head = tuple(group[k].iloc[0] for k in keys) if keep_key else ()
            return [(*head, *t) for t in fold(group)]

        def frame(made: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame({n: pd.Series([m[i] for m in made], dtype=object) for i, n in enumerate(out.names)})

        for batch in batches:
            if not len(batch):
                continue
            heads = (batch.pop(NTH) == 1).to_numpy().nonzero()[0].tolist()
            edges = [0, *[i for i in heads if i], len(batch)]
            begun = not heads or heads[0] > 0
            made: list[tuple] = []
            for a, b in zip(edges, edges[1:], strict=False):
                part = batch.iloc[a:b]
                if held and not (a == 0 and begun):
                    made += done(held)
                    held = []
                held.append(part)
            yield frame(made)
        if held:
            yield frame(done(held))

    dealt = rows.select(*columns, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).alias(NTH))
    return dealt.mapInPandas(run, out)
