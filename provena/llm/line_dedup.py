"""Operator 1: line dedup over levelled sorted runs of line hashes.

Lines are hashed once, in one pass over the documents. They come in batches, smallest ids first. A batch claims its line keys (hash, smallest document); the claims
are merge-joined with the runs kept so far, and those without a match are a new run. Runs are bucketed and sorted
by hash in the shared folder, so that the join moves only the batch and never the runs. When a level holds
``fanout`` runs they are compacted into one run of the next level, so a batch meets few runs however many came
before it.

A key that very many documents hold is one claim for each map task (the smallest document is combined before the
shuffle). Telling the documents which lines go is a join against keys with more than one holder, whose hot keys
adaptive execution splits.

Runs may outlive a call: a caller that passes its own :class:`LineRuns` dedups later documents against all earlier
ones, in another session too (:meth:`LineRuns.state`).
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.llm.common import default_parallelism, scratch_path, without, write_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\f\r"
OUTPUTS = ("n_lines", "n_dropped")
_LAST = (1 << 63) - 1


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


class LineRuns:
    """Levels of runs (h1, h2, owner): sorted by hash, bucketed alike, disjoint in their keys."""

    def __init__(self, spark, fanout: int = 3):
        self.spark, self.fanout, self.buckets = spark, fanout, default_parallelism(spark)
        self.levels: list[list[str]] = []
        self.paths: dict[str, str] = {}
        self.name = f"line_runs_{uuid.uuid4().hex[:12]}"

    def state(self) -> dict:
        """What :meth:`restored` needs to go on with these runs: their folders by level, and how they are bucketed."""
        return {"buckets": self.buckets, "fanout": self.fanout, "levels": [[self.paths[n] for n in level] for level in self.levels]}

    @classmethod
    def restored(cls, spark, state: dict) -> LineRuns:
        runs = cls(spark, state["fanout"])
        runs.buckets = state["buckets"]
        for level in state["levels"]:
            runs.levels.append([])
            for path in level:
                name = f"{runs.name}_{len(runs.paths)}"
                spark.sql(f"CREATE TABLE {name} (h1 BIGINT, h2 BIGINT, owner BIGINT, fresh BOOLEAN, shared BOOLEAN) USING parquet CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {runs.buckets} BUCKETS LOCATION '{path}'")
                runs.paths[name] = path
                runs.levels[-1].append(name)
        return runs

    def _write(self, rows: DataFrame) -> tuple[str, str]:
        name = f"{self.name}_{len(self.paths)}"
        path = self.paths[name] = scratch_path(self.spark, name)
        rows = rows.repartition(self.buckets, "h1", "h2")
        rows.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name, path

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(n).where("fresh").select("h1", "h2", F.col("owner").alias("held")) for level in self.levels for n in level]

    def add(self, claims: DataFrame) -> DataFrame:
        """Merge-anti-join ``claims`` (h1, h2, owner, last) with the runs; what is new becomes a run of level 0.

        Returns the claims with their final owner, ``fresh`` (new keys) and ``shared`` (held by more documents than the owner).
        """
        self._compact()
        held = F.lit(None).cast("long")
        for k, run in enumerate(self.runs()):
            claims = claims.join(run.withColumnRenamed("held", f"held{k}"), ["h1", "h2"], "left")
            held = F.coalesce(held, F.col(f"held{k}"))
        decided = claims.select("h1", "h2", F.coalesce(held, F.col("owner")).alias("owner"), held.isNull().alias("fresh"), (held.isNotNull() | (F.col("last") > F.col("owner"))).alias("shared"))
        name, path = self._write(decided)
        self.levels = self.levels or [[]]
        self.levels[0].append(name)
        # read without its buckets: a join with it is dealt anew, so that adaptive execution can split hot lines
        return self.spark.read.schema(decided.schema).parquet(path)

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                merged = reduce(DataFrame.unionByName, [self.spark.table(n).where("fresh") for n in self.levels[k]])
                name, _ = self._write(merged)
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(name)
                self.levels[k] = []

    def forget(self) -> None:
        """Drop the names; the files stay in the shared folder while results still read them."""
        for name in self.paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def line_hashes(own: DataFrame, min_chars: int) -> DataFrame:
    """(__rank, __a, __b, pos, h1, h2): the key hashes of all lines long enough, as a written table."""
    hashed = lambda k: F.when(F.char_length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")))
    keys = F.transform(F.transform(F.split("__text", "\n"), line_key), hashed)
    lines = own.select("__rank", "__a", "__b", F.posexplode(keys).alias("pos", "key")).where("key IS NOT NULL")
    return write_table(lines.select("__rank", "__a", "__b", "pos", "key.h1", "key.h2"), "line-hashes")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, batches: int = 4, fanout: int = 2, runs: LineRuns | None = None) -> DataFrame:
    """Drop each line whose key an earlier document (by id) also holds; other lines stay, joined by newlines.

    A line's key is the line without blanks at its ends, A-Z lower-cased; keys of fewer than ``min_chars`` code
    points are never dropped. Returns the input's columns and ``n_lines`` (before) and ``n_dropped``; input columns
    of these names are replaced. A document keeps all its own repeats of a line that it owns. Ids are integers (others
    are cast to long, and fail if they can't be). A null text is one empty line and comes back empty; rows with the
    same id are one document, so none of them takes lines from the other; a null id comes after all others; an empty
    table gives an empty result. With ``runs`` given, documents of earlier calls own their lines whatever their ids,
    and the lines of these documents join the runs, which the caller keeps (and forgets).
    """
    docs = without(docs, *OUTPUTS, "__rank", "__text", "__gone", "__a", "__b")
    rank = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST))
    own = docs.withColumns({"__rank": rank, "__text": F.coalesce(F.col(f"`{text_col}`"), F.lit(""))}).withColumns({"__a": F.xxhash64("__text"), "__b": F.xxhash64(F.lit(1), "__text")})
    lines = line_hashes(own, min_chars)
    cuts = lines.agg(F.percentile_approx("__rank", [k / batches for k in range(1, batches)], 10000)).first()[0] if batches > 1 else None
    edges = sorted({-(1 << 63), *(cuts or [])})
    kept_runs, parts = runs or LineRuns(docs.sparkSession, fanout), []
    try:
        for k, low in enumerate(edges):
            batch = lines.where(F.col("__rank") >= low) if k else lines
            batch = batch.where(F.col("__rank") < edges[k + 1]) if k + 1 < len(edges) else batch
            decided = kept_runs.add(batch.groupBy("h1", "h2").agg(F.min("__rank").alias("owner"), F.max("__rank").alias("last")))
            gone = batch.join(decided.where("shared").select("h1", "h2", "owner"), ["h1", "h2"]).where(F.col("owner") != F.col("__rank"))
            parts.append(gone.groupBy("__rank", "__a", "__b").agg(F.collect_set("pos").alias("__gone")))
        gone = write_table(reduce(DataFrame.unionByName, parts), "dropped-lines")
    finally:
        if runs is None:
            kept_runs.forget()
    told = own.join(gone, ["__rank", "__a", "__b"], "left")

    def kept(lines: Column) -> Column:
        return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__gone")), lambda i: lines[i]), "\n")

    text = F.when(F.col("__gone").isNull(), F.col("__text")).otherwise(F.transform(F.array(F.split("__text", "\n")), kept)[0])
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return told.select(*columns, F.size(F.split("__text", "\n")).cast("long").alias("n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_dropped"))
