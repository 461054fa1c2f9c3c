"""Connections with their values as one object: planes of values, sparse deltas, prototypes, refits, save and load."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import stored
from . import factorise, graph
from . import planes as P

#: Version of what :meth:`EdgeStore.save` writes.
FORMAT = "axonframe-edges-1"
#: Ticks that have to lie between two refits.
LEAST_TICKS = 1000


class StoreError(ValueError):
    pass


class EdgeStore:
    """``edges`` (src, dst, ordinal, prototype), ``values`` (plane, ordinal, value) and ``deltas`` (plane, ordinal, delta), all tables.

    A value reads as its basis and its delta; a pair that is no edge reads 0, its delay 0, its prototype -1.
    """

    def __init__(self, edges: DataFrame, values: DataFrame, planes: list[str], deltas: DataFrame | None = None, last_refit: int | None = None):
        self.spark, self.planes = edges.sparkSession, list(planes)
        self.edges, self.values = edges.select("src", "dst", "ordinal", "prototype"), values.select("plane", "ordinal", "value")
        self.deltas = self.spark.createDataFrame([], "plane string, ordinal long, delta double") if deltas is None else deltas
        self.last_refit = last_refit

    @classmethod
    def of(cls, edges: DataFrame, planes: dict[str, Column], prototype: Column | None = None) -> EdgeStore:
        """From edges (src, dst, ...), no pair twice, with an expression for each plane."""
        if graph.duplicate_pairs(edges.select("src", "dst")).head(1):
            raise StoreError("a pair is there twice")
        named = edges.select("src", "dst", (F.lit(0) if prototype is None else prototype).cast("int").alias("prototype"), *[c.cast("double").alias(f"p_{n}") for n, c in planes.items()])
        numbered = stored(graph.ordinals(named), "numbered")
        each = F.array(*[F.struct(F.lit(n).alias("plane"), F.col(f"p_{n}").alias("value")) for n in planes])
        return cls(numbered, numbered.select("ordinal", F.explode(each).alias("p")).select("p.plane", "ordinal", "p.value"), list(planes))

    @classmethod
    def of_runs(cls, edges: DataFrame, runs: DataFrame, planes: list[str]) -> EdgeStore:
        """From edges (src, dst) and runs (first_ordinal, n, prototype, one column a plane) of consecutive ordinals that share a prototype and first values."""
        numbered = stored(graph.ordinals(edges.select("src", "dst")), "numbered")
        count, checks = numbered.count(), runs.agg(F.sum("n").alias("n"), F.min("n").alias("least"), F.count_if(F.col("first_ordinal").isNull() | F.col("prototype").isNull() | (F.col("prototype") < 0)).alias("bad")).first()
        spread = runs.withColumn("ordinal", F.explode(F.sequence(F.col("first_ordinal"), F.col("first_ordinal") + F.greatest("n", F.lit(1)) - 1)))
        spread = stored(spread.select("ordinal", F.col("prototype").cast("int").alias("prototype"), *[F.col(p).cast("double").alias(f"p_{p}") for p in planes]), "runs")
        covered = spread.agg(F.count_distinct("ordinal").alias("n"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high")).first()
        if checks.bad or (checks.n or 0) != count or covered.n != count or count and (checks.least < 1 or covered.low != 0 or covered.high != count - 1):
            raise StoreError(f"runs have to cover the {count} ordinals once each, with a prototype")
        both = stored(numbered.join(spread, "ordinal"), "numbered")
        each = F.array(*[F.struct(F.lit(p).alias("plane"), F.col(f"p_{p}").alias("value")) for p in planes])
        return cls(both, both.select("ordinal", F.explode(each).alias("p")).select("p.plane", "ordinal", "p.value"), planes)

    def _plane(self, plane: str) -> str:
        if plane not in self.planes:
            raise StoreError(f"no plane {plane!r}")
        return plane

    def neighbor_values(self, plane: str) -> DataFrame:
        """(src, dst, ordinal, value) of all edges."""
        now = P.with_deltas(self.values.where(F.col("plane") == self._plane(plane)), self.deltas)
        return self.edges.join(now.select("ordinal", "value"), "ordinal").select("src", "dst", "ordinal", "value")

    def get(self, pairs: DataFrame, plane: str) -> DataFrame:
        """``pairs`` (src, dst) with their value."""
        return pairs.join(self.neighbor_values(plane).select("src", "dst", "value"), ["src", "dst"], "left").na.fill(0.0, ["value"])

    def delay_ticks(self, pairs: DataFrame, plane: str = "delay") -> DataFrame:
        """``pairs`` with whole ticks of delay, at least one for an edge."""
        found = self.neighbor_values(plane).select("src", "dst", F.greatest(F.lit(1), F.round("value")).cast("long").alias("delay_ticks"))
        return pairs.join(found, ["src", "dst"], "left").na.fill(0, ["delay_ticks"])

    def prototypes(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.edges.select("src", "dst", "prototype"), ["src", "dst"], "left").na.fill(-1, ["prototype"])

    def accumulate(self, updates: DataFrame) -> None:
        """Add ``updates`` (plane, src, dst, delta), several for an edge if need be. One that is no edge, of no plane, or not finite is refused and nothing changes."""
        rows = stored(updates.select("plane", "src", "dst", F.col("delta").cast("double").alias("delta")).join(self.edges, ["src", "dst"], "left"), "updates")
        bad = ~F.col("plane").isin(self.planes) | F.col("plane").isNull() | F.col("ordinal").isNull() | F.col("delta").isNull() | F.isnan("delta") | (F.abs("delta") == float("inf"))
        if first := rows.where(bad).head(1):
            raise StoreError(f"can't add {first[0].delta} to {first[0].src} -> {first[0].dst} of plane {first[0].plane!r}: no edge, no plane, or not finite")
        every = self.deltas.unionByName(rows.select("plane", "ordinal", "delta"))
        self.deltas = stored(P.compact(every), "deltas")

    def occupancy(self) -> float:
        """Largest share of edges that have a delta, over all planes."""
        return float(P.occupancy(self.deltas, self.edges.count(), 0.0).first().occupancy)

    def refit_due(self, tick: int, every: int = 0, threshold: float = 0.0) -> bool:
        """Each ``every`` ticks, or once the occupancy reaches ``threshold``; 0 switches either off; never within a thousand ticks of the last."""
        if self.last_refit is not None and tick - self.last_refit < LEAST_TICKS:
            return False
        return bool(every > 0 and tick > 0 and tick % every == 0 or threshold > 0 and self.occupancy() >= threshold)

    def stats(self, plane: str) -> DataFrame:
        return P.stats(self.neighbor_values(plane), "value")

    def scale_to_rms(self, plane: str, target: float, least: float = 1e-12) -> float:
        """Scale a plane, its basis and its deltas, to a root mean square of ``target``; returns the factor."""
        if target < 0:
            raise StoreError("a root mean square can't be negative")
        rms = self.neighbor_values(plane).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("r")).first().r or 0.0
        factor = target / max(rms, least)
        own = F.when(F.col("plane") == plane, F.lit(factor)).otherwise(1.0)
        self.values, self.deltas = stored(self.values.withColumn("value", F.col("value") * own), "values"), stored(self.deltas.withColumn("delta", F.col("delta") * own), "deltas")
        return factor

    def fold(self, tick: int = 0) -> list[str]:
        """Add all deltas into the basis and empty them; returns the planes that had any."""
        touched = sorted(r.plane for r in self.deltas.select("plane").distinct().collect())  # planes are few
        if touched:
            self.values = stored(P.with_deltas(self.values, self.deltas), "values")
            self.deltas = self.spark.createDataFrame([], "plane string, ordinal long, delta double")
        self.last_refit = tick
        return touched

    def refit(self, plane: str, lanes: int, old: factorise.Fit | None = None, tolerance: float = factorise.TOLERANCES["normal"], tick: int = 0, sweeps: int = factorise.MOST_SWEEPS) -> factorise.Fit:
        """Fold the deltas in and fit the plane's rows again, from ``old`` on if given: only rows of changed edges move.
        If that leaves an error over the tolerance and over twice that of ``old``, the fit is done afresh. Rows are in units of the plane's root mean square."""
        changed = self.deltas.where(F.col("plane") == self._plane(plane)).join(self.edges, "ordinal")
        moved = tuple(stored(changed.select(F.col(c).alias("node")).distinct(), "moved") for c in ("src", "dst"))
        self.fold(tick)
        scaled, _ = factorise.scaled(self.neighbor_values(plane).withColumnRenamed("value", "weight"))
        if old is not None:
            found = factorise.alternate(scaled, lanes, tolerance, sweeps, (old.u, old.v), moved)
            if found.error <= tolerance or found.error <= 2 * old.error:
                return found
        return factorise.alternate(scaled, lanes, tolerance, sweeps)

    def save(self, path: str) -> None:
        """Write everything below ``path``, a folder of the shared store that has nothing yet; the manifest comes last."""
        self.edges.write.parquet(os.path.join(path, "edges"))
        self.values.write.parquet(os.path.join(path, "values"))
        self.deltas.write.parquet(os.path.join(path, "deltas"))
        self._manifest(self).write.parquet(os.path.join(path, "manifest"))

    @staticmethod
    def _manifest(store: EdgeStore) -> DataFrame:
        sums = [f.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*f.columns)), F.lit(0).cast("long"))).first() for f in (store.edges, store.values, store.deltas)]
        row = (FORMAT, store.planes, [int(s[0]) for s in sums], [int(s[1]) for s in sums], store.last_refit)
        return store.spark.createDataFrame([row], "format string, planes array<string>, counts array<long>, sums array<long>, last_refit long")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> EdgeStore:
        """What :meth:`save` wrote; a missing, other or damaged manifest, count or sum is an error before anything is used."""
        try:
            told = spark.read.parquet(os.path.join(path, "manifest")).collect()
        except Exception as missing:  # whatever store it is in
            raise StoreError(f"{path}: no edges were saved here in full") from missing
        if len(told) != 1 or told[0].format != FORMAT:
            raise StoreError(f"{path}: not of format {FORMAT}")
        e, v, d = (spark.read.parquet(os.path.join(path, n)) for n in ("edges", "values", "deltas"))
        store = cls(e, v, told[0].planes, d, told[0].last_refit)
        found = cls._manifest(store).first()
        n = store.edges.agg(F.count("*").alias("n"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high"), F.count_distinct("ordinal").alias("different")).first()
        if found.counts != told[0].counts or found.sums != told[0].sums or n.n and (n.low != 0 or n.high != n.n - 1 or n.different != n.n) or found.counts[1] != n.n * len(store.planes):
            raise StoreError(f"{path}: what is there isn't what was saved")
        return store
