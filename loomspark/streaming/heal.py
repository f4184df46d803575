"""Selectors that heal while a stream runs: each micro-batch is read with the newest selectors, and may leave newer ones.

A batch's pages are read by their domain's selectors, in parallel. Only the outcomes, a flag for each field, go on to the ring
of their domain and field; a ring with too many nulls triggers, and the domain's document is mended from its newest samples. The ring of a
mended field begins anew: the outcomes after its trigger came from the selector that went. Selectors,
rings and samples are tables by version: batch n reads version n and writes version n + 1. A batch that is run again, after
a restart, reads what it has read before and overwrites what it has written, so nothing is counted, healed or written
twice. The batch after it sees the mended selectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import selectors
from ..operators.ledger import fold_sorted
from ..session import keep
from .watch import THRESHOLD, WINDOW

PAGES = "domain string, seq long, html string, truth string"


class VersionedTable:
    """Rows by key, of which each version holds those that it has changed, and every SNAPSHOT-th all."""

    SNAPSHOT = 10

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], columns: str):
        self.spark, self.folder, self.keys = spark, folder, keys
        self.schema = ", ".join([*(f"{k} string" for k in keys), columns])

    def _path(self, version: int) -> str:
        return f"{self.folder}/version={version}"

    def read(self, version: int) -> DataFrame:
        """The rows as of a version, with since, the version that they come from."""
        first = version // self.SNAPSHOT * self.SNAPSHOT
        reader = self.spark.read.schema(f"{self.schema}, version long").option("basePath", self.folder)
        rows = reader.parquet(*(self._path(v) for v in range(first, version + 1)))
        others = [c for c in rows.columns if c not in (*self.keys, "version", "since")]
        newest = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*others, "since"), "version").alias("r"))
        return newest.select(*self.keys, "r.*")

    def write(self, changed: DataFrame, version: int) -> None:
        rows = changed.withColumn("since", F.lit(version).cast("long"))
        if version and version % self.SNAPSHOT == 0:
            rows = keep(rows)
            rows = rows.unionByName(self.read(version - 1).join(rows.select(*self.keys), self.keys, "left_anti"))
        rows.write.mode("overwrite").parquet(self._path(version))


def _step(state: tuple, row: tuple) -> tuple:
    ring, fired = state
    before, is_null = row
    if before is not None:
        return before, fired
    ring = (ring + ("1" if is_null else "0"))[-WINDOW:]
    fire = len(ring) >= WINDOW // 5 and ring.count("1") / len(ring) > THRESHOLD
    return ("" if fire else ring), fired + fire


class HealingStream:
    """Reads a stream of pages into records in a folder, with selectors (domain, fields, fingerprints: JSON) that it mends as it goes."""

    def __init__(self, spark: SparkSession, folder: str, hints: dict | None = None):
        self.spark, self.folder, self.hints = spark, folder, hints
        self.selectors = VersionedTable(spark, f"{folder}/selectors", ["domain"], "fields string, fingerprints string, since long")
        self.rings = VersionedTable(spark, f"{folder}/rings", ["domain", "field"], "ring string, since long")
        self.samples = VersionedTable(spark, f"{folder}/samples", ["domain"], "newest array<struct<seq:long,html:string,truth:string>>, since long")

    def begin(self, documents: DataFrame) -> None:
        """The first selectors. A folder that has a stream's state already keeps its own."""
        self.selectors.write(documents.select("domain", "fields", "fingerprints"), 0)
        self.rings.write(self.spark.createDataFrame([], "domain string, field string, ring string"), 0)
        self.samples.write(self.spark.createDataFrame([], "domain string, newest array<struct<seq:long,html:string,truth:string>>"), 0)

    def batch(self, pages: DataFrame, version: int) -> None:
        """For foreachBatch: pages (domain, seq, html and truth, a JSON object of known values, or null); seq orders them and is their key."""
        pages = keep(pages.select("domain", "seq", "html", "truth"))
        documents = keep(self.selectors.read(version))
        records = selectors.apply_selectors(pages, documents, "seq").join(documents.select("domain", "since"), "domain")
        records.write.mode("overwrite").parquet(f"{self.folder}/records/batch={version}")
        records = self.spark.read.schema(records.schema).parquet(f"{self.folder}/records/batch={version}")

        named = records.join(documents.select("domain", F.explode(F.json_object_keys("fields")).alias("field")), "domain")
        outcomes = named.select("domain", "field", "seq", F.lit(None).cast("string").alias("ring"), F.array_contains("nulls", F.col("field")).alias("is_null"))
        touched = outcomes.select("domain", "field").distinct()
        before = self.rings.read(version).join(touched, ["domain", "field"], "left_semi")
        before = before.select("domain", "field", F.lit(-(2**63)).cast("long").alias("seq"), "ring", F.lit(None).cast("boolean").alias("is_null"))
        after = fold_sorted(before.unionByName(outcomes), ["domain", "field"], ["seq"], ["ring", "is_null"], lambda: ("", 0), _step, lambda s: s, "ring string, fired int")
        after = keep(after)

        fresh = pages.where("truth IS NOT NULL")
        newest = F.row_number().over(Window.partitionBy("domain").orderBy(F.desc("seq")))
        old = self.samples.read(version).join(fresh.select("domain").distinct(), "domain", "left_semi").select("domain", F.explode("newest").alias("s")).select("domain", "s.*")
        kept = old.unionByName(fresh.select("domain", "seq", "html", "truth")).withColumn("n", newest).where(F.col("n") <= selectors.RING)
        ring = F.sort_array(F.collect_list(F.struct("seq", "html", "truth"))).alias("newest")
        self.samples.write(kept.groupBy("domain").agg(ring), version + 1)

        triggers = after.where("fired > 0").select("domain", "field")
        known = self.samples.read(version + 1).join(triggers.select("domain").distinct(), "domain", "left_semi").select("domain", F.explode("newest").alias("s")).select("domain", "s.*")
        healed = keep(selectors.heal_domains(triggers, documents, known, self.hints).where(F.size("healed") > 0))
        # What a replaced selector has found says nothing about the one in its place, so the ring of a mended field begins anew.
        mended = healed.select("domain", F.explode("healed").alias("field"), F.lit(True).alias("mended"))
        rings = after.join(mended, ["domain", "field"], "left").select("domain", "field", F.when(F.col("mended"), "").otherwise(F.col("ring")).alias("ring"))
        self.rings.write(rings, version + 1)
        self.selectors.write(healed.select("domain", "fields", "fingerprints"), version + 1)

    def run(self, stream: DataFrame) -> DataFrame:
        """Read what is there now, and return all records so far: domain, seq, record, nulls and the version of the selectors."""
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.folder}/state")
        writer.trigger(availableNow=True).start().awaitTermination()
        schema = "domain string, seq long, record string, nulls array<string>, since long"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/records")
