"""Fingerprints of pages in a versioned table, so that pages that did not change are skipped, batch after batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattgrid.functions import files

KEYS = ["utility_id", "url"]


class FingerprintTable:
    """The last known content hash of each page (utility_id, url), kept under a folder that all executors share.

    Three kinds of entries: ``tables/`` holds runs of fingerprints, sorted by key bucket; ``manifest/`` a small file per version
    that names the live runs and the last batch; ``decisions/<batch>`` what became of each row of a batch. A version is valid once
    its manifest is there, so a batch that failed half way is simply done again, and one that a manifest names changes nothing.

    A batch adds one run with the fingerprints that it changed. Two runs are merged when the older is at most twice the
    newer's size, as in a log-structured store: there are about log2(pages) runs whatever the number of batches, each
    fingerprint is rewritten as many times at most, and of equal keys only the latest is kept. What a batch reads are its own
    buckets of the runs, by the minima and maxima of their row groups, and none of the earlier batches. One batch is applied at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def manifest(self) -> dict:
        names = [n for n in files.names_in(self.spark, f"{self.folder}/manifest") if n.endswith(".json")]
        return json.loads(files.read_text(self.spark, f"{self.folder}/manifest/{names[-1]}")) if names else {"version": 0, "batch": -1, "runs": []}

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema("utility_id bigint, url string, content_hash string, at timestamp, batch bigint, bucket int").parquet(f"{self.folder}/tables/{name}")

    def _latest(self, rows: DataFrame) -> DataFrame:
        last = F.max(F.struct("at", "batch", "content_hash")).alias("l_")
        return rows.groupBy(*KEYS, "bucket").agg(last).select(*KEYS, "l_.content_hash", "l_.at", "l_.batch", "bucket")

    def _rows(self, runs: list[dict]) -> DataFrame | None:
        out = None
        for r in runs:
            out = self._run(r["name"]) if out is None else out.union(self._run(r["name"]))
        return out

    def current(self) -> DataFrame:
        """utility_id, url, content_hash, at, batch: the fingerprints as the last version has them."""
        rows = self._rows(self.manifest()["runs"])
        rows = self.spark.createDataFrame([], self._run("none").schema) if rows is None else self._latest(rows)
        return rows.drop("bucket")

    def _write_run(self, name: str, rows: DataFrame) -> dict:
        path = f"{self.folder}/tables/{name}"
        rows.repartitionByRange("bucket", *KEYS).sortWithinPartitions("bucket", *KEYS).write.mode("overwrite").parquet(path)
        return {"name": name, "rows": self._run(name).count()}

    def apply(self, batch: DataFrame, number: int) -> DataFrame:
        """Takes in a batch (utility_id, url, content_hash, at) and gives its rows with before, outcome and batch.

        A row is compared with the one before it of its page, in order of at, then hash: outcome is first, changed or same. Rows
        older than their page's known fingerprint are late and leave it as it is. Rows with a null key are dropped; a null
        hash is a hash of its own, a null time is older than any. A number that was applied before gives what it gave then.
        """
        known_as, path = self.manifest(), f"{self.folder}/decisions/{number}"
        if number <= known_as["batch"]:
            return self.spark.read.parquet(path)
        version = known_as["version"] + 1
        bucket = F.pmod(F.xxhash64(*KEYS), F.lit(self.buckets)).cast("int")
        rows = batch.select(F.col("utility_id").cast("bigint").alias("utility_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("content_hash").cast("string"), F.lit("")).alias("content_hash"), F.col("at").cast("timestamp").alias("at"))
        rows = rows.where("utility_id is not null and url is not null").withColumn("bucket", bucket)
        runs = self._rows(known_as["runs"])
        if runs is None:
            met = rows.withColumns({"known_": F.lit(None).cast("string"), "since_": F.lit(None).cast("timestamp")})
        else:
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # as many as there are buckets at most
            known = runs.where(F.col("bucket").isin(touched)).join(rows.select(*KEYS).distinct(), KEYS, "left_semi")
            known = self._latest(known).select(*KEYS, F.col("content_hash").alias("known_"), F.col("at").alias("since_"))
            met = rows.join(known, KEYS, "left")
        late = F.col("since_").isNotNull() & (F.col("at").isNull() | (F.col("at") < F.col("since_")))
        order = Window.partitionBy(*KEYS, "late_").orderBy(F.asc_nulls_first("at"), "content_hash")
        before = F.coalesce(F.lag("content_hash").over(order), "known_")
        decided = met.withColumn("late_", late).withColumn("before", F.when(~F.col("late_"), before))
        outcome = F.when(F.col("late_"), "late").when(F.col("before").isNull(), "first").when(F.col("before") != F.col("content_hash"), "changed").otherwise("same")
        decided.select(*KEYS, "content_hash", "at", "before", outcome.alias("outcome"), F.lit(number).cast("bigint").alias("batch"), "bucket").write.mode("overwrite").parquet(path)
        done = self.spark.read.parquet(path)
        changed = self._latest(done.where("outcome <> 'late'").select(*KEYS, "content_hash", "at", "batch", "bucket"))
        live = [*known_as["runs"], self._write_run(f"{version}-0", changed)]
        k = 0
        while len(live) > 1 and live[-2]["rows"] <= 2 * live[-1]["rows"]:
            k += 1
            live[-2:] = [self._write_run(f"{version}-{k}", self._latest(self._rows(live[-2:])))]
        files.write_text(self.spark, f"{self.folder}/manifest/{version:012d}.json", json.dumps({"version": version, "batch": number, "runs": live}))
        self._clean({r["name"] for r in live} | {r["name"] for r in known_as["runs"]}, version)
        return done

    def _clean(self, in_use: set[str], version: int) -> None:
        """Deletes runs that neither this version nor the one before needs (a reader may still have that one), and older manifests."""
        for name in files.names_in(self.spark, f"{self.folder}/tables"):
            if name not in in_use:
                files.delete(self.spark, f"{self.folder}/tables/{name}")
        for name in files.names_in(self.spark, f"{self.folder}/manifest"):
            if name < f"{version - 1:012d}.json":
                files.delete(self.spark, f"{self.folder}/manifest/{name}")


def write_changed_pages(pages: DataFrame, spark: SparkSession, folder: str, checkpoint: str, at: str | None = None):
    """A query over a stream of pages (utility_id, url, content_hash, at) that stores, batch by batch, under folder/<batch> those that are new or changed: a row per page with its last hash.

    What is known is kept in a FingerprintTable beside them, so a batch costs what its own pages cost, and one that is written
    again after a failure replaces its own table. Without at, a batch's number is the time of its rows.
    """
    table = FingerprintTable(spark, f"{folder}/fingerprints")

    def store(batch: DataFrame, number: int) -> None:
        time = F.timestamp_seconds(F.lit(number)) if at is None else F.col(at)
        done = table.apply(batch.withColumn("at", time), number)
        new = done.where("outcome in ('first', 'changed')").groupBy(*KEYS).agg(F.max(F.struct("at", "content_hash")).alias("l_"))
        new.select(*KEYS, "l_.content_hash", F.lit(number).cast("bigint").alias("batch")).write.mode("overwrite").parquet(f"{folder}/{number}")

    return pages.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
