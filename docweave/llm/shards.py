"""Sharding by size-tiered compaction, in DataFrame operations.

A store is a folder with immutable Parquet shards and a chain of manifests.
Appending writes arrivals as small shards; compaction takes the tiers (shards
whose sizes lie within a factor of each other) that hold enough shards, fills
runs of them up to the target size, and writes one file for each run. A change
becomes visible by one rename: the new manifest is written aside and renamed to
the next version, which fails if another writer took that version, and then the
caller starts over from the newer one. Readers use the shards a manifest names
and nothing else, so a failed or repeated task leaves no trace.

No source or key matters: runs are filled by size alone, each output file is at
most one target in size or one shard, and rows meet their run through a join
with the plan, which has one row a shard.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .text import shared_dir

#: Bytes of a compacted file, shards a tier must hold to be merged, and the factor between tiers.
TARGET_BYTES = 128 << 20
FAN_IN = 4
TIER_FACTOR = 4
#: A round rewrites this share of the store at most (and one run at least), so it needs so much space beside the store.
ROUND_SHARE = 0.34
MANIFEST = "shard long, path string, bytes long, rows long, tier int, version int"


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class Store:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN, tier_factor: int = TIER_FACTOR):
        self.spark, self.root = spark, root.rstrip("/")
        self.target_bytes, self.fan_in, self.tier_factor = target_bytes, fan_in, tier_factor
        self.jvm = spark.sparkContext._jvm
        self.files = self.jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def version(self) -> int:
        """The newest committed version, 0 if there is none."""
        folder = self._path(f"{self.root}/manifest")
        if not self.files.exists(folder):
            return 0
        return max((int(s.getPath().getName()[2:]) for s in self.files.listStatus(folder) if s.getPath().getName().startswith("v=")), default=0)

    def manifest(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v={version:08d}").withColumn("version", F.lit(version))

    def commit(self, shards: DataFrame, version: int) -> int:
        """Makes `shards` the content of the version, or raises Conflict if that version exists."""
        aside = f"{self.root}/manifest/_{uuid.uuid4().hex}"
        shards.select("shard", "path", "bytes", "rows", "tier").coalesce(1).write.parquet(aside)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(aside), self._path(f"{self.root}/manifest/v={version:08d}"), plain)
        except Exception as error:
            if "FileAlreadyExists" in str(error):
                self.files.delete(self._path(aside), True)
                raise Conflict(f"version {version}") from error
            raise
        return version

    def _written(self, folder: str, after: int) -> DataFrame:
        """A manifest row for each file in a folder that was just written; shard numbers go on from `after`."""
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
        sizes = listed.select("path", F.col("length").alias("bytes"))
        counts = self.spark.read.option("recursiveFileLookup", "true").parquet(folder).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("rows"))
        tier = F.floor(F.log(float(self.tier_factor), F.greatest("bytes", F.lit(1)).cast("double"))).cast("int")
        files = sizes.join(counts, "path", "left").fillna(0, ["rows"]).withColumn("tier", tier)
        # One row a file: the numbering is over the files of one commit.
        number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path"))
        return files.select((number + after).cast("long").alias("shard"), "path", "bytes", "rows", "tier")

    def append(self, arrivals: DataFrame) -> int:
        """Writes arrivals as small shards, one for each partition that has rows, and commits them."""
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        arrivals.write.parquet(folder)
        while True:
            version = self.version()
            old = self.manifest(version)
            last = old.agg(F.coalesce(F.max("shard"), F.lit(0))).first()[0]
            try:
                return self.commit(old.drop("version").unionByName(self._written(folder, last)), version + 1)
            except Conflict:
                continue

    def plan(self, shards: DataFrame) -> DataFrame:
        """(path, shard, run): which shards a round merges, runs numbered from 0. Runs fill a target each and stay within a tier;
        single shards are left, and what goes beyond ROUND_SHARE waits for the next round."""
        small = shards.filter(F.col("bytes") < self.target_bytes // 2)
        crowd = small.groupBy("tier").agg(F.count("*").alias("n")).filter(F.col("n") >= self.fan_in)
        order = Window.partitionBy("tier").orderBy("bytes", "shard")
        filled = small.join(crowd, "tier").withColumn("before", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        runs = filled.withColumn("run", F.concat_ws("-", "tier", F.floor(F.coalesce("before", F.lit(0)) / self.target_bytes)))
        many = runs.groupBy("run").agg(F.count("*").alias("n"), F.sum("bytes").alias("size")).filter("n > 1")
        # One row a run, not a shard.
        reach = F.sum("size").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
        room = shards.agg(F.sum("bytes")).first()[0] or 0
        now = many.withColumn("before", F.coalesce(reach, F.lit(0))).filter(F.col("before") + F.col("size") <= F.greatest(F.lit(int(room * ROUND_SHARE)), F.col("size"))).select("run", (F.row_number().over(Window.orderBy("run")) - 1).alias("number"))
        return runs.join(now, "run").select("path", "shard", F.col("number").alias("run"))

    def compact(self) -> int:
        """Rounds of merging until no tier is crowded; each round commits a version. Older versions stay readable until expire()."""
        while True:
            version = self.version()
            shards = self.manifest(version)
            plan = self.plan(shards).persist()
            try:
                runs = plan.select("run").distinct().count()
                if not runs:
                    return version
                paths = [r.path for r in plan.select("path").toLocalIterator()]  # one a shard, not a row
                rows = self.spark.read.parquet(*paths)
                tagged = rows.withColumn("__path", F.col("_metadata.file_path")).join(plan.select(F.col("path").alias("__path"), F.col("run").alias("__run")), "__path").drop("__path")
                folder = f"{self.root}/shards/{uuid.uuid4().hex}"
                tagged.repartitionById(runs, F.col("__run")).write.partitionBy("__run").parquet(folder)
                last = shards.agg(F.max("shard")).first()[0]
                kept = shards.join(plan.select("shard"), "shard", "left_anti").drop("version")
                try:
                    self.commit(kept.unionByName(self._written(folder, last)), version + 1)
                except Conflict:
                    self.files.delete(self._path(folder), True)
            finally:
                plan.unpersist()

    def expire(self, keep_versions: int = 1) -> None:
        """Removes all but the newest versions, first from the list and then the files that no kept one names.

        Readers of a removed version fail from then on, so it should be older than any reader.
        """
        if keep_versions < 1:
            raise ValueError("keep_versions must be 1 at least")
        folder = self._path(f"{self.root}/manifest")
        listed = sorted(int(s.getPath().getName()[2:]) for s in self.files.listStatus(folder) if s.getPath().getName().startswith("v=")) if self.files.exists(folder) else []
        shards = lambda versions: {r.path for v in versions for r in self.manifest(v).select("path").toLocalIterator()}  # noqa: E731  one a shard, not a row
        old = listed[:-keep_versions]
        gone = shards(old) - shards(listed[-keep_versions:])
        for v in old:
            self.files.delete(self._path(f"{self.root}/manifest/v={v:08d}"), True)
        for path in gone:
            self.files.delete(self._path(path), False)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with their shard number in `__shard`."""
        shards = self.manifest(version)
        paths = [r.path for r in shards.select("path").toLocalIterator()]
        rows = self.spark.read.parquet(*paths)
        return rows.withColumn("__path", F.col("_metadata.file_path")).join(shards.select(F.col("path").alias("__path"), F.col("shard").alias("__shard")), "__path").drop("__path")


def sharded(docs: DataFrame, root: str | None = None, **options) -> Store:
    """A store that holds docs: appended as they lie, then compacted.

    Null columns and texts are stored as they are; repeated rows stay repeated;
    a very long text stays whole, in a shard that may be larger than the target;
    shards of equal size are merged in the order of their numbers; an empty
    table makes one empty shard. Columns may bear any names but __path, __run
    and __shard, which are refused.
    """
    if {"__path", "__run", "__shard"} & set(docs.columns):
        raise ValueError("a column bears a name that the store needs")
    spark = docs.sparkSession
    store = Store(spark, root or f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", **options)
    store.append(docs)
    store.compact()
    return store


def summary(docs: DataFrame) -> DataFrame:
    """(doc_id, shard, shard_rows, text_sha256) of every row as the committed version holds it; null texts hash as empty."""
    store = sharded(docs)
    rows = store.read().select("doc_id", F.col("__shard").alias("shard"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    return rows.join(store.manifest().select("shard", F.col("rows").alias("shard_rows")), "shard")
