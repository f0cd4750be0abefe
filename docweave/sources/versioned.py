"""Tables that are changed by whole versions.

A table lies in buckets of its key. A commit writes the buckets that it touches
anew, beside the old ones, and then gives the next number to a manifest that
names the files of every bucket. That last step is one rename that fails if the
number is taken: a reader sees a version whole or not at all, and of two writers
that started from one version the second begins again from the other's.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"
ATTEMPTS = 5


class Conflict(Exception):
    """Another writer has committed the version."""


class Table:
    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    # Files

    def _hadoop(self, *below: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *below)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        path, fs = self._hadoop(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def _publish(self, version: int, manifest: dict) -> None:
        gateway, jvm = self.spark.sparkContext._gateway, self.spark.sparkContext._jvm
        aside, fs = self._hadoop(f"_aside-{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target, _ = self._hadoop("_versions", f"{version:010d}.json")
        fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(aside, target, gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as e:
            fs.delete(aside, False)
            if fs.exists(target):
                raise Conflict(f"version {version} of {self.path} is taken") from e
            raise

    # Versions

    def version(self) -> int:
        """The number of the last version; 0 where there is none."""
        return max((int(n.split(".")[0]) for n in self._names("_versions") if n.endswith(".json") and not n.startswith(".")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        number = self.version() if version is None else version
        if not number:
            return {"version": 0, "buckets": {}, "sides": {}, "schema": None}
        return json.loads(self.spark.read.text(f"{self.path}/_versions/{number:010d}.json", wholetext=True).first()[0])

    def _rows(self, manifest: dict, only: list[int] | None = None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        schema = StructType.fromJson(manifest["schema"])
        paths = [f"{self.path}/{p}" for b, p in manifest["buckets"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is named."""
        found = self._rows(self.manifest(version))
        if found is None:
            raise ValueError(f"there is no version of {self.path}")
        return found

    def side(self, name: str, version: int | None = None) -> DataFrame | None:
        """A table that was committed along with a version, or before it and not changed since."""
        place = self.manifest(version)["sides"].get(name)
        return None if place is None else self.spark.read.parquet(f"{self.path}/{place}")

    # Changes

    def upsert(self, rows: DataFrame, *order: str, sides: dict[str, DataFrame] | None = None) -> int:
        """Replaces the rows of the keys that rows bring; of several rows of a key, stored ones included, the last by order stays.
        Repeating it changes nothing. sides are committed along with it. Returns the version."""
        last = Window.partitionBy(self.key).orderBy(*(F.desc(o) for o in order))
        pick = lambda both: both.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")
        return self._change(rows, lambda old, new: pick(old.unionByName(new)), sides)

    def replace(self, rows: DataFrame, sides: dict[str, DataFrame] | None = None) -> int:
        """Puts rows in the place of all stored rows of their keys, as when a document is processed again. Returns the version."""
        return self._change(rows, lambda old, new: old.join(new.select(self.key).distinct(), self.key, "left_anti").select(*new.columns).unionByName(new), sides)

    def _change(self, rows: DataFrame, merge, sides: dict[str, DataFrame] | None) -> int:
        for _ in range(ATTEMPTS):
            base = self.manifest()
            try:
                return self._commit(base, rows, merge, sides or {})
            except Conflict:
                continue
        raise Conflict(f"{self.path} was changed {ATTEMPTS} times meanwhile")

    def _commit(self, base: dict, rows: DataFrame, merge, sides: dict[str, DataFrame]) -> int:
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        stage = f"data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, bucket).write.partitionBy(BUCKET).parquet(f"{self.path}/{stage}/in")
        touched = self._buckets(f"{stage}/in")
        new = self.spark.read.schema(rows.schema).parquet(f"{self.path}/{stage}/in").select(*rows.columns)
        old = self._rows(base, touched)
        merged = merge(old.select(*rows.columns) if old is not None else new.limit(0), new)
        merged.withColumn(BUCKET, bucket).write.partitionBy(BUCKET).parquet(f"{self.path}/{stage}/out")
        written = self._buckets(f"{stage}/out")
        places = {b: p for b, p in base["buckets"].items() if int(b) not in touched} | {str(b): f"{stage}/out/{BUCKET}={b}" for b in written}
        for name, df in sides.items():
            df.write.parquet(f"{self.path}/{stage}/{name}")
        beside = base["sides"] | {name: f"{stage}/{name}" for name in sides}
        number = base["version"] + 1
        self._publish(number, {"version": number, "buckets": places, "sides": beside, "schema": rows.schema.jsonValue()})
        return number

    def _buckets(self, folder: str) -> list[int]:
        return sorted(int(n.split("=")[1]) for n in self._names(folder) if n.startswith(f"{BUCKET}="))

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what none of the last `keep` versions names, the leavings of writers that failed included, so no writer may
        be at work; older versions can't be read after it. Returns the number of folders that went."""
        numbers = range(max(1, self.version() - keep + 1), self.version() + 1)
        used = {p.split("/")[1] for n in numbers for m in [self.manifest(n)] for p in [*m["buckets"].values(), *m["sides"].values()]}
        gone = [("data", n) for n in self._names("data") if n not in used]
        gone += [("_versions", n) for n in self._names("_versions") if n.endswith(".json") and int(n.split(".")[0]) < min(numbers, default=0)]
        for below in gone:
            path, fs = self._hadoop(*below)
            fs.delete(path, True)
        return len(gone)


def changed_files(spark: SparkSession, source: str, table: Table) -> tuple[DataFrame, DataFrame]:
    """((path, modified) of the files at source that the table's cursor has not seen as they are, the cursor with them)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(source).select("path", F.col("modificationTime").alias("modified"))
    seen = table.side("cursor")
    if seen is None:
        return files, files
    fresh = files.join(seen, ["path", "modified"], "left_anti")
    return fresh, seen.join(fresh.select("path"), "path", "left_anti").select("path", "modified").unionByName(fresh)


def ingest(spark: SparkSession, source: str, schema: str, table: Table, *order: str) -> int:
    """Brings the files at source that are new or have changed since the last run into the table and says how many.

    What was read (path and time of modification) is the table's cursor,
    committed with the rows: after a failure the next run finds both as they
    were. Files that are unchanged are not opened. Rows of a key follow order.
    """
    fresh, cursor = changed_files(spark, source, table)
    paths = [r[0] for r in fresh.select("path").collect()]  # no longer than the list of files that Spark's readers make
    if paths:
        rows = spark.read.schema(schema).parquet(*paths)
        table.upsert(rows, *order, sides={"cursor": cursor})
    return len(paths)
