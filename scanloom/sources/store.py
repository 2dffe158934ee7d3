"""A store of layouts by file that is added to, in versions.

Rows lie in buckets by a hash of their file.  A version is a manifest that names each
bucket's folder; folders are written once and never changed, so a reader keeps what its
version had.  Saving writes the buckets that it touches anew, and then moves the manifest
of the next version into place, which fails if there is one: the writer that comes second
merges again with what the first has written.  A write that fails leaves folders that no
manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
SCHEMA = "file string, ver int, tiers array<double>, ratio double, read_ratio double, std_pitch double"
TRIES = 20


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that are there, in order."""
    fs, folder = _fs(spark, path), _path(spark, f"{path}/versions")
    if not fs.exists(folder):
        return []
    names = (x.getPath().getName() for x in fs.listStatus(folder))
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int) -> dict:
    """{"version", "buckets": {bucket: folder}} of a version; 0 is empty."""
    if not version:
        return {"version": 0, "buckets": {}}
    return json.loads(spark.read.text(f"{path}/versions/{version}.json", wholetext=True).first()[0])


def _publish(spark: SparkSession, path: str, found: dict) -> bool:
    """Move a manifest to its place, unless its version is there already."""
    fs = _fs(spark, path)
    there = f"{path}/versions/{found['version']}.json"
    draft = _path(spark, f"{path}/drafts/{uuid.uuid4().hex}")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    fs.mkdirs(_path(spark, f"{path}/versions"))
    moved = not fs.exists(_path(spark, there))
    try:
        if moved:
            context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), spark._jsc.hadoopConfiguration())
            none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
            context.rename(draft.makeQualified(fs.getUri(), fs.getWorkingDirectory()), _path(spark, there).makeQualified(fs.getUri(), fs.getWorkingDirectory()), none)
    except Exception as e:
        if "FileAlreadyExists" not in str(e):
            raise
        moved = False
    if not moved:
        fs.delete(draft, False)
    return moved


def _rows(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(*folders) if folders else spark.createDataFrame([], SCHEMA)


def load(spark: SparkSession, path: str, rules: int, version: int | None = None) -> DataFrame:
    """The layouts found under these rules, of the last version or of the given one.  A store
    that isn't there is empty."""
    last = (versions(spark, path) or [0])[-1] if version is None else version
    return _rows(spark, sorted(manifest(spark, path, last)["buckets"].values())).filter(F.col("ver") == rules)


def save(layouts: DataFrame, path: str, rules: int, buckets: int = BUCKETS) -> int:
    """Add layouts (file, tiers, ratio, read_ratio, std_pitch; those absent are null) to the
    store, in place of what it has of their files, and return the version.

    A null file is refused; of several rows of one file the greatest counts.  Without rows
    there is no new version.  The number of buckets is that of the first version.
    """
    spark = layouts.sparkSession
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = dict(c.split() for c in SCHEMA.split(", "))
    given = layouts.select(*((F.lit(rules) if c == "ver" else F.col(c) if c in layouts.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in columns))
    one = given.groupBy("file").agg(F.max(F.struct(*(c for c in columns if c != "file"))).alias("x")).select("file", "x.*").select(*columns)
    for _ in range(TRIES):
        found = manifest(spark, path, (versions(spark, path) or [0])[-1])
        n = found.get("n", buckets)
        bucket = F.pmod(F.xxhash64("file"), F.lit(n)).cast("int")
        touched = one.groupBy(bucket.alias("bucket")).agg(F.max(F.col("file").isNull()).alias("none")).collect()  # at most n rows
        if any(r["none"] for r in touched):
            raise ValueError("a layout without a file")
        if not touched:
            return found["version"]
        old = _rows(spark, [folder for b, folder in found["buckets"].items() if int(b) in {r["bucket"] for r in touched}])
        merged = old.join(one.select("file"), "file", "left_anti").select(*columns).union(one)
        data = f"{path}/data/{uuid.uuid4().hex}"
        merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(data)
        new = {str(r["bucket"]): f"{data}/bucket={r['bucket']}" for r in touched}
        if _publish(spark, path, {"version": found["version"] + 1, "n": n, "buckets": found["buckets"] | new}):
            return found["version"] + 1
    raise RuntimeError(f"{TRIES} other writers came first")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Delete all but the last ``keep`` versions, and folders that none of those names; not
    while others write."""
    fs, all_ = _fs(spark, path), versions(spark, path)
    named = {f for v in all_[-keep:] for f in manifest(spark, path, v)["buckets"].values()}
    for v in all_[:-keep]:
        fs.delete(_path(spark, f"{path}/versions/{v}.json"), False)
    gone = []
    for run in fs.listStatus(_path(spark, f"{path}/data")):
        for folder in fs.listStatus(run.getPath()):
            name = folder.getPath().toString().split("/data/")[-1]
            if folder.isDirectory() and not any(x.endswith(f"/data/{name}") for x in named):
                fs.delete(folder.getPath(), True)
                gone.append(name)
    return gone
