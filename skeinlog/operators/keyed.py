"""A table of rows by key that is merged into, a version at a time.

Rows lie in buckets by the hash of their key. A merge reads the buckets that its rows fall into, writes these anew beside the old ones,
and then adds a manifest, which names a folder for each bucket, under the next version's number. A manifest appears whole or not at all,
and only one writer can take a number: another that finds it taken looks at what has changed and, where that is a bucket of its own,
merges again. What a manifest names never changes, so a reader keeps the version that it began with.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors.exceptions.captured import CapturedException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, TRIES = 64, 16


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the versions that are there, in order."""
    return [int(n[:-5]) for n in _names(spark, f"{path}/_versions") if n.endswith(".json") and n[:-5].isdigit()]


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """What a version, by default the last, is made of; None if there is none."""
    known = versions(spark, path)
    if not known:
        return None
    fs, at = _fs(spark, f"{path}/_versions/{version or known[-1]:012d}.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _commit(spark: SparkSession, path: str, entry: dict) -> bool:
    """Puts the manifest in its place; False if another writer has taken it."""
    jvm = spark._jvm
    fs, beside = _fs(spark, f"{path}/_versions/.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(json.dumps(entry, sort_keys=True).encode()))
    out.close()
    target = _fs(spark, f"{path}/_versions/{entry['version']:012d}.json")[1]
    qualified = fs.makeQualified(beside)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), spark._jsc.hadoopConfiguration())
    option = jvm.org.apache.hadoop.fs.Options.Rename
    try:
        context.rename(qualified, fs.makeQualified(target), spark.sparkContext._gateway.new_array(option, 0))  # fails where the target is there
        return True
    except Exception as e:
        fs.delete(beside, False)
        cause = e.java_exception.toString() if hasattr(e, "java_exception") else str(e)
        if "FileAlreadyExists" in cause or isinstance(e, CapturedException) and "already exists" in str(e):
            return False
        raise


def _of(spark: SparkSession, path: str, entry: dict, buckets: set[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(entry["schema"])
    folders = [f"{path}/data/{at}/__bucket={b}" for b, at in entry["folders"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default of the last. A store that isn't there is an error: it has no columns."""
    entry = manifest(spark, path, version)
    if entry is None:
        raise FileNotFoundError(f"no version below {path}")
    return _of(spark, path, entry)


def merge(rows: DataFrame, path: str, key: str, at: str, buckets: int = BUCKETS) -> int:
    """Merges rows into the store at path and returns its new version.

    Of the rows of one key, old and new, that with the greatest `at` stays (a null is the least; of equal ones a new row). Rows of other
    keys stay as they are. A null key is an error. Rows must have the store's columns. `buckets` counts for a new store only. A bucket
    is written by one task, so there should be enough of them; none is read that no row falls into. No rows, no version.
    """
    spark = rows.sparkSession
    for _ in range(TRIES):
        base = manifest(spark, path) or {"version": 0, "key": key, "buckets": buckets, "folders": {}, "schema": rows.schema.jsonValue()}
        if base["key"] != key:
            raise ValueError(f"rows of {path} are kept by {base['key']}, not by {key}")
        if {c: t for c, t in rows.dtypes} != {c: t for c, t in _of(spark, path, base, set()).dtypes}:
            raise ValueError(f"columns differ from those of {path}")
        sound = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a row without {key}"))).otherwise(F.pmod(F.xxhash64(key), F.lit(base["buckets"])))
        new = rows.withColumn("__bucket", sound.cast("int"))
        touched = {r[0] for r in new.select("__bucket").distinct().collect()}
        if not touched:
            return base["version"]
        old = _of(spark, path, base, touched).withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(base["buckets"])).cast("int"))
        both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
        rest = [c for c in rows.columns if c != key]
        last = F.max_by(F.struct(*rest), F.struct(F.col(at).isNotNull().alias("some"), at, "__new"))
        kept = both.groupBy("__bucket", key).agg(last.alias("__r")).select("__bucket", key, "__r.*").select("__bucket", *rows.columns)
        folder = uuid.uuid4().hex
        kept.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{path}/data/{folder}")
        while True:
            entry = base | {"version": base["version"] + 1, "folders": base["folders"] | {str(b): folder for b in sorted(touched)}}
            if _commit(spark, path, entry):
                return entry["version"]
            now = manifest(spark, path)
            mine = lambda m: {b: m["folders"].get(str(b)) for b in touched}
            if mine(now) != mine(base):
                break  # another writer has changed a bucket of ours: merge into what it left
            base = now
    raise RuntimeError(f"{path} changed {TRIES} times while rows were merged into it")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all versions but the newest `keep`, and the folders that none of those names; returns how many folders went. Not to be
    run while others write: what they have written and not committed yet has no name either."""
    known = versions(spark, path)
    named = {at for v in known[-keep:] for at in manifest(spark, path, v)["folders"].values()}
    for v in known[:-keep]:
        fs, at = _fs(spark, f"{path}/_versions/{v:012d}.json")
        fs.delete(at, False)
    gone = [n for n in _names(spark, f"{path}/data") if n not in named]
    for n in gone:
        fs, at = _fs(spark, f"{path}/data/{n}")
        fs.delete(at, True)
    return len(gone)
