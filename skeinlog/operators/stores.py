"""Stores of rows by key: upserts, frozen copies, differences, retention, contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.functions.text import sha_hex
from skeinlog.operators import keyed


def upsert(old: DataFrame, new: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each key of both tables, that with the greatest `at`."""
    rest = [c for c in old.columns if c != key]
    both = old.select(key, *rest).unionByName(new.select(key, *rest))
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("__r")).select(key, "__r.*")


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def mark(keys: DataFrame, more: DataFrame, key: str = "key") -> DataFrame:
    return keys.select(key).union(more.select(key)).distinct()


def unmark(keys: DataFrame, less: DataFrame, key: str = "key") -> DataFrame:
    return keys.select(key).join(less.select(key), key, "left_anti")


def frozen_diff(frozen: DataFrame, live: DataFrame, key: str, content: str) -> DataFrame:
    """(key, state): same, diverged (content differs), gone (frozen only) or new (live only)."""
    a = frozen.select(F.col(key).alias("a"), sha_hex(F.col(content)).alias("x"))
    b = live.select(F.col(key).alias("b"), sha_hex(F.col(content)).alias("y"))
    state = F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "new").when(F.col("x") == F.col("y"), "same").otherwise("diverged")
    return a.join(b, F.col("a") == F.col("b"), "full").select(F.coalesce("a", "b").alias(key), state.alias("state"))


def freeze(spark: SparkSession, path: str, frozen: DataFrame, live: DataFrame, key: str, content: str) -> DataFrame:
    """Appends the rows of live that are new to the frozen table at path. A frozen row never changes: one that differs is an error."""
    diff = frozen_diff(frozen, live, key, content)
    bad = [r[0] for r in diff.where("state = 'diverged'").orderBy(key).limit(10).collect()]
    if bad:
        raise ValueError(f"frozen rows differ from live ones: {bad}")
    new = live.join(diff.where("state = 'new'").select(key), key, "left_semi")
    new.write.mode("append").parquet(path)
    return new


def write_bundles(evidence: DataFrame, path: str) -> None:
    """A folder for each repo, ids prefixed by it; dates of sessions are left out by selection, not by a filter of values."""
    rows = evidence.drop("session_dates").withColumn("id", F.concat_ws("/", "repo", "id"))
    rows.repartition("repo").write.partitionBy("repo").mode("overwrite").json(path)


def contract(rows: DataFrame, arrays: list[str]) -> DataFrame:
    """(json): each row as an object in which a missing array is an empty one and other missing fields are left out."""
    filled = rows.withColumns({a: F.coalesce(a, F.array().cast(rows.schema[a].dataType)) for a in arrays})
    return filled.select(F.to_json(F.struct(*filled.columns)).alias("json"))


def envelope(raw: DataFrame, c: str) -> DataFrame:
    """raw with output (variant) and failure: why a model's answer can't be used, null if it can."""
    v = F.try_parse_json(c)
    out = F.try_variant_get(v, "$.structured_output", "variant")
    failed = F.coalesce(F.try_variant_get(v, "$.is_error", "boolean"), F.lit(False))
    why = F.when(v.isNull(), "not JSON").when(failed, "model error").when(out.isNull() | F.is_variant_null(out), "no output")
    return raw.withColumns({"output": F.when(why.isNull(), out), "failure": why})


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def store_analyses(rows: DataFrame, path: str, key: str = "session_id", at: str = "transcript_mtime", buckets: int = keyed.BUCKETS) -> int:
    """Merges analyses into the store at path, the newest of each session; those of other sessions stay. Returns the store's version."""
    return keyed.merge(rows, path, key, at, buckets)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written beside and then renamed over the old one, so that a reader sees all of either."""
    jvm = spark._jvm
    fs, at = _fs(spark, path)
    _, beside = _fs(spark, path + ".tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(at).toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(beside), fs.makeQualified(at), over)


def store_snapshot(spark: SparkSession, folder: str, text: str, instant: str, keep: int = 10) -> str:
    """Writes a snapshot under its instant (YYYY-MM-DDTHH-MM-SSZ) and leaves the newest `keep`. A failure to remove is no failure to store."""
    write_text(spark, f"{folder}/{instant}.json", text)
    fs, at = _fs(spark, folder)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))
    for name in names[:-keep]:
        try:
            fs.delete(_fs(spark, f"{folder}/{name}")[1], False)
        except Exception as e:
            print(f"not removed: {name}: {e}")
    return f"{instant}.json"


class Cache:
    """Results by stage and hash of their inputs, each in a file of its own. A file that can't be read is an error, never a miss."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def get(self, stage: str, key: str):
        import json

        fs, at = _fs(self.spark, f"{self.root}/{stage}/{key}.json")
        if not fs.exists(at):
            return None
        try:
            return json.loads(self.spark.read.text(at.toString(), wholetext=True).first()[0])
        except (ValueError, TypeError) as e:
            raise ValueError(f"corrupt entry {stage}/{key}") from e

    def put(self, stage: str, key: str, value) -> None:
        import json

        write_text(self.spark, f"{self.root}/{stage}/{key}.json", json.dumps(value, sort_keys=True))


def publish(spark: SparkSession, local: str, public: str, name: str, text: str, patterns) -> None:
    """Keeps text in local in any case, and in public only if no pattern(label, regex) matches; the error names labels, never matches."""
    from skeinlog.functions.text import private_labels

    write_text(spark, f"{local}/{name}", text)
    labels = spark.createDataFrame([(text,)], "t string").select(private_labels(F.col("t"), patterns)).first()[0]
    if labels:
        raise ValueError(f"{name} stays local, it holds: {', '.join(labels)}")
    write_text(spark, f"{public}/{name}", text)


def cards_markdown(cards: DataFrame) -> DataFrame:
    """(text): a section for each card(target, trigger, level, text, note), in order of target and trigger."""
    body = F.concat(F.lit("## "), F.col("target").cast("string"), F.lit(" — "), F.col("trigger"), F.lit("\n\n"), F.concat_ws("\n\n", F.concat(F.lit("> "), F.nullif("text", F.lit(""))), F.concat(F.lit("level "), F.col("level").cast("string")), F.nullif("note", F.lit(""))))
    rows = F.sort_array(F.collect_list(F.struct(F.col("target").cast("string").alias("t"), "trigger", body.alias("b"))))
    return cards.agg(F.array_join(F.transform(rows, lambda r: r["b"]), "\n\n").alias("text"))
