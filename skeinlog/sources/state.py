"""Readers of what runs leave behind: pools, snapshots, verdicts, adjudications, rubrics, settings, frozen corpora.

Whatever is strict names the file that it refuses; whatever is tolerant returns an empty table or the defaults, as each docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.operators.scoring import adjudication_key

# Defaults of the settings, and what a rubric may say.
DEFAULTS = {"cadence_days": 14, "min_sessions": 10, "due_new_sessions": 10}
PARTS, TIERS, SURFACES = ("regression", "gap", "negative"), ("HIGH", "MODERATE-HIGH", "MODERATE", "MEDIUM"), ("theme", "recommendation", "either")
STATUSES = ("must_pass", "expected_partial", "expected_fail", "needs_reconfirmation", "invalidated")
RUBRIC = (
    "id string, part string, tier string, surface string, statement string, pass_at string, seed_status string, anchor_theme string, repos array<string>, anchor_session_ids array<string>, "
    "source_theme_session_ids array<string>, required_nuances array<string>, forbidden_generalizations array<string>, file string, hash string"
)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def documents(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(name, mtime, raw, v): each file of a folder; v is null where it isn't an object in JSON. A folder that lacks gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "name string, mtime timestamp, raw string").withColumn("v", F.try_parse_json("raw"))
    rows = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("_metadata.file_modification_time").alias("mtime"), F.col("value").alias("raw"))
    v = F.try_parse_json("raw")
    return rows.withColumn("v", F.when(F.schema_of_variant(v).startswith("OBJECT"), v))


def strict(docs: DataFrame) -> DataFrame:
    """docs, of which a malformed one is an error that names it, wherever its v is read."""
    return docs.withColumn("v", F.coalesce("v", F.raise_error(F.concat(F.lit("malformed: "), F.col("name"))).cast("variant")))


def pool(spark: SparkSession, path: str) -> DataFrame:
    """(session_id, transcript_mtime, analysed_at, v): stored analyses, all of which must be sound. analysed_at is the file's time."""
    d = strict(documents(spark, path))
    got = lambda p: F.try_variant_get("v", p, "string")
    return d.select(F.coalesce(got("$.stats.session_id"), F.regexp_extract("name", r"^(.*)\.json$", 1)).alias("session_id"), F.try_to_timestamp(got("$.transcript_mtime")).alias("transcript_mtime"), F.col("mtime").alias("analysed_at"), "v")


def pool_entries(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("session_id"), "session_id", "left_semi")


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot by name that is sound; no row without one."""
    return documents(spark, path).where("v is not null").orderBy(F.desc("name")).limit(1)


def ground_truth(spark: SparkSession, root: str, apart: str = "global") -> DataFrame:
    """(repo, name, v): of each folder but `apart` the newest sound snapshot."""
    d = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").text(root, wholetext=True)
    d = d.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("repo"), F.col("_metadata.file_name").alias("name"), F.try_parse_json("value").alias("v"))
    return d.where((F.col("repo") != apart) & F.schema_of_variant("v").startswith("OBJECT")).groupBy("repo").agg(F.max("name").alias("name")).join(d, ["repo", "name"])


def settings(spark: SparkSession, path: str) -> dict:
    """Settings in YAML over the defaults; numbers of 0 or less are as good as none, a file that lacks gives the defaults."""
    import yaml

    given = yaml.safe_load(spark.read.text(path, wholetext=True).first()[0]) if exists(spark, path) else {}
    if given is not None and not isinstance(given, dict):
        raise ValueError(f"{path}: not a mapping")
    out = DEFAULTS | (given or {})
    return out | {k: n for k, n in DEFAULTS.items() if not out[k] or out[k] <= 0}


def acted_keys(spark: SparkSession, path: str) -> DataFrame:
    """(key) of a JSON array of strings; none where it lacks or isn't one."""
    raw = spark.read.text(path, wholetext=True).select("value") if exists(spark, path) else spark.createDataFrame([], "value string")
    return raw.select(F.explode(F.from_json("value", "array<string>")).alias("key")).where("key is not null").distinct()


def run_state(spark: SparkSession, path: str) -> DataFrame:
    """(v): the state of the last run; no row where it lacks or isn't sound."""
    raw = spark.read.text(path, wholetext=True) if exists(spark, path) else spark.createDataFrame([], "value string")
    v = F.try_parse_json("value")
    return raw.select(v.alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """(name, mtime, raw, v): all committed verdicts by name; each must be sound."""
    return strict(documents(spark, path)).orderBy("name")


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """The record with the greatest ran_at; records must be sound."""
    return strict(documents(spark, path)).withColumn("ran_at", F.try_to_timestamp(F.try_variant_get("v", "$.ran_at", "string"))).where("ran_at is not null").orderBy(F.desc("ran_at"), F.desc("name")).limit(1)


def adjudications(rows: DataFrame) -> DataFrame:
    """rows(target, statement, session_ids, rubric_hash, trigger, key_hash, decision), of which each must decide accept or reject, under
    the hash of its own key: an entry that was edited by hand would never match again, so it is an error."""
    key = adjudication_key(F.col("target"), F.col("statement"), F.col("session_ids"), F.col("rubric_hash"), F.col("trigger"))
    bad = F.when(~F.coalesce(F.col("decision").isin("accept", "reject"), F.lit(False)), "decision").when(~F.col("key_hash").eqNullSafe(key), "key_hash")
    return rows.withColumn("decision", F.when(bad.isNull(), F.col("decision")).otherwise(F.raise_error(F.concat(F.lit("adjudication "), F.coalesce("key_hash", F.lit("")), F.lit(": bad "), bad)).cast("string")))


def private_patterns(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(label, pattern) for each line that is neither empty nor a comment, whatever the case; a bad one is named by its line only."""
    import re

    if not exists(spark, path):
        return []
    out = []
    for n, raw in enumerate(spark.read.text(path, wholetext=True).first()[0].split("\n"), 1):
        line = raw.strip()
        if line and not line.startswith("#"):
            try:
                re.compile(line)
            except re.error:
                raise ValueError(f"{path}: line {n} is no pattern") from None
            out.append((f"private_{n}", f"(?i){line}"))
    return out


def card_by_prefix(cards: DataFrame, prefix: str) -> DataFrame:
    """The one card whose key_hash begins with prefix; none, several, or one that can't be decided is an error."""
    found = cards.where(F.col("key_hash").startswith(prefix)).dropDuplicates(["key_hash"]).limit(2)
    rows = found.select("key_hash", "adjudicable").collect()
    if len(rows) != 1 or not rows[0]["adjudicable"]:
        raise ValueError(f"{prefix}: " + ("no card" if not rows else "several cards" if len(rows) > 1 else "not to be decided"))
    return found


def rubrics(spark: SparkSession, path: str) -> DataFrame:
    """Rubrics, a YAML file each, by id, with pass_at and status filled in. Unknown fields, two of one id, a broken rule, or no file at
    all is an error: a wrong folder must never look like a benchmark without targets."""
    import hashlib

    import yaml

    files = spark.read.option("pathGlobFilter", "*.yaml").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value").collect() if exists(spark, path) else []
    if not files:
        raise ValueError(f"{path}: no rubrics")
    fields = [f.split(" ")[0] for f in RUBRIC.split(", ")]
    rows = []
    for file, raw in files:  # a rubric is written by hand, so there are few
        given = yaml.safe_load(raw)
        unknown = set(given if isinstance(given, dict) else {"": 0}) - set(fields[:-2])
        if unknown:
            raise ValueError(f"{file}: unknown fields {sorted(unknown)}")
        rows.append(tuple((given | {"file": file, "hash": hashlib.sha256(raw.encode()).hexdigest()}).get(f) for f in fields))
    df = spark.createDataFrame(rows, RUBRIC)
    bad = rubric_errors(df).orderBy("file", "error").collect()
    if bad:
        raise ValueError("; ".join(f"{r.file}: {r.error}" for r in bad))
    return with_defaults(df).orderBy("id")


def rubric_errors(df: DataFrame) -> DataFrame:
    """(file, id, error): every rule that a rubric breaks."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    said = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    target, negative = F.col("part").isin("regression", "gap"), F.col("part") == "negative"
    anchored, source = some("anchor_session_ids"), some("source_theme_session_ids")
    cut = F.length("anchor_theme") - F.length(F.substring_index("anchor_theme", "/", -1)) - 1
    rules = (
        ("id and statement", ~said("id") | ~said("statement")), ("part", ~F.coalesce(F.col("part").isin(*PARTS), F.lit(False))), ("tier", target & ~F.coalesce(F.col("tier").isin(*TIERS), F.lit(False))),
        ("surface", target & ~F.coalesce(F.col("surface").isin(*SURFACES), F.lit(False))), ("repos", target & ~some("repos")), ("anchors of a gap", (F.col("part") == "gap") & anchored),
        ("source sessions of anchors", target & anchored & ~source), ("anchors outside of the source", target & anchored & source & (F.size(F.array_except("anchor_session_ids", "source_theme_session_ids")) > 0)),
        ("anchor_theme", target & anchored & said("anchor_theme") & ~F.col("anchor_theme").rlike(r"^.+/\d+$")), ("bucket of anchor_theme", target & anchored & F.col("anchor_theme").rlike(r"^.+/\d+$") & (F.substr("anchor_theme", F.lit(1), cut) != F.get("repos", 0))),
        ("anchor_theme without anchors", target & ~anchored & said("anchor_theme")), ("source sessions without anchors", target & ~anchored & source),
        ("anchors of a negative", negative & (anchored | source | said("anchor_theme"))), ("pass_at", said("pass_at") & ~F.col("pass_at").isin("full", "partial")), ("seed_status", said("seed_status") & ~F.col("seed_status").isin(*STATUSES)),
    )
    found = df.select("file", "id", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules]))).alias("error"))
    twice = df.groupBy("id").agg(F.count("*").alias("n"), F.max("file").alias("file")).where("n > 1 and id <> ''").select("file", "id", F.lit("id of another file").alias("error"))
    return found.unionByName(twice)


def with_defaults(df: DataFrame) -> DataFrame:
    """pass_at: full for HIGH, else partial; status: what the rubric says, expected_fail for gaps, else must_pass."""
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    return df.withColumns({"pass_at": F.coalesce(given("pass_at"), F.when(F.col("tier") == "HIGH", "full").otherwise("partial")), "status": F.coalesce(given("seed_status"), F.when(F.col("part") == "gap", "expected_fail").otherwise("must_pass"))})


def status_gaps(targets: DataFrame, statuses: DataFrame) -> DataFrame:
    """(id, problem): rubrics(id, part) that aren't negative and have no valid status."""
    j = targets.where("part <> 'negative'").select("id").join(statuses.select("id", "status"), "id", "left")
    problem = F.when(F.col("status").isNull(), "missing").when(~F.col("status").isin(*STATUSES), "invalid")
    return j.select("id", problem.alias("problem")).where("problem is not null")


def sidechains(spark: SparkSession, root: str) -> DataFrame:
    """(path, parent, bytes): agents' transcripts, at any depth below a session's folder `subagents`; the folder before it is the parent."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", "agent-*.jsonl").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("bytes"))
    return d.withColumn("parent", F.regexp_extract("path", r"([^/]+)/subagents/(?:[^/]+/)*agent-[^/]*$", 1)).where("parent <> ''").select("path", "parent", "bytes")


def frozen(spark: SparkSession, root: str, manifest: DataFrame) -> DataFrame:
    """(id, path, text) of the files of manifest(id, path, sha256), relative to root; gzip is read as it is. A file that lacks or whose
    text has another hash is an error that names it."""
    d = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("at"), F.col("value").alias("text"))
    base = F.lit(root.rstrip("/").removeprefix("file://") + "/")
    d = d.withColumn("path", F.substr(F.regexp_replace("at", r"^file:/*/", "/"), F.length(base) + 1)).drop("at")
    j = manifest.join(d, "path", "left")
    wrong = ~F.sha2(F.encode("text", "UTF-8"), 256).eqNullSafe(F.col("sha256"))
    return j.select("id", "path", F.when(~wrong, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("frozen file lacks or differs: "), F.col("path"))).cast("string")).alias("text"))


def frozen_gaps(ids: DataFrame, manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """(id, problem): ids that the manifest(id, mtime) lacks (gap), or whose pool entry(id, mtime) is of another time (skew)."""
    j = ids.select("id").join(manifest.select("id", F.col("mtime").alias("m")), "id", "left").join(entries.select("id", F.col("mtime").alias("p")), "id", "left")
    problem = F.when(F.col("m").isNull(), "gap").when(F.col("p").isNotNull() & (F.col("p") != F.col("m")), "skew")
    return j.select("id", problem.alias("problem")).where("problem is not null")
