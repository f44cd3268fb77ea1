"""Transcripts: a growing folder of JSONL files, decoded tolerantly into events, blocks and a canary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_TYPES = ("user", "assistant", "system", "summary", "ai-title", "last-prompt", "mode", "permission-mode", "file-history-snapshot", "queue-operation", "attachment")
#: Fields of a line that are strings.
STRINGS = ("type", "timestamp", "cwd", "gitBranch", "version", "uuid", "parentUuid", "leafUuid", "aiTitle", "attributionSkill", "attributionPlugin")
BLOCK_TYPES = ("text", "thinking", "tool_use", "tool_result", "image")


def refs(spark: SparkSession, root: str) -> DataFrame:
    """(path, session_id, project_dir, mtime, bytes) of the sessions two levels below root: no agent files, no deeper folders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").load(f"{root}/*").select("path", "modificationTime", "length")
    name = F.substring_index("path", "/", -1)
    return files.where(~name.startswith("agent-")).select("path", F.regexp_extract(name, r"^(.+)\.jsonl$", 1).alias("session_id"), F.element_at(F.split("path", "/"), -2).alias("project_dir"), F.col("modificationTime").alias("mtime"), F.col("length").alias("bytes"))


def newest(listing: DataFrame) -> DataFrame:
    """One row for each session: the newest file, of equal ones the first by path."""
    last = listing.groupBy("session_id").agg(F.max("mtime").alias("mtime"))
    best = listing.join(last, ["session_id", "mtime"]).groupBy("session_id", "mtime").agg(F.min_by(F.struct("path", "project_dir", "bytes"), "path").alias("r"))
    return best.select("session_id", "r.path", "r.project_dir", "mtime", "r.bytes")


#: A file of up to so many bytes is read as a value of its own; a larger one is cut at line ends and read by many tasks.
WHOLE = 1 << 26
#: So many pieces of files at most are known to each task (some 60 bytes each); beyond that, lines and pieces meet in a shuffle.
PIECES = 1_000_000


def _split(spark: SparkSession, paths: str | list[str], pieces: int) -> DataFrame:
    """(session_id, line_no, raw) of files that are cut into pieces at line ends. A line knows its piece and its place in the order of a
    task; pieces are counted, and the lines before a piece are added up file by file."""
    lines = spark.read.text(paths, lineSep="\n")
    at = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("piece"), F.col("_metadata.file_size").alias("size")]
    lines = lines.select(*at, F.col("_metadata.file_name").alias("name"), F.col("value").alias("raw"), F.monotonically_increasing_id().alias("row")).where(F.col("size") > WHOLE)
    counted = lines.groupBy("path", "piece").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = counted.select("path", "piece", (before - F.col("first")).alias("off"))
    numbered = lines.join(F.broadcast(counted) if pieces <= PIECES else counted, ["path", "piece"])
    return numbered.select("name", (F.col("row") + F.col("off")).alias("line_no"), "raw")


def raw_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(session_id, line_no, raw): every line of the files at paths, numbered from 0 in each file. No file is too large: only those of
    up to WHOLE bytes are values. Files of agents have no lines here."""
    found = spark.read.format("binaryFile").load(paths).select("length")  # a listing, no file is opened
    least = WHOLE >> 4  # Spark's pieces are larger, but for small settings of spark.sql.files.maxPartitionBytes
    large = found.where(F.col("length") > WHOLE).agg(F.sum(F.ceil(F.col("length") / least)).alias("pieces")).first().pieces
    whole = spark.read.text(paths, wholetext=True).where(F.col("_metadata.file_size") <= WHOLE)
    rows = whole.select(F.col("_metadata.file_name").alias("name"), F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("line_no", "raw")).withColumn("line_no", F.col("line_no").cast("long"))
    if large:
        rows = rows.unionByName(_split(spark, paths, large))
    return rows.select(F.regexp_extract("name", r"^(?!agent-)(.+)\.jsonl$", 1).alias("session_id"), "line_no", "raw").where("session_id <> ''")


def lines(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """(session_id, line_no, raw, v): every line that isn't blank, of any length, of the sessions below root, or of a list of files; v is
    null where it isn't an object in JSON."""
    return decode(raw_lines(spark, f"{root}/*/*.jsonl" if isinstance(root, str) else root))


def decode(raw: DataFrame) -> DataFrame:
    """raw(session_id, line_no, raw) without blank lines and with v, the line's object; null for what isn't one.

    A line is parsed once: its checks are in a lambda, whose argument is a value, and a generator hands v on, which no filter on v goes
    below. As a plain column the parsing is repeated for every check, and all of them for each filter."""

    def object_of(v: Column) -> Column:
        kind = lambda f: F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{f}", "variant")), F.lit("VOID"))
        sound = F.schema_of_variant(v).startswith("OBJECT")
        for f in STRINGS:  # a wrong type makes the whole line malformed; a null is as good as none
            sound = sound & kind(f).isin("STRING", "VOID")
        return F.when(sound, v)

    lines = raw.where(F.trim("raw") != "").select("session_id", F.col("line_no").cast("long").alias("line_no"), "raw")
    return lines.select("*", F.explode(F.transform(F.array(F.try_parse_json("raw")), object_of)).alias("v"))


def _get(path: str, kind: str = "string", v: str = "v") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def _typed(path: str, name: str, kind: str = "string", v: str = "v") -> Column:
    """The value at path if it has that type in JSON; a cast never makes one up."""
    return F.when(F.schema_of_variant(_get(path, "variant", v)) == name, _get(path, kind, v))


def events(decoded: DataFrame) -> DataFrame:
    """A row for each well-formed line. A bad timestamp is none."""
    text = _typed("$.timestamp", "STRING")
    ts = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"), F.try_to_timestamp(text))
    usage = lambda k: F.coalesce(_get(f"$.message.usage.{k}", "bigint"), F.lit(0).cast("long"))
    patch = F.expr("try_variant_get(v, '$.toolUseResult.structuredPatch', 'array<struct<lines: array<string>>>')")
    return decoded.where("v is not null").select(
        "session_id", "line_no", "v",
        F.coalesce(_typed("$.type", "STRING"), F.lit("")).alias("type"), ts.alias("ts"),
        _get("$.cwd").alias("cwd"), _get("$.gitBranch").alias("git_branch"), _get("$.version").alias("version"), _get("$.aiTitle").alias("ai_title"),
        _get("$.attributionSkill").alias("skill"), _get("$.message.id").alias("message_id"), _get("$.message.model").alias("model"),
        usage("input_tokens").alias("input_tokens"), usage("output_tokens").alias("output_tokens"),
        usage("cache_creation_input_tokens").alias("cache_creation"), usage("cache_read_input_tokens").alias("cache_read"),
        F.nullif(_get("$.toolUseResult.filePath"), F.lit("")).alias("result_path"), _get("$.toolUseResult.type").alias("result_type"),
        F.flatten(F.transform(patch, lambda h: h["lines"])).alias("patch_lines"), F.coalesce(F.size(patch) > 0, F.lit(False)).alias("patched"),
        (_get("$.message.usage", "variant").isNotNull()).alias("has_usage"),
    )


def blocks(of: DataFrame) -> DataFrame:
    """(session_id, line_no, block_no, line_type, block_type, text, tool_name, tool_input, has_is_error, is_error, body): a content that
    is a string is one text block; one that is neither string nor array has none."""
    content = _get("$.message.content", "variant")
    kind = F.schema_of_variant(content)
    one = F.array(F.struct(F.lit(0).alias("pos"), F.lit(None).cast("variant").alias("b"), _get("$.message.content").alias("s")))
    listed = F.transform(_get("$.message.content", "array<variant>"), lambda b, i: F.struct(i.alias("pos"), b.alias("b"), F.lit(None).cast("string").alias("s")))
    rows = of.select("session_id", "line_no", F.col("type").alias("line_type"), F.explode(F.when(kind == "STRING", one).when(kind.startswith("ARRAY"), listed)).alias("x"))
    rows = rows.select("session_id", "line_no", F.col("x.pos").alias("block_no"), "line_type", F.col("x.b").alias("b"), F.col("x.s").alias("s"))
    got = lambda p, k="string": _get(p, k, "b")
    inner = F.schema_of_variant(got("$.content", "variant"))
    joined = F.array_join(F.transform(F.expr("try_variant_get(b, '$.content', 'array<struct<text: string>>')"), lambda x: F.coalesce(x["text"], F.lit(""))), "")
    kind = F.when(F.col("s").isNotNull(), "text").otherwise(F.coalesce(got("$.type"), F.lit("")))
    return rows.select(
        "session_id", "line_no", "block_no", "line_type", kind.alias("block_type"),
        F.coalesce("s", F.when(got("$.type") == "thinking", got("$.thinking")).otherwise(got("$.text")), F.lit("")).alias("text"),
        got("$.name").alias("tool_name"), got("$.input", "variant").alias("tool_input"),
        got("$.is_error", "variant").isNotNull().alias("has_is_error"),
        F.coalesce(_typed("$.is_error", "BOOLEAN", "boolean", "b"), F.lit(False)).alias("is_error"),
        F.coalesce(F.when(inner == "STRING", got("$.content")).when(inner.startswith("ARRAY"), joined), F.lit("")).alias("body"),
    )


def canary(decoded: DataFrame) -> DataFrame:
    """(session_id, kind, key, n): what drifted from the known format: malformed lines, unknown types, missing fields."""
    bad = decoded.where("v is null").select("session_id", F.lit("malformed").alias("kind"), F.lit("line").alias("key"))
    ev = events(decoded)
    unknown = ev.where(~F.col("type").isin(*LINE_TYPES)).select("session_id", F.lit("unknown_line_type").alias("kind"), F.col("type").alias("key"))
    odd = blocks(ev).where(~F.col("block_type").isin(*BLOCK_TYPES)).select("session_id", F.lit("unknown_block_type").alias("kind"), F.col("block_type").alias("key"))
    message = F.col("type").isin("user", "assistant")
    missing = F.array_compact(F.array(F.when(message & F.col("ts").isNull(), "timestamp"), F.when((F.col("type") == "assistant") & ~F.col("has_usage"), "assistant.usage")))
    gone = ev.select("session_id", F.lit("missing").alias("kind"), F.explode(missing).alias("key"))
    return bad.unionByName(unknown).unionByName(odd).unionByName(gone).groupBy("session_id", "kind", "key").agg(F.count("*").alias("n"))
