"""Secret scanning over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. A ledger keeps, for each blob, which (rule, rule version)
pairs have been tried on it and what they found. A run takes one row for each blob that lacks a pair, tries only the pairs that
lack, appends to the ledger, and joins the findings of the present rule versions back to all paths by the blob's address.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm.common import scratch, table, text_of, without


@dataclass(frozen=True)
class Rule:
    """A pattern; `least` is the least length of its group `group`. `may` is true of every text that has a finding."""

    kind: str
    pattern: str
    group: int
    least: int
    may: str
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


_NAMED = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]%s)"""
#: In the order in which kinds sort. The first three are the base rules.
RULES = (
    Rule("assign", "(?i)" + _NAMED % "+", 2, 8, "(?i)" + _NAMED % "{8}"),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16, "AKIA[A-Z0-9]{12}"),
    Rule("hex", "[0-9a-f]+", 0, 32, "[0-9a-f]{32}"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\."),
)
BASE = tuple(r.kind for r in RULES[:3])
SPAN = "array<struct<start: int, ord: int, kind: string, version: int, end: int>>"


def spans(text: Column, rule: Rule, order: int) -> Column:
    """The leftmost non-overlapping matches of rule whose group is long enough, in code points.

    SQL has no function for a match's place, but the pieces between matches and the matches add up to the text.
    """
    whole, part = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    zipped = F.arrays_zip(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"), part.alias("part"))

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.char_length(m["gap"])
        end = start + F.char_length(m["whole"])
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), end.alias("end"))
        grown = F.concat(state["out"], F.array(one))
        return F.struct(end.alias("at"), F.when(F.char_length(m["part"]) >= rule.least, grown).otherwise(state["out"]).alias("out"))

    none = F.array().cast(SPAN)
    all_ = F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda s: s["out"])
    return F.when(text.rlike(rule.may), all_).otherwise(none)


def scan(spark: SparkSession, docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, key: str = "doc_id") -> DataFrame:
    """docs (versions of paths, with `text`) with blob and findings, an array of spans sorted by start and kind.

    ledger: a folder for the ledger's table; it need not exist. A blob that the ledger has under all rules is not scanned again;
    a null text is the empty blob; repeated rows and copies share one scan and all get its findings; a null key is allowed. An
    empty table adds nothing to the ledger. Columns of docs named blob or findings give way.
    """
    spark_keys = [r.key for r in rules]
    docs = without(docs, "blob", "findings")
    address = F.unhex(F.sha2(F.encode(text_of("text"), "UTF-8"), 256))
    versions = docs.withColumn("blob", address)
    path = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    seen = None
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        seen = spark.read.parquet(ledger).groupBy("blob").agg(F.flatten(F.collect_list("tried")).alias("__seen"))
    # one path for each blob, then the texts of these paths alone
    one = versions.groupBy("blob").agg(F.min(F.xxhash64(key)).alias("__one"))
    todo = F.array(*map(F.lit, spark_keys))
    if seen is not None:
        one = one.join(seen, "blob", "left").withColumn("__todo", F.when(F.col("__seen").isNull(), todo).otherwise(F.array_except(todo, "__seen")))
        one = one.where(F.size("__todo") > 0).drop("__seen")
    texts = versions.select("blob", F.xxhash64(key).alias("__one"), text_of("text").alias("__text"))
    fresh = texts.join(one, ["blob", "__one"])
    tried = F.col("__todo") if seen is not None else todo
    found = [spans(F.col("__text"), r, i) if seen is None else F.when(F.array_contains("__todo", r.key), spans(F.col("__text"), r, i)).otherwise(F.array().cast(SPAN)) for i, r in enumerate(rules)]
    fresh = fresh.select("blob", tried.alias("tried"), F.concat(*found).alias("spans"))
    fresh.dropDuplicates(["blob"]).write.mode("append").parquet(ledger)

    now = F.filter(F.flatten(F.collect_list("spans")), lambda s: F.concat_ws(":", s["kind"], s["version"]).isin(spark_keys))
    findings = spark.read.parquet(ledger).where(F.size("spans") > 0).groupBy("blob").agg(F.array_sort(now).alias("findings"))
    at = scratch(spark, "findings")
    findings.write.parquet(at)
    back = versions.join(spark.read.parquet(at), "blob", "left")
    return back.withColumn("findings", F.coalesce("findings", F.array().cast(SPAN)))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = scan(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "ledger"))
    said = lambda fs: F.array_join(F.transform(fs, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    return docs.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(F.encode(said(F.filter("findings", lambda s: s["kind"].isin(*BASE))), "UTF-8"), 256).alias("base_sha256"),
        said(F.col("findings")).alias("spans"),
    )
