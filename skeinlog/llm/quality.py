"""Quality rules over a bitmask ledger.

Each document's measurements are taken once. Each rule is evaluated once on them, and its outcome is one bit of fail_bits. The ledger
is kept as a table under the version of its rules. A policy is a name, a version and a mask of rules; applying one, comparing two or
leaving a rule out reads the kept ledger and no text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm.common import SPACE, bounded_batches, scratch, table

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ends", "n_alpha_words")
#: Bits in order: name and what makes a document fail. The first two are the base rules.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 10"),
    ("repeated_passages", "100 * n_repeat_words > 20 * n_words"),
    ("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("few_alphabetic_words", "10 * n_alpha_words < 6 * n_words"),
    ("no_sentence_end", "n_ends = 0"),
)
#: The version of the rules: what a ledger's bits mean.
RULESET = hashlib.sha256(repr((MEASURES, RULES)).encode()).hexdigest()[:12]
#: Policies by name and version. A version never changes; a new mask is a new version.
POLICIES: dict[tuple[str, int], tuple[str, ...]] = {
    ("base", 1): ("few_words", "repeated_passages"),
    ("strict", 1): ("few_words", "repeated_passages", "word_length", "symbols", "repeated_lines", "few_alphabetic_words"),
    ("strict", 2): tuple(n for n, _ in RULES),
}


def _repeated(words: list[bytes], width: int = 5) -> int:
    """How many words lie in a window of `width` words that is found twice or more."""
    n = len(words)
    if n <= width:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if n - len(ids) < width:  # two equal windows repeat that many words, or overlap and repeat one often enough
        return 0
    code, k = a[: n - width + 1], n - width + 1
    for i in range(1, width):  # equal codes mean equal windows: codes are made dense before they could overflow
        code = code * np.int64(len(ids)) + a[i : i + k]
        if i < width - 1:
            code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(k, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + width, -1)
    return int((np.cumsum(edge) > 0).sum())


def measure(text: str) -> tuple[int, ...]:
    """The MEASURES of a text."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: exactly the six characters of SPACE separate
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    chars = len(text) - sum(map(text.count, SPACE))
    ends = sum(map(text.count, ".!?"))
    alpha = sum(1 for w in words if w[0] > 64 or w[-1] > 64)
    return len(words), chars, sum(map(text.count, "#*$%&|<>")), dup, _repeated(words), lines, ends, alpha


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [measure(t or "") for t in batch.column("__text").to_pylist()]
        columns = np.array(got, np.int64).reshape(len(got), len(MEASURES)).T
        keep = [n for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + [pa.array(c) for c in columns], keep + list(MEASURES))


def ledger(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, the MEASURES and fail_bits for each row of docs. A null text has no words; a null key and repeated rows stay rows of
    their own; other columns aren't read. An empty table gives an empty ledger."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    got = docs.select(key, F.col("text").alias("__text")).mapInArrow(_measured, f"`{key}` {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(0).cast("long") for i, (_, rule) in enumerate(RULES)]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return got.withColumn("fail_bits", total)


def keep(book: DataFrame, path: str) -> DataFrame:
    """Writes a ledger below path, under the version of its rules, and returns it as it is read from there."""
    book.write.mode("overwrite").parquet(f"{path}/rules={RULESET}")
    return kept(book.sparkSession, path)


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The ledger that keep() wrote. Of other rules than these there is none: their bits mean something else, and Spark's error names the path."""
    return spark.read.parquet(f"{path}/rules={RULESET}")


def mask_of(*names: str) -> int:
    return sum(1 << i for i, (n, _) in enumerate(RULES) if n in names)


def passes(policy: str, version: int, bits: Column | str = "fail_bits") -> Column:
    """Whether bits have none of the policy's rules; null bits give null. An unknown policy or version is a KeyError."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask_of(*POLICIES[policy, version])).cast("long")) == 0


def compared(book: DataFrame, one: tuple[str, int], other: tuple[str, int]) -> DataFrame:
    """(kept_by_one, kept_by_other, n): how many rows of a ledger two policies keep; no row of an empty ledger."""
    return book.groupBy(passes(*one).alias("kept_by_one"), passes(*other).alias("kept_by_other")).agg(F.count("*").alias("n"))


def ablation(book: DataFrame, policy: str, version: int) -> DataFrame:
    """For each rule of policy: how many rows fail it, fail it alone, and would be kept without it; an empty ledger gives no rows.
    Repeated rows count as often as they are there. One pass, summed in part first."""
    mask = mask_of(*POLICIES[policy, version])
    bits = F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long"))
    patterns = book.groupBy(bits.alias("bits")).agg(F.count("*").alias("n"))  # at most a row for each combination of rules
    rules = F.explode(F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(n).alias("rule")) for i, (n, _) in enumerate(RULES) if mask >> i & 1])).alias("r")
    one = F.expr("shiftleft(1L, r.bit)")
    has = F.col("bits").bitwiseAND(one) != 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return (
        patterns.select("bits", "n", rules)
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(total(has).alias("failed"), total(F.col("bits") == one).alias("failed_alone"), total((F.col("bits") == 0) | (F.col("bits") == one)).alias("kept_without"))
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = keep(ledger(table(spark, sf_dir, "documents")), scratch(spark, "quality"))
    base = ~passes("base", 1)
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & passes("strict", 1)).alias("kept"), "fail_bits")
