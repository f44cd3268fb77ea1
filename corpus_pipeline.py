"""From raw documents to shards of training data. Each stage reads the whole table that the stage before it wrote.

STAGES: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents; the last adds the shard, the slot
in it and what they were worked out from. run() writes every stage but the last to the shared folder and reads it again.

Each stage keeps rows with a null doc_id, source or text, unless it says otherwise, and an empty table gives an empty one. Extra columns
of docs pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinlog.llm.common import table, written
from skeinlog.llm.decontaminate import uncontaminated
from skeinlog.llm.mixing import pareto_mix
from skeinlog.llm.neardup import representatives
from skeinlog.llm.shards import histogram_sort
from skeinlog.llm.toxicity import toxicity


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic (score under 0.5; one of 0.5 goes). A null or empty text is scored as one
    window of padding, a long one by its highest window; repeated rows are scored alike. Without labels of both classes the score is a
    constant, the share of toxic labels (0 without any), so that all rows stay unless it is 0.5 or more."""
    return toxicity(docs, table(spark, sf_dir, "labels"), name="__toxicity").where("__toxicity < 0.5").drop("__toxicity")


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest doc_id, once, also where rows repeat. A document without
    words is linked with nothing and stays."""
    return representatives(docs)


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no run of 10 words of a benchmark item occurs; of an item with fewer words, no occurrence of all of them. A
    document without words stays; repeated rows stay or go together; without a benchmark all stay."""
    return uncontaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be not at all. A document without words is taken as often as all of its
    source are, so not at all where the source gives less than it has; a null source is a source; repeated rows are documents of their
    own; ties in rank are broken by a hash of doc_id and text, then by the row's place."""
    packed = docs.select("doc_id", "text", "source", F.struct("*").alias("__doc"))  # so that no column of docs gives way
    drawn = pareto_mix(packed).where("copies > 0")
    return drawn.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("__doc.*")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with shard (0 to 23) and slot. A null text has 8 bytes; equal texts are neighbours, and equal rows are dealt apart
    where they have to be; a document is never cut, however long."""
    return histogram_sort(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near-duplicates", near_duplicates_out),
    ("decontamination", contaminated_out),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: No stage before the last can be expressed in SQL; tests/llm holds each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
