"""Similar texts: multiset Jaccard over tokens through a shared-token join, and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.functions.text import tokens


def _saved(df: DataFrame) -> DataFrame:
    """df as a table in the folder that spark.checkpoint.dir names; a local one where it is unset and the master is local, as in tests.
    It is removed when the driver ends."""
    spark: SparkSession = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skeinlog-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/sim-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Token occurrences of an item up to which they go along with the keys of its join.
SHORT = 64


def similar_pairs(items: DataFrame, key: str, text: str, bar: float, within: str | None = None) -> DataFrame:
    """(a, b, inter, size_a, size_b): pairs a < b whose token multisets have a Jaccard similarity of bar or more;
    with `within`, only pairs that agree in that column.

    Exact for any bar above 0, which is taken as the decimal fraction that it is written as. Only the rarest tokens of an item are
    joined: of s token occurrences, any partner must share one of the first s - ceil(bar * s) + 1 in a common order by rarity, so frequent
    tokens are never keys of a join unless an item has no others. Two items of SHORT occurrences or fewer bring them along and are held
    against each other where they meet, so that only pairs that are similar leave that join; of others, candidates fetch their tokens.
    """
    num, den = Fraction(str(bar)).as_integer_ratio()
    words = items.select(F.col(key).alias("id"), *([within] if within else []), F.explode(tokens(F.lower(F.col(text)))).alias("t"))
    if within:
        words = words.withColumn("t", F.concat_ws("\0", within, "t"))
    bag = words.groupBy("id", "t").agg(F.count("*").alias("n"))
    freq = bag.groupBy("t").agg(F.count("*").alias("df"))
    order = Window.partitionBy("id").orderBy("df", "t")
    bag = bag.join(freq, "t").withColumns({"size": F.sum("n").over(Window.partitionBy("id")), "upto": F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))})
    bag = _saved(bag)
    # the k-th occurrence of a token is an entry of its own, so that the intersection of sets is that of multisets
    entries = F.flatten(F.collect_list(F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda k: F.concat_ws("\0", F.col("t"), k.cast("string")))))
    few = bag.where(F.col("size") <= SHORT).groupBy("id").agg(entries.alias("few"))
    prefix = bag.where(F.col("upto") - F.col("n") < F.col("size") - F.expr(f"(size * {num} + {den - 1}) div {den}") + 1).select("id", "t", "size")
    side = lambda df, name: df.select(F.col("id").alias(name), "t", F.col("size").alias(f"s{name}"), *([F.col("few").alias(f"few_{name}")] if "few" in df.columns else []))
    met = lambda x, y: side(x, "a").join(side(y, "b"), "t").where((F.col("a") < F.col("b")) & (den * F.least("sa", "sb") >= num * F.greatest("sa", "sb")))
    alike = den * F.col("inter") >= num * (F.col("sa") + F.col("sb") - F.col("inter"))
    small, big = prefix.where(F.col("size") <= SHORT), prefix.where(F.col("size") > SHORT)
    held = small.join(few, "id")
    near = met(held, held).withColumn("inter", F.size(F.array_intersect("few_a", "few_b")).cast("long")).where(alike).select("a", "b", "sa", "sb", "inter").distinct()
    cand = met(big, prefix).unionAll(met(small, big)).select("a", "b", "sa", "sb").distinct()
    na, nb = bag.select(F.col("id").alias("a"), "t", F.col("n").alias("na")), bag.select(F.col("id").alias("b"), "t", F.col("n").alias("nb"))
    shared = cand.join(na, "a").join(nb, ["b", "t"]).groupBy("a", "b", "sa", "sb").agg(F.sum(F.least("na", "nb")).alias("inter")).where(alike)
    return near.unionByName(shared).select("a", "b", "inter", F.col("sa").alias("size_a"), F.col("sb").alias("size_b"))


def clusters(pairs: DataFrame, most: int = 60) -> DataFrame:
    """(id, cluster) of the nodes of pairs (a, b), cluster being the least id that can be reached; a pair of a node with itself has one.

    Stars by turns: each node's greater neighbours are hung under the least of its neighbours and itself, then its lesser ones are. What
    hangs below a root gets flatter by a factor each round, so a chain of any order takes a number of rounds like its length's logarithm.
    Least neighbours are aggregated and joined back, so a node with very many links is spread over tasks."""
    named = pairs.where("a is not null and b is not null").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links = _saved(named)
    alone = links.where("hi = lo").select(F.col("hi").alias("id"))
    links, before = links.where("hi <> lo"), None
    for _ in range(most):
        ends = links.select(F.col("hi").alias("n"), F.col("lo").alias("to")).unionAll(links.select("lo", "hi"))
        low = ends.groupBy("n").agg(F.min("to").alias("low")).select("n", F.least("n", "low").alias("low"))
        hung = _saved(ends.where("to > n").join(low, "n").select(F.col("to").alias("hi"), F.col("low").alias("lo")).distinct())
        low = hung.groupBy("hi").agg(F.min("lo").alias("low"))
        up = hung.join(low, "hi").select(F.when(F.col("lo") > F.col("low"), F.col("lo")).otherwise(F.col("hi")).alias("hi"), F.col("low").alias("lo"))
        links = _saved(up.unionAll(low.select("hi", F.col("low").alias("lo"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == before:
            tops = links.select("lo").unionAll(alone.select(F.col("id").alias("lo"))).distinct().join(links.select(F.col("hi").alias("lo")), "lo", "left_anti")
            return links.select(F.col("hi").alias("id"), F.col("lo").alias("cluster")).unionAll(tops.select(F.col("lo").alias("id"), F.col("lo").alias("cluster")))
        before = now
    raise RuntimeError(f"clusters did not settle in {most} rounds")


def duplicate_groups(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(cluster, n): groups of equal texts of two or more, by hash; cluster is the least key."""
    return rows.groupBy(F.sha2(F.encode(text, "UTF-8"), 256).alias("h")).agg(F.min(key).alias("cluster"), F.count("*").alias("n")).where("n > 1").drop("h")


GRAM = 4  # characters by which a piece of a word is looked up


def _longest(words):
    return F.get(F.array_sort(words, lambda x, y: F.length(y) - F.length(x)), 0)


def quoted(docs: DataFrame, quotes: DataFrame, normal=lambda c: c) -> DataFrame:
    """(doc_id, item_id): documents whose text contains a quote as it stands, after `normal` on both; an empty quote is in none.

    The words inside of a quote have white space on both sides, so the longest of them must be a word of the document, and candidates
    come from an equality join on it. A quote of one or two words has none inside; its longest piece is part of a word. Such words are
    found among the distinct words of all texts, by a join on a piece's first GRAM characters (all, if it has fewer) and the grams of
    words, and lead to the documents that have them. White space between words counts as a word for quotes that have nothing else.

    Texts are read once for the words of quotes, once more if some quote has no word inside, and then only those of candidates are
    normalised again: quotes and candidates are kept as tables, so that their sizes are known before the texts are joined."""
    pieces = F.split("quote", r"\s+")
    q = quotes.select("item_id", normal(F.col("text")).alias("quote")).where("quote <> ''")
    inner = F.filter(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0))), lambda w: w != "")
    q = _saved(q.withColumns({"w": _longest(inner), "part": F.coalesce(F.nullif(_longest(pieces), F.lit("")), F.col("quote"))}))
    body = docs.select("doc_id", normal(F.col("text")).alias("body"))
    words, keys = F.split("body", r"\s+"), q.where("w is not null").select("item_id", "w")
    short = q.where("w is null").select("item_id", "part", F.substring("part", 1, GRAM).alias("gram"))
    if short.limit(1).count():
        words = F.concat(words, F.split("body", r"\S+"))
        known = body.select(F.explode(words).alias("w")).where("w <> ''").distinct()
        grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length("w") - i + 1)), lambda n: F.col("w").substr(i, n))))
        parts = known.select("w", F.explode(F.array_distinct(grams)).alias("gram")).join(short, "gram").where(F.col("w").contains(F.col("part")))
        keys = keys.unionByName(_saved(parts.select("item_id", "w")))
    words = body.select("doc_id", F.explode(F.array_distinct(words)).alias("w"))
    found = _saved(words.join(keys, "w").select("doc_id", "item_id").distinct())
    met = found.join(docs.select("doc_id", "text"), "doc_id").join(q.select("item_id", "quote"), "item_id")
    return met.where(normal(F.col("text")).contains(F.col("quote"))).select("doc_id", "item_id")
