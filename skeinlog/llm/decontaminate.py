"""Benchmark decontamination by a positional inverted index, in DataFrame and SQL functions only.

The index holds postings (token, document, position) of the training texts, of tokens that some test item has, in documents in
which enough of them come in a row to make up a test phrase. It is sharded by document and written to the shared folder.
A test phrase is looked up from its rarest tokens on: the postings of the rarest give candidate starts (position minus the
token's offset in the phrase), those of the next rarest, adjusted by their own offset, are intersected with them, and so on. What
is left holds every token of the phrase at its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skeinlog.llm.common import ascii_lower, drop, scratch, table, text_of

#: What separates words: ASCII other than digits and letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The most test tokens that are compared as a set held by each task; more are joined by a shuffle.
HELD = 20_000


def words_of(text: Column | str) -> Column:
    """The words of a text: A-Z lowered, runs of [a-z0-9] and characters beyond ASCII."""
    return F.filter(F.split(ascii_lower(text_of(text)), BREAK), lambda w: w != "")


def phrases(items: DataFrame, width: int) -> DataFrame:
    """(phrase, tokens, items): the distinct runs of `width` words of the items, or all words of an item that has fewer, but not none."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - width + 1, F.lit(1)))
    runs = w.select("item", F.explode(F.transform(starts, lambda s: F.slice("w", s, F.lit(width)))).alias("tokens"))
    runs = runs.groupBy("tokens").agg(F.collect_set("item").alias("items"))
    return runs.select(F.xxhash64(F.array_join("tokens", " ")).alias("phrase"), "tokens", "items")


def index(spark: SparkSession, docs: DataFrame, tokens: DataFrame, least: int, path: str, key: str = "__row") -> DataFrame:
    """Writes the postings (token, key, pos) of the tokens of table `tokens` (token) in docs (key, __words), positions from 0. Documents
    with fewer than `least` such tokens in a row are left out. The token set is held by tasks up to HELD tokens."""
    known = [r.token for r in tokens.limit(HELD + 1).collect()]
    if len(known) <= HELD:
        is_known = lambda w: w.isin(known)
        marked = docs.withColumn("__at", F.transform("__words", is_known))
        runs = F.array_join(F.transform("__at", lambda b: F.when(b, "1").otherwise("0")), "")
        marked = marked.where(runs.contains("1" * least)) if known else marked.where(F.lit(False))
        rows = marked.select(key, F.posexplode(F.arrays_zip(F.col("__words").alias("w"), F.col("__at").alias("at"))).alias("pos", "x")).where("x.at")
        rows = rows.select(F.col("x.w").alias("token"), key, "pos")
    else:
        rows = docs.select(key, F.posexplode("__words").alias("pos", "token")).join(tokens, "token", "left_semi")
    rows.write.parquet(path)
    return spark.read.parquet(path)


def lookup(spark: SparkSession, postings: DataFrame, wanted: DataFrame, key: str = "__row", first: int = 2) -> DataFrame:
    """(key, phrase, start) of every place in the index at which a phrase of wanted (phrase, tokens) stands.

    Tokens rank by their number of postings. The first `first` lists are joined one by one, each pruning the candidates; the
    others are counted in one pass over the candidates that are left.
    """
    counts = postings.groupBy("token").agg(F.count("*").alias("n"))
    terms = wanted.select("phrase", F.size("tokens").alias("size"), F.posexplode("tokens").alias("offset", "token")).join(counts, "token")
    rank = Window.partitionBy("phrase").orderBy("n", "offset")
    ranked = terms.withColumns({"rank": F.row_number().over(rank), "present": F.count("*").over(Window.partitionBy("phrase"))})
    at = scratch(spark, "terms")
    ranked.where("present = size").drop("present", "n").write.parquet(at)  # a phrase with an unknown token is nowhere
    ranked = spark.read.parquet(at)
    small = ranked.limit(2_000_001).count() <= 2_000_000
    held = lambda df: F.broadcast(df) if small else df
    starts = postings.join(held(ranked.where("rank = 1")), "token").select(key, "phrase", (F.col("pos") - F.col("offset")).alias("start"))
    path = scratch(spark, "starts")
    starts.where("start >= 0").distinct().write.parquet(path)
    starts = spark.read.parquet(path)
    for k in range(2, first + 1):  # phrases of fewer tokens pass
        need = starts.join(held(ranked.where(f"rank = {k}")), "phrase", "left")
        need = need.select(key, "phrase", "start", (F.col("start") + F.col("offset")).alias("pos"), "token")
        kept = need.where("token is not null").join(postings, [key, "pos", "token"], "left_semi").select(key, "phrase", "start")
        starts = kept.unionByName(need.where("token is null").select(key, "phrase", "start"))
        path = scratch(spark, "starts")
        starts.write.parquet(path)
        starts = spark.read.parquet(path)
    rest = starts.join(held(ranked.where(f"rank > {first}")), "phrase").select(key, "phrase", "start", (F.col("start") + F.col("offset")).alias("pos"), "token", "size")
    full = rest.join(postings, [key, "pos", "token"], "left_semi").groupBy(key, "phrase", "start").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    full = full.where(f"n = size - {first}").select(key, "phrase", "start")
    short = starts.join(held(wanted.where(F.size("tokens") <= first).select("phrase")), "phrase", "left_semi")
    return full.unionByName(short.select(key, "phrase", "start"))


def proximity(postings: DataFrame, pairs: DataFrame, within: int, key: str = "__row") -> DataFrame:
    """(key, a, b, gap): for each pair (a, b) of different tokens, the documents in which b stands at most `within` positions after
    a, with the least gap. Positions meet in cells of that length, so a document's lists are never paired as a whole."""
    cell = F.floor(F.col("pos") / within)
    left = postings.join(pairs, F.col("token") == F.col("a")).select(key, "a", "b", F.col("pos").alias("at"), F.explode(F.array(cell, cell + 1)).alias("cell"))
    right = postings.select(key, F.col("token").alias("b"), "pos", cell.alias("cell"))
    met = left.join(right, [key, "b", "cell"]).withColumn("gap", F.col("pos") - F.col("at"))
    return met.where((F.col("gap") > 0) & (F.col("gap") <= within)).groupBy(key, "a", "b").agg(F.min("gap").alias("gap"))


def decontaminate(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """A row for each row of docs: doc_id, n_words, n_hit (words inside an occurrence of a test phrase), item_ids (sorted, of items
    with an occurrence), n_items, contaminated, and __row, a hash of doc_id and text by which the row is known.

    Rows equal in doc_id and text share their findings. A null or empty text has no words and no hit; null test texts and tests
    without words have no phrase; with no tests at all nothing is hit; an empty table gives an empty result. A null doc_id is an
    id like any other. No column but doc_id and text is read.
    """
    row = F.xxhash64("doc_id", text_of("text"))
    base = docs.select("doc_id", row.alias("__row"), words_of("text").alias("__words"))
    at = scratch(spark, "phrases")
    phrases(items, width).write.parquet(at)
    wanted = spark.read.parquet(at)
    least = wanted.agg(F.min(F.size("tokens"))).first()[0] or width
    tokens = wanted.select(F.explode("tokens").alias("token")).distinct()
    at = scratch(spark, "postings")
    postings = index(spark, base, tokens, least, at)
    found = lookup(spark, postings, wanted).distinct()
    hits = found.join(F.broadcast(wanted) if wanted.limit(200_001).count() <= 200_000 else wanted, "phrase")
    place = scratch(spark, "hits")
    hits.select("__row", "start", F.size("tokens").alias("size"), "items").write.parquet(place)
    hits = spark.read.parquet(place)
    drop(spark, at)
    # words inside of the union of [start, start + size): each occurrence adds what lies beyond all that begin before it
    order = Window.partitionBy("__row").orderBy("start", "size")
    reach = F.coalesce(F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    more = F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", reach))
    covered = hits.withColumn("more", more).groupBy("__row").agg(F.sum("more").cast("long").alias("n_hit"))
    which = hits.select("__row", F.explode("items").alias("item")).groupBy("__row").agg(F.sort_array(F.collect_set("item")).alias("item_ids"))
    summed = scratch(spark, "hit-rows")
    covered.join(which, "__row").write.parquet(summed)
    out = base.select("doc_id", "__row", F.size("__words").cast("long").alias("n_words")).join(spark.read.parquet(summed), "__row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "__row", "n_words", n_hit.alias("n_hit"), ids.alias("item_ids"), F.size(ids).cast("long").alias("n_items"), (n_hit > 0).alias("contaminated"))


def uncontaminated(spark: SparkSession, docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """The rows of docs without any hit."""
    hit = decontaminate(spark, docs, items, width).where("contaminated").select("__row").distinct()
    return docs.withColumn("__row", F.xxhash64("doc_id", text_of("text"))).join(hit, "__row", "left_anti").drop("__row")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = decontaminate(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256)
    return got.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")
