"""Hashes of trees of files, level by level: a changed file gives other hashes to the folders above it, and to no others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tree_hashes(files: DataFrame, path: str = "path", digest: str = "digest", most: int = 64) -> DataFrame:
    """(path, digest, files) of each file and each folder above one; the root is ''.

    files: relative paths with / between their parts, each once, and the hex digest of what they hold. A folder's digest is the SHA-256 of
    its parts' digests in order, of 256 at most: its entries are dealt by the first byte of their name's SHA-256, and a part is the
    SHA-256 of `name NUL digest NUL` of its entries in the order of their names. So a folder of very many entries meets as parts, not as
    one list of them. An empty table has no root. A path of more than `most` parts, or one that is both a file and a folder, is an error."""
    depth = F.size(F.split("path", "/"))
    deep = F.when(depth > most, F.raise_error(F.concat(F.lit("too deep: "), F.col("path"))).cast("int")).otherwise(depth)
    level = files.select(F.col(path).alias("path"), F.col(digest).alias("digest"), F.lit(1).cast("long").alias("files")).withColumn("depth", deep)
    deepest = level.agg(F.max("depth")).first()[0]
    done = level
    for d in range(deepest or 0, 0, -1):
        here = done.where(F.col("depth") == d)
        name = F.substring_index("path", "/", -1)
        parent = F.when(F.lit(d == 1), F.lit("")).otherwise(F.substring_index("path", "/", d - 1))
        rows = here.select(parent.alias("up"), F.substring(F.sha2(name, 256), 1, 2).alias("part"), name.alias("name"), "digest", "files")
        said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "digest"))), lambda x: F.concat(x["name"], F.lit("\0"), x["digest"], F.lit("\0"))), "")
        parts = rows.groupBy("up", "part").agg(F.sha2(said, 256).alias("digest"), F.sum("files").alias("files"))
        whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "digest"))), lambda x: x["digest"]), "")
        up = parts.groupBy("up").agg(F.sha2(whole, 256).alias("digest"), F.sum("files").alias("files"))
        done = done.unionByName(up.select(F.col("up").alias("path"), "digest", "files", F.lit(d - 1).alias("depth")))
    twice = done.groupBy("path").agg(F.count("*").alias("n"), F.any_value("digest").alias("digest"), F.any_value("files").alias("files"))
    sound = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("twice: "), F.col("path"))).cast("string")).otherwise(F.col("digest"))
    return twice.select("path", sound.alias("digest"), "files")


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state) of two results of tree_hashes: added, removed or changed; a folder is changed if something below it is."""
    b = after.select(F.col("path").alias("p"), F.col("digest").alias("d"))
    j = before.join(b, before["path"] == b["p"], "full").where(~F.col("digest").eqNullSafe(F.col("d")))
    return j.select(F.coalesce("path", "p").alias("path"), F.when(F.col("path").isNull(), "added").when(F.col("p").isNull(), "removed").otherwise("changed").alias("state"))
