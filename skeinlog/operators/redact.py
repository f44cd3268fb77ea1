"""Pseudonyms that keep joins: one keyed hash for each kind of name, over several tables, and a check that no name is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\p{L}\p{Nd}_.-]+"


def short_hash(c: Column) -> Column:
    """The first 12 hex digits of the SHA-256, by which a published table names a session."""
    return F.substring(F.sha2(c, 256), 1, 12)


def base_name(c: Column) -> Column:
    """The last part of a path; '' for none."""
    return F.coalesce(F.substring_index(F.regexp_replace(c, r"/+$", ""), "/", -1), F.lit(""))


def pseudonym(c: Column, kind: str, secret: str) -> Column:
    """32 hex digits that depend on the name, its kind and a secret (SHA-256 within SHA-256, as a keyed hash is made); null stays null."""
    inner = F.sha2(F.concat(F.lit(f"{secret}\0in\0{kind}\0"), c.cast("string")), 256)
    return F.substring(F.sha2(F.concat(F.lit(f"{secret}\0out\0"), inner), 256), 1, 32)


def redacted(tables: dict[str, DataFrame], names: dict[str, dict[str, str]], secret: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables with each column of names[table] (column: kind) replaced by pseudonyms, and the manifest (kind, name, pseudonym, rows),
    which stays private. Equal names of a kind have equal pseudonyms in all tables, so joins and groups are those of the names; nulls stay
    null and aren't in the manifest; other columns stay as they are. Columns of one kind are compared as strings."""
    out, seen = {}, None
    for table, df in tables.items():
        here = names.get(table, {})
        out[table] = df.withColumns({c: pseudonym(F.col(c), k, secret) for c, k in here.items()}) if here else df
        for c, k in here.items():
            part = df.where(F.col(c).isNotNull()).groupBy(F.lit(k).alias("kind"), F.col(c).cast("string").alias("name")).agg(F.count("*").alias("rows"))
            seen = part if seen is None else seen.unionByName(part)
    if seen is None:
        raise ValueError("no column is to be replaced")
    kinds = sorted({k for cols in names.values() for k in cols.values()})
    coded = None
    for k in kinds:
        coded = F.when(F.col("kind") == k, pseudonym(F.col("name"), k, secret)) if coded is None else coded.when(F.col("kind") == k, pseudonym(F.col("name"), k, secret))
    manifest = seen.groupBy("kind", "name").agg(F.sum("rows").alias("rows")).select("kind", "name", coded.alias("pseudonym"), "rows")
    return out, manifest


def left_over(tables: dict[str, DataFrame], manifest: DataFrame, least: int = 6) -> DataFrame:
    """(table, column, kind, rows): string columns in which a name still stands, as a value or as a word of a text. Names of fewer than
    `least` characters are looked for as whole values only: as words they would be found everywhere."""
    out = None
    for table, df in tables.items():
        for c in [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]:
            words = df.select(F.monotonically_increasing_id().alias("row"), F.explode(F.array_distinct(F.concat(F.array(F.col(c)), F.filter(F.split(F.col(c), WORD), lambda w: F.length(w) >= least)))).alias("name"))
            hit = words.join(manifest.select("kind", "name"), "name").groupBy("kind").agg(F.count_distinct("row").alias("rows"))
            part = hit.select(F.lit(table).alias("table"), F.lit(c).alias("column"), "kind", "rows")
            out = part if out is None else out.unionByName(part)
    if out is None:
        return manifest.sparkSession.createDataFrame([], "table string, column string, kind string, rows bigint")
    return out
