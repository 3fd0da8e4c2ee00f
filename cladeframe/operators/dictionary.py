"""Suggestions from a stored dictionary of values.

The dictionary has a row for each field's value and each word of it: `key` is the folded value from that word on, so that
whole prefixes and prefixes of words are both prefixes of keys. Its files are parts of one range sort by key, and the
range of each is kept with them: a prefix reads the files whose range holds it, mostly one, and in them the row groups
whose statistics do. Only where too few values begin so are the values themselves scanned.

Cases: null values are in no dictionary; the empty query begins every key; an empty table gives an empty dictionary; a
value in several fields is told of the first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

LIMIT = 10
#: Greater than any character of a key: ends a range of prefixes.
_LAST = "\U0010ffff"


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(k, field, value, n): rows of each value of each column; k is the column's place."""
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("value")) for k, c in enumerate(columns)])
    return df.select(F.explode(each).alias("x")).select("x.*").where("value is not null").groupBy("k", "field", "value").agg(F.count("*").alias("n"))


def changed_counts(counts: DataFrame, old: DataFrame, new: DataFrame, diff: DataFrame, rid: str, line: str, columns: list[str]) -> DataFrame:
    """value_counts after an update, from the rows that changed alone: those gone or replaced are taken off, those new or
    replacing them added. `diff` is what snapshot_diff gave for old and new."""
    off = old.join(diff.where("op in ('chg', 'gone')").select(F.col("old_id").alias(rid)), rid, "left_semi")
    on = new.join(diff.where("op in ('chg', 'new')").select(F.col("new_id").alias(line)), line, "left_semi")
    less = value_counts(off, columns).withColumn("n", -F.col("n"))
    return counts.unionByName(less).unionByName(value_counts(on, columns)).groupBy("k", "field", "value").agg(F.sum("n").alias("n")).where("n > 0")


def _keys(counts: DataFrame) -> DataFrame:
    folded = T.fold(F.col("value"))
    # From each word on: what is left after so many words. Words are parted by single spaces, as in the ranking.
    words = F.split(folded, " ", -1)
    key = F.array_join(F.slice(words, F.col("at") + 1, F.size(words)), " ")
    return counts.select("k", "field", "value", "n", F.posexplode(words).alias("at", "_w")).select(key.alias("key"), "at", "k", "field", "value", "n")


@dataclass(frozen=True)
class ValueDictionary:
    """Where the files are, and for each its first and last key."""

    path: str
    ranges: tuple[tuple[str, str, str], ...]

    def files(self, prefix: str) -> list[str]:
        return [f for f, low, high in self.ranges if low <= prefix + _LAST and prefix <= high]


_SHAPE = "key string, at int, k int, field string, value string, n long"


def store_dictionary(counts: DataFrame, path: str) -> ValueDictionary:
    """Writes the dictionary of value_counts under path, and opens it."""
    _keys(counts).repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{path}/keys")
    spark = counts.sparkSession
    held = spark.read.schema(_SHAPE).parquet(f"{path}/keys").groupBy(F.input_file_name().alias("file")).agg(F.min("key").alias("low"), F.max("key").alias("high"))
    held.coalesce(1).write.parquet(f"{path}/ranges")
    return open_dictionary(spark, path)


def open_dictionary(spark: SparkSession, path: str) -> ValueDictionary:
    """A stored dictionary; its list of ranges, one row a file, is read here."""
    rows = spark.read.schema("file string, low string, high string").parquet(f"{path}/ranges").collect()
    return ValueDictionary(path, tuple(sorted((r["file"], r["low"], r["high"]) for r in rows)))


def stored_counts(spark: SparkSession, d: ValueDictionary) -> DataFrame:
    """value_counts of what the dictionary was made of."""
    return spark.read.schema(_SHAPE).parquet(f"{d.path}/keys").where("at = 0").select("k", "field", "value", "n")


def starting(spark: SparkSession, d: ValueDictionary, query: str) -> DataFrame:
    """(tier, value, k, field, n): values that begin with the query (tier 0) or hold a word that does (1)."""
    q = T.fold_text(query)
    files = d.files(q)
    held = spark.read.schema(_SHAPE)
    rows = held.parquet(*files) if files else held.parquet(f"{d.path}/keys").limit(0)
    rows = rows.coalesce(1) if len(files) == 1 else rows  # one file is one task: what follows needs no shuffle
    return rows.where(F.col("key").startswith(q)).select(F.when(F.col("at") == 0, 0).otherwise(1).alias("tier"), "value", "k", "field", "n")


def _ranked(found: DataFrame, limit: int) -> DataFrame:
    first = found.groupBy("value").agg(F.min("tier").alias("tier"), F.min_by(F.struct("field", "n"), "k").alias("x"))
    return first.orderBy("tier", F.desc("x.n"), F.length("value"), "value").limit(limit).select("value", "x.field", F.col("x.n").alias("rows"), "tier")


def suggest(spark: SparkSession, d: ValueDictionary, query: str, limit: int = LIMIT) -> DataFrame:
    """(value, field, rows): values that hold the query: those that begin with it, then those with a word that does, then
    others; within each the most frequent, then the shortest. Each value once, with its first field and rows there."""
    best = _ranked(starting(spark, d, query), limit)
    rows = best.collect()  # at most `limit` rows
    if len(rows) >= limit:
        told = [F.struct(F.lit(r["value"]).alias("value"), F.lit(r["field"]).alias("field"), F.lit(r["rows"]).cast("long").alias("rows")) for r in rows]
        return spark.range(1).select(F.inline(F.array(*told)))
    # Too few: values with the query inside a word are looked for as well.
    q = T.fold_text(query)
    folded = T.fold(F.col("value"))
    tier = F.when(folded.startswith(q), 0).when(F.concat(F.lit(" "), folded).contains(" " + q), 1).otherwise(2)
    return _ranked(stored_counts(spark, d).where(folded.contains(q)).withColumn("tier", tier), limit).drop("tier")
