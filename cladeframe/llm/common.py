"""What several operators share: the word and line rules, and safe column handling."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: space and the five ASCII controls from tab to carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order; empty for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


NO_ID = -(1 << 63)


def whole_row(docs: DataFrame) -> Column:
    """The row as one struct: beside it an operator's own columns clash with none of the table's; "row_.*" unpacks it."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_")


def id_key(doc_id: Column) -> Column:
    """An id as a join key: a null id is a key of its own, below all others."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID))


def text_key(value: Column) -> Column:
    """A string as a join key: null is a key of its own."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


#: A key is hot if it holds this share of the rows to be joined, and no fewer than HOT_ROWS; its rows are dealt SALTS ways.
HOT_SHARE, HOT_ROWS, SALTS = 1e-3, 2_000, 64


def load_of(right: DataFrame) -> tuple[int, int]:
    """The sum and the most of n_: how many rows are to be joined, and how many of them share a key."""
    total, most = right.agg(F.sum("n_"), F.max("n_")).first()
    return total or 0, most or 0


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: Column, how: str = "inner", load: tuple[int, int] | None = None) -> DataFrame:
    """left joined by shuffle with right, whose keys are unique and whose column n_ says how many rows of left hold them.

    Rows of hot keys are dealt SALTS ways by the hash of `by`, and their row of the right side is repeated as often: no
    task gets more than its share of a hot key. The list of hot keys has at most 1 / HOT_SHARE rows, which bounds its
    broadcast. Where no key is hot the join is a plain one. Keys must not be null; `load` is load_of(right), if known.
    """
    total, most = load or load_of(right)
    limit = max(HOT_ROWS, total * HOT_SHARE)
    if most < limit:
        return left.join(right.drop("n_").hint("merge"), keys, how)
    hot = F.broadcast(right.where(F.col("n_") >= limit).select(*keys, F.lit(True).alias("hot_")))
    dealt = F.when(F.col("hot_"), F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.when(F.col("hot_"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    l = left.join(hot, keys, "left").withColumn("salt_", dealt).drop("hot_")
    r = right.drop("n_").join(hot, keys, "left").withColumn("salt_", F.explode(copies)).drop("hot_")
    return l.join(r.hint("merge"), [*keys, "salt_"], how).drop("salt_")


_kept: dict[str, Any] = {}


def kept_in_worker(name: str, build: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: one object, so that workers do not gather every operator's."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = build()
    return _kept[name]
